"""Queries: forests, boosted trees, sequence reconstruction, oversampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustwatch.catalogue.base import (
    CUTOFF,
    KINDS,
    SENSORS,
    event_info,
    query,
    r6,
    scores,
    sql_with,
    telemetry,
)
from gustwatch.catalogue.sequences import GAP_MINUTES, LENGTH
from gustwatch.functions.expressions import above, rounded
from gustwatch.operators import (
    autoencoder,
    contributions,
    evaluate,
    forest,
    intervals,
    labels,
    neural_sequence,
    oversample,
    scaling,
    supervised,
    thresholds,
)
from gustwatch.operators.rolling import add_rolling, fill_zero, rolling_names
from gustwatch.session import materialize
from gustwatch.settings import FarmSettings


def _masked(spark, sf_dir):
    return labels.add_fit_mask(telemetry(spark, sf_dir), event_info(spark, sf_dir), FarmSettings(fit_cutoff=CUTOFF))


def _featured(spark, sf_dir):
    """Telemetry with rolling columns of all sensors, nulls filled."""
    rolled = add_rolling(telemetry(spark, sf_dir), SENSORS, KINDS)
    return fill_zero(rolled, rolling_names(SENSORS))


_FEATURES = [*SENSORS, *rolling_names(SENSORS)]
# Every asset has train rows; eligible ones need not exist for each.
def _fit_rows():
    return F.col("train_test") == "train"



@query("iforest_scores")
def iforest_scores(spark, sf_dir):
    """Score, flag and normalized score of every row, from a forest per asset."""
    masked = _masked(spark, sf_dir)
    keep = ["train_test", "status_type_id", "if_fit_eligible", "in_anomaly_window"]
    # Assets without an eligible row have no scores; the train split as a fallback is ``add_fit_mask(..., use_split=True)``.
    scored = forest.isolation_scores(masked, SENSORS, F.col("if_fit_eligible"), keep, strict=False)
    return scaling.minmax(scored, {"if_anomaly_score": "if_anomaly_score_norm"}, F.col("if_fit_eligible"))


@query("iforest_v2_scores")
def iforest_v2_scores(spark, sf_dir):
    """Second forest on the features that separate best, its threshold chosen by the percentile sweep."""
    events = event_info(spark, sf_dir)
    rows = _featured(spark, sf_dir)
    top = evaluate.top_separating(intervals.event_rows(rows, events), _FEATURES, n=50).collect()
    scored = forest.isolation_scores(rows, [r.feature for r in top], _fit_rows(), ["train_test"], strict=False)
    flagged = scored.select("asset_id", "id", "if_anomaly_score")
    for name, label in (("anomalous", "anomaly"), ("normal", "normal")):
        flagged = intervals.add_window_flag(flagged, events.filter(F.col("event_label") == label), name)
    swept = thresholds.sweep_percentiles(scored, flagged.filter("anomalous or normal"), "if_anomaly_score")
    best = thresholds.choose_percentile(swept, 0.10).first()
    flag = above("if_anomaly_score", best["threshold"]).cast("int")
    return scored.select("asset_id", "time_stamp", "id", F.col("if_anomaly_score").alias("if_anomaly_score_v2"), flag.alias("if_anomaly_flag_v2"))


_FIT_SCORES = "fit AS (SELECT asset_id, if_anomaly_score AS s FROM scores WHERE train_test = 'train')"


@query(
    "iforest_offset",
    sql_with(
        "telemetry scores",
        f"""SELECT asset_id, contamination, {r6('p')} AS "offset", {r6('m')} AS mean_score FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY m, contamination) AS nth FROM (
    {' UNION ALL '.join(f"SELECT asset_id, {c}e0 AS contamination, quantile_cont(s, {1 - c}) AS p, avg(s) - quantile_cont(s, {1 - c}) AS m FROM fit GROUP BY 1" for c in (0.01, 0.03, 0.05))}))
WHERE nth = 1""",
        _FIT_SCORES,
    ),
)
def iforest_offset(spark, sf_dir):
    """Choice of contamination and offset on fixed scores."""
    chosen = forest.choose_offsets(scores(spark, sf_dir), "if_anomaly_score", F.col("train_test") == "train")
    return chosen.select("asset_id", "contamination", rounded("offset").alias("offset"), rounded("mean_score").alias("mean_score"))


def _folded(spark, sf_dir, featured=None):
    """Labelled rows with their folds, written once since several models read them."""
    featured = _featured(spark, sf_dir) if featured is None else featured
    labelled = intervals.window_labels(featured, event_info(spark, sf_dir))
    return materialize(supervised.add_time_folds(labelled))


@query("gbt_cross_validation")
def gbt_cross_validation(spark, sf_dir):
    """F1, precision and recall of the event classifier on forward-chained folds."""
    return supervised.cross_validate(_folded(spark, sf_dir), _FEATURES)


def _event_scored(spark, sf_dir):
    """Labelled rows with their folds, and every row with its anomaly probability and flag."""
    featured = materialize(_featured(spark, sf_dir))
    folded = _folded(spark, sf_dir, featured)
    model = supervised.fit_event_model(folded.filter("not holdout"), _FEATURES, weight=supervised.positive_weight(folded))
    threshold = supervised.tuned_threshold(supervised.add_probability(folded, model, _FEATURES))
    scored = supervised.add_probability(featured, model, _FEATURES)
    flag = above("xgb_anomaly_prob", threshold).cast("int")
    return folded, scored.select("asset_id", "time_stamp", "id", "xgb_anomaly_prob", flag.alias("xgb_anomaly_flag"))


@query("gbt_event_prob")
def gbt_event_prob(spark, sf_dir):
    """Anomaly probability and flag of every row, the threshold tuned on the latest labelled rows."""
    return _event_scored(spark, sf_dir)[1]


@query("fault_classifier")
def fault_classifier(spark, sf_dir):
    """Predicted fault type of every anomaly row of the fit split."""
    anomalies = _folded(spark, sf_dir).filter("label = 1 and not holdout")
    model = supervised.fit_fault_model(anomalies, _FEATURES)
    predicted = supervised.add_fault_type(anomalies, model, _FEATURES)
    return predicted.select("asset_id", "id", "fault_type", "fault_prediction")


TARGET = "hours_to_next_operator_warning"


def _horizon_rows(spark, sf_dir):
    """Rows with their horizons, and those to learn from: normal ones before a usable event with a warning to come.

    Events that start with a high value stand for a farm's list of usable ones.
    """
    events = event_info(spark, sf_dir)
    rows = materialize(_featured(spark, sf_dir))
    listed = rows.filter("sensor_0_avg >= 5000").select(F.col("id").alias("event_id"))
    flagged = labels.add_usable_flag(labels.add_event_horizon(rows, events), events.join(listed, "event_id").select("event_id"))
    labelled = materialize(labels.add_downtime_horizon(flagged, events, rows, [4]))
    return labelled, labels.supervised_rows(labelled, TARGET, [0])


# Usable events of the smallest farm, each left out once there.
LOEO_FOLDS = 12


@query("loeo_rmse")
def loeo_rmse(spark, sf_dir):
    """Error on all usable events, each left out of training once, with the other events of its fold."""
    _, learned = _horizon_rows(spark, sf_dir)
    return supervised.leave_event_out(learned, _FEATURES, TARGET, folds=LOEO_FOLDS)


def _horizon_scored(spark, sf_dir):
    """The rows that a horizon model learned from, and every row with predicted hours, tier and urgency."""
    rows, learned = _horizon_rows(spark, sf_dir)
    model = supervised.fit_horizon_model(learned, _FEATURES, TARGET)
    return learned, supervised.horizon_scores(rows, model, _FEATURES, ["asset_id", "time_stamp", "id"])


@query("horizon_scores")
def horizon_scores(spark, sf_dir):
    """Predicted hours, tier and urgency of every row."""
    return _horizon_scored(spark, sf_dir)[1]


@query("feature_importance")
def feature_importance(spark, sf_dir):
    """Split gain and mean absolute contribution per feature of the horizon model."""
    _, learned = _horizon_rows(spark, sf_dir)
    model = supervised.fit_horizon_model(learned, _FEATURES, TARGET)
    gain = supervised.gain_importance(spark, model, _FEATURES)
    return gain.join(contributions.mean_contributions(learned, model), "feature")


# The rows with the highest readings are a class of a few rows, at every size of the table.
_RARE = 7
_POINT = ["sensor_0_avg", "sensor_2_avg"]


def _with_rare(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    top = rows.orderBy(F.desc_nulls_last("sensor_0_avg"), "id").limit(_RARE).select("id").collect()
    return rows.withColumn("label", F.col("id").isin([r["id"] for r in top]).cast("int"))


@query(
    "smote_neighbours",
    sql_with(
        "telemetry",
        f"""SELECT id, neighbour, CAST(rank AS INTEGER) AS rank, {r6('distance')} AS distance FROM (
  SELECT a.id, b.id AS neighbour, d AS distance, row_number() OVER (PARTITION BY a.id ORDER BY d, b.id) AS rank
  FROM rare a JOIN rare b ON a.id <> b.id,
    LATERAL (SELECT (a.sensor_0_avg - b.sensor_0_avg) * (a.sensor_0_avg - b.sensor_0_avg) + (a.sensor_2_avg - b.sensor_2_avg) * (a.sensor_2_avg - b.sensor_2_avg) AS d))
WHERE rank <= 3""",
        f"rare AS (SELECT * FROM telemetry ORDER BY sensor_0_avg DESC NULLS LAST, id LIMIT {_RARE})",
    ),
)
def smote_neighbours(spark, sf_dir):
    """Neighbours within the rare class found in the whole table."""
    rare = _with_rare(spark, sf_dir).filter("label = 1")
    found = oversample.nearest_neighbours(rare, _POINT, k=oversample.NEIGHBOURS)
    return found.select("id", "neighbour", "rank", rounded("distance").alias("distance"))


@query("smote_rows")
def smote_rows(spark, sf_dir):
    """The whole table with synthetic rows of the rare class."""
    return oversample.oversample(_with_rare(spark, sf_dir), "label", _POINT)


def _sequence_model(spark, sf_dir):
    masked = materialize(_masked(spark, sf_dir))
    return masked, neural_sequence.fit_nonlinear_model(masked, SENSORS, LENGTH, GAP_MINUTES, components=3)


@query("sequence_recon_error")
def sequence_recon_error(spark, sf_dir):
    """Reconstruction error of the window ending at each row, and the same between 0 and 1."""
    masked, model = _sequence_model(spark, sf_dir)
    keep = ["asset_id", "time_stamp", "id", "train_test", "if_fit_eligible", *SENSORS]
    scored = autoencoder.reconstruction_errors(masked.select(*keep), model)
    return autoencoder.normalized_errors(scored).drop("errors")


@query("recon_by_feature")
def recon_by_feature(spark, sf_dir):
    masked, model = _sequence_model(spark, sf_dir)
    keep = ["asset_id", "time_stamp", "id", "if_fit_eligible", *SENSORS]
    return autoencoder.error_by_feature(autoencoder.reconstruction_errors(masked.select(*keep), model), SENSORS)
