"""Queries: normalization, thresholds, ensemble and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustwatch.catalogue.base import (
    event_info,
    hot_limits,
    micros,
    query,
    r6,
    scores,
    sql_with,
    table,
    telemetry,
)
from gustwatch.functions.expressions import (
    probability_tier,

    rounded,
    status_threshold,
)
from gustwatch.operators import ensemble, intervals, scaling, thresholds
from gustwatch.operators.percentiles import exact_percentiles, percentile_column
from gustwatch.operators.supervised import add_time_folds
from gustwatch.session import materialize, sized
from gustwatch.settings import SWEEP_PERCENTILES

_SCORES = ["if_anomaly_score", "lstm_anomaly_score", "xgb_anomaly_prob"]
_NORMS = [f"{s}_norm" for s in _SCORES]


def _labelled_scores(spark, sf_dir):
    """Scores of rows inside windows with label and fault type."""
    return intervals.window_labels(
        scores(spark, sf_dir).drop("xgb_fault_type"), event_info(spark, sf_dir)
    )


_LABELLED_SCORES = "labelled_scores AS (SELECT s.*, l.label, l.fault_type FROM scores s JOIN labelled l ON s.id = l.id)"
_LS = "telemetry event_info scores labelled"


@query(
    "score_dedupe",
    sql_with(
        "telemetry scores",
        f"""SELECT asset_id, id, {r6('max(s)')} AS if_anomaly_score, {r6('max(p)')} AS xgb_anomaly_prob
FROM (SELECT asset_id, id, if_anomaly_score AS s, xgb_anomaly_prob AS p FROM scores
  UNION ALL SELECT asset_id, id, 1 - if_anomaly_score, xgb_anomaly_prob / 2 FROM scores) GROUP BY 1, 2""",
    ),
)
def score_dedupe(spark, sf_dir):
    """Every key twice, with other scores the second time."""
    once = scores(spark, sf_dir).select("asset_id", "time_stamp", "id", "if_anomaly_score", "xgb_anomaly_prob")
    again = once.withColumns(
        {"if_anomaly_score": 1 - F.col("if_anomaly_score"), "xgb_anomaly_prob": F.col("xgb_anomaly_prob") / 2}
    )
    kept = ensemble.dedupe_scores(once.unionByName(again), ["if_anomaly_score", "xgb_anomaly_prob"])
    return kept.select("asset_id", "id", *[rounded(c).alias(c) for c in ("if_anomaly_score", "xgb_anomaly_prob")])


@query(
    "score_join",
    sql_with(
        "telemetry scores",
        f"""SELECT s.id, {r6('coalesce(i.if_anomaly_score, 0)')} AS if_anomaly_score, {r6('coalesce(m.lstm_anomaly_score, 0)')} AS lstm_anomaly_score,
  {r6('s.xgb_anomaly_prob')} AS xgb_anomaly_prob, CAST(NULL AS DOUBLE) AS ttf_hours
FROM scores s LEFT JOIN (SELECT * FROM scores WHERE status_type_id <> 1) i ON s.id = i.id AND s.asset_id = i.asset_id
LEFT JOIN (SELECT * FROM scores WHERE train_test = 'train') m ON s.id = m.id AND s.asset_id = m.asset_id""",
    ),
)
def score_join(spark, sf_dir):
    """One score missing for some rows, one for a whole split, one table missing altogether."""
    rows = scores(spark, sf_dir)
    base = rows.select("asset_id", "time_stamp", "id", "xgb_anomaly_prob")
    others = {
        "if_anomaly_score": rows.filter("status_type_id <> 1"),
        "lstm_anomaly_score": rows.filter("train_test = 'train'"),
        "ttf_hours": None,
    }
    joined = ensemble.join_scores(base, others, fill=_SCORES)
    return joined.select("id", *[rounded(c).alias(c) for c in _SCORES], "ttf_hours")


_PCT = "quantile_cont(if_anomaly_score, 0.95)"


@query(
    "percentile_flag",
    sql_with(
        "telemetry scores",
        f"""SELECT s.id, CAST(s.if_anomaly_score > p.p AS INTEGER) AS if_anomaly_flag, {r6('p.p')} AS threshold
FROM scores s JOIN (SELECT asset_id, {_PCT} AS p FROM scores GROUP BY 1) p ON s.asset_id = p.asset_id""",
    ),
)
def percentile_flag(spark, sf_dir):
    """Rows strictly above the 95th percentile of their asset."""
    rows = scores(spark, sf_dir)
    bounds = sized(exact_percentiles(rows, "if_anomaly_score", [95], by=["asset_id"]))
    flagged = rows.join(bounds, "asset_id")
    flag = (F.col("if_anomaly_score") > F.col(percentile_column(95))).cast("int")
    return flagged.select("id", flag.alias("if_anomaly_flag"), rounded(percentile_column(95)).alias("threshold"))


@query(
    "percentiles_hot_keys",
    sql_with(
        "telemetry scores",
        f"SELECT asset_id, {r6('quantile_cont(if_anomaly_score, 0.5)')} AS p50, {r6(_PCT)} AS p95 FROM scores GROUP BY 1",
        hot=True,
    ),
)
def percentiles_hot_keys(spark, sf_dir):
    """Percentiles by rank, where one asset has a third of all rows."""
    rows = telemetry(spark, sf_dir, hot=True).withColumn("s", F.log(F.col("sensor_0_avg") / 100 + 1) / 5)
    found = exact_percentiles(rows, "s", [50, 95], by=["asset_id"], limits=hot_limits(rows))
    return found.select("asset_id", *[rounded(c).alias(c) for c in ("p50", "p95")])


@query(
    "percentiles_global",
    sql_with(
        "telemetry scores",
        "SELECT " + ", ".join(f"{r6(f'quantile_cont(xgb_anomaly_prob, {p / 100})')} AS p{p}" for p in SWEEP_PERCENTILES) + " FROM scores",
    ),
)
def percentiles_global(spark, sf_dir):
    """Percentiles over all rows by rank."""
    rows = scores(spark, sf_dir)
    found = exact_percentiles(rows, "xgb_anomaly_prob", SWEEP_PERCENTILES, limits=hot_limits(rows))
    return found.select(*[rounded(c).alias(c) for c in found.columns])


def _range_sql(mask: str, columns, clip: bool) -> str:
    def scaled(c):
        value = f"({c} - lo_{c}) / (hi_{c} - lo_{c})"
        return r6(f"greatest(0, least(1, {value}))" if clip else value)

    ranges = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in columns)
    return f"SELECT id, {', '.join(f'{scaled(c)} AS {c}_norm' for c in columns)} FROM scores, (SELECT {ranges} FROM scores WHERE {mask})"


@query("minmax_masked", sql_with("telemetry scores", _range_sql("status_type_id = 1 AND lstm_anomaly_score < 0.9", _SCORES[:2], clip=True)))
def minmax_masked(spark, sf_dir):
    mask = (F.col("status_type_id") == 1) & (F.col("lstm_anomaly_score") < 0.9)
    normalized = scaling.minmax(scores(spark, sf_dir), {c: f"{c}_norm" for c in _SCORES[:2]}, mask, flat=0.5)
    return normalized.select("id", *[rounded(f"{c}_norm").alias(f"{c}_norm") for c in _SCORES[:2]])


@query("minmax_train", sql_with("telemetry scores", _range_sql("train_test = 'train'", _SCORES, clip=False)))
def minmax_train(spark, sf_dir):
    return _normalized(spark, sf_dir).select("id", *[rounded(c).alias(c) for c in _NORMS])


@query(
    "minmax_inverted",
    sql_with(
        "telemetry scores",
        f"SELECT id, {r6('1 - (ttf_hours - lo) / (hi - lo)')} AS urgency FROM scores, (SELECT min(ttf_hours) AS lo, max(ttf_hours) AS hi FROM scores)",
    ),
)
def minmax_inverted(spark, sf_dir):
    return scaling.minmax_inverted(scores(spark, sf_dir), "ttf_hours", "urgency").select("id", rounded("urgency").alias("urgency"))


_COUNTS = """count(*) FILTER ({s} > t AND label = 1) AS tp, count(*) FILTER ({s} > t AND label = 0) AS fp,
    count(*) FILTER ({s} <= t AND label = 1) AS fn, count(*) FILTER ({s} <= t AND label = 0) AS tn"""
_RATES = """coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS detection_rate, coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0) AS false_alarm_rate,
    coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision"""


@query(
    "confusion_at_threshold",
    sql_with(
        _LS,
        f"""SELECT tp, fp, fn, tn, {r6('detection_rate')} AS detection_rate, {r6('false_alarm_rate')} AS false_alarm_rate, {r6('precision')} AS precision
FROM (SELECT *, {_RATES} FROM (SELECT {_COUNTS.format(s='xgb_anomaly_prob')} FROM labelled_scores, (SELECT 0.5e0 AS t)))""",
        _LABELLED_SCORES,
    ),
)
def confusion_at_threshold(spark, sf_dir):
    counts = thresholds.confusion(_labelled_scores(spark, sf_dir), "xgb_anomaly_prob", "label", 0.5)
    return counts.select("tp", "fp", "fn", "tn", *[rounded(c).alias(c) for c in ("detection_rate", "false_alarm_rate", "precision")])


def _grid_sql(name: str, values) -> str:
    return f"{name} AS (SELECT unnest([{', '.join(repr(v) + 'e0' for v in values)}]) AS t)"


def _sweep_sql(name: str, source: str, score: str, grid: str) -> str:
    f1 = "coalesce(2 * precision * detection_rate / nullif(precision + detection_rate, 0), 0)"
    f05 = "coalesce(1.25 * precision * detection_rate / nullif(0.25 * precision + detection_rate, 0), 0)"
    return f"""{name} AS (SELECT *, {f1} AS f1, {f05} AS f05 FROM (SELECT *, {_RATES} FROM (
  SELECT t, {_COUNTS.format(s=score)} FROM {source}, {grid} GROUP BY t)))"""


_PROB_GRID = _grid_sql("grid", thresholds.probability_grid())
_PROB_SWEEP = _sweep_sql("sweep", "labelled_scores", "xgb_anomaly_prob", "grid")


@query(
    "threshold_sweep_grid",
    sql_with(
        _LS,
        f"""SELECT {r6('t')} AS threshold, tp, fp, fn, tn, {', '.join(f'{r6(c)} AS {c}' for c in ('detection_rate', 'false_alarm_rate', 'precision', 'f1', 'f05'))} FROM sweep""",
        _LABELLED_SCORES,
        _PROB_GRID,
        _PROB_SWEEP,
    ),
)
def threshold_sweep_grid(spark, sf_dir):
    swept = thresholds.sweep_grid(_labelled_scores(spark, sf_dir), "xgb_anomaly_prob", "label", thresholds.probability_grid())
    rates = ("threshold", "detection_rate", "false_alarm_rate", "precision", "f1", "f05")
    return swept.select("tp", "fp", "fn", "tn", *[rounded(c).alias(c) for c in rates])


@query(
    "threshold_choice_grid",
    sql_with(
        _LS,
        f"""SELECT {r6('t')} AS threshold, precision, detection_rate, f05 FROM (
  SELECT t, round(precision, 4) AS precision, round(detection_rate, 4) AS detection_rate, round(f05, 4) AS f05 FROM sweep)
ORDER BY detection_rate >= 0.75 DESC, CASE WHEN detection_rate >= 0.75 THEN precision ELSE f05 END DESC, t LIMIT 1""",
        _LABELLED_SCORES,
        _PROB_GRID,
        _PROB_SWEEP,
    ),
)
def threshold_choice_grid(spark, sf_dir):
    swept = thresholds.sweep_grid(_labelled_scores(spark, sf_dir), "xgb_anomaly_prob", "label", thresholds.probability_grid())
    chosen = thresholds.choose_probability_threshold(swept)
    return chosen.select(rounded("threshold").alias("threshold"), "precision", "detection_rate", "f05")


_WINDOW_MASKS = """masked AS (SELECT s.if_anomaly_score, bool_or(e.event_label = 'anomaly') AS anomalous, bool_or(e.event_label = 'normal') AS normal
  FROM scores s JOIN event_info e ON s.asset_id = e.asset_id AND s.id BETWEEN e.event_start_id AND e.event_end_id GROUP BY s.id, s.if_anomaly_score)"""
_PCT_SWEEP = """swept AS (SELECT *, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS detection_rate, coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0) AS false_alarm_rate FROM (
  SELECT percentile, t AS threshold, count(*) FILTER (if_anomaly_score > t AND anomalous) AS tp, count(*) FILTER (if_anomaly_score > t AND normal) AS fp,
    count(*) FILTER (if_anomaly_score <= t AND anomalous) AS fn, count(*) FILTER (if_anomaly_score <= t AND normal) AS tn
  FROM masked, (SELECT unnest({percents}) AS percentile, unnest({values}) AS t FROM scores) GROUP BY 1, 2))""".format(
    percents=list(SWEEP_PERCENTILES),
    values="[" + ", ".join(f"quantile_cont(if_anomaly_score, {p / 100})" for p in SWEEP_PERCENTILES) + "]",
)


def _percentile_sweep(spark, sf_dir):
    rows, events = scores(spark, sf_dir), event_info(spark, sf_dir)
    flagged = rows.select("asset_id", "id", "if_anomaly_score")
    for name, label in (("anomalous", "anomaly"), ("normal", "normal")):
        flagged = intervals.add_window_flag(flagged, events.filter(F.col("event_label") == label), name)
    return thresholds.sweep_percentiles(rows, flagged.filter("anomalous or normal"), "if_anomaly_score")


@query(
    "threshold_sweep_pct",
    sql_with(
        "telemetry event_info scores",
        f"SELECT percentile, {r6('threshold')} AS threshold, tp, fp, fn, tn, {r6('detection_rate')} AS detection_rate, {r6('false_alarm_rate')} AS false_alarm_rate FROM swept",
        _WINDOW_MASKS,
        _PCT_SWEEP,
    ),
)
def threshold_sweep_pct(spark, sf_dir):
    swept = _percentile_sweep(spark, sf_dir)
    return swept.select("percentile", "tp", "fp", "fn", "tn", *[rounded(c).alias(c) for c in ("threshold", "detection_rate", "false_alarm_rate")])


@query(
    "threshold_choice_pct",
    sql_with(
        "telemetry event_info scores",
        """SELECT 'forest' AS rule, percentile FROM (SELECT * FROM swept ORDER BY false_alarm_rate < 0.10 DESC,
  CASE WHEN false_alarm_rate < 0.10 THEN detection_rate ELSE detection_rate - false_alarm_rate END DESC, percentile LIMIT 1)
UNION ALL SELECT 'sequence', percentile FROM (SELECT * FROM swept ORDER BY false_alarm_rate < 0.15 DESC,
  CASE WHEN false_alarm_rate < 0.15 THEN detection_rate WHEN percentile = 95 THEN 1 ELSE 0 END DESC, percentile LIMIT 1)""",
        _WINDOW_MASKS,
        _PCT_SWEEP,
    ),
)
def threshold_choice_pct(spark, sf_dir):
    swept = _percentile_sweep(spark, sf_dir)
    forest = thresholds.choose_percentile(swept, 0.10).select(F.lit("forest").alias("rule"), "percentile")
    sequence = thresholds.choose_percentile(swept, 0.15, fallback=95).select(F.lit("sequence").alias("rule"), "percentile")
    return forest.unionByName(sequence)


@query(
    "class_weights",
    sql_with(
        "telemetry event_info labelled",
        f"""SELECT n_neg, n_pos, {r6('(n_neg + n_pos) / (2.0e0 * n_neg)')} AS weight_neg, {r6('(n_neg + n_pos) / (2.0e0 * n_pos)')} AS weight_pos,
  {r6('least(n_neg::DOUBLE / n_pos, 6.0e0)')} AS scale_pos_weight, least(n_neg, n_pos) < 10 AS oversample
FROM (SELECT count(*) FILTER (label = 0) AS n_neg, count(*) FILTER (label = 1) AS n_pos FROM labelled)""",
    ),
)
def class_weights(spark, sf_dir):
    labelled = intervals.window_labels(telemetry(spark, sf_dir), event_info(spark, sf_dir))
    weights = thresholds.class_weights(labelled, "label")
    return weights.select("n_neg", "n_pos", "oversample", *[rounded(c).alias(c) for c in ("weight_neg", "weight_pos", "scale_pos_weight")])


_AP = sql_with(
    _LS,
    f"""SELECT CAST(sum(pos) AS BIGINT) AS positives, {r6('sum(pos * tp / flagged) / sum(pos)')} AS average_precision FROM (
  SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS flagged FROM (
    SELECT xgb_anomaly_prob AS s, count(*) FILTER (label = 1) AS pos, count(*) AS n FROM labelled_scores GROUP BY 1)
  WINDOW w AS (ORDER BY s DESC))""",
    _LABELLED_SCORES,
)


@query("average_precision", _AP)
def average_precision(spark, sf_dir):
    """With the scores ranked in runs, as for more of them than one task may sort."""
    labelled = _labelled_scores(spark, sf_dir)
    found = thresholds.average_precision(labelled, "xgb_anomaly_prob", "label")
    return found.select("positives", rounded("average_precision").alias("average_precision"))


_FIXED_PREDICTION = "CASE WHEN xgb_anomaly_prob > 0.6 THEN xgb_fault_type ELSE 'normal' END"


@query(
    "class_report",
    sql_with(
        _LS,
        f"""SELECT class, {r6('p')} AS precision, {r6('r')} AS recall, {r6('coalesce(2 * p * r / nullif(p + r, 0), 0)')} AS f1, support
FROM (SELECT class, coalesce(hits / nullif(flagged, 0)::DOUBLE, 0) AS p, coalesce(hits / nullif(support, 0)::DOUBLE, 0) AS r, support FROM (
  SELECT class, count(*) FILTER (side = 'l') AS support, count(*) FILTER (side = 'p') AS flagged, count(*) FILTER (side = 'l' AND hit) AS hits
  FROM (SELECT fault_type AS class, 'l' AS side, fault_type = pred AS hit FROM predicted UNION ALL SELECT pred, 'p', fault_type = pred FROM predicted)
  GROUP BY class))""",
        _LABELLED_SCORES,
        f"predicted AS (SELECT fault_type, {_FIXED_PREDICTION} AS pred FROM labelled_scores)",
    ),
)
def class_report(spark, sf_dir):
    labelled = intervals.window_labels(scores(spark, sf_dir), event_info(spark, sf_dir))
    predicted = labelled.withColumn(
        "pred", F.when(F.col("xgb_anomaly_prob") > 0.6, F.col("xgb_fault_type")).otherwise("normal")
    )
    report = thresholds.class_report(predicted, "fault_type", "pred")
    return report.select("class", "support", *[rounded(c).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "prob_tier",
    sql_with(
        "telemetry scores",
        """SELECT id, CASE WHEN xgb_anomaly_prob <= 0.3 THEN 'low' WHEN xgb_anomaly_prob <= 0.6 THEN 'medium'
  WHEN xgb_anomaly_prob <= 0.9 THEN 'high' ELSE 'critical' END AS xgb_risk_tier FROM scores""",
    ),
)
def prob_tier(spark, sf_dir):
    return scores(spark, sf_dir).select("id", probability_tier("xgb_anomaly_prob").alias("xgb_risk_tier"))


@query(
    "fault_assignment",
    sql_with("telemetry scores", "SELECT id, CASE WHEN xgb_anomaly_prob > 0.7 THEN xgb_fault_type ELSE 'normal' END AS xgb_fault_type FROM scores"),
)
def fault_assignment(spark, sf_dir):
    flagged = scores(spark, sf_dir).withColumn("flag", (F.col("xgb_anomaly_prob") > 0.7).cast("int"))
    return flagged.select("id", ensemble.fault_type_of("flag", "xgb_fault_type").alias("xgb_fault_type"))


@query(
    "time_folds",
    sql_with(
        "telemetry",
        """SELECT id, nth, nth >= hold AS holdout, fold FROM (
  SELECT id, nth, hold, splits, CASE WHEN nth < hold AND nth >= hold - splits * size THEN (nth - (hold - splits * size)) // size END AS fold FROM (
    SELECT *, least(5, greatest(2, hold // 200)) AS splits, hold // (least(5, greatest(2, hold // 200)) + 1) AS size FROM (
      SELECT id, row_number() OVER (ORDER BY time_stamp, id) - 1 AS nth,
        CASE WHEN greatest(50, CAST(floor(n * 0.8e0) AS BIGINT)) >= n - 20 THEN CAST(floor(n * 0.85e0) AS BIGINT) ELSE greatest(50, CAST(floor(n * 0.8e0) AS BIGINT)) END AS hold
      FROM telemetry, (SELECT count(*) AS n FROM telemetry))))""",
    ),
)
def time_folds(spark, sf_dir):
    """Hold-out of the last fifth and forward-chained folds, with the rank over all rows taken in runs."""
    rows = telemetry(spark, sf_dir)
    return add_time_folds(rows).select("id", "nth", "holdout", "fold")


# -- ensemble ---------------------------------------------------------------


def _normalized(spark, sf_dir):
    train = F.col("train_test") == "train"
    return scaling.minmax(scores(spark, sf_dir), dict(zip(_SCORES, _NORMS)), train, clip=False)


def _validation(spark, sf_dir, rows=None):
    """Train rows inside windows with label ``y_window``."""
    rows = _normalized(spark, sf_dir) if rows is None else rows
    # Only rows of the train split inside windows, read several times.
    inside = intervals.window_labels(rows.filter("train_test = 'train'").drop("xgb_fault_type"), event_info(spark, sf_dir))
    return materialize(inside.select("id", *[c for c in rows.columns if c.endswith("_norm")], F.col("label").alias("y_window")))


_NORMALIZED = "normalized AS (SELECT s.*, {} FROM scores s, (SELECT {} FROM scores WHERE train_test = 'train'))".format(
    ", ".join(f"({c} - lo_{c}) / (hi_{c} - lo_{c}) AS {c}_norm" for c in _SCORES),
    ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in _SCORES),
)
_VALIDATION = "validation AS (SELECT n.*, l.label FROM normalized n JOIN labelled l ON n.id = l.id WHERE n.train_test = 'train')"
_F1_GRID = _grid_sql("grid", thresholds.f1_grid())
_WEIGHT_SWEEPS = [_sweep_sql(f"sweep_{i}", "validation", c, "grid") for i, c in enumerate(_NORMS)]
_WEIGHTS = "weights AS (SELECT score, best_f1, greatest(best_f1, 1e-6) / sum(greatest(best_f1, 1e-6)) OVER () AS weight FROM ({}))".format(
    " UNION ALL ".join(f"SELECT '{c}' AS score, max(f1) AS best_f1 FROM sweep_{i}" for i, c in enumerate(_NORMS))
)
_ENSEMBLE = "ensemble AS (SELECT n.*, ({}) / 3 AS ensemble_simple, {} AS ensemble_score FROM normalized n, (SELECT {} FROM weights))".format(
    " + ".join(_NORMS),
    " + ".join(f"{c} * w{i}" for i, c in enumerate(_NORMS)),
    ", ".join(f"max(weight) FILTER (score = '{c}') AS w{i}" for i, c in enumerate(_NORMS)),
)
_SIMPLE_SWEEP = "simple AS (SELECT e.*, l.label FROM ensemble e JOIN labelled l ON e.id = l.id WHERE e.train_test = 'train')"
_BEST = "best AS (SELECT t AS threshold FROM sweep_simple ORDER BY f1 DESC, t LIMIT 1)"
_ENSEMBLE_CTES = [_NORMALIZED, _VALIDATION, _F1_GRID, *_WEIGHT_SWEEPS, _WEIGHTS, _ENSEMBLE]
_THRESHOLD_CTES = [*_ENSEMBLE_CTES, _SIMPLE_SWEEP, _sweep_sql("sweep_simple", "simple", "ensemble_simple", "grid"), _BEST]
_ALERTS = """alerts AS (SELECT *, CAST(coalesce(sum(CASE WHEN ensemble_score > threshold THEN 1 ELSE 0 END)
    OVER (PARTITION BY asset_id ORDER BY time_stamp, id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0) >= 3 AS INTEGER) AS alert_triggered
  FROM ensemble, best)"""
ALERT_CTES = [*_THRESHOLD_CTES, _ALERTS]


def _weighted(spark, sf_dir):
    """Normalized scores and validation rows, both with equal and weighted mean."""
    rows = _normalized(spark, sf_dir)
    validation = _validation(spark, sf_dir, rows)
    weights = {s: w for s, (_, w) in ensemble.model_weights(validation, _NORMS).items()}
    return ensemble.add_ensemble(rows, weights), ensemble.add_ensemble(validation, weights)


def ensemble_rows(spark, sf_dir):
    return _weighted(spark, sf_dir)[0]


def alert_rows(spark, sf_dir):
    """Ensemble rows with debounced alerts at the tuned threshold."""
    rows, validation = _weighted(spark, sf_dir)
    return ensemble.add_alerts(rows, "ensemble_score", ensemble.ensemble_threshold(validation))


@query(
    "ensemble_weights",
    sql_with(_LS, f"SELECT score, {r6('best_f1')} AS best_f1, {r6('weight')} AS weight FROM weights", *_ENSEMBLE_CTES[:-1]),
)
def ensemble_weights(spark, sf_dir):
    weights = ensemble.model_weights(_validation(spark, sf_dir), _NORMS)
    listed = spark.createDataFrame([(s, f, w) for s, (f, w) in weights.items()], "score string, best_f1 double, weight double")
    return listed.select("score", rounded("best_f1").alias("best_f1"), rounded("weight").alias("weight"))


@query(
    "ensemble_scores",
    sql_with(_LS, f"SELECT id, {r6('ensemble_simple')} AS ensemble_simple, {r6('ensemble_score')} AS ensemble_score FROM ensemble", *_ENSEMBLE_CTES),
)
def ensemble_scores(spark, sf_dir):
    rows = ensemble_rows(spark, sf_dir)
    return rows.select("id", rounded("ensemble_simple").alias("ensemble_simple"), rounded("ensemble_score").alias("ensemble_score"))


@query("score_corr", sql_with(_LS, f"SELECT {r6('corr(ensemble_simple, ensemble_score)')} AS correlation FROM ensemble", *_ENSEMBLE_CTES))
def score_corr(spark, sf_dir):
    return ensemble_rows(spark, sf_dir).agg(rounded(F.corr("ensemble_simple", "ensemble_score")).alias("correlation"))


@query("ensemble_threshold", sql_with(_LS, f"SELECT {r6('threshold')} AS threshold FROM best", *_THRESHOLD_CTES))
def ensemble_threshold(spark, sf_dir):
    _, validation = _weighted(spark, sf_dir)
    swept = thresholds.sweep_grid(validation, "ensemble_simple", "y_window", thresholds.f1_grid())
    return thresholds.best_f1(swept).select(rounded("threshold").alias("threshold"))


@query(
    "alert_debounce",
    sql_with(_LS, f"SELECT id, asset_id, alert_triggered, {r6('threshold')} AS threshold_used FROM alerts", *ALERT_CTES),
)
def alert_debounce(spark, sf_dir):
    return alert_rows(spark, sf_dir).select("id", "asset_id", "alert_triggered", rounded("threshold_used").alias("threshold_used"))


@query(
    "alert_debounce_hot_keys",
    sql_with(
        "telemetry",
        """SELECT id, CAST(sum(CASE WHEN sensor_0_avg > 3000 THEN 1 ELSE 0 END)
  OVER (PARTITION BY asset_id ORDER BY time_stamp, id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 AS INTEGER) AS alert_triggered FROM telemetry""",
        hot=True,
    ),
)
def alert_debounce_hot_keys(spark, sf_dir):
    rows = telemetry(spark, sf_dir, hot=True)
    return ensemble.add_alerts(rows, "sensor_0_avg", 3000.0, hot_limits(rows)).select("id", "alert_triggered")


@query(
    "alert_contextual",
    sql_with(
        _LS,
        """SELECT id, threshold_contextual, CAST(ensemble_score > threshold_contextual AS INTEGER) AS alert_contextual
FROM (SELECT *, CASE status_type_id WHEN 0 THEN 0.65e0 WHEN 1 THEN 0.7e0 WHEN 2 THEN 0.7e0 WHEN 3 THEN 0.85e0 WHEN 4 THEN 0.9e0 WHEN 5 THEN 0.75e0 ELSE 0.65e0 END AS threshold_contextual FROM ensemble)""",
        *_ENSEMBLE_CTES,
    ),
)
def alert_contextual(spark, sf_dir):
    rows = ensemble.add_contextual_alerts(ensemble_rows(spark, sf_dir), "ensemble_score")
    return rows.select("id", "threshold_contextual", "alert_contextual")


@query(
    "status_thresholds",
    """SELECT DISTINCT c_nationkey AS status, CASE c_nationkey WHEN 0 THEN 0.65e0 WHEN 1 THEN 0.7e0 WHEN 2 THEN 0.7e0 WHEN 3 THEN 0.85e0 WHEN 4 THEN 0.9e0 WHEN 5 THEN 0.75e0 ELSE 0.65e0 END AS threshold FROM customer""",
)
def status_thresholds(spark, sf_dir):
    """Known and unknown status codes."""
    codes = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("status")).distinct()
    return codes.select("status", status_threshold("status").alias("threshold"))


@query(
    "alert_summary",
    sql_with(
        _LS,
        f"""SELECT CAST(asset_id AS VARCHAR) || '_' || strftime(time_stamp, '%Y-%m-%d %H:%M:%S') AS alert_id, asset_id, epoch_us(time_stamp) AS alert_us,
  {r6('ensemble_score')} AS ensemble_score, xgb_fault_type, ttf_hours,
  CASE WHEN coalesce(ttf_hours, 999) < 24 THEN 'CRITICAL' WHEN coalesce(ttf_hours, 999) < 72 THEN 'HIGH' ELSE 'MONITOR' END AS urgency
FROM alerts WHERE alert_triggered = 1""",
        *ALERT_CTES,
    ),
)
def alert_summary(spark, sf_dir):
    summary = ensemble.alert_summary(alert_rows(spark, sf_dir))
    # The id holds the whole time; its fraction of a second is left out of the comparison.
    return summary.select(
        F.split_part("alert_id", F.lit("."), F.lit(1)).alias("alert_id"),
        "asset_id",
        micros("alert_time").alias("alert_us"),
        rounded("ensemble_score").alias("ensemble_score"),
        "xgb_fault_type",
        "ttf_hours",
        "urgency",
    )
