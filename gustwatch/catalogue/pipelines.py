"""Queries: the whole ways from telemetry to features and from scores to alerts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gustwatch.catalogue import models
from gustwatch.catalogue.base import CUTOFF, SENSORS, event_info, query, r6, scores, sql_with, telemetry
from gustwatch.catalogue.decisions import ALERT_CTES, _LS
from gustwatch.catalogue.events import (
    _ANOMALY_STARTS,
    _NEXT_ANOMALY,
    _NEXT_STOP,
    _STOPS,
    _semi,
)
from gustwatch.catalogue.sequences import GAP_MINUTES, LENGTH
from gustwatch.functions.expressions import rounded
from gustwatch.operators import labels
from gustwatch.plans.alerts import build_alerts
from gustwatch.plans.features import build_feature_table
from gustwatch.plans.scores import (
    FOREST_COLUMNS,
    HORIZON_COLUMNS,
    SEQUENCE_COLUMNS,
    build_forest_scores,
    build_horizon_scores,
    build_sequence_scores,
    require_scores,
)
from gustwatch.session import checkpoint_root, materialize
from gustwatch.settings import FarmSettings
from gustwatch.sources import published

_DESCRIPTIONS = [
    ("sensor_0", "gearbox oil temperature", "C", "false", "false"),
    ("sensor_1", "wind direction", "deg", "true", "false"),
    ("sensor_2", "active power total", "kWh", "false", "true"),
    ("sensor_3", "ambient temperature", "C", "false", "false"),
]

_W = "PARTITION BY asset_id ORDER BY time_stamp, id"
_FEATURE_NAMES = {
    "sensor_0_avg": "sensor_0_avg",
    "sensor_0_avg_roll_mean_6h": f"avg(sensor_0_avg) OVER ({_W} ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)",
    "sensor_0_avg_roll_std_6": f"coalesce(stddev_samp(sensor_0_avg) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 0)",
    "sensor_0_avg_delta": f"coalesce(sensor_0_avg - lag(sensor_0_avg) OVER ({_W}), 0)",
    "sensor_0_avg_deviation": "coalesce(sensor_0_avg - baseline, 0)",
    "gearbox_oil_x_power": "sensor_0_avg * sensor_2_avg",
}
_NORMAL_TRAIN = "train_test = 'train' AND status_type_id = 0"
_DERIVED = f"""derived AS (SELECT asset_id, id, train_test, status_type_id, {', '.join(f'{e} AS {n}' for n, e in _FEATURE_NAMES.items())}
  FROM (SELECT t.*, b.baseline FROM telemetry t LEFT JOIN (SELECT asset_id, avg(sensor_0_avg) AS baseline FROM telemetry WHERE {_NORMAL_TRAIN} GROUP BY 1) b ON t.asset_id = b.asset_id))"""
_STATS = f"stats AS (SELECT {', '.join(f'avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}' for n in _FEATURE_NAMES)} FROM derived WHERE {_NORMAL_TRAIN})"


@query(
    "feature_table",
    sql_with(
        "telemetry event_info",
        f"""SELECT d.id, {', '.join(f'{r6(f"(d.{n} - m_{n}) / s_{n}")} AS {n}' for n in _FEATURE_NAMES)},
  {r6('n.hours')} AS hours_to_next_anomaly, {r6('least(n.hours, s.hours)')} AS hours_to_next_operator_warning,
  n.time_stamp < TIMESTAMP '{CUTOFF}' AND n.status_type_id = 0 AND NOT n.inside AS if_fit_eligible
FROM derived d, stats, next_stop s, (SELECT t.*, {_semi('anomaly')} AS inside FROM next_anomaly t) n WHERE d.id = n.id AND d.id = s.id""",
        _DERIVED,
        _STATS,
        _ANOMALY_STARTS,
        _NEXT_ANOMALY,
        _STOPS,
        _NEXT_STOP,
    ),
)
def feature_table(spark, sf_dir):
    """Telemetry, events and metadata to the labelled, scaled table; a choice of its columns."""
    names = ["sensor_name", "description", "unit", "is_angle", "is_counter"]
    descriptions = spark.createDataFrame(_DESCRIPTIONS, names)
    built = build_feature_table(
        telemetry(spark, sf_dir).drop("k"), event_info(spark, sf_dir), descriptions, FarmSettings(fit_cutoff=CUTOFF)
    )
    hours = ["hours_to_next_anomaly", "hours_to_next_operator_warning"]
    return built.rows.select("id", *[rounded(c).alias(c) for c in [*_FEATURE_NAMES, *hours]], "if_fit_eligible")


@query(
    "alert_chain",
    sql_with(
        _LS,
        f"""SELECT asset_id, id, train_test, CAST(status_type_id AS VARCHAR) AS status_type, {r6('ensemble_score')} AS ensemble_score, alert_triggered,
  CAST(ensemble_score > CASE status_type_id WHEN 0 THEN 0.65e0 WHEN 1 THEN 0.7e0 ELSE 0.9e0 END AS INTEGER) AS alert_contextual, {r6('threshold')} AS threshold_used FROM alerts""",
        *ALERT_CTES,
    ),
)
def alert_chain(spark, sf_dir):
    """Score tables to alerts; the forest's table has every key twice."""
    rows = scores(spark, sf_dir)
    key = ["asset_id", "time_stamp", "id"]
    forest = rows.select(*key, "if_anomaly_score")
    twice = forest.unionByName(forest.withColumn("if_anomaly_score", F.col("if_anomaly_score") / 2))
    built = build_alerts(
        twice,
        rows.select(*key, "train_test", "status_type_id", "xgb_anomaly_prob", "xgb_fault_type"),
        event_info(spark, sf_dir),
        rows.select(*key, "lstm_anomaly_score"),
        rows.select(*key, "ttf_hours"),
    )
    return built.alerts.select(
        "asset_id",
        "id",
        "train_test",
        "status_type",
        rounded("ensemble_score").alias("ensemble_score"),
        "alert_triggered",
        "alert_contextual",
        rounded("threshold_used").alias("threshold_used"),
    )


_ONCE = """SELECT count(*) AS n, count(DISTINCT id) AS n_keys, true AS again_refused, true AS logged, true AS diagnosed FROM telemetry"""


def _published_once(spark, built, columns, diagnostics, rows):
    """The plan's tables published twice as one run and read back: rows, keys, and what the second try changed."""
    root = f"{checkpoint_root(spark)}/published-{uuid.uuid4().hex}"
    first = built.publish(root, "run-1", columns)
    again = built.publish(root, "run-1", columns)
    stored = published.read_published(spark, f"{root}/scores")
    require_scores(stored.drop("run"), rows, columns)
    log = published.read_published(spark, f"{root}/log")
    told = all(published.read_published(spark, f"{root}/{d}").count() > 0 for d in diagnostics)
    children = log.filter("parent is not null and kind = 'metric'").count() > 0
    return stored.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("id").alias("n_keys"),
        F.lit(first and not again).alias("again_refused"),
        F.lit(bool(children)).alias("logged"),
        F.lit(bool(told)).alias("diagnosed"),
    )


@query("forest_scores", sql_with("telemetry", _ONCE))
def forest_scores(spark, sf_dir):
    """The forest's score table with separation and flag rates, published under one run."""
    events = event_info(spark, sf_dir)
    rows = materialize(models._masked(spark, sf_dir))
    built = build_forest_scores(rows, events, SENSORS, strict=False)
    return _published_once(spark, built, FOREST_COLUMNS, ["separation", "flag_rates"], rows)


@query("sequence_scores", sql_with("telemetry", _ONCE))
def sequence_scores(spark, sf_dir):
    """The sequence model's score table with losses per step and errors per feature, published under one run."""
    rows = materialize(models._masked(spark, sf_dir))
    built = build_sequence_scores(rows, SENSORS, LENGTH, GAP_MINUTES, components=3)
    return _published_once(spark, built, SEQUENCE_COLUMNS, ["by_feature", "history"], rows)


@query("horizon_table", sql_with("telemetry", _ONCE))
def horizon_table(spark, sf_dir):
    """The horizon model's score table with errors of events left out and contributions, published under one run."""
    labelled, _ = models._horizon_rows(spark, sf_dir)
    rows = materialize(labels.add_fit_mask(labelled, event_info(spark, sf_dir), FarmSettings(fit_cutoff=CUTOFF)))
    built = build_horizon_scores(rows, models._FEATURES, folds=models.LOEO_FOLDS)
    return _published_once(spark, built, HORIZON_COLUMNS, ["left_out", "contributions"], rows)


@query(
    "published_runs",
    sql_with(
        "telemetry",
        """SELECT run, count(*) AS n, CAST(count(sensor_1_avg) AS BIGINT) AS with_sensor FROM (
  SELECT CASE WHEN train_test = 'train' THEN 'first' ELSE 'second' END AS run, CASE WHEN train_test <> 'train' THEN sensor_1_avg END AS sensor_1_avg
  FROM telemetry) GROUP BY run""",
    ),
)
def published_runs(spark, sf_dir):
    """Two runs, each tried twice, and one that fails its check: every row once, columns united, nothing of the failed one."""
    rows, path = telemetry(spark, sf_dir), f"{checkpoint_root(spark)}/published-{uuid.uuid4().hex}"

    def refuse(written):
        raise ValueError("withheld")

    for _ in range(2):
        published.publish(rows.filter("train_test = 'train'").drop("sensor_1_avg"), path, "first")
        published.publish(rows.filter("train_test <> 'train'"), path, "second")
    try:
        published.publish(rows, path, "third", check=refuse)
    except ValueError:
        pass
    return published.read_published(spark, path).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count("sensor_1_avg").alias("with_sensor"))
