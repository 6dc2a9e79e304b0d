"""The registry of queries and the stand-in inputs they share.

Telemetry, events and scores are derived from the ``events`` table, with the
same definition on both sides: a DataFrame here, a common table expression for
the SQL check. All work grows with that table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustwatch.session import ship_package, use_utc
from gustwatch.settings import Limits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SENSORS = ["sensor_0_avg", "sensor_1_avg", "sensor_2_avg"]
KINDS = {"sensor_1_avg": "angle", "sensor_2_avg": "counter"}
CUTOFF = "2024-01-15 00:00:00"
SPLIT = "2024-01-21 00:00:00"


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, the SQL to check it against."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(ship_package(spark)).read.parquet(f"{sf_dir}/{name}.parquet")


def hot_limits(rows: DataFrame) -> Limits:
    """Limits far below the third of all rows that the hot asset has, and no broadcast."""
    return Limits(task_rows=max(1, rows.count() // 10), broadcast_rows=0)


def _asset(hot: bool):
    """Asset of an event; ``hot`` gives a third of all rows to one asset."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    return (F.when(k < 33, F.lit(0).cast("bigint")).otherwise(F.col("user_id")) if hot else F.col("user_id")).alias("asset_id")


def telemetry(spark: SparkSession, sf_dir: str, hot: bool = False) -> DataFrame:
    events = table(spark, sf_dir, "events")
    turned = F.col("value") * 37.7
    return events.select(
        _asset(hot),
        F.col("ts").cast("timestamp").alias("time_stamp"),
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", 4).when(F.col("event_type") == "purchase", 1).otherwise(0).alias("status_type_id"),
        F.when(F.col("ts").cast("timestamp") < F.to_timestamp(F.lit(SPLIT)), "train").otherwise("prediction").alias("train_test"),
        F.round(F.col("value") * 100).alias("sensor_0_avg"),
        (turned - 360 * F.floor(turned / 360)).alias("sensor_1_avg"),
        (F.col("event_id") % 997).cast("double").alias("sensor_2_avg"),
        F.lit(1.0).alias("sensor_3_avg"),
        F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"),
    )


def event_info(spark: SparkSession, sf_dir: str, hot: bool = False) -> DataFrame:
    """One window per sign-up, about five rows of the asset long; windows overlap."""
    events = table(spark, sf_dir, "events")
    reach = 5 * (events.agg(F.max("user_id")).first()[0] or 0)
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    start = F.col("ts").cast("timestamp")
    return events.filter("event_type = 'signup'").select(
        _asset(hot),
        "event_id",
        start.alias("event_start"),
        (start + F.expr("interval 2 days")).alias("event_end"),
        F.col("event_id").alias("event_start_id"),
        (F.col("event_id") + F.lit(reach)).alias("event_end_id"),
        F.when(k < 50, "anomaly").otherwise("normal").alias("event_label"),
        F.concat(F.lit("fault_"), F.floor(k / 20).cast("string")).alias("event_description"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    rows = telemetry(spark, sf_dir).withColumn("value", F.col("sensor_0_avg") / 100)
    return rows.select(
        "asset_id",
        "time_stamp",
        "id",
        "train_test",
        "status_type_id",
        (F.log(v + 1) / 5).alias("if_anomaly_score"),
        (F.sqrt(v) / 10).alias("lstm_anomaly_score"),
        (1 - F.exp(-v / 50)).alias("xgb_anomaly_prob"),
        F.concat(F.lit("fault_"), F.floor(F.col("k") / 20).cast("string")).alias("xgb_fault_type"),
        F.when(F.col("k") >= 50, F.col("k") * 1.5).alias("ttf_hours"),
    )


_CTES = {
    "telemetry": f"""telemetry AS (
  SELECT user_id AS asset_id, ts AS time_stamp, event_id AS id,
    CAST(CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 1 ELSE 0 END AS INTEGER) AS status_type_id,
    CASE WHEN ts < TIMESTAMP '{SPLIT}' THEN 'train' ELSE 'prediction' END AS train_test,
    round(value * 100) AS sensor_0_avg,
    value * 37.7e0 - 360 * floor(value * 37.7e0 / 360) AS sensor_1_avg,
    CAST(event_id % 997 AS DOUBLE) AS sensor_2_avg,
    1.0e0 AS sensor_3_avg,
    CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
    CAST(epoch_us(ts) // 1000000 AS BIGINT) AS sec
  FROM events)""",
    "event_info": """event_info AS (
  SELECT user_id AS asset_id, event_id, ts AS event_start, ts + INTERVAL 2 DAY AS event_end,
    event_id AS event_start_id, event_id + 5 * (SELECT max(user_id) FROM events) AS event_end_id,
    CASE WHEN k < 50 THEN 'anomaly' ELSE 'normal' END AS event_label,
    'fault_' || CAST(k // 20 AS VARCHAR) AS event_description
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events WHERE event_type = 'signup'))""",
    "scores": """scores AS (
  SELECT asset_id, time_stamp, id, train_test, status_type_id, sec,
    ln(v + 1) / 5 AS if_anomaly_score, sqrt(v) / 10 AS lstm_anomaly_score,
    1 - exp(-v / 50) AS xgb_anomaly_prob,
    'fault_' || CAST(k // 20 AS VARCHAR) AS xgb_fault_type,
    CASE WHEN k >= 50 THEN k * 1.5e0 END AS ttf_hours
  FROM (SELECT *, sensor_0_avg / 100 AS v FROM telemetry))""",
    # Every row with every window that holds it.
    "tagged": """tagged AS (
  SELECT s.*, e.event_id, e.event_label, e.event_description
  FROM scores s JOIN event_info e ON s.asset_id = e.asset_id AND s.id BETWEEN e.event_start_id AND e.event_end_id)""",
    # Rows in windows: anomaly beats normal, the last anomaly names the fault.
    "labelled": """labelled AS (
  SELECT s.asset_id, s.id,
    CAST(max(CASE WHEN e.event_label = 'anomaly' THEN 1 ELSE 0 END) AS INTEGER) AS label,
    coalesce(arg_max(e.event_description, e.event_id) FILTER (e.event_label = 'anomaly'), 'normal') AS fault_type
  FROM telemetry s JOIN event_info e ON s.asset_id = e.asset_id AND s.id BETWEEN e.event_start_id AND e.event_end_id
  GROUP BY s.asset_id, s.id)""",
}


_HOT_ASSET = "CASE WHEN CAST(regexp_extract(props, '[0-9]+') AS INTEGER) < 33 THEN 0 ELSE user_id END AS asset_id"


def sql_with(names: str, body: str, *more: str, hot: bool = False) -> str:
    """``body`` behind the named shared table expressions and further ones given as text."""
    shared = [_CTES[n] for n in names.split()]
    if hot:
        shared = [text.replace("user_id AS asset_id", _HOT_ASSET) for text in shared]
    return "WITH " + ",\n".join([*shared, *more]) + "\n" + body


def r6(expression: str) -> str:
    """SQL counterpart of ``rounded``."""
    return f"(round({expression}, 6) + 0.0e0)"


def micros(time: str = "time_stamp"):
    return F.unix_micros(F.col(time).cast("timestamp"))
