"""Queries: next events, event windows and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustwatch.catalogue.base import (
    CUTOFF,
    event_info,
    hot_limits,
    micros,
    query,
    r6,
    scores,
    sql_with,
    telemetry,
)
from gustwatch.functions.expressions import risk_tier, rounded, sooner
from gustwatch.operators import intervals, labels
from gustwatch.operators.asof import NEXT, next_event
from gustwatch.operators.rolling import add_rolling
from gustwatch.settings import FarmSettings, Limits

_HOURS = "(epoch_us({later}) // 1000000 - t.sec) / 3600.0e0"
_TIER = "CASE WHEN {h} IS NULL THEN 0.0e0 WHEN {h} <= 24 THEN 1.0e0 WHEN {h} <= 72 THEN 0.9e0 WHEN {h} <= 168 THEN 0.6e0 WHEN {h} <= 336 THEN 0.3e0 ELSE 0.0e0 END"

_ANOMALY_STARTS = """starts AS (
  SELECT asset_id, event_start AS start_time, min(event_id) AS event_id FROM event_info WHERE event_label = 'anomaly' GROUP BY 1, 2)"""
_NEXT_ANOMALY = f"""next_anomaly AS (
  SELECT t.*, s.event_id AS next_id, s.start_time, {_HOURS.format(later='s.start_time')} AS hours
  FROM telemetry t ASOF LEFT JOIN starts s ON t.asset_id = s.asset_id AND t.time_stamp < s.start_time)"""
_STOPS = """stops AS (
  SELECT asset_id, stop_time, min(event_id) AS event_id FROM (
    SELECT e.asset_id, e.event_id, min(t.time_stamp) AS stop_time
    FROM telemetry t JOIN event_info e ON t.asset_id = e.asset_id AND t.id BETWEEN e.event_start_id AND e.event_end_id
    WHERE t.status_type_id = 4 AND e.event_label = 'anomaly' GROUP BY 1, 2) GROUP BY 1, 2)"""
_NEXT_STOP = f"""next_stop AS (
  SELECT t.id, {_HOURS.format(later='s.stop_time')} AS hours
  FROM telemetry t ASOF LEFT JOIN stops s ON t.asset_id = s.asset_id AND t.time_stamp < s.stop_time)"""


@query(
    "risk_by_tier",
    sql_with(
        "telemetry event_info",
        f"""SELECT {_TIER.format(h='hours')} AS risk_score, count(*) AS n, {r6('avg(mean_1h)')} AS mean_1h
FROM (SELECT *, avg(sensor_0_avg) OVER (PARTITION BY asset_id ORDER BY time_stamp, id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS mean_1h FROM next_anomaly)
GROUP BY 1""",
        _ANOMALY_STARTS,
        _NEXT_ANOMALY,
    ),
)
def risk_by_tier(spark, sf_dir):
    """Rows and mean rolling value per risk tier: the whole way from telemetry to labels."""
    rolled = add_rolling(telemetry(spark, sf_dir), ["sensor_0_avg"])
    labelled = labels.add_event_horizon(rolled, event_info(spark, sf_dir))
    return labelled.groupBy("risk_score").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("sensor_0_avg_roll_mean_1h")).alias("mean_1h")
    )


def _asof_sql(hot):
    return sql_with(
        "telemetry event_info",
        f"SELECT id, next_id AS next_event_id, epoch_us(start_time) AS next_us, {r6('hours')} AS hours FROM next_anomaly",
        _ANOMALY_STARTS,
        _NEXT_ANOMALY,
        hot=hot,
    )


def _show_next(found):
    return found.select(
        "id",
        F.col(f"{NEXT}.event_id").alias("next_event_id"),
        micros(f"{NEXT}.time").alias("next_us"),
        rounded(labels.hours_between(f"{NEXT}.time", "time_stamp")).alias("hours"),
    )


@query("next_event_asof", _asof_sql(hot=False))
def next_event_asof(spark, sf_dir):
    anomalies = event_info(spark, sf_dir).filter("event_label = 'anomaly'")
    return _show_next(next_event(telemetry(spark, sf_dir), anomalies))


@query("next_event_asof_hot_keys", _asof_sql(hot=True))
def next_event_asof_hot_keys(spark, sf_dir):
    """The same without broadcast, where one asset has a third of all rows and events."""
    rows = telemetry(spark, sf_dir, hot=True)
    anomalies = event_info(spark, sf_dir, hot=True).filter("event_label = 'anomaly'")
    return _show_next(next_event(rows, anomalies, limits=hot_limits(rows)))


@query(
    "first_downtime_per_event",
    sql_with(
        "telemetry event_info",
        """SELECT e.event_id, e.asset_id, epoch_us(min(t.time_stamp)) AS first_us
FROM telemetry t JOIN event_info e ON t.asset_id = e.asset_id AND t.id BETWEEN e.event_start_id AND e.event_end_id
WHERE t.status_type_id = 4 GROUP BY 1, 2""",
    ),
)
def first_downtime_per_event(spark, sf_dir):
    stops = intervals.first_downtime(telemetry(spark, sf_dir), event_info(spark, sf_dir))
    return stops.select("event_id", "asset_id", micros("first_downtime").alias("first_us"))


@query(
    "next_downtime_asof",
    sql_with("telemetry event_info", f"SELECT id, {r6('hours')} AS hours FROM next_stop", _STOPS, _NEXT_STOP),
)
def next_downtime_asof(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    stops = intervals.first_downtime(rows, event_info(spark, sf_dir).filter("event_label = 'anomaly'"))
    found = next_event(rows, stops, event_time="first_downtime")
    return found.select("id", rounded(labels.hours_between(f"{NEXT}.time", "time_stamp")).alias("hours"))


_MEMBER = "t.asset_id = e.asset_id AND t.id BETWEEN e.event_start_id AND e.event_end_id"


def _semi(label: str | None, negate: bool = False) -> str:
    restrict = f" AND e.event_label = '{label}'" if label else ""
    return f"{'NOT ' if negate else ''}EXISTS (SELECT 1 FROM event_info e WHERE {_MEMBER}{restrict})"


@query("event_window_rows", sql_with("telemetry event_info", f"SELECT t.id, t.asset_id FROM telemetry t WHERE {_semi(None)}"))
def event_window_rows(spark, sf_dir):
    return intervals.rows_in_windows(telemetry(spark, sf_dir), event_info(spark, sf_dir)).select("id", "asset_id")


@query(
    "in_event_window",
    sql_with("telemetry event_info", f"SELECT DISTINCT t.asset_id, t.id FROM telemetry t JOIN event_info e ON {_MEMBER} WHERE e.event_label = 'anomaly'"),
)
def in_event_window(spark, sf_dir):
    """Inner join and removal of copies, without broadcast: by id buckets."""
    anomalies = event_info(spark, sf_dir).filter("event_label = 'anomaly'")
    pairs = intervals.event_rows(telemetry(spark, sf_dir), anomalies, Limits(broadcast_rows=0))
    return pairs.select("asset_id", "id").dropDuplicates()


@query(
    "train_excluding_windows",
    sql_with("telemetry event_info", f"SELECT t.id FROM telemetry t WHERE t.train_test = 'train' AND t.status_type_id = 0 AND {_semi('anomaly', True)}"),
)
def train_excluding_windows(spark, sf_dir):
    rows = telemetry(spark, sf_dir).filter("train_test = 'train' and status_type_id = 0")
    anomalies = event_info(spark, sf_dir).filter("event_label = 'anomaly'")
    return intervals.rows_outside_windows(rows, anomalies).select("id")


def _flag_sql(hot):
    return sql_with("telemetry event_info", f"SELECT t.id, {_semi('anomaly')} AS in_anomaly_window FROM telemetry t", hot=hot)


@query("anomaly_window_flag", _flag_sql(hot=False))
def anomaly_window_flag(spark, sf_dir):
    anomalies = event_info(spark, sf_dir).filter("event_label = 'anomaly'")
    return intervals.add_window_flag(telemetry(spark, sf_dir), anomalies, "in_anomaly_window").select("id", "in_anomaly_window")


@query("anomaly_window_flag_hot_keys", _flag_sql(hot=True))
def anomaly_window_flag_hot_keys(spark, sf_dir):
    """The same by one ordered pass over rows and united windows, where one asset has a third of both."""
    rows = telemetry(spark, sf_dir, hot=True)
    anomalies = event_info(spark, sf_dir, hot=True).filter("event_label = 'anomaly'")
    return intervals.add_window_flag(rows, anomalies, "in_anomaly_window", hot_limits(rows)).select("id", "in_anomaly_window")


@query(
    "event_eval_rows",
    sql_with("telemetry event_info", f"SELECT t.id, e.event_id, e.event_label FROM telemetry t JOIN event_info e ON {_MEMBER}"),
)
def event_eval_rows(spark, sf_dir):
    return intervals.event_rows(telemetry(spark, sf_dir), event_info(spark, sf_dir)).select("id", "event_id", "event_label")


@query("row_labels", sql_with("telemetry event_info labelled", "SELECT asset_id, id, label, fault_type FROM labelled"))
def row_labels(spark, sf_dir):
    labelled = intervals.window_labels(telemetry(spark, sf_dir), event_info(spark, sf_dir))
    return labelled.select("asset_id", "id", "label", "fault_type")


@query(
    "risk_tier",
    sql_with(
        "telemetry event_info",
        f"SELECT id, {_TIER.format(h='hours')} AS risk_score, {r6('hours')} AS hours_to_next_anomaly, next_id AS next_anomaly_event_id FROM next_anomaly",
        _ANOMALY_STARTS,
        _NEXT_ANOMALY,
    ),
)
def risk_tier_query(spark, sf_dir):
    labelled = labels.add_event_horizon(telemetry(spark, sf_dir), event_info(spark, sf_dir))
    return labelled.select(
        "id", "risk_score", rounded("hours_to_next_anomaly").alias("hours_to_next_anomaly"), "next_anomaly_event_id"
    )


# Events that start with a high value stand for a farm's list of usable ones.
_USABLE = "SELECT e.event_id FROM event_info e JOIN telemetry t ON e.event_id = t.id WHERE t.sensor_0_avg >= 5000"


def _with_usable(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    listed = rows.filter("sensor_0_avg >= 5000").select(F.col("id").alias("event_id"))
    usable = event_info(spark, sf_dir).join(listed, "event_id").select("event_id")
    return labels.add_usable_flag(labels.add_event_horizon(rows, event_info(spark, sf_dir)), usable)


@query(
    "usable_flag",
    sql_with(
        "telemetry event_info",
        f"SELECT id, CASE WHEN next_id IS NOT NULL THEN next_id IN ({_USABLE}) END AS usable FROM next_anomaly",
        _ANOMALY_STARTS,
        _NEXT_ANOMALY,
    ),
)
def usable_flag(spark, sf_dir):
    return _with_usable(spark, sf_dir).select("id", F.col(labels.USABLE).alias("usable"))


@query(
    "supervised_rows",
    sql_with(
        "telemetry event_info",
        f"SELECT id, next_id AS next_anomaly_event_id, {r6('hours')} AS hours_to_next_anomaly FROM next_anomaly WHERE hours IS NOT NULL AND next_id IN ({_USABLE}) AND status_type_id IN (0)",
        _ANOMALY_STARTS,
        _NEXT_ANOMALY,
    ),
)
def supervised_rows(spark, sf_dir):
    kept = labels.supervised_rows(_with_usable(spark, sf_dir), "hours_to_next_anomaly", [0])
    return kept.select("id", "next_anomaly_event_id", rounded("hours_to_next_anomaly").alias("hours_to_next_anomaly"))


@query(
    "operator_warning",
    sql_with(
        "telemetry event_info",
        f"""SELECT id, {r6('least(a, d)')} AS hours_to_next_operator_warning, {_TIER.format(h='least(a, d)')} AS risk_score_operator_warning,
  {_TIER.format(h='d')} AS risk_score_anomaly_linked_downtime
FROM (SELECT n.id, n.hours AS a, s.hours AS d FROM next_anomaly n JOIN next_stop s ON n.id = s.id)""",
        _ANOMALY_STARTS,
        _NEXT_ANOMALY,
        _STOPS,
        _NEXT_STOP,
    ),
)
def operator_warning(spark, sf_dir):
    rows, events = telemetry(spark, sf_dir), event_info(spark, sf_dir)
    warned = labels.add_downtime_horizon(labels.add_event_horizon(rows, events), events, rows, [4])
    return warned.select(
        "id",
        rounded("hours_to_next_operator_warning").alias("hours_to_next_operator_warning"),
        "risk_score_operator_warning",
        "risk_score_anomaly_linked_downtime",
    )


@query(
    "fit_eligible",
    sql_with(
        "telemetry event_info",
        f"SELECT t.id, t.time_stamp < TIMESTAMP '{CUTOFF}' AND {_semi('anomaly', True)} AND t.status_type_id IN (0) AS if_fit_eligible FROM telemetry t",
    ),
)
def fit_eligible(spark, sf_dir):
    masked = labels.add_fit_mask(telemetry(spark, sf_dir), event_info(spark, sf_dir), FarmSettings(fit_cutoff=CUTOFF))
    return masked.select("id", "if_fit_eligible")


@query(
    "prediction_tiers",
    sql_with("telemetry scores", f"SELECT id, {_TIER.format(h='ttf_hours')} AS tier, least(ttf_hours, 24.0e0) AS nearest FROM scores"),
)
def prediction_tiers(spark, sf_dir):
    """Tier of predicted hours, and the sooner of two horizons of which one may be missing."""
    rows = scores(spark, sf_dir)
    return rows.select("id", risk_tier("ttf_hours").alias("tier"), sooner("ttf_hours", F.lit(24.0)).alias("nearest"))


_MIXED = "CAST(pow(10, event_id % 7) AS BIGINT)"


@query(
    "event_rows_mixed_widths",
    sql_with(
        "telemetry event_info",
        f"""SELECT e.event_id, count(*) AS n, min(t.id) AS first_id, max(t.id) AS last_id FROM telemetry t
JOIN (SELECT asset_id, event_id, event_start_id, event_start_id + {_MIXED} - 1 AS event_end_id FROM event_info) e
ON t.asset_id = e.asset_id AND t.id BETWEEN e.event_start_id AND e.event_end_id GROUP BY e.event_id""",
    ),
)
def event_rows_mixed_widths(spark, sf_dir):
    """Rows of windows that are 1 to a million ids wide, through the index by levels."""
    width = F.pow(F.lit(10), F.col("event_id") % 7).cast("bigint")
    events = event_info(spark, sf_dir).select("asset_id", "event_id", "event_start_id", (F.col("event_start_id") + width - 1).alias("event_end_id"))
    held = intervals.event_rows(telemetry(spark, sf_dir), events, Limits(broadcast_rows=0))
    return held.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
