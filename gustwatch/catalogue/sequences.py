"""Queries: gap segments and sliding windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustwatch.catalogue.base import SENSORS, hot_limits, query, r6, sql_with, telemetry
from gustwatch.functions.expressions import rounded
from gustwatch.operators import sequences

# Rows of the test tables are hours apart, so segments may have gaps of up to a day and windows are four rows long.
GAP_MINUTES = 24 * 60
LENGTH = 4
ELIGIBLE = "status_type_id = 0 or status_type_id = 1"

_W = "PARTITION BY asset_id ORDER BY time_stamp, id"


def rows(spark, sf_dir, hot=False):
    return telemetry(spark, sf_dir, hot).withColumn("if_fit_eligible", F.expr(ELIGIBLE))


def _segments(gap_seconds: int | None) -> list[str]:
    opens = "lag(sec) OVER w IS NULL" + (f" OR sec - lag(sec) OVER w > {gap_seconds}" if gap_seconds else "")
    return [
        f"opened AS (SELECT *, {ELIGIBLE} AS if_fit_eligible, CASE WHEN {opens} THEN 1 ELSE 0 END AS o FROM telemetry WINDOW w AS ({_W}))",
        f"numbered AS (SELECT *, CAST(sum(o) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM opened)",
        f"""segments AS (SELECT *, row_number() OVER (PARTITION BY asset_id, segment ORDER BY time_stamp, id) AS segment_row,
    min(CASE WHEN if_fit_eligible THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id, segment ORDER BY time_stamp, id ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) = 1 AS all_eligible
  FROM numbered)""",
    ]


_GAPPED, _UNGAPPED = _segments(GAP_MINUTES * 60), _segments(None)


@query("gap_segments", sql_with("telemetry", "SELECT id, segment, segment_row FROM segments", *_GAPPED))
def gap_segments(spark, sf_dir):
    return sequences.gap_segments(rows(spark, sf_dir), GAP_MINUTES).select("id", "segment", "segment_row")


@query("gap_segments_hot_keys", sql_with("telemetry", "SELECT id, segment, segment_row FROM segments", *_GAPPED, hot=True))
def gap_segments_hot_keys(spark, sf_dir):
    hot = rows(spark, sf_dir, hot=True)
    return sequences.gap_segments(hot, GAP_MINUTES, hot_limits(hot)).select("id", "segment", "segment_row")


_FULL = f"segment_row >= {LENGTH}"


@query("sequence_windows", sql_with("telemetry", f"SELECT id, segment, all_eligible AS trainable FROM segments WHERE {_FULL}", *_GAPPED))
def sequence_windows(spark, sf_dir):
    return sequences.sequence_windows(rows(spark, sf_dir), LENGTH, GAP_MINUTES).select("id", "segment", "trainable")


_VALUES = ", ".join(f"list({c}) OVER p AS l{i}" for i, c in enumerate(SENSORS))
_PLACES = [(n, i) for n in range(LENGTH) for i in range(len(SENSORS))]


@query(
    "sequence_payload",
    sql_with(
        "telemetry",
        f"""SELECT id, {', '.join(f'{r6(f"l{i}[{n + 1}]")} AS step_{n}_{c}' for n, i in _PLACES for c in [SENSORS[i]])} FROM (SELECT *, {_VALUES} FROM segments
  WINDOW p AS (PARTITION BY asset_id, segment ORDER BY time_stamp, id ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW)) WHERE {_FULL}""",
        *_GAPPED,
    ),
)
def sequence_payload(spark, sf_dir):
    """The payload of each window, one column per step and sensor."""
    windows = sequences.sequence_payload(rows(spark, sf_dir), SENSORS, LENGTH, GAP_MINUTES)
    return windows.select(
        "id",
        *[rounded(F.col("payload")[n * len(SENSORS) + i]).alias(f"step_{n}_{SENSORS[i]}") for n, i in _PLACES],
    )


@query(
    "sequence_windows_strided",
    sql_with("telemetry", f"SELECT id, all_eligible AS trainable FROM segments WHERE {_FULL} AND (segment_row - {LENGTH}) % 3 = 0", *_UNGAPPED),
)
def sequence_windows_strided(spark, sf_dir):
    """Every third window, over gaps."""
    return sequences.sequence_windows(rows(spark, sf_dir), LENGTH, None, stride=3).select("id", "trainable")


@query(
    "sequence_window_stats",
    sql_with(
        "telemetry",
        f"""SELECT asset_id, count(*) FILTER ({_FULL}) AS scored, count(*) FILTER ({_FULL} AND all_eligible) AS trainable,
  count(*) FILTER ({_FULL} AND NOT all_eligible) AS skipped_ineligible,
  count(DISTINCT segment) - count(DISTINCT CASE WHEN {_FULL} THEN segment END) AS too_short FROM segments GROUP BY 1""",
        *_GAPPED,
    ),
)
def sequence_window_stats(spark, sf_dir):
    return sequences.window_statistics(rows(spark, sf_dir), LENGTH, GAP_MINUTES)
