"""Next-event lookup: the earliest event of the same asset strictly after a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustwatch.operators.ordered import Ordered
from gustwatch.session import fits, sized
from gustwatch.settings import LIMITS, Limits

NEXT = "_next"


def next_event(
    rows: DataFrame,
    events: DataFrame,
    time: str = "time_stamp",
    event_time: str = "event_start",
    limits: Limits = LIMITS,
) -> DataFrame:
    """Add struct ``_next`` (time, event_id) of the next event, null when there is none.

    Equal event times are won by the smaller event id. ``events`` has
    ``asset_id``, ``event_id`` and ``event_time``.
    """
    starts = events.select("asset_id", F.col(event_time).alias("time"), "event_id").dropna()
    # Counted first and then joined; what they are derived from may be a join of all rows.
    starts = sized(starts.groupBy("asset_id", "time").agg(F.min("event_id").alias("event_id")))
    if fits(starts, limits):
        return _by_validity(rows, starts, time)
    return _by_running_minimum(rows, starts, time, limits)


def _by_validity(rows: DataFrame, starts: DataFrame, time: str) -> DataFrame:
    """Few events: each is valid from the event before it; one match per row, rows are not moved."""
    in_asset = Window.partitionBy("asset_id").orderBy("time")
    valid = starts.select(
        F.col("asset_id").alias("_asset"),
        F.lag("time").over(in_asset).alias("_from"),
        F.struct("time", "event_id").alias(NEXT),
    )
    now = F.col(time)
    match = (
        (F.col("asset_id") == F.col("_asset"))
        & (now < F.col(f"{NEXT}.time"))
        & (F.col("_from").isNull() | (now >= F.col("_from")))
    )
    return rows.join(F.broadcast(valid), match, "left").drop("_asset", "_from")


def _by_running_minimum(rows: DataFrame, starts: DataFrame, time: str, limits: Limits) -> DataFrame:
    """Many events: one pass over rows and events from late to early, keeping the earliest event so far.

    Rows of a time come before events of that time, so an event at the time of
    the row does not count.
    """
    row_side = rows.withColumn("_at", F.col(time)).withColumn("_is_row", F.lit(1))
    event_side = starts.select(
        "asset_id",
        F.col("time").alias("_at"),
        F.lit(0).alias("_is_row"),
        F.struct("time", "event_id").alias("_event"),
    )
    both = row_side.unionByName(event_side, allowMissingColumns=True)
    scanned = Ordered.of(both, ["asset_id"], ["-_at", "-_is_row", "-id"], limits).running(**{NEXT: ("min", F.col("_event"))})
    return scanned.result().filter("_is_row = 1").drop("_at", "_is_row", "_event")
