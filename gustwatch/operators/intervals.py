"""Event windows: closed id ranges per asset, and the rows inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustwatch.functions.expressions import text_to_bigint
from gustwatch.operators.ordered import Ordered
from gustwatch.session import fits, materialize, sized
from gustwatch.settings import LIMITS, Limits

_RANGE = ("event_start_id", "event_end_id")


def normalize_events(events: DataFrame) -> DataFrame:
    """Common event schema: ``asset_id``, lower-case label, numeric ids, times; bad values become null."""
    if "asset_id" not in events.columns and "asset" in events.columns:
        events = events.withColumnRenamed("asset", "asset_id")
    numbers = ["asset_id", "event_id", *_RANGE]
    changed = {c: text_to_bigint(c) for c in numbers if c in events.columns}
    changed["event_label"] = F.lower(F.trim("event_label"))
    types = dict(events.dtypes)
    for time in ("event_start", "event_end"):
        if types.get(time) == "string":
            changed[time] = F.try_to_timestamp(time)
    return events.select(*[changed.get(c, F.col(c)).alias(c) for c in events.columns])


def invalid_events(events: DataFrame) -> DataFrame:
    """Normalized events whose asset or bounds are missing or not numeric."""
    return events.filter(" or ".join(f"{c} is null" for c in ("asset_id", *_RANGE)))


def require_valid_events(events: DataFrame) -> DataFrame:
    bad = invalid_events(events).limit(5).collect()
    if bad:
        raise ValueError(f"events with unreadable asset or id bounds, for example {bad}")
    return events


def event_rows(rows: DataFrame, events: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Each row with each event whose window holds it; a row in two windows appears twice."""
    shared = [c for c in events.columns if c in rows.columns and c != "asset_id"]
    if shared:
        raise ValueError(f"columns on both sides: {shared}")
    if fits(events, limits):
        ranged = events.withColumnRenamed("asset_id", "_asset")
        inside = (F.col("asset_id") == F.col("_asset")) & _inside(F.col("id"))
        return rows.join(F.broadcast(ranged), inside).drop("_asset")
    return _ranked_event_rows(rows, events, limits)


def _inside(position: Column) -> Column:
    return position.between(F.col(_RANGE[0]), F.col(_RANGE[1]))


#: Blocks of one level of the index are 2 ** _BITS times as wide as those of the level below.
_BITS = 4


def _levels(events: DataFrame) -> int:
    """Levels that the widest window needs."""
    widest = events.agg(F.max(F.col(_RANGE[1]) - F.col(_RANGE[0]) + 1)).first()[0] or 1
    return max(1, -(-max(1, widest).bit_length() // _BITS))


def window_blocks(events: DataFrame, levels: int) -> DataFrame:
    """``events`` once per aligned block of ids that their window is made of: ``_level`` and ``_block``, disjoint, widest first.

    At each level a window leaves less than one block of the next level over
    on either side, so it has at most ``2 * (2 ** _BITS - 1)`` blocks there,
    however long it is.
    """

    def bounds(level):
        # The blocks of the level that lie in the window: from the first (included) to the last (left out).
        first = -F.shiftright(-F.col(_RANGE[0]), _BITS * level)
        return first, F.shiftright(F.col(_RANGE[1]) + 1, _BITS * level)

    def some(first, end):
        return F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<bigint>"))

    def placed(level):
        return lambda block: F.struct(F.lit(level).alias("_level"), block.alias("_block"))

    parts = []
    for level in range(levels):
        first, end = bounds(level)
        over_first, over_end = bounds(level + 1)
        wide = (over_first < over_end) if level + 1 < levels else F.lit(False)
        edges = F.concat(some(first, F.shiftleft(over_first, _BITS)), some(F.shiftleft(over_end, _BITS), end))
        blocks = F.when(wide, edges).otherwise(some(first, end))
        # A level below the widest one only has what the levels above leave over.
        parts.append(F.transform(blocks, placed(level)))
    return events.filter(F.col(_RANGE[0]) <= F.col(_RANGE[1])).select("*", F.explode(F.concat(*parts)).alias("_b")).select("*", "_b.*").drop("_b")


#: Places of one window that are listed together.
_LISTED = 1 << 16


def _ranked_event_rows(rows: DataFrame, events: DataFrame, limits: Limits) -> DataFrame:
    """Many events: the rows of an asset are numbered by id, so that a window holds the numbers from one to another.

    One ordered pass over ids and bounds counts the rows before and up to each
    window. A window then is as many numbers as it has rows, and each is joined
    to its row: what is moved are rows, windows and hits, however wide windows
    are and however ids are spread. Hot keys of the join are split by adaptive
    execution. It may not broadcast: the planner does not see how far windows
    are multiplied.
    """
    ranged = events.withColumns({c: F.col(c).cast("bigint") for c in _RANGE}).filter(F.col(_RANGE[0]) <= F.col(_RANGE[1]))
    # Written, so that both bounds of a window have the same number.
    numbered = materialize(ranged.withColumn("_window", F.monotonically_increasing_id()))
    known = rows.filter("asset_id is not null and id is not null")

    def points(df, at, kind, window):
        return df.select("asset_id", F.col(at).cast("bigint").alias("_at"), F.lit(kind).alias("_kind"), window.alias("_window"))

    own = F.col("_window")
    places = points(numbered, _RANGE[0], 0, own).unionByName(points(known, "id", 1, F.lit(None).cast("bigint"))).unionByName(points(numbered, _RANGE[1], 2, own))
    counted = Ordered.of(places, ["asset_id"], ["_at", "_kind"], limits).running(_rows=("sum", (F.col("_kind") == 1).cast("bigint")))
    held = counted.result().filter("_kind <> 1").groupBy("_window").agg(F.min("_rows").alias("_before"), F.max("_rows").alias("_upto"))
    spans = numbered.hint("merge").join(held.filter("_before < _upto").hint("merge"), "_window")
    lists = spans.withColumn("_from", F.explode(F.sequence(F.col("_before") + 1, F.col("_upto"), F.lit(_LISTED).cast("bigint"))))
    hits = lists.withColumn("_nth", F.explode(F.sequence("_from", F.least(F.col("_from") + _LISTED - 1, "_upto"))))
    ranked = Ordered.of(known, ["asset_id"], ["id"], limits).running(_nth=("sum", F.lit(1).cast("bigint"))).result()
    found = ranked.hint("merge").join(hits.select("asset_id", "_nth", *[c for c in events.columns if c != "asset_id"]).hint("merge"), ["asset_id", "_nth"])
    return found.select(*rows.columns, *[F.col(c).cast(events.schema[c].dataType).alias(c) for c in events.columns if c != "asset_id"])


def merged_windows(events: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Overlapping windows of an asset united, so that no id lies in two of them."""
    ranges = (
        events.select("asset_id", *_RANGE)
        .filter(F.col(_RANGE[0]) <= F.col(_RANGE[1]))
        .groupBy("asset_id", _RANGE[0])
        .agg(F.max(_RANGE[1]).alias(_RANGE[1]))
    )
    reach = Ordered.of(ranges, ["asset_id"], [_RANGE[0]], limits).running(_reach=("max", F.col(_RANGE[1])))
    opened = reach.lookback(
        1,
        lambda df, window: df.withColumn(
            "_opens", F.coalesce(F.col(_RANGE[0]) > F.lag("_reach").over(window), F.lit(True)).cast("int")
        ),
    )
    return (
        opened.running(_island=("sum", F.col("_opens")))
        .result()
        .groupBy("asset_id", "_island")
        .agg(F.min(_RANGE[0]).alias(_RANGE[0]), F.max(_RANGE[1]).alias(_RANGE[1]))
        .drop("_island")
    )


def add_window_flag(rows: DataFrame, events: DataFrame, name: str, limits: Limits = LIMITS) -> DataFrame:
    """Boolean column ``name``: the row lies in some window of ``events``.

    The windows are united first, so a row meets at most one of them and no
    duplicates have to be removed afterwards.
    """
    windows = sized(merged_windows(events, limits))
    if fits(windows, limits):
        ranged = windows.toDF("_asset", "_first", "_last")
        inside = (F.col("asset_id") == F.col("_asset")) & F.col("id").between(F.col("_first"), F.col("_last"))
        flagged = rows.join(F.broadcast(ranged), inside, "left").withColumn(name, F.col("_asset").isNotNull())
        return flagged.drop("_asset", "_first", "_last")
    return _flag_by_scan(rows, windows, name, limits)


def _flag_by_scan(rows: DataFrame, windows: DataFrame, name: str, limits: Limits) -> DataFrame:
    """Many windows: the latest window opened at or before the row, from one ordered pass."""
    opened = windows.select(
        "asset_id",
        F.col(_RANGE[0]).alias("_at"),
        F.lit(0).alias("_is_row"),
        F.struct(*_RANGE).alias("_window"),
    )
    both = rows.withColumn("_at", F.col("id")).withColumn("_is_row", F.lit(1)).unionByName(
        opened, allowMissingColumns=True
    )
    extra = ["time_stamp"] if "time_stamp" in rows.columns else []
    scanned = Ordered.of(both, ["asset_id"], ["_at", "_is_row", *extra], limits).running(
        _last=("max", F.col("_window"))
    )
    flag = F.coalesce(F.col("id") <= F.col(f"_last.{_RANGE[1]}"), F.lit(False))
    return scanned.result().filter("_is_row = 1").withColumn(name, flag).drop("_at", "_is_row", "_window", "_last")


def rows_in_windows(rows: DataFrame, events: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Rows inside any window, each once."""
    return add_window_flag(rows, events, "_in", limits).filter("_in").drop("_in")


def rows_outside_windows(rows: DataFrame, events: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Rows outside all windows."""
    return add_window_flag(rows, events, "_in", limits).filter("not _in").drop("_in")


def first_downtime(rows: DataFrame, events: DataFrame, downtime=(4,), limits: Limits = LIMITS) -> DataFrame:
    """First time in downtime status inside each event window; events without one are left out."""
    stopped = rows.filter(F.col("status_type_id").isin(*downtime)).select("asset_id", "id", "time_stamp")
    return (
        event_rows(stopped, events.select("asset_id", "event_id", *_RANGE), limits)
        .groupBy("event_id", "asset_id", *_RANGE)
        .agg(F.min("time_stamp").alias("first_downtime"))
    )


def _labelled_pieces(events: DataFrame, limits: Limits) -> DataFrame:
    """Disjoint id ranges of all anomaly and normal windows, with the label and fault that hold in each."""
    wanted = events.select("asset_id", "event_id", "event_label", "event_description", *_RANGE).filter(
        F.col("event_label").isin("anomaly", "normal") & (F.col(_RANGE[0]) <= F.col(_RANGE[1]))
    )
    edges = F.explode(F.array(F.col(_RANGE[0]), F.col(_RANGE[1]) + 1)).alias("id")
    cuts = wanted.select("asset_id", edges).distinct()
    # The next edge is the last one seen from behind.
    ends = Ordered.of(cuts, ["asset_id"], ["-id"], limits).lookback(
        1, lambda df, window: df.withColumn("_end", F.lag("id").over(window) - 1)
    )
    pieces = ends.result().filter("_end is not null")
    anomalous = F.col("event_label") == "anomaly"
    held = event_rows(pieces, wanted, limits)
    return held.groupBy("asset_id", F.col("id").alias("_start"), "_end").agg(
        F.max(anomalous.cast("int")).alias("label"),
        F.coalesce(
            F.max_by(F.coalesce("event_description", F.lit("anomaly")), F.when(anomalous, F.col("event_id"))), F.lit("normal")
        ).alias("fault_type"),
    )


def window_labels(rows: DataFrame, events: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Rows inside windows with ``label`` (1 anomaly, 0 normal only) and ``fault_type``.

    Anomaly beats normal; among anomalies the one with the greatest event id
    names the fault. Both are settled per disjoint range of ids first, so a row
    meets one range at most and the rows need no grouping.
    """
    pieces = sized(_labelled_pieces(events, limits)).withColumnsRenamed({"_start": _RANGE[0], "_end": _RANGE[1]})
    return event_rows(rows, pieces, limits).drop(*_RANGE)
