"""Mixing sources to target weights as a time-varying curriculum."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustwatch.llm.common import NO_SPACE, whole
from gustwatch.session import materialize

Schedule = tuple[tuple[float, float], ...]


@dataclass(frozen=True)
class Mix:
    """Sources by code point (null last) take ``weights`` and ``schedules`` in turn.

    The mix has ``share`` times all words; no source gives more than ``most``
    times its own. A schedule lists (time, density), times from 0 to 1, linear
    between; only its shape counts.
    """

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most: float = 2.0
    schedules: tuple[Schedule, ...] = (
        ((0.0, 1.0), (1.0, 1.0)),
        ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
        ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
    )
    #: Rows that one task orders: a source is cut into buckets of about so many rows.
    bucket_rows: int = 20_000


MIX = Mix()


def source_targets(sizes: DataFrame, mix: Mix = MIX) -> DataFrame:
    """One row per source of ``sizes`` (source, size): source, source_size, rank, target.

    Resharing the excess by weight until no source is above its bound ends in
    one level: target = least(bound, level * weight). With sources sorted by
    bound over weight, the level is the greatest of what remains for a source
    and those behind it, over their weights. One row per source meets in one
    task, documents never do.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = total.withColumn("rank", F.row_number().over(by_name) - 1)
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    bounded = ranked.withColumn("weight", F.get(weights, F.col("rank") % len(mix.weights))).withColumn(
        "bound", mix.most * F.col("source_size")
    )
    order = Window.orderBy(F.col("bound") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    behind = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = mix.share * F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    levels = bounded.withColumn("at_most", left / F.sum("weight").over(behind))
    level = F.max("at_most").over(everything)
    return levels.withColumn("target", F.least("bound", level * F.col("weight"))).select(
        "source", "source_size", "rank", "target"
    )


def time_of(share: Column, schedule: Schedule) -> Column:
    """The time by which a source has given ``share`` (0 to 1) of its words: its schedule's integral, inverted."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        pieces.append((t0, t1, w0, w1, total))
        total += (t1 - t0) * (w0 + w1) / 2
    found = None
    for t0, t1, w0, w1, start in pieces:
        demand = share * total - start
        bend = (w1 - w0) / (t1 - t0)
        # The stable root of bend / 2 * x^2 + w0 * x = demand.
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * bend * demand, F.lit(0.0)))
        at = F.least(F.lit(t1), t0 + F.when(demand > 0, 2 * demand / (w0 + root)).otherwise(F.lit(0.0)))
        found = at if found is None else F.when(share * total >= start, at).otherwise(found)
    return found


def mix_documents(docs: DataFrame, mix: Mix = MIX) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, positions.

    A source's documents lie on its word axis in the order of a hash of their
    id, again and again; the mix takes the axis up to the target, so taken
    words add up to the whole words of the target and no document gives more
    than ``most`` times its size (the last document of a source may be cut).
    ``positions`` has the time (0 to 1) at which each pass over the document
    begins. Null texts have size 0; a null source is a source; rows with equal
    ids count each. No rows give no rows. A source of any size is cut into
    buckets: sums per bucket give each bucket its place on the axis, and only
    the rows of one bucket are ordered in a task. Texts are not moved.
    """
    sizes = materialize(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(whole(), F.lit(NO_SPACE)).cast("long").alias("size"))
    )
    buckets = max(64, math.ceil(sizes.count() / mix.bucket_rows))
    keyed = sizes.withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy("source", "bucket")
        .agg(F.sum("size").alias("words"))
        .withColumn("start", F.coalesce(F.sum("words").over(so_far), F.lit(0)))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), "start")
    )
    targets = source_targets(sizes, mix)
    placed = starts.join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        keyed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(placed, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("at", F.col("start") + F.col("before"))
        .withColumn("goal", F.floor("target"))
    )
    passes = range(math.ceil(mix.most))
    none = F.lit(0).cast("long")
    taken = sum(
        (F.greatest(none, F.least(F.col("size"), F.col("goal") - F.col("at") - k * F.col("source_size"))) for k in passes),
        none,
    )

    def position(k: int) -> Column:
        share = (F.col("at") + k * F.col("source_size")) / F.col("goal")
        turn = F.col("rank") % len(mix.schedules)
        time = F.lit(None).cast("double")
        for which, schedule in enumerate(mix.schedules):
            time = F.when(turn == which, time_of(share, schedule)).otherwise(time)
        return F.when((F.col("size") > 0) & (share < 1), time)

    return rows.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        taken.alias("taken"),
        F.array_compact(F.array(*[position(k) for k in passes])).alias("positions"),
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """A row per pass over a taken document (doc_id, source, size, taken, pass, position), range-sorted by position."""
    passes = mixed.where(F.col("taken") > 0).select(
        "doc_id", "source", "size", "target", "taken", F.posexplode("positions").alias("pass", "position")
    )
    return passes.orderBy("position", "source", "doc_id", "pass")
