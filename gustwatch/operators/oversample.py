"""Oversampling of a very small class by interpolating between its neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Only classes with fewer rows than this are oversampled, unless the caller says otherwise.
SMALL_CLASS = 10
NEIGHBOURS = 3


def neighbour_count(rows: int) -> int:
    return max(1, min(NEIGHBOURS, rows - 1))


def nearest_neighbours(
    minority: DataFrame, features: Sequence[str], k: int, small_class: int = SMALL_CLASS
) -> DataFrame:
    """The ``k`` nearest other rows of each row, by squared distance, ties by id.

    Made for a class of fewer than ``small_class`` rows, and refuses a larger
    one: its few rows travel to each row as an array.
    """
    values = F.array(*[F.col(c).cast("double") for c in features])
    own = minority.select("id", values.alias("x"))
    points = own.limit(small_class).collect()
    if len(points) >= small_class:
        raise ValueError(f"not a small class: {small_class} rows or more")
    if not points:
        return own.select("id", F.col("id").alias("neighbour"), "x", F.col("x").alias("y"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
    kind = f"array<struct<neighbour:{own.schema['id'].dataType.simpleString()},y:array<double>>>"
    others = F.array(
        *[F.struct(F.lit(p["id"]).alias("neighbour"), F.array(*map(F.lit, p["x"])).alias("y")) for p in points]
    ).cast(kind)

    def distance(other):
        squares = F.zip_with("x", other["y"], lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0.0), lambda total, d: total + d)

    measured = F.transform(
        F.filter(others, lambda o: o["neighbour"] != F.col("id")),
        lambda o: F.struct(distance(o).alias("distance"), o["neighbour"].alias("neighbour"), o["y"].alias("y")),
    )
    nearest = own.select("id", "x", F.posexplode(F.slice(F.sort_array(measured), 1, k)).alias("_place", "_near"))
    return nearest.select(
        "id", "_near.neighbour", "x", "_near.y", "_near.distance", (F.col("_place") + 1).alias("rank")
    )


def oversample(
    df: DataFrame, label: str, features: Sequence[str], seed: int = 42, small_class: int = SMALL_CLASS
) -> DataFrame:
    """``df`` (id, label, features) with synthetic rows until both classes are equally large.

    Nothing is added unless the smaller class has 2 to ``small_class - 1``
    rows and the larger at least 2. Each synthetic row lies between a row of
    the small class and one of its neighbours, both and the place between
    them taken from hashes; its id is negative.
    """
    rows = df.select("id", label, *features)
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) != 2 or min(counts.values()) < 2 or min(counts.values()) >= small_class:
        return rows
    small = min(counts, key=lambda c: (counts[c], c))
    size, missing = counts[small], max(counts.values()) - counts[small]
    k = neighbour_count(size)
    minority = rows.filter(F.col(label) == small)
    pairs = nearest_neighbours(minority, features, k, small_class)
    # At most (small_class - 1) * NEIGHBOURS rows.
    by_id = Window.orderBy("id")
    numbered = pairs.withColumn("_base", F.dense_rank().over(by_id) - 1).select("_base", "rank", "x", "y")
    drawn = df.sparkSession.range(missing).select(
        (-F.col("id") - 1).alias("id"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("base"), "id"), F.lit(size)).cast("int").alias("_base"),
        (F.pmod(F.xxhash64(F.lit(seed), F.lit("rank"), "id"), F.lit(k)) + 1).cast("int").alias("rank"),
        (F.pmod(F.xxhash64(F.lit(seed), F.lit("place"), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("_place"),
    )
    synthetic = drawn.join(F.broadcast(numbered), ["_base", "rank"]).select(
        "id",
        F.lit(small).alias(label),
        *[(F.col("x")[i] + F.col("_place") * (F.col("y")[i] - F.col("x")[i])).alias(c) for i, c in enumerate(features)],
    )
    return rows.unionByName(synthetic)
