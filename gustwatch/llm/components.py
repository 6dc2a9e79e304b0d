"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustwatch.llm.common import Scratch
from gustwatch.session import materialize


#: Edges of one file of a round's tables; at least as many files as the session has cores.
EDGES_PER_FILE = 1_000_000


def _state(stars: DataFrame) -> tuple[int, int]:
    """Number of edges, and of nodes that have several parents or are a parent and a child: without such nodes all is stars."""
    ends = stars.unionByName(stars.select(F.col("m").alias("v"), F.lit(None).cast(stars.schema["m"].dataType).alias("m")))
    per_node = ends.groupBy("v").agg(F.min("m").alias("lo"), F.max("m").alias("hi"), F.count("m").alias("up"), F.count(F.lit(1)).alias("all"))
    unsettled = (F.col("up") > 0) & ((F.col("lo") != F.col("hi")) | (F.col("all") > F.col("up")))
    row = per_node.agg(F.sum("up"), F.count_if(unsettled)).first()
    return row[0] or 0, row[1]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row per node of ``edges``: node, component (the smallest node it is connected with).

    Rounds grow with the logarithm of the largest component. A hub is never
    gathered: its smallest neighbour is a partial aggregate, and handing it to
    the neighbours is a join of two-column rows that adaptive execution can
    split. Each round is written to the checkpoint folder, so that a lost
    executor repeats at most one round; the driver sees two counts. Edges
    never become more, so a round has files by their number, not one per
    shuffle partition. Null ends and loops are no edges; no edges give no rows.
    """
    big, small = F.greatest(a, b).alias("v"), F.least(a, b).alias("m")
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    spark = edges.sparkSession
    now = Scratch(spark)
    stars = now.write(edges.select(big, small).distinct())
    many, unsettled = _state(stars)
    while unsettled:
        files = max(spark.sparkContext.defaultParallelism, ceil(many / EDGES_PER_FILE))
        both = stars.unionByName(stars.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy(F.col("v").alias("u")).agg(F.min("m").alias("least"))
        least = least.select("u", F.least("u", "least").alias("least"))
        large = (
            both.where(F.col("m") > F.col("v"))
            .join(least, F.col("v") == F.col("u"))
            .select(F.col("m").alias("v"), F.col("least").alias("m"))
            .distinct()
        )
        step = Scratch(spark)
        large = step.write(large.coalesce(files))
        down = large.groupBy(F.col("v").alias("u")).agg(F.min("m").alias("least"))
        moved = large.join(down, F.col("v") == F.col("u")).where(F.col("m") != F.col("least"))
        next_stars = down.select(F.col("u").alias("v"), F.col("least").alias("m")).unionByName(
            moved.select(F.col("m").alias("v"), F.col("least").alias("m"))
        )
        then = Scratch(spark)
        stars = then.write(next_stars.distinct().coalesce(files))
        step.drop()
        now.drop()
        now = then
        many, unsettled = _state(stars)
    found = stars.select(F.col("v").alias("node"), F.col("m").alias("component"))
    named = materialize(
        found.unionByName(stars.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
    )
    now.drop()
    return named
