"""Ranks and running sums over one global order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustwatch.session import materialize


def global_running(rows: DataFrame, order: Sequence[Column], **columns: Column) -> DataFrame:
    """``rows`` with a running sum per named column, from the first row by ``order``, which should be unique, to the row itself.

    Rows are range-partitioned by the order; a sum is that within the range
    plus the total of earlier ranges. Only one total per range and column
    passes the driver. Give narrow rows and join what else is needed afterwards.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = rows.withColumns({f"_v_{c}": v for c, v in columns.items()})
    cut = materialize(named.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    totals = cut.groupBy("_range").agg(*[F.coalesce(F.sum(f"_v_{c}"), F.lit(0)).alias(c) for c in columns])
    before, starts = dict.fromkeys(columns, 0), []
    for r in totals.orderBy("_range").collect():
        starts.append((r["_range"], *before.values()))
        before = {c: v + r[c] for c, v in before.items()}
    kinds = {f.name: f.dataType.simpleString() for f in totals.schema.fields}
    schema = ", ".join(["_range int", *[f"_b_{c} {kinds[c]}" for c in columns]])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = cut.join(F.broadcast(spark.createDataFrame(starts, schema)), "_range")
    return joined.select(*rows.columns, *[(F.sum(f"_v_{c}").over(within) + F.col(f"_b_{c}")).alias(c) for c in columns])


def global_ranks(keys: DataFrame, order: Sequence[str], out: str = "nth") -> DataFrame:
    """``keys`` with ``out``, the rank from 0 by ``order``, which should be unique."""
    return global_running(keys, [F.col(c) for c in order], **{out: F.lit(1)}).withColumn(out, F.col(out) - 1)
