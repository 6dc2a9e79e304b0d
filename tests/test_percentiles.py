"""Percentiles by bits, and the run bounds of hot keys."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustwatch.operators.ordered import RUN, Ordered
from gustwatch.operators.percentiles import exact_percentiles, from_bits, ordered_bits, percentile_column
from gustwatch.settings import Limits

EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.0, 1.0 + 2**-52, 1.0 - 2**-53, 2.0, 8.0, 1e300, -1e300, 0.1, -0.1, math.inf, -math.inf]


def test_bits_keep_order_and_value(spark):
    pick = random.Random(4)
    values = EDGES + [s * 2.0**e for e in range(-1074, 1024, 37) for s in (1, -1)]
    values += [pick.uniform(-1, 1) * 10.0 ** pick.randint(-300, 300) for _ in range(2000)] + [math.nextafter(2.0**e, 0) for e in range(-1000, 1000, 19)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").withColumn("b", ordered_bits(F.col("v")))
    found = rows.withColumn("back", from_bits(F.col("b"))).collect()
    assert all(r["v"] == r["back"] for r in found)
    pairs = sorted((r["v"], r["b"]) for r in found)
    assert all((v == w) == (b == c) and b <= c for (v, b), (w, c) in zip(pairs, pairs[1:]))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_like_numpy(spark, by):
    pick = random.Random(1)
    rows = [(g, v) for g, n in ((1, 900), (2, 7), (3, 1), (None, 50)) for v in (pick.choice([pick.gauss(0, 5), 1.5, -1e200, 3e-310]) for _ in range(n))]
    df = spark.createDataFrame([*rows, (1, None), (1, math.nan)], "g int, v double").repartition(4)
    percents = [0, 12.5, 50, 95, 99.9, 100]
    found = exact_percentiles(df, "v", percents, by=by, limits=Limits(task_rows=10)).collect()
    assert len(found) == (4 if by else 1)
    for r in found:
        own = [v for g, v in rows if not by or g == r["g"]]
        assert [r[percentile_column(p)] for p in percents] == pytest.approx(np.percentile(own, percents).tolist(), rel=1e-12)


def test_plan_has_neither_the_aggregate_nor_a_sort_of_values(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    plan = exact_percentiles(df, "v", [50], by=["g"], limits=Limits(task_rows=10))._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "rangepartitioning" not in plan.lower()


def test_no_rows(spark):
    assert exact_percentiles(spark.range(0).select(F.col("id").cast("double").alias("v")), "v", [50], limits=Limits(task_rows=10)).first()["p50"] is None


def test_only_hot_keys_are_cut(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), (F.col("id") * 77 % 2003).alias("t"), "id")
    cut = Ordered.of(rows.repartition(5), ["k"], ["t", "id"], Limits(task_rows=200))
    sizes = cut.df.groupBy("k", RUN).count().collect()
    assert all(r[RUN] == 0 for r in sizes if r["k"] > 0)
    hot = [r["count"] for r in sizes if r["k"] == 0]
    assert max(hot) <= 200 and len(hot) >= 10
    plan = cut.df._jdf.queryExecution().toString().lower()
    assert "rangepartitioning" not in plan
    summed = {r["id"]: r["s"] for r in cut.running(s=("sum", F.lit(1))).result().collect()}
    nth = {}
    for r in sorted(rows.collect(), key=lambda r: (r["t"], r["id"])):
        nth[r["k"]] = nth.get(r["k"], 0) + 1
        assert summed[r["id"]] == nth[r["k"]]
