"""Boosted trees: both ways of adding up, any partitioning, objectives, draws, and Shapley values by brute force."""

import os
import shutil
import tracemalloc
from dataclasses import replace
from itertools import combinations
from math import factorial
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from gustwatch.operators import boosting, contributions
from gustwatch.operators.boosting import BINS, Block, Boosted, Objective, Trees, TreeSettings, fit_boosted, grow_in_block, margins
from gustwatch.operators.ranks import global_ranks, global_running
from gustwatch.settings import LIMITS

FEATURES = ["a", "b", "c"]
SMALL = TreeSettings(rounds=4, depth=3, subsample=0.8, feature_share=0.7, l1=0.1)


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(5)
    a, b, c = draw.normal(size=400), draw.integers(0, 5, 400).astype(float), draw.normal(size=400)
    frame = pd.DataFrame({"id": np.arange(400), "a": a, "b": b, "c": c})
    frame["yes"] = ((a > 0) ^ (b > 2)).astype(int)
    frame["kind"] = (a > 0).astype(int) + (c > 0.5)
    frame["size"] = 10 * a * a + b
    frame.loc[frame.index[::40], "c"] = np.nan
    return spark.createDataFrame(frame).cache()


def same(one, other):
    return all(
        np.array_equal(getattr(x.trees, c), getattr(y.trees, c)) for x, y in zip(one, other, strict=True) for c in ("feature", "cut", "value", "gain", "cover")
    )


@pytest.mark.parametrize(("kind", "target", "classes"), [("logistic", "yes", 1), ("squared", "size", 1), ("softmax", "kind", 3)])
def test_jobs_per_level_give_the_same_trees(rows, monkeypatch, kind, target, classes):
    monkeypatch.setattr(boosting, "REFRESH", 3)
    how = {"classes": classes, "members": [F.col("id") % 2 == 0, F.col("id") > 100], "weight": F.when(F.col("id") < 50, 3.0).otherwise(1.0)}
    one = fit_boosted(rows, FEATURES, F.col(target), kind, SMALL, **how)
    several = replace(LIMITS, block_bytes=90 * (len(FEATURES) + 32))
    other = fit_boosted(rows.repartition(3), FEATURES, F.col(target), kind, SMALL, limits=several, **how)
    assert same(one, other) and one[0].base == other[0].base
    assert (one[0].trees.feature[0] >= 0).any()


@pytest.mark.parametrize("kind", ["squared", "logistic", "softmax"])
def test_derivatives_by_differences(kind):
    classes = 3 if kind == "softmax" else 1
    objective = Objective(kind, classes)
    margin = np.array([[0.3, -0.8], [0.1, 0.5], [-0.4, 0.2]][:classes])
    y, w, step = np.array([1.0, 0.0]), np.ones(2), 1e-4

    def loss(m):
        if kind == "squared":
            return (m[0] - y) ** 2 / 2
        if kind == "logistic":
            return np.log1p(np.exp(m[0])) - y * m[0]
        return np.log(np.exp(m).sum(axis=0)) - m[y.astype(int), np.arange(2)]

    g, h = objective.derivatives(margin, y, w)
    for k in range(classes):
        up, down = margin.copy(), margin.copy()
        up[k] += step
        down[k] -= step
        assert g[k] / boosting.STEPS == pytest.approx((loss(up) - loss(down)) / (2 * step), abs=1e-5)
        second = (loss(up) - 2 * loss(margin) + loss(down)) / step**2
        # Classes share one loss; twice the diagonal bounds what they do together.
        assert h[k] / boosting.STEPS == pytest.approx((2 if kind == "softmax" else 1) * second, abs=1e-4)


def test_learns_what_a_line_cannot(rows):
    full = replace(SMALL, rounds=60, learning_rate=0.2)
    yes = fit_boosted(rows, FEATURES, F.col("yes"), "logistic", full)
    hits = rows.select(((margins(yes)[0] > 0) == (F.col("yes") == 1)).alias("hit")).filter("hit").count()
    assert hits > 380
    size = fit_boosted(rows, FEATURES, F.col("size"), "squared", full)
    error, spread = rows.select(F.sqrt(F.avg(F.pow(margins(size)[0] - F.col("size"), 2))), F.stddev("size")).first()
    assert error < spread / 4
    kind = fit_boosted(rows, FEATURES, F.col("kind"), "softmax", full, classes=3)
    told = rows.select("kind", margins(kind).alias("m"))
    assert told.filter(F.array_position("m", F.array_max("m")) - 1 == F.col("kind")).count() > 380


def test_models_side_by_side_do_not_see_each_others_rows(rows):
    whole = TreeSettings(rounds=3, depth=2)
    both = fit_boosted(rows, FEATURES, F.col("size"), "squared", whole, members=[F.col("id") < 200, F.col("id") >= 200])
    left = rows.filter("id < 200").select(F.avg("size")).first()[0]
    assert both[0].base == pytest.approx(left, abs=1e-4)
    held = rows.select("id", margins(both, F.when(F.col("id") < 400, (F.col("id") >= 200).cast("int")))[0].alias("m"))
    assert held.filter("m is null").count() == 0
    assert rows.select(margins(both, F.lit(None).cast("int")).alias("m")).filter("m is not null").count() == 0


def test_bounds_are_values_and_rows_without_target_are_left_out(rows):
    model = fit_boosted(rows.withColumn("yes", F.when(F.col("id") < 300, F.col("yes"))), FEATURES, F.col("yes"), "logistic", SMALL)[0]
    values = {r["b"] for r in rows.select("b").distinct().collect()}
    assert values - {max(values)} <= set(model.bounds[1]) <= values
    assert max(map(len, model.bounds)) < BINS
    assert model.trees.cover[0, 0] < 300 / 4
    with pytest.raises(ValueError, match="no rows"):
        fit_boosted(rows.limit(0), FEATURES, F.col("yes"), "logistic", SMALL)


def plain_value(trees, t, bins, known, node=0):
    f = int(trees.feature[t, node])
    if f < 0:
        return trees.value[t, node]
    left, right = 2 * node + 1, 2 * node + 2
    if f in known:
        return plain_value(trees, t, bins, known, right if bins[f] > trees.cut[t, node] else left)
    share = trees.cover[t, left] / trees.cover[t, node]
    return share * plain_value(trees, t, bins, known, left) + (1 - share) * plain_value(trees, t, bins, known, right)


def test_contributions_by_all_subsets(rows):
    model = fit_boosted(rows, FEATURES, F.col("size"), "squared", replace(SMALL, depth=4))[0]
    told = contributions.add_contributions(rows, model).select("*", margins([model])[0].alias("m")).filter("id < 12").toPandas()
    bins = model.binned(np.nan_to_num(told[FEATURES].to_numpy(float)))
    n = len(FEATURES)
    for row, b in zip(told.itertuples(), bins, strict=True):
        value = lambda known: sum(plain_value(model.trees, t, b, known) for t in range(len(model.trees.feature)))
        for i in range(n):
            others = [j for j in range(n) if j != i]
            want = sum(
                factorial(len(s)) * factorial(n - 1 - len(s)) / factorial(n) * (value({*s, i}) - value(set(s)))
                for size in range(n)
                for s in combinations(others, size)
            )
            assert row.contributions[i] == pytest.approx(want, abs=1e-9)
        assert sum(row.contributions) + contributions.expected_margin(model) == pytest.approx(row.m, abs=1e-9)
    ranked = contributions.mean_contributions(rows, model).collect()
    assert ranked[0]["feature"] == "a" and len(ranked) == n


def test_leaf_only_trees():
    trees = Trees.empty(2, 3)
    trees.value[:, 0] = [1.0, 2.0]
    model = Boosted(("a",), (np.zeros(0),), Objective("squared"), 0.5, trees)
    assert model.margins(np.zeros((3, 1))).tolist() == [[3.5, 3.5, 3.5]]
    assert contributions.expected_margin(model) == 3.5


def test_global_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("v")).repartition(7)
    ranked = global_ranks(rows.select("k"), ["k"]).collect()
    assert all(r["k"] == r["nth"] for r in ranked) and len(ranked) == 1000
    sums = {r["k"]: (r["s"], r["n"]) for r in global_running(rows, [F.desc("k")], s=F.col("v"), n=F.lit(1)).collect()}
    values = {r["k"]: r["v"] for r in rows.collect()}
    total = 0
    for nth, k in enumerate(sorted(values, reverse=True), 1):
        total += values[k]
        assert sums[k] == (total, nth)
    assert global_running(rows.limit(0), [F.asc("k")], s=F.col("v")).count() == 0


def test_contributions_are_spread_and_their_tables_made_once(rows, spark, monkeypatch):
    """Rows come in few files, since they have few bytes; the work on them is for all tasks, and tables are not made by each."""
    model = fit_boosted(rows.coalesce(1), FEATURES, F.col("size"), "squared", TreeSettings(rounds=3, depth=4))[0]
    made, groups_of = [], contributions.groups_of
    monkeypatch.setattr(contributions, "groups_of", lambda trees, t: made.append(t) or groups_of(trees, t))
    told = contributions.add_contributions(rows.coalesce(1), model)
    parts = told.select(F.spark_partition_id().alias("p"), "contributions").filter("contributions is not null")
    assert parts.select("p").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions")) and made == [0, 1, 2]


def test_levels_are_no_plans_of_their_own(rows, monkeypatch):
    """The driver keeps a description of each plan, so their number must not follow the rounds and levels."""
    collected, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: collected.append(1) or collect(self))
    several = replace(LIMITS, block_bytes=90 * (len(FEATURES) + 32))
    fit_boosted(rows, FEATURES, F.col("yes"), "logistic", replace(SMALL, rounds=1), limits=several)
    first = len(collected)
    fit_boosted(rows, FEATURES, F.col("yes"), "logistic", replace(SMALL, rounds=3), limits=several)
    assert len(collected) == 2 * first


def test_one_task_needs_no_number_per_row_and_feature():
    n, features = 20_000, 40
    draw = np.random.default_rng(3)
    bins = draw.integers(0, BINS, (n, features)).astype(np.uint8)
    block = Block(bins, (bins[:, 0] > 99).astype(float), np.ones(n), draw.integers(0, 1 << 60, n), np.ones(n, np.int64), None)
    tracemalloc.start()
    grow_in_block(block, 0, 0.0, Objective("logistic"), TreeSettings(rounds=2, depth=4))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * n * features


def test_levels_sum_up_one_of_two_siblings_and_rows_once_a_round(rows, monkeypatch):
    """Rows are added up for the root and for the lighter child of each split, not for every node of a level."""
    asked, by_level = [], boosting._sums

    def sums(now, last, wanted, number, depth, *rest):
        asked.append((depth, sum(int((w >= 0).sum()) for w in wanted.values())))
        return by_level(now, last, wanted, number, depth, *rest)

    monkeypatch.setattr(boosting, "_sums", sums)
    several = replace(LIMITS, block_bytes=90 * (len(FEATURES) + 32))
    model = fit_boosted(rows, FEATURES, F.col("yes"), "logistic", replace(SMALL, rounds=1), limits=several)[0]
    split = model.trees.feature[0] >= 0
    assert asked == [(d, 1 if d == 0 else int(split[2 ** (d - 1) - 1 : 2**d - 1].sum())) for d in range(SMALL.depth)]


def test_blocks_that_are_lost_are_made_again(rows, spark, monkeypatch):
    """Blocks lie in files of the executors; without them trees are the same. Nothing is left of them afterwards."""
    several = replace(LIMITS, block_bytes=90 * (len(FEATURES) + 32))
    want = fit_boosted(rows, FEATURES, F.col("kind"), "softmax", SMALL, classes=3, limits=several)
    local = spark.sparkContext.parallelize([0], 1).map(lambda _: os.environ["SPARK_LOCAL_DIRS"]).first().split(",")
    folders = lambda: [f for d in local for f in Path(d).glob("gbt-*")]
    by_level, lost = boosting._sums, []

    def sums(now, last, wanted, number, depth, *rest):
        if (number, depth) in ((0, 1), (2, 0), (2, 2)):
            lost.append([shutil.rmtree(f) for f in folders()])
        return by_level(now, last, wanted, number, depth, *rest)

    monkeypatch.setattr(boosting, "_sums", sums)
    assert same(fit_boosted(rows, FEATURES, F.col("kind"), "softmax", SMALL, classes=3, limits=several), want)
    assert len(lost) == 3 and all(lost) and not folders()


def test_sums_too_large_for_the_driver_are_added_up_before(rows, monkeypatch):
    several = replace(LIMITS, block_bytes=90 * (len(FEATURES) + 32))
    want = fit_boosted(rows, FEATURES, F.col("size"), "squared", SMALL, limits=several)
    monkeypatch.setattr(boosting, "SENT_BYTES", 0)
    assert same(fit_boosted(rows, FEATURES, F.col("size"), "squared", SMALL, limits=several), want)


@pytest.mark.parametrize("depth", [1, 5, 9])
def test_places_are_those_of_a_walk(depth, monkeypatch):
    draw = np.random.default_rng(depth)
    trees = Trees.empty(2, depth)
    inner = 2**depth - 1
    trees.feature[:, :inner] = draw.integers(-1, 4, (2, inner))
    trees.cut[:], trees.value[:] = draw.integers(0, BINS - 1, trees.cut.shape), draw.normal(size=trees.value.shape)
    bins = draw.integers(0, BINS, (300, 4)).astype(np.uint8)

    def walked(t, row):
        node = 0
        while trees.feature[t, node] >= 0:
            node = 2 * node + 1 + int(row[trees.feature[t, node]] > trees.cut[t, node])
        return trees.value[t, node]

    want = [sum(walked(t, row) for t in range(2)) for row in bins]
    assert trees.margins(bins)[0].tolist() == want
    monkeypatch.setattr(boosting, "COMPARED", 2)
    assert trees.margins(bins)[0].tolist() == want
