"""Contribution of each feature to each prediction: path-dependent Shapley values of boosted trees.

The value of a set of features in a tree is the prediction when a row decides
at nodes of these features and goes both ways elsewhere, weighted by the
children's covers. A leaf's share of it depends only on which of the features
on its path the row satisfies: for at most ``depth`` of them these are at most
``2**depth`` patterns, whose Shapley values are computed once per leaf. Leaves
that are ``JOINED`` levels or less apart share a table by the outcomes of the
nodes on their paths. Rows then only look outcomes up, in a map over partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustwatch.operators.boosting import Boosted, Trees, number_array
from gustwatch.session import spread

#: Levels at the bottom of a tree whose leaves are looked up together.
JOINED = 2


def _pattern_tables(shares: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Shapley values of the features of paths (leaf, feature), for each pattern of those that a row satisfies: (leaf, pattern, feature)."""
    leaves, m = shares.shape
    bits = (np.arange(2**m)[:, None] >> np.arange(m)) & 1
    tables = np.zeros((leaves, 2**m, m))
    weights = np.array([factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)])
    for i in range(m):
        # Coefficient s: sum over sets of s other features of what they give, the rest by their shares.
        sums = np.zeros((leaves, 2**m, m))
        sums[:, :, 0] = 1.0
        for j in range(m):
            if j != i:
                sums = sums * shares[:, j, None, None] + np.pad(sums[:, :, :-1] * bits[:, j, None], ((0, 0), (0, 0), (1, 0)))
        tables[:, :, i] = values[:, None] * (sums @ weights) * (bits[:, i] - shares[:, i, None])
    return tables


def _path_to(node: int) -> list[int]:
    """Nodes above ``node``, the root first."""
    above = []
    while node:
        node = (node - 1) // 2
        above.append(node)
    return above[::-1]


def _leaf_shares(trees: Trees, t: int) -> dict[int, dict[int, float]]:
    """Per leaf of tree ``t`` the features on its path, in order, with the share of the cover that follows them."""
    found, stack = {}, [(0, {})]
    while stack:
        node, shares = stack.pop()
        f = int(trees.feature[t, node])
        if f < 0:
            found[node] = dict(sorted(shares.items()))
            continue
        for child in (2 * node + 1, 2 * node + 2):
            stack.append((child, {**shares, f: shares.get(f, 1.0) * trees.cover[t, child] / trees.cover[t, node]}))
    return found


def expected_margin(model: Boosted) -> float:
    """Prediction without knowing any feature."""
    trees = model.trees
    leaves = ((t, node, shares) for t in range(len(trees.feature)) for node, shares in _leaf_shares(trees, t).items())
    return model.base + sum(float(trees.value[t, node]) * float(np.prod(list(shares.values()))) for t, node, shares in leaves)


@dataclass(frozen=True)
class Group:
    """Leaves below one node: what they give together, by the outcomes of the nodes above and among them."""

    #: Nodes asked, first the ones above; bit i of an outcome tells that a row goes right at node i.
    nodes: tuple[int, ...]
    features: np.ndarray
    #: (features, outcomes)
    table: np.ndarray


def groups_of(trees: Trees, t: int) -> list[Group]:
    """The leaves of tree ``t`` by the subtree of ``JOINED`` levels that they lie in."""
    feature, top = trees.feature[t], max(0, trees.depth - JOINED)
    shares = {leaf: own for leaf, own in _leaf_shares(trees, t).items() if own}
    given: dict[int, np.ndarray] = {}
    for m in {len(own) for own in shares.values()}:
        alike = [leaf for leaf, own in shares.items() if len(own) == m]
        tables = _pattern_tables(np.array([list(shares[leaf].values()) for leaf in alike]), trees.value[t, alike])
        given |= dict(zip(alike, tables, strict=True))
    subtrees: dict[int, list[int]] = {}
    for leaf in shares:
        path = [*_path_to(leaf), leaf]
        subtrees.setdefault(path[min(top, len(path) - 1)], []).append(leaf)
    groups = []
    for root, leaves in subtrees.items():
        above = _path_to(root)
        nodes = above + sorted({n for leaf in leaves for n in _path_to(leaf)} - set(above))
        place = {n: i for i, n in enumerate(nodes)}
        names = sorted({int(feature[n]) for n in nodes})
        outcomes = np.arange(2 ** len(nodes))
        right = (outcomes >> np.arange(len(nodes))[:, None]) & 1 == 1
        table = np.zeros((len(names), len(outcomes)))
        for leaf in leaves:
            path = _path_to(leaf)
            kept = dict.fromkeys(shares[leaf], True)
            for n, child in zip(path, [*path[1:], leaf], strict=True):
                kept[int(feature[n])] &= right[place[n]] if child == 2 * n + 2 else ~right[place[n]]
            pattern = sum(k.astype(np.int64) << i for i, k in enumerate(kept.values()))
            table[[names.index(f) for f in kept]] += given[leaf][pattern].T
        groups.append(Group(tuple(nodes), np.array(names, np.int64), table))
    return groups


def shapley(model: Boosted, values: np.ndarray, groups: Sequence[Sequence[Group]], slice_rows: int = 4096) -> np.ndarray:
    """Contributions (rows, features); ``groups`` are those of each tree."""
    bins = model.binned(values).astype(np.int16)
    out = np.zeros(values.shape)
    for start in range(0, len(values), slice_rows):
        part = np.ascontiguousarray(bins[start : start + slice_rows].T)
        sums = np.zeros(part.shape)
        for t, told in enumerate(groups):
            right = {n: (part[model.trees.feature[t, n]] > model.trees.cut[t, n]).astype(np.int64) for n in {n for g in told for n in g.nodes}}
            upto: dict[tuple[int, ...], np.ndarray] = {(): np.zeros(part.shape[1], np.int64)}

            def outcome(nodes, upto=upto, right=right):
                # Groups share the nodes above them.
                if nodes not in upto:
                    upto[nodes] = outcome(nodes[:-1]) + (right[nodes[-1]] << (len(nodes) - 1))
                return upto[nodes]

            for g in told:
                at = outcome(g.nodes)
                for f, by_outcome in zip(g.features.tolist(), g.table, strict=True):
                    sums[f] += by_outcome[at]
        out[start : start + slice_rows] = sums.T
    return out


def add_contributions(rows: DataFrame, model: Boosted, out: str = "contributions") -> DataFrame:
    """Add an array with one contribution per feature; with :func:`expected_margin` they add up to the prediction.

    For models of one class. All rows are explained, none are sampled.
    """

    # Made once, for all tasks; it grows with the model alone.
    held = rows.sparkSession.sparkContext.broadcast([groups_of(model.trees, t) for t in range(len(model.trees.feature))])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def explained(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            values = np.array(x.to_list(), np.float64).reshape(len(x), len(model.features))
            yield pd.Series(list(shapley(model, values, held.value)), dtype=object)

    return spread(rows).withColumn(out, explained(number_array(model.features)))


def mean_contributions(rows: DataFrame, model: Boosted) -> DataFrame:
    """Mean absolute contribution per feature over all rows, largest first."""
    numbered = add_contributions(rows, model, "_c").select(F.posexplode("_c").alias("_f", "_v"))
    names = F.array(*map(F.lit, model.features))
    means = numbered.groupBy("_f").agg(F.avg(F.abs("_v")).alias("mean_abs_contribution"))
    return means.select(names[F.col("_f")].alias("feature"), "mean_abs_contribution").orderBy(F.desc("mean_abs_contribution"), "feature")
