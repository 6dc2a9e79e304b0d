"""Isolation forest per asset: fitted on a small hashed sample, scored where the rows are, or in the same pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustwatch.functions.expressions import above
from gustwatch.operators.percentiles import exact_percentiles, percentile_column
from gustwatch.session import materialize, sized, spread
from gustwatch.settings import CONTAMINATIONS, FLAG_PERCENTILE, KEY, LIMITS, Limits

TREES = 100
SAMPLE = 256
#: Rows that walk all trees at once.
SLICE = 4096
#: Nodes of all assets together that one executor may hold; above it rows and models meet in groups.
BROADCAST_NODES = 500_000

MODEL_SCHEMA = (
    "asset_id bigint, fit_rows bigint, roots array<int>, feature array<int>, threshold array<double>, "
    "left array<int>, right array<int>, path array<double>"
)


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` rows."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_trees(values: np.ndarray, trees: int, size: int, depth: int, rng: np.random.Generator):
    """Grow ``trees`` trees, each on ``size`` rows of ``values``, level by level and all at once.

    Returns flat arrays (feature, threshold, left, right, path); node ``t`` is
    the root of tree ``t``, and a leaf is its own child.
    """
    drawn = np.concatenate([rng.choice(len(values), size, replace=False) for _ in range(trees)])
    rows = values[drawn]
    nodes, counts = np.arange(trees), np.full(trees, size)
    feature, threshold, child, path = [], [], [], []
    total = trees
    for level in range(depth + 1):
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(int)
        low, high = np.minimum.reduceat(rows, starts), np.maximum.reduceat(rows, starts)
        varies = high > low
        inner = varies.any(axis=1) & (level < depth)
        # A feature drawn evenly among those that vary in the node, and a cut drawn evenly in its range.
        chosen = np.where(varies, rng.random(varies.shape), -1.0).argmax(axis=1)
        at = np.arange(len(nodes))
        lo, hi = low[at, chosen], high[at, chosen]
        cut = lo + rng.random(len(nodes)) * (hi - lo)
        cut = np.where(cut < hi, cut, lo)
        first_child = np.where(inner, total + 2 * (np.cumsum(inner) - 1), -1)
        feature.append(np.where(inner, chosen, 0))
        threshold.append(np.where(inner, cut, np.inf))
        child.append(first_child)
        path.append(level + mean_path(counts))
        if not inner.any():
            break
        owner = np.repeat(at, counts)
        kept = inner[owner]
        rows, owner = rows[kept], owner[kept]
        above = rows[np.arange(len(rows)), chosen[owner]] > cut[owner]
        next_node = first_child[owner] + above
        order = np.argsort(next_node, kind="stable")
        rows, next_node = rows[order], next_node[order]
        nodes, counts = np.unique(next_node, return_counts=True)
        total += 2 * int(inner.sum())
    feature, threshold, child, path = (np.concatenate(part) for part in (feature, threshold, child, path))
    own = np.arange(len(child))
    return feature, threshold, np.where(child < 0, own, child), np.where(child < 0, own, child + 1), path


def _features(df: DataFrame, features: Sequence[str]) -> Column:
    return F.array(*[F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features])


def _uniform(seed: int) -> Column:
    """Number in [0, 1) that a row is drawn by."""
    return F.pmod(F.xxhash64(F.lit(seed), "asset_id", "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _asset_trees(asset: int, values: np.ndarray, trees: int, sample: int, seed: int):
    """Trees of one asset on its drawn rows, in the order of their ids."""
    size = min(sample, len(values))
    depth = max(1, ceil(log2(max(2, size))))
    return grow_trees(values, trees, size, depth, np.random.default_rng([seed, asset & 0xFFFFFFFF]))


def fit_forest(
    df: DataFrame,
    features: Sequence[str],
    mask: Column,
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = 42,
) -> DataFrame:
    """One model row per asset.

    Each asset gives the rows with the lowest hashes, about ``trees * sample``
    of them however many it has, and every tree draws its rows from these. So
    the groups handed to Python are bounded and the same on any partitioning.
    """
    fit = df.filter(mask).select("asset_id", "id", _features(df, features).alias("x"))
    sizes = sized(fit.groupBy("asset_id").agg(F.count(F.lit(1)).alias("fit_rows")))
    share = F.lit(float(trees * sample)) / F.col("fit_rows")
    pool = fit.join(sizes, "asset_id").filter(_uniform(seed) < share)

    def grow(pool_rows: pd.DataFrame) -> pd.DataFrame:
        asset, total = int(pool_rows.asset_id.iloc[0]), int(pool_rows.fit_rows.iloc[0])
        values = np.stack(pool_rows.sort_values("id").x.to_numpy())
        model = (asset, total, list(range(trees)), *_asset_trees(asset, values, trees, sample, seed))
        return pd.DataFrame([model], columns=[part.split()[0] for part in MODEL_SCHEMA.split(", ")])

    return spread(pool, "asset_id").groupBy("asset_id").applyInPandas(grow, MODEL_SCHEMA)


class FlatForest:
    """Models of several assets side by side, walked for many rows at once."""

    def __init__(self, models: pd.DataFrame, sample: int):
        nodes = models.feature.map(len).to_numpy()
        starts = np.concatenate([[0], np.cumsum(nodes)[:-1]]).astype(np.int64)
        self.assets = pd.Index(models.asset_id)
        self.roots = np.stack([np.asarray(r) + s for r, s in zip(models.roots, starts)])
        self.feature = np.concatenate([np.asarray(f) for f in models.feature])
        self.threshold = np.concatenate([np.asarray(t) for t in models.threshold])
        self.left = np.concatenate([np.asarray(c) + s for c, s in zip(models.left, starts)])
        self.right = np.concatenate([np.asarray(c) + s for c, s in zip(models.right, starts)])
        self.path = np.concatenate([np.asarray(p) for p in models.path])
        self.depth = max(1, ceil(log2(max(2, sample))))
        self.normal = mean_path(np.minimum(sample, models.fit_rows.to_numpy()))

    @classmethod
    def of_asset(cls, fit_rows: int, trees: int, grown: Sequence[np.ndarray], sample: int) -> FlatForest:
        """The model of one asset, number 0, from what ``grow_trees`` gave."""
        forest = cls.__new__(cls)
        forest.roots = np.arange(trees)[None, :]
        forest.feature, forest.threshold, forest.left, forest.right, forest.path = grown
        used = min(sample, fit_rows)
        # No tree is deeper than its rows allow.
        forest.depth = max(1, ceil(log2(max(2, used))))
        forest.normal = mean_path(np.array([used]))
        return forest

    def score(self, assets: pd.Series, values: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1); NaN for an asset without a model. Walked by slices of rows, so that the work arrays stay small."""
        return self.walk(self.assets.get_indexer(assets), values)

    def walk(self, known: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Scores of rows whose models are given by number, -1 for none."""
        parts = [self._walk(known[i : i + SLICE], values[i : i + SLICE]) for i in range(0, len(values), SLICE)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _walk(self, known: np.ndarray, values: np.ndarray) -> np.ndarray:
        place = np.maximum(known, 0)
        node = self.roots[place]
        rows = np.arange(len(values))[:, None]
        for _ in range(self.depth):
            node = np.where(values[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        normal = np.where(self.normal[place] > 0, self.normal[place], 1.0)
        return np.where(known >= 0, 2.0 ** (-self.path[node].mean(axis=1) / normal), np.nan)


def score_forest(
    df: DataFrame, models: DataFrame, features: Sequence[str], sample: int = SAMPLE, limits: Limits = LIMITS
) -> DataFrame:
    """``df`` with column ``if_raw_score``.

    Few small models go to every executor and rows stay in place. Otherwise
    rows and models meet in groups: assets of up to ``Limits.python_rows`` rows
    share one, others are cut into chunks of about as many rows.
    """
    rows = df.withColumn("_x", _features(df, features))
    schema = T.StructType([*df.schema.fields, T.StructField("if_raw_score", T.DoubleType())])
    names = df.columns

    def scored(forest: FlatForest, batch: pd.DataFrame) -> pd.DataFrame:
        out = batch[names].copy()
        out["if_raw_score"] = forest.score(batch.asset_id, np.stack(batch._x.to_numpy()))
        return out

    size = models.agg(F.sum(F.size("feature"))).first()[0] or 0
    if size <= BROADCAST_NODES and limits.broadcast_rows > 0:
        held = df.sparkSession.sparkContext.broadcast(models.toPandas())

        def score_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            forest = FlatForest(held.value, sample)
            for batch in batches:
                if len(batch):
                    yield scored(forest, batch)

        return rows.mapInPandas(score_batches, schema)

    needed = F.ceil(F.count(F.lit(1)) / F.lit(limits.python_rows)).cast("int")
    chunks = sized(df.groupBy("asset_id").agg(F.count(F.lit(1)).alias("_rows"), needed.alias("_chunks")).withColumnRenamed("asset_id", "_asset"))
    total = chunks.agg(F.sum("_rows")).first()[0] or 0
    # Assets of one chunk share groups, as many as keep rows and nodes of each within the bounds.
    shared = max(ceil(total / max(1, limits.python_rows)), ceil(size / BROADCAST_NODES), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    alone = F.col("_chunks") == 1
    group = F.when(alone, F.pmod(F.xxhash64("_asset"), F.lit(shared))).otherwise(F.xxhash64("_asset")).alias("_group")
    chunk = F.when(alone, F.lit(-1)).otherwise(F.pmod(F.xxhash64("id"), F.col("_chunks")).cast("int")).alias("_chunk")
    same = F.col("asset_id").eqNullSafe(F.col("_asset"))
    placed = rows.join(chunks, same).select(*names, "_x", group, chunk)
    # Other names than those of the rows, which the models may have been made from.
    model_names = models.columns
    copies = F.explode(F.when(alone, F.array(F.lit(-1))).otherwise(F.expr("sequence(0, _chunks - 1)"))).alias("_model_chunk")
    copied = models.join(chunks, same).select(*[F.col(c).alias(f"_model_{c}") for c in model_names], group.alias("_model_group"), copies)

    def score_group(key, group: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if group.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        if model.empty:
            return group[names].assign(if_raw_score=np.nan)
        return scored(FlatForest(model.rename(columns={f"_model_{c}": c for c in model_names}), sample), group)

    by, model_by = ["_group", "_chunk"], ["_model_group", "_model_chunk"]
    given = spread(copied, *model_by).groupBy(*model_by)
    return spread(placed, *by).groupBy(*by).cogroup(given).applyInPandas(score_group, schema)


def fit_and_score(df: DataFrame, features: Sequence[str], fit: str, trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """``df`` with column ``if_raw_score``, the same as by ``fit_forest`` on the rows marked ``fit`` and ``score_forest``.

    For assets whose rows one task may hold: rows come sorted by asset, and each asset's forest is grown, walked and
    forgotten in turn. A forest is many times as large as the rows of a small asset, and is neither written nor moved.
    """
    inputs = [f"_x{i}" for i in range(len(features))]
    schema = T.StructType([*df.schema.fields, T.StructField("if_raw_score", T.DoubleType())])
    names = df.columns
    values = [F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(x) for c, x in zip(features, inputs)]
    rows = spread(df.select("*", *values, _uniform(seed).alias("_u")), "asset_id").sortWithinPartitions("asset_id", "id")

    def asset_scores(asset: int, x: np.ndarray, marked: np.ndarray, drawn: np.ndarray) -> np.ndarray:
        total = int(marked.sum())
        pool = marked & (drawn < trees * sample / total) if total else marked
        if not pool.any():
            return np.full(len(x), np.nan)
        grown = _asset_trees(asset, x[pool], trees, sample, seed)
        return FlatForest.of_asset(total, trees, grown, sample).walk(np.zeros(len(x), np.int64), x)

    def scored(part: pd.DataFrame) -> pd.DataFrame:
        assets = part.asset_id.to_numpy()
        x, marked, drawn = part[inputs].to_numpy(np.float64), part[fit].to_numpy(bool), part._u.to_numpy()
        bounds = np.concatenate([[0], np.flatnonzero(assets[1:] != assets[:-1]) + 1, [len(part)]])
        each = [asset_scores(int(assets[a]), x[a:b], marked[a:b], drawn[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        return part[names].assign(if_raw_score=np.concatenate(each))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            # The last asset of a batch may go on in the next one.
            last = batch.asset_id.iloc[-1]
            first = int((batch.asset_id.to_numpy() != last).sum())
            if first or (held and held[-1].asset_id.iloc[-1] != last):
                yield scored(pd.concat([*held, batch.iloc[:first]]))
                held = []
            held.append(batch.iloc[first:])
        if held:
            yield scored(pd.concat(held))

    return rows.mapInPandas(walk, schema)


def choose_offsets(
    scores: DataFrame,
    score: str,
    mask: Column,
    contaminations: Sequence[float] = CONTAMINATIONS,
    limits: Limits = LIMITS,
) -> DataFrame:
    """Per asset the contamination with the lowest mean shifted fit score, and its offset.

    The offset is the ``1 - c`` percentile of the fit scores; the first
    contamination wins ties.
    """
    fit = scores.filter(mask)
    percents = [100 * (1 - c) for c in contaminations]
    found = exact_percentiles(fit, score, percents, by=["asset_id"], limits=limits)
    means = fit.groupBy("asset_id").agg(F.avg(score).alias("_mean"))
    tries = F.array(
        *[
            F.struct(
                (F.col("_mean") - F.col(percentile_column(p))).alias("mean_score"),
                F.lit(i).alias("nth"),
                F.lit(float(c)).alias("contamination"),
                F.col(percentile_column(p)).alias("offset"),
            )
            for i, (c, p) in enumerate(zip(contaminations, percents))
        ]
    )
    best = found.join(means, "asset_id").withColumn("_best", F.array_min(tries))
    return best.select("asset_id", "_best.contamination", "_best.offset", "_best.mean_score")


def add_asset_flag(
    scores: DataFrame, score: str, flag: str, percent: float = FLAG_PERCENTILE, limits: Limits = LIMITS
) -> DataFrame:
    """``flag`` is 1 strictly above the asset's own percentile of ``score``."""
    found = sized(exact_percentiles(scores, score, [percent], by=["asset_id"], limits=limits))
    bound = F.col(percentile_column(percent))
    joined = scores.join(found, "asset_id", "left")
    return joined.withColumn(flag, above(score, bound).cast("int")).drop(
        percentile_column(percent)
    )


def isolation_scores(
    df: DataFrame,
    features: Sequence[str],
    mask: Column,
    keep: Sequence[str] = (),
    trees: int = TREES,
    seed: int = 42,
    strict: bool = True,
    limits: Limits = LIMITS,
) -> DataFrame:
    """Shifted score ``if_anomaly_score`` and flag ``if_anomaly_flag`` for every row.

    Inputs and raw scores are written once: fitting and scoring read the
    former, offsets, flags and the caller's normalization the latter. An asset
    without rows to fit on is an error, or has null scores if not ``strict``.
    """
    kept = list(dict.fromkeys([*KEY, *keep]))
    inputs = [c for c in features if c not in kept]
    narrowed = materialize(df.withColumn("_fit", F.coalesce(mask, F.lit(False))).select(*kept, "_fit", *inputs))
    if strict:
        unfitted = narrowed.groupBy("asset_id").agg(F.max("_fit").alias("fitted")).filter("not fitted").limit(5).collect()
        if unfitted:
            raise ValueError(f"no rows to fit on for assets {[r.asset_id for r in unfitted]}")
    # Assets that one task may hold are fitted and scored at once; the forests of others are written and meet their rows in chunks.
    large = sized(narrowed.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limits.python_rows).select("asset_id"))
    out = [*kept, "_fit", "if_raw_score"]
    known, split = narrowed.filter("asset_id is not null"), not large.isEmpty()
    small = known.join(large, "asset_id", "left_anti").select(*narrowed.columns) if split else known
    scored = fit_and_score(small, features, "_fit", trees, seed=seed).select(*out)
    scored = scored.unionByName(narrowed.filter("asset_id is null").withColumn("if_raw_score", F.lit(float("nan"))).select(*out))
    if split:
        many = materialize(known.join(large, "asset_id", "left_semi").select(*narrowed.columns))
        models = materialize(fit_forest(many, features, F.col("_fit"), trees, seed=seed))
        scored = scored.unionByName(score_forest(many, models, features, limits=limits).select(*out))
    raw = materialize(scored)
    offsets = sized(choose_offsets(raw, "if_raw_score", F.col("_fit"), limits=limits).select("asset_id", "offset"))
    shifted = raw.join(offsets, "asset_id", "left").withColumn(
        "if_anomaly_score", F.col("if_raw_score") - F.col("offset")
    )
    return add_asset_flag(shifted.drop("if_raw_score", "offset", "_fit"), "if_anomaly_score", "if_anomaly_flag", limits=limits)
