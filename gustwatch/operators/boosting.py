"""Boosted trees on binned features: gradient histograms, Newton leaf values, several models at once.

Features are cut once into at most 256 bins at ranks of a bounded hash sample,
and rows are packed into blocks of bytes. A model grows level by level: blocks
give sums of gradients per (model, class, node, feature, bin), the sums of all
blocks are added, and each node takes the cut of largest gain. Gradients are
rounded to integers first, and rows, features and folds are drawn from hashes,
so sums are exact and a model is the same on any partitioning.

Two ways of adding up, with the same result. Rows that fit in one block
(``Limits.block_bytes``, checked by a count) are one row of the table of
blocks; a task per model takes it through all rounds, since a job per level
would cost more than the sums. Larger tables take one Spark job per level,
which returns the sums of all models, classes and nodes together, of two
siblings those of the lighter one. Blocks and margins lie in files of the
executors from round to round; what a lost executor had is made again from the
table of blocks and the trees so far.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import suppress
from dataclasses import dataclass, replace
from math import ceil, frexp
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustwatch.session import materialize, ship_package
from gustwatch.settings import LIMITS, Limits

BINS = 256
#: Rows that the bins' bounds are taken from, chosen by hash.
BIN_SAMPLE = 50_000
#: Rounds between two collections of the driver's garbage, where blocks are many.
REFRESH = 25
#: Where the executors' blocks are: a few bytes a block.
KEPT = StorageLevel.MEMORY_AND_DISK
#: Bytes that the first block of a task is sent with. Spark sends a task in two pieces; where the second is shorter than a packet it
#: waits some 40 ms until the first one is acknowledged, more than most levels take.
FILLER = 1 << 17
#: Rows that work arrays have at once, so that they stay in a core's cache.
SLICE = 32_768
#: Nodes of a level whose outcomes are all compared and then chosen from, instead of being looked up row by row.
COMPARED = 64
#: Bytes of sums that tasks may send to the driver as they are; above it executors add them up first.
SENT_BYTES = 20_000_000
#: Gradients are multiples of one over this, relative to the largest possible one.
STEPS = 1 << 22
#: Models that one fit can train side by side, a bit each.
MOST_MODELS = 62


@dataclass(frozen=True)
class TreeSettings:
    """Size and regularisation of a boosted model."""

    rounds: int = 100
    depth: int = 5
    learning_rate: float = 0.05
    #: Shares of rows and of features that a round sees.
    subsample: float = 1.0
    feature_share: float = 1.0
    #: Least sum of second derivatives in a child, and least gain of a split.
    min_hessian: float = 1.0
    min_gain: float = 0.0
    l2: float = 1.0
    l1: float = 0.0
    seed: int = 42


@dataclass(frozen=True)
class Objective:
    """What is learned: ``classes`` margins per row and the derivatives of the loss by them."""

    kind: str
    classes: int = 1
    #: Unit of the gradients, a power of two: for ``squared`` that of the largest target.
    unit: float = 1.0

    def derivatives(self, margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both derivatives as integers, (classes, rows)."""
        if self.kind == "squared":
            g, h = margin - y, np.ones_like(margin)
        elif self.kind == "logistic":
            p = 1.0 / (1.0 + np.exp(-margin))
            g, h = p - y, p * (1.0 - p)
        else:
            e = np.exp(margin - margin.max(axis=0))
            p = e / e.sum(axis=0)
            g, h = p - (y == np.arange(self.classes)[:, None]), 2.0 * p * (1.0 - p)
        return np.rint(w * g * (STEPS / self.unit)), np.rint(w * h * STEPS)


@dataclass(frozen=True)
class Trees:
    """Complete binary trees as arrays (tree, node): node ``i`` has the children ``2 i + 1`` and ``2 i + 2``.

    ``feature`` is -1 for a leaf; a row goes left where its bin is at most
    ``cut``. Tree ``t`` adds to the margin of class ``t % classes``.
    """

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    @classmethod
    def empty(cls, trees: int, depth: int) -> Trees:
        shape = (trees, 2 ** (depth + 1) - 1)
        return cls(np.full(shape, -1, np.int16), np.zeros(shape, np.int16), np.zeros(shape), np.zeros(shape), np.zeros(shape))

    def part(self, trees: slice) -> Trees:
        return Trees(self.feature[trees], self.cut[trees], self.value[trees], self.gain[trees], self.cover[trees])

    @property
    def depth(self) -> int:
        return (self.feature.shape[1] + 1).bit_length() - 2

    def ends(self) -> np.ndarray:
        """Node that a row ends in by its place at full depth, (trees, places)."""
        places = np.arange(2**self.depth)
        trees = np.arange(len(self.feature))[:, None]
        node = np.zeros((len(self.feature), len(places)), np.int64)
        for d in range(self.depth):
            right = (places >> (self.depth - 1 - d)) & 1
            node = np.where(self.feature[trees, node] < 0, node, 2 * node + 1 + right)
        return node

    def added(self, out: np.ndarray, bins: np.ndarray) -> None:
        """Adds the leaf values to margins (classes, rows), tree by tree; ``bins`` by feature, (features, rows)."""
        values = np.take_along_axis(self.value, self.ends(), axis=1)
        for t, by_place in enumerate(values):
            out[t % len(out)] += by_place.take(_places(self.feature[t], self.cut[t], bins, self.depth))

    def margins(self, bins: np.ndarray, classes: int = 1) -> np.ndarray:
        """Sums of leaf values per class, (classes, rows), of ``bins`` (rows, features)."""
        out = np.zeros((classes, len(bins)))
        self.added(out, np.ascontiguousarray(bins.T))
        return out


@dataclass(frozen=True)
class Boosted:
    """A trained model: bounds of the bins per feature, trees, and the margin they start from."""

    features: tuple[str, ...]
    bounds: tuple[np.ndarray, ...]
    objective: Objective
    base: float
    trees: Trees

    def binned(self, values: np.ndarray) -> np.ndarray:
        return binned(values, self.bounds)

    def margins(self, values: np.ndarray, slice_rows: int = SLICE) -> np.ndarray:
        """(classes, rows), by slices of rows, so that the work arrays stay small."""
        bins = self.binned(values)
        parts = [self.trees.margins(bins[i : i + slice_rows], self.objective.classes) for i in range(0, len(bins), slice_rows)]
        return self.base + np.concatenate(parts, axis=1) if parts else np.zeros((self.objective.classes, 0))


# -- draws and sums shared by both ways -------------------------------------


def binned(values: np.ndarray, bounds: Sequence[np.ndarray]) -> np.ndarray:
    """Bin per value: the number of bounds below it."""
    out = np.empty(values.shape, np.uint8)
    for f, b in enumerate(bounds):
        out[:, f] = np.searchsorted(b, values[:, f], side="left")
    return out


def _either(left: np.ndarray | None, right: np.ndarray | None, at_right: np.ndarray | None) -> np.ndarray | None:
    """``right`` where ``at_right``, else ``left``; None is False for all rows."""
    if at_right is None or (left is None and right is None):
        return left
    if left is None:
        return right & at_right
    return left & ~at_right if right is None else left ^ (at_right & (left ^ right))


def _places(feature: np.ndarray, cut: np.ndarray, bins: np.ndarray, depth: int) -> np.ndarray:
    """Place of each row among the ``2**depth`` nodes of a level of one tree, rows of a leaf going left; ``bins`` by feature.

    Bytes are compared for all nodes of a level, and rows choose among the
    outcomes by those of the levels above: nothing is looked up row by row.
    """
    place = np.zeros(bins.shape[1], np.uint8 if depth <= 8 else np.int32)
    taken: list[np.ndarray | None] = []
    for d in range(depth):
        first = 2**d - 1
        if 2**d <= COMPARED:
            nodes = zip(feature[first : 2 * first + 1].tolist(), cut[first : 2 * first + 1].tolist(), strict=True)
            tests = [bins[f] > c if f >= 0 else None for f, c in nodes]
            for bit in reversed(taken):
                tests = [_either(a, b, bit) for a, b in zip(tests[::2], tests[1::2], strict=True)]
            right = tests[0]
        else:
            asked = feature[first + place]
            right = (bins[np.maximum(asked, 0), np.arange(len(place))] > cut[first + place]) & (asked >= 0)
        taken.append(right)
        np.left_shift(place, 1, out=place)
        if right is not None:
            np.bitwise_or(place, right, out=place)
    return place


def _add_sums(out: np.ndarray, chosen: np.ndarray, bins: np.ndarray, rows: np.ndarray, slot: np.ndarray, derivatives: np.ndarray) -> None:
    """Adds to ``out`` (chosen feature, slot * BINS + bin) both derivatives of ``rows``, as the parts of a complex number.

    Feature by feature, so that work arrays have a number per row, not one per
    row and feature; ``bins`` by feature.
    """
    first = slot.astype(np.int64) * BINS
    for sums, f in zip(out, chosen.tolist(), strict=True):
        np.add.at(sums, first + bins[f].take(rows), derivatives)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _round_salt(seed: int, number: int) -> np.uint64:
    return _mixed(np.array([(seed << 32) + number], np.uint64))[0]


def drawn_rows(hashes: np.ndarray, number: int, settings: TreeSettings) -> np.ndarray:
    """Whether a row takes part in a round."""
    if settings.subsample >= 1:
        return np.ones(len(hashes), bool)
    drawn = _mixed(hashes.astype(np.uint64) ^ _round_salt(settings.seed, number)) >> np.uint64(11)
    return drawn < np.uint64(int(settings.subsample * 2**53))


def drawn_features(features: int, number: int, settings: TreeSettings) -> np.ndarray:
    """Numbers of the features that a round may use, at least one."""
    keep = max(1, int(settings.feature_share * features))
    order = np.argsort(_mixed(np.arange(features, dtype=np.uint64) + _round_salt(settings.seed, ~number & 0xFFFFFFFF)), kind="stable")
    return np.sort(order[:keep])


def _score(g, h, settings: TreeSettings):
    """Twice the loss that a leaf with these sums saves."""
    shrunk = np.sign(g) * np.maximum(np.abs(g) - settings.l1, 0.0)
    return shrunk * shrunk / (h + settings.l2)


def leaf_value(g: float, h: float, settings: TreeSettings) -> float:
    shrunk = np.sign(g) * max(abs(g) - settings.l1, 0.0)
    return float(-settings.learning_rate * shrunk / (h + settings.l2)) if h + settings.l2 > 0 else 0.0


def _both(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Both derivatives as the parts of complex numbers, so that they are added up at once."""
    out = np.empty(g.shape, np.complex128)
    out.real, out.imag = g, h
    return out


@dataclass
class Split:
    """Sums of a node and, where it can be split, the best cut with the sums left of it."""

    g: float
    h: float
    feature: int = -1
    cut: int = 0
    gain: float = 0.0
    left_g: float = 0.0
    left_h: float = 0.0


def _best_cuts(sums: np.ndarray, features: np.ndarray, unit: float, settings: TreeSettings) -> list[Split]:
    """Per slot of the sums (slot, feature, bin): the cut of largest gain, the first of equals by feature and bin."""
    g, h = sums.real * (unit / STEPS), sums.imag / STEPS
    left_g, left_h = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
    all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    fits = (left_h >= settings.min_hessian) & (right_h >= settings.min_hessian)
    with np.errstate(divide="ignore", invalid="ignore"):
        gains = _score(left_g, left_h, settings) + _score(right_g, right_h, settings) - _score(all_g, all_h, settings)
    gains = np.where(fits & (gains > settings.min_gain), gains, -np.inf).reshape(len(g), -1)
    out = []
    for slot, at in enumerate(gains.argmax(axis=1)):
        split = Split(float(all_g[slot, 0, 0]), float(all_h[slot, 0, 0]))
        if gains[slot, at] > -np.inf:
            f, b = divmod(int(at), g.shape[2])
            split.feature, split.cut, split.gain = int(features[f]), b, float(gains[slot, at])
            split.left_g, split.left_h = float(left_g[slot, f, b]), float(left_h[slot, f, b])
        out.append(split)
    return out


def _set_level(trees: Trees, t: int, depth: int, splits: dict[int, Split], settings: TreeSettings) -> None:
    """Write the splits of the open nodes at ``depth``; what is not split becomes a leaf, and so do children at full depth."""
    for slot, s in splits.items():
        node = 2**depth - 1 + slot
        trees.cover[t, node] = s.h
        if s.feature < 0:
            trees.value[t, node] = leaf_value(s.g, s.h, settings)
            continue
        trees.feature[t, node], trees.cut[t, node], trees.gain[t, node] = s.feature, s.cut, s.gain
        for child, g, h in ((2 * node + 1, s.left_g, s.left_h), (2 * node + 2, s.g - s.left_g, s.h - s.left_h)):
            trees.cover[t, child] = h
            trees.value[t, child] = leaf_value(g, h, settings)


# -- rows to blocks ---------------------------------------------------------

_BLOCK = T.StructType(
    [T.StructField("n", T.LongType())] + [T.StructField(c, T.BinaryType()) for c in ("bins", "y", "w", "hash", "member", "margin")]
)


@dataclass(frozen=True)
class Block:
    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray
    hash: np.ndarray
    member: np.ndarray
    #: (models, classes, rows), or None before the first refresh.
    margin: np.ndarray | None

    @classmethod
    def of(cls, row: dict, models: int, classes: int) -> Block:
        n = row["n"]
        f8 = [np.frombuffer(row[c], np.float64) for c in ("y", "w")]
        i8 = [np.frombuffer(row[c], np.int64) for c in ("hash", "member")]
        margin = np.frombuffer(row["margin"], np.float64).reshape(models, classes, n) if row["margin"] else None
        return cls(np.frombuffer(row["bins"], np.uint8).reshape(n, -1), *f8, *i8, margin)


def _bounds(rows: DataFrame, features: int, total: int) -> tuple[np.ndarray, ...]:
    """Values at ranks ``ceil(k n / 256)`` of the sample, without repeats, per feature."""
    sample = rows.where(F.pmod("_hash", F.lit(max(1, ceil(total / BIN_SAMPLE)))) == 0)
    values = sample.select(F.posexplode("_x").alias("feature", "value"))
    nth = F.row_number().over(Window.partitionBy("feature").orderBy("value"))
    n = F.count(F.lit(1)).over(Window.partitionBy("feature"))
    ranked = values.select("feature", "value", nth.alias("nth"), n.alias("n"))
    # The values at whose rank a multiple of n / 256 is passed.
    passed = F.floor(F.col("nth") * BINS / F.col("n")) > F.floor((F.col("nth") - 1) * BINS / F.col("n"))
    told = ranked.where(passed & (F.col("nth") < F.col("n"))).groupBy("feature").agg(F.sort_array(F.collect_set("value")).alias("b")).collect()
    found = {r["feature"]: np.array(r["b"], np.float64) for r in told}
    return tuple(found.get(f, np.zeros(0))[: BINS - 1] for f in range(features))


def _packed(bounds: tuple[np.ndarray, ...], block_rows: int) -> Callable:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def block(part: pd.DataFrame) -> dict:
            bins = binned(np.array(part["_x"].to_list(), np.float64).reshape(len(part), len(bounds)), bounds)
            y, w = (part[c].to_numpy(np.float64) for c in ("_y", "_w"))
            h, m = (part[c].to_numpy(np.int64) for c in ("_hash", "_member"))
            return {"n": len(part), "bins": bins.tobytes(), "y": y.tobytes(), "w": w.tobytes(), "hash": h.tobytes(), "member": m.tobytes(), "margin": b""}

        for batch in batches:
            while len(batch):
                take = block_rows - size
                held.append(batch.iloc[:take])
                size += len(held[-1])
                batch = batch.iloc[take:]
                if size == block_rows:
                    yield pd.DataFrame([block(pd.concat(held))])
                    held, size = [], 0
        if size:
            yield pd.DataFrame([block(pd.concat(held))])

    return pack


# -- one block: a task per model --------------------------------------------


def grow_in_block(block: Block, model: int, base: float, objective: Objective, settings: TreeSettings) -> Trees:
    """All rounds of one model over the rows of one block."""
    keep = (block.member >> model) & 1 == 1
    bins, y, w, hashes = block.bins[keep], block.y[keep], block.w[keep], block.hash[keep]
    n, features = bins.shape
    classes, depth = objective.classes, settings.depth
    by_feature = np.ascontiguousarray(bins.T)
    margin = np.full((classes, n), base)
    trees = Trees.empty(settings.rounds * classes, depth)

    def sums(rows: np.ndarray, slot: np.ndarray, slots: int, both: np.ndarray) -> np.ndarray:
        """(slot, chosen feature, bin)"""
        rows = rows[used[rows]]
        out = np.zeros((len(chosen), slots * BINS), np.complex128)
        for i in range(0, len(rows), SLICE):
            part = rows[i : i + SLICE]
            _add_sums(out, chosen, by_feature, part, slot[part], both[part])
        return out.reshape(len(chosen), slots, BINS).swapaxes(0, 1)

    for number in range(settings.rounds):
        used = drawn_rows(hashes, number, settings)
        chosen = drawn_features(features, number, settings)
        all_g, all_h = objective.derivatives(margin, y, w)
        for k in range(classes):
            t = number * classes + k
            both = _both(all_g[k], all_h[k])
            node = np.zeros(n, np.int64)
            open_rows = np.arange(n)
            slot = np.zeros(n, np.int64)
            summed = sums(open_rows, slot, 1, both)
            open_slots = [0]
            for d in range(depth):
                found = _best_cuts(summed[open_slots], chosen, objective.unit, settings)
                splits = dict(zip(open_slots, found, strict=True))
                _set_level(trees, t, d, splits, settings)
                parents = [s for s, x in splits.items() if x.feature >= 0]
                if not parents:
                    break
                feature, cut = trees.feature[t], trees.cut[t]
                at = node[open_rows]
                open_rows = open_rows[feature[at] >= 0]
                at = node[open_rows]
                node[open_rows] = 2 * at + 1 + (bins[open_rows, feature[at]] > cut[at])
                if d + 1 == depth:
                    break
                slot[open_rows] = node[open_rows] - (2 ** (d + 1) - 1)
                # Only the smaller child is summed up; its sibling is what remains of the parent.
                many = np.bincount(slot[open_rows], minlength=2 ** (d + 1))
                small = np.array([2 * p + (many[2 * p + 1] < many[2 * p]) for p in parents])
                is_small = np.zeros(2 ** (d + 1), bool)
                is_small[small] = True
                below = sums(open_rows[is_small[slot[open_rows]]], slot, 2 ** (d + 1), both)
                other = small ^ 1
                below[other] = summed[parents] - below[small]
                summed = below
                open_slots = sorted([*small.tolist(), *other.tolist()])
            margin[k] += trees.value[t, node]
    return trees


def _grown_in_tasks(blocks: DataFrame, bases: list[float], objective: Objective, settings: TreeSettings) -> list[Trees]:
    models = len(bases)

    def grow(row: Row) -> tuple[int, Trees]:
        m = row["model"]
        return m, grow_in_block(Block.of(row.asDict(), models, objective.classes), m, bases[m], objective, settings)

    each = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(models - 1).cast("long"))).alias("model"))
    # A row is a whole block; as plain rows they come one by one, without a setting of the session.
    told = each.repartitionByRange(models, "model").rdd.map(grow).collect()
    return [trees for _, trees in sorted(told, key=lambda x: x[0])]


# -- many blocks: a job per level -------------------------------------------


@dataclass(frozen=True)
class Stored:
    """A block in files of its executor: bins by feature, what rows are learned by, and margins and derivatives of the rounds."""

    path: str
    rows: int
    features: int
    models: int
    classes: int
    filler: bytes = b""

    @classmethod
    def of(cls, block: Block, folder: str, bases: list[float], classes: int, past: list[Trees], number: int) -> Stored:
        """Writes ``block`` below ``folder``, with margins by the trees of all rounds before ``number``."""
        n, features = block.bins.shape
        stored = cls(f"{folder}/{uuid4().hex}", n, features, len(bases), classes)
        margin = np.empty((len(bases), classes, n))
        margin[:] = np.array(bases)[:, None, None]
        bins = np.ascontiguousarray(block.bins.T)
        for i in range(0, n, SLICE):
            for m, trees in enumerate(past):
                trees.added(margin[m, :, i : i + SLICE], bins[:, i : i + SLICE])
        stored.write("bins", bins)
        stored.write("learned", block.y, block.w, block.hash, block.member)
        stored.write(f"margins-{number}", margin)
        return stored

    def write(self, name: str, *arrays: np.ndarray) -> None:
        """Whole or not at all; a task that is run again writes the same."""
        part = f"{self.path}.{name}.{uuid4().hex}"
        with open(part, "wb") as file:
            for array in arrays:
                np.ascontiguousarray(array).tofile(file)
        os.replace(part, f"{self.path}.{name}")

    def remove(self, name: str) -> None:
        with suppress(FileNotFoundError):
            os.remove(f"{self.path}.{name}")

    def read(self, name: str, dtype: type, *shape: int, offset: int = 0) -> np.ndarray:
        return np.memmap(f"{self.path}.{name}", dtype, "r", offset, shape)

    def bins(self) -> np.ndarray:
        return self.read("bins", np.uint8, self.features, self.rows)

    def round(self, number: int, last: list[Trees] | None, objective: Objective, settings: TreeSettings) -> tuple[np.ndarray, np.ndarray]:
        """Derivatives (model, class, row) of round ``number`` and the rows that each model sees (model, row).

        Made from the margins of the round before and ``last``, its trees,
        where they are not there yet.
        """
        shape, name = (self.models, self.classes, self.rows), f"round-{number}"
        if not os.path.exists(f"{self.path}.{name}"):
            try:
                margin = np.array(self.read(f"margins-{number}", np.float64, *shape))
            except FileNotFoundError:
                margin, bins = np.array(self.read(f"margins-{number - 1}", np.float64, *shape)), self.bins()
                for i in range(0, self.rows, SLICE):
                    for m, trees in enumerate(last or []):
                        trees.added(margin[m, :, i : i + SLICE], bins[:, i : i + SLICE])
                self.write(f"margins-{number}", margin)
            y, w = self.read("learned", np.float64, 2, self.rows)
            hashes, member = self.read("learned", np.int64, 2, self.rows, offset=16 * self.rows)
            used = drawn_rows(hashes, number, settings)
            seen = np.stack([used & ((member >> m) & 1 == 1) for m in range(self.models)])
            both = np.empty(shape, np.complex128)
            for i in range(0, self.rows, SLICE):
                at = slice(i, i + SLICE)
                for m in range(self.models):
                    both[m, :, at] = _both(*objective.derivatives(margin[m, :, at], y[at], w[at]))
            self.write(name, both, seen)
            self.remove(f"margins-{number - 2}")
            self.remove(f"round-{number - 1}")
        size = 16 * self.models * self.classes * self.rows
        return self.read(name, np.complex128, *shape), self.read(name, np.bool_, self.models, self.rows, offset=size)


def _stored(name: str, bases: list[float], classes: int, past: list[Trees], number: int) -> Callable:
    def store(rows: Iterator) -> Iterator[Stored]:
        # The executor's own folders, which go with it.
        folders = os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")
        for i, row in enumerate(rows):
            folder = f"{folders[i % len(folders)]}/{name}"
            os.makedirs(folder, exist_ok=True)
            stored = Stored.of(Block.of(row.asDict(), len(bases), classes), folder, bases, classes, past, number)
            yield stored if i else replace(stored, filler=bytes(FILLER))

    return store


def _removed(blocks: Iterator[Stored]) -> Iterator[int]:
    """Removes the folders that a fit's blocks lie in."""
    for folder in {os.path.dirname(block.path) for block in blocks}:
        shutil.rmtree(folder, ignore_errors=True)
    return iter(())


#: What a task gives whose blocks are not where it runs.
LOST = (-1, -1, -1)


def _sums(
    now: list[Trees], last: list[Trees] | None, wanted: dict[tuple[int, int], np.ndarray], number: int, depth: int, objective: Objective, settings: TreeSettings
) -> Callable:
    """Sums per (model, class, feature) of a partition's blocks, an array (slot, bin), for the wanted nodes at ``depth``.

    ``now`` are the trees of round ``number``, one per class, ``last`` those of
    the round before. ``wanted`` gives each place at ``depth`` its slot, or -1.
    """

    def sums(blocks: Iterator[Stored]) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
        added: dict[tuple[int, int], np.ndarray] = {}
        chosen, lost = np.zeros(0, np.int64), False
        for block in blocks:
            try:
                both, seen = block.round(number, last, objective, settings)
                bins = block.bins()
            except FileNotFoundError:
                lost = True
                continue
            chosen = drawn_features(block.features, number, settings)
            for i in range(0, block.rows, SLICE):
                at = slice(i, i + SLICE)
                part = bins[:, at]
                for (m, k), slots in wanted.items():
                    slot = slots.take(_places(now[m].feature[k], now[m].cut[k], part, depth))
                    rows = np.flatnonzero(seen[m, at] & (slot >= 0))
                    if (m, k) not in added:
                        added[m, k] = np.zeros((len(chosen), (int(slots.max()) + 1) * BINS), np.complex128)
                    _add_sums(added[m, k], chosen, part, rows, slot.take(rows), both[m, k, at].take(rows))
        if lost:
            yield LOST, np.zeros(0)
            return
        for (m, k), found in added.items():
            for f, of_feature in enumerate(found):
                yield (m, k, f), of_feature.reshape(-1, BINS)

    return sums


def _grown_by_jobs(blocks: DataFrame, bases: list[float], objective: Objective, settings: TreeSettings) -> list[Trees]:
    """Plain jobs on blocks that lie in files of the executors: a plan per level would cost more than the sums, and the driver keeps each
    one's description.

    Spark keeps where the blocks are and runs tasks there. A task that does not find its blocks says so; then all are written
    anew from the table of blocks, with margins by the trees so far, and the level is done again.
    """
    spark = blocks.sparkSession
    models, classes = len(bases), objective.classes
    grown = [Trees.empty(settings.rounds * classes, settings.depth) for _ in bases]
    tasks, name = spark.sparkContext.defaultParallelism, f"gbt-{uuid4().hex}"

    def written(number: int) -> RDD:
        past = [t.part(slice(0, number * classes)) for t in grown]
        return blocks.repartition(tasks).rdd.mapPartitions(_stored(name, bases, classes, past, number)).persist(KEPT)

    state = written(0)
    try:
        features = max(state.map(lambda block: block.features).collect())
        for number in range(settings.rounds):
            of_round, before = (slice(n * classes, (n + 1) * classes) for n in (number, number - 1))
            last = [t.part(before) for t in grown] if number else None
            chosen = drawn_features(features, number, settings)
            # Open nodes by their places, and their sums in this order.
            open_slots = {(m, k): [0] for m in range(models) for k in range(classes)}
            summed: dict[tuple[int, int], np.ndarray] = {}
            small = {x: [0] for x in open_slots}
            for d in range(settings.depth):
                wanted = {}
                for x, slots in small.items():
                    wanted[x] = np.full(2**d, -1, np.int16)
                    wanted[x][slots] = np.arange(len(slots))
                job = _sums([t.part(of_round) for t in grown], last, wanted, number, d, objective, settings)
                size = 16 * BINS * len(chosen) * sum(map(len, small.values()))
                while (found := _added_up(state, job, tasks, size)) is None:
                    state.unpersist()
                    state = written(number)
                for x, slots in small.items():
                    sums = np.zeros((len(slots), len(chosen), BINS), np.complex128)
                    for f in range(len(chosen)):
                        if (*x, f) in found:
                            sums[:, f] = found[*x, f]
                    if d:
                        # Children of one parent are neighbours; the other one's sums are what remains of the parent's.
                        parents = [open_slots[x].index(s // 2) for s in slots]
                        both = np.empty((2 * len(slots), *sums.shape[1:]), np.complex128)
                        at = np.arange(len(slots)) * 2 + np.array(slots) % 2
                        both[at], both[at ^ 1] = sums, summed[x][parents] - sums
                        sums = both
                    summed[x] = sums
                open_slots = {x: sorted({s for c in slots for s in ((c, c ^ 1) if d else (c,))}) for x, slots in small.items()}
                small = {}
                for (m, k), slots in open_slots.items():
                    splits = dict(zip(slots, _best_cuts(summed[m, k], chosen, objective.unit, settings), strict=True))
                    _set_level(grown[m], number * classes + k, d, splits, settings)
                    if lighter := [2 * slot + (s.h - s.left_h < s.left_h) for slot, s in splits.items() if s.feature >= 0]:
                        small[m, k] = lighter
                if not small:
                    break
            if (number + 1) % REFRESH == 0:
                # Files of shuffles that are done go when the driver collects its garbage.
                spark.sparkContext._jvm.System.gc()
    finally:
        with suppress(Exception):
            state.mapPartitions(_removed).count()
        state.unpersist()
    return grown


def _added_up(state: RDD, job: Callable, tasks: int, size: int) -> dict[tuple[int, int, int], np.ndarray] | None:
    """The sums of all blocks, ``size`` bytes, or None where blocks are lost."""
    sums, found = state.mapPartitions(job), {}
    if size * tasks > SENT_BYTES:
        sums = sums.reduceByKey(np.add, tasks)
    for x, part in sums.collect():
        if x == LOST:
            return None
        found[x] = found[x] + part if x in found else part
    return found


# -- fitting and scoring ----------------------------------------------------


def number_array(features: Sequence[str]) -> Column:
    """The features as one array; null and NaN count 0."""
    return F.array(*[F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features])


def fit_boosted(
    rows: DataFrame,
    features: Sequence[str],
    target: Column,
    kind: str,
    settings: TreeSettings,
    *,
    classes: int = 1,
    weight: Column | None = None,
    members: Sequence[Column] | None = None,
    key: Sequence[str] = ("id",),
    limits: Limits = LIMITS,
) -> list[Boosted]:
    """One model per entry of ``members``, which tells the rows that the model learns from; without it one model of all rows.

    ``kind`` is ``squared``, ``logistic`` (target 0 or 1) or ``softmax``
    (target 0 to ``classes - 1``). ``key`` names what rows are drawn by: rows
    with equal keys are drawn together. Rows whose target is null are left out.
    """
    spark = ship_package(rows.sparkSession)
    members = [F.lit(True)] if members is None else list(members)
    if not 0 < len(members) <= MOST_MODELS:
        raise ValueError(f"between 1 and {MOST_MODELS} models at once")
    bits = [F.when(F.coalesce(m, F.lit(False)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, m in enumerate(members)]
    member = bits[0]
    for b in bits[1:]:
        member = member.bitwiseOR(b)
    used = materialize(
        rows.where(target.isNotNull()).select(
            number_array(features).alias("_x"),
            target.cast("double").alias("_y"),
            (F.lit(1.0) if weight is None else weight.cast("double")).alias("_w"),
            F.xxhash64(*key).alias("_hash"),
            member.alias("_member"),
        )
    )
    total, largest = used.agg(F.count(F.lit(1)), F.max(F.abs("_y"))).first()
    if not total:
        raise ValueError("no rows to learn from")
    unit = 2.0 ** frexp(largest)[1] if kind == "squared" and largest else 1.0
    objective = Objective(kind, classes, unit)
    bases = [0.0] * len(members)
    if kind == "squared":
        whole = F.round(F.col("_y") * (STEPS / unit)).cast("long")
        has = [F.col("_member").bitwiseAND(F.lit(1 << i)) != 0 for i in range(len(members))]
        sums = used.agg(*[F.struct(F.sum(F.when(x, whole)).alias("s"), F.count_if(x).alias("n")) for x in has]).first()
        bases = [(s["s"] or 0) / max(1, s["n"]) * (unit / STEPS) for s in sums]
    bounds = _bounds(used, len(features), total)
    block_rows = max(1, limits.block_bytes // (len(features) + 32))
    # Of several blocks each task gets some.
    each = block_rows if total <= block_rows else min(block_rows, max(4096, total // (4 * spark.sparkContext.defaultParallelism)))
    packed = (used.coalesce(1) if total <= block_rows else used).mapInPandas(_packed(bounds, each), _BLOCK)
    grow = _grown_in_tasks if total <= block_rows else _grown_by_jobs
    grown = grow(materialize(packed), bases, objective, settings)
    return [Boosted(tuple(features), bounds, objective, base, trees) for base, trees in zip(bases, grown, strict=True)]


def margins(models: Sequence[Boosted], which: Column | None = None) -> Column:
    """Margins per class of the model ``which`` (the first by default), as an array; null where ``which`` is null."""
    features = models[0].features

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, model in batches:
            values = np.array(x.to_list(), np.float64).reshape(len(x), len(features))
            out: list = [None] * len(x)
            numbers = model.fillna(-1).to_numpy(np.int64)
            for m in np.unique(numbers[numbers >= 0]):
                at = np.flatnonzero(numbers == m)
                for i, row in zip(at, models[m].margins(values[at]).T.tolist(), strict=True):
                    out[i] = row
            yield pd.Series(out, dtype=object)

    return scored(number_array(features), F.lit(0).cast("int") if which is None else which.cast("int"))
