"""Near duplicates by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustwatch.llm.common import Scratch, for_python, tokens, whole
from gustwatch.llm.components import components
from gustwatch.session import materialize


@dataclass(frozen=True)
class Near:
    """Link texts whose shingle sets share at least ``percent`` of their union.

    ``bands`` of ``rows`` coordinates: at 85 % a link is missed by all bands
    with a chance of 2e-8, at 80 % of 4e-6.
    """

    words: int = 3
    percent: int = 85
    bands: int = 24
    rows: int = 4
    #: Size of the universe that the two permutations act on.
    slots: int = 1 << 21
    seed: int = 11
    cache_words: int = 300_000
    #: Rounds of comparing a bucket's members with one centre, at most, before what remains apart is compared in blocks.
    rounds: int = 3
    #: Another round follows while one links at least this share of the pairs it compared.
    worth: float = 0.05
    #: Shingles of a block of the last comparison (about half a MB); each node counts as ``node_shingles`` more, which bounds a block's nodes.
    block_shingles: int = 60_000
    node_shingles: int = 100


NEAR = Near()


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles; fewer words than a shingle count as one shingle."""

    def __init__(self, how: Near) -> None:
        self.words, self.limit = how.words, how.cache_words
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        found, known = tokens(text), self.known
        if len(known) > self.limit:
            known.clear()
        for word in set(found):
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word)
        if not found:
            return np.empty(0, np.uint64)
        hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        width = min(self.words, len(found))
        total = np.full(len(found) - width + 1, width, np.uint64)
        for k in range(width):
            total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(found) - width + 1 + k])
        return np.unique(total)


class Circulant:
    """Signatures of circulant MinHash: coordinate k is the least of pi, shifted by k, over sigma of the set.

    The coordinates of one element are neighbours in pi, so a signature is the
    minimum over slices of one array.
    """

    def __init__(self, how: Near) -> None:
        random = np.random.default_rng(how.seed)
        self.how, self.size = how, how.bands * how.rows
        self.sigma = random.permutation(how.slots).astype(np.uint32)
        pi = random.permutation(how.slots).astype(np.uint32)
        self.slices = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: self.size]]), self.size)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        places = self.sigma[(shingles % np.uint64(self.how.slots)).astype(np.int64)]
        least = np.full(self.size, self.how.slots, np.uint32)
        for at in range(0, len(places), 1024):
            np.minimum(least, self.slices[places[at : at + 1024]].min(axis=0), out=least)
        return least

    def bands(self, shingles: np.ndarray) -> list[int]:
        """One key per band; the band's number is part of it."""
        signature = self(shingles).astype(np.uint64).reshape(self.how.bands, self.how.rows)
        key = np.arange(1, self.how.bands + 1, dtype=np.uint64)
        for k in range(self.how.rows):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, k])
        return key.view(np.int64).tolist()


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signer(how: Near):
    @F.pandas_udf("n long, node binary, bands array<long>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler, circulant = Shingler(how), Circulant(how)
        for texts in batches:
            rows = []
            for text in texts:
                shingles = shingler(text)
                rows.append((len(shingles), digest(shingles), circulant.bands(shingles) if len(shingles) else []))
            yield pd.DataFrame(rows, columns=["n", "node", "bands"])

    return sign


def _set_maker(how: Near):
    @F.pandas_udf("node binary, shingles array<long>")
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(how)
        for texts in batches:
            sets = [shingler(text) for text in texts]
            yield pd.DataFrame({"node": [digest(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]})

    return make


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, ...) whose full sets are near enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return (
        pairs.join(right, "b")
        .join(left, "a")
        .where(100 * both >= percent * (F.size("sa") + F.size("sb") - both))
        .select(*pairs.columns)
    )


def _may_link(a: Column, b: Column, percent: int) -> Column:
    """Sizes alone allow a link."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _joined_pairs(frame: pd.DataFrame, percent: int) -> list[tuple[bytes, bytes]]:
    """Pairs of components that links between rows of ``frame`` (component, shingles) join; no more than it takes to join them."""
    sizes = np.array([len(s) for s in frame["shingles"]], np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    _, codes, counts = np.unique(np.concatenate(frame["shingles"].to_numpy()), return_inverse=True, return_counts=True)
    shared = counts[codes] > 1
    rows, codes = rows[shared], codes[shared]
    order = np.argsort(codes, kind="stable")
    rows, codes = rows[order], codes[order]
    both = np.zeros((len(sizes), len(sizes)), np.float32)
    width = 4096
    _, codes = np.unique(codes, return_inverse=True)
    for first in range(0, int(codes[-1]) + 1 if len(codes) else 0, width):
        part = slice(*np.searchsorted(codes, [first, first + width]))
        held = np.zeros((len(sizes), width), np.float32)
        held[rows[part], codes[part] - first] = 1
        both += held @ held.T
    union = sizes[:, None] + sizes[None, :] - both
    near = np.argwhere(np.triu(100 * both.astype(np.float64) >= percent * union, 1))
    parent = {c: c for c in frame["component"]}

    def root(c: bytes) -> bytes:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    components_of = frame["component"].to_list()
    for i, j in near:
        x, y = root(components_of[i]), root(components_of[j])
        if x != y:
            parent[x] = y
            out.append((x, y))
    return out


def _cross_links(apart: DataFrame, sets: DataFrame, how: Near, work: Scratch) -> DataFrame:
    """Components of the buckets in ``apart`` (key, node, n, component) that links join (a, b), from all pairs across them.

    Nodes that share buckets, directly or by others, make a cluster, and a
    cluster is cut into blocks of bounded size; a component larger than a block
    has blocks of its own, which are not compared with each other. Each pair of
    a cluster's blocks is one group, compared by one product of incidence
    matrices. No pairs of nodes are emitted, only components to join.
    """
    least = apart.groupBy("key").agg(F.min("node").alias("least"))
    clusters = components(apart.join(least, "key").select("node", "least").distinct(), "node", "least")
    nodes = (
        apart.select("node", "n", "component")
        .distinct()
        .join(clusters.select(F.col("node").alias("x"), F.col("component").alias("cluster")), F.col("node") == F.col("x"))
        .drop("x")
    )
    nodes = work.write(nodes)
    whole_block = F.col("w") >= how.block_shingles
    weights = nodes.groupBy("cluster", "component").agg(F.sum(F.col("n") + how.node_shingles).alias("w"))
    homes = weights.select("cluster", "component", F.when(whole_block, F.col("component")).alias("home"), "w")
    many = homes.groupBy("cluster", "home").agg(F.ceil(F.sum("w") / how.block_shingles).alias("many"))
    placed = homes.join(
        many.select(F.col("cluster").alias("k"), F.col("home").alias("h"), "many"),
        (F.col("cluster") == F.col("k")) & F.col("home").eqNullSafe(F.col("h")),
    ).select(F.col("cluster").alias("k"), F.col("component").alias("c"), "home", "many")
    turn = F.when(F.col("home").isNull(), F.xxhash64("component")).otherwise(F.xxhash64("node"))
    blocked = work.write(
        nodes.join(placed, (F.col("cluster") == F.col("k")) & (F.col("component") == F.col("c"))).select(
            "cluster", "node", "component", "home", F.xxhash64("home", F.pmod(turn, F.col("many"))).alias("block")
        )
    )
    blocks = blocked.groupBy("cluster", "block").agg(F.max("home").alias("home"))
    other = blocks.select(F.col("cluster").alias("k"), F.col("block").alias("other"), F.col("home").alias("h"))
    same_home = F.coalesce(F.col("home") == F.col("h"), F.lit(False))
    pairs = blocks.join(other, (F.col("cluster") == F.col("k")) & (F.col("block") <= F.col("other"))).where(~same_home)
    sides = pairs.select(
        F.xxhash64("cluster", "block", "other").alias("pair"),
        F.col("cluster").alias("k"),
        F.explode(F.array_distinct(F.array("block", "other"))).alias("side"),
    )
    rows = (
        sides.join(blocked, (F.col("k") == F.col("cluster")) & (F.col("side") == F.col("block")))
        .select("pair", "node", "component")
        .join(sets, "node")
        .drop("node")
    )
    percent = how.percent

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_joined_pairs(frame, percent), columns=["a", "b"])

    return rows.groupBy("pair").applyInPandas(compare, "a binary, b binary")


def near_groups(docs: DataFrame, how: Near, work: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """(signed, steps): a row per row of ``docs`` (doc_id, n, node), and tables (node, component) that name a node's component step by step.

    A node is a distinct shingle set and its own component at first; each step
    maps components to larger ones, those it does not list stay. In the end
    they join exactly the nodes that all links of the banded candidates join.
    Not all links are looked at: in a bucket, each member is first compared
    with one centre, then with another while that pays; what is still apart is
    compared in full, in blocks. So a bucket of many copies costs its size,
    not its square, and no pair across components goes unseen.
    """
    for_python(docs.sparkSession)
    texts = docs.select("doc_id", whole().alias("text"))
    signed = work.write(texts.select("doc_id", _signer(how)("text").alias("s")).select("doc_id", "s.*"))
    nodes = signed.where(F.col("n") > 0).groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    keyed = work.write(nodes.select("node", "doc_id", "n", F.explode("bands").alias("key")))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    members = work.write(keyed.join(shared.select("key"), "key", "left_semi"))
    wanted = members.select("node", "doc_id").distinct()
    sets = work.write(
        texts.join(wanted.select(F.col("doc_id").alias("i"), F.col("node").alias("w")), F.col("doc_id").eqNullSafe(F.col("i")))
        .select("w", _set_maker(how)("text").alias("s"))
        .where(F.col("w") == F.col("s.node"))
        .select("s.*")
        .dropDuplicates(["node"])
    )
    steps = []
    apart = members.select("key", "node", "n", F.col("node").alias("component"))
    for turn in range(how.rounds):
        # Any member can be the centre; another one each round.
        chosen = F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "n", "component"))
        centres = apart.groupBy("key").agg(chosen.alias("c"))
        centres = centres.select("key", F.col("c.node").alias("cn"), F.col("c.n").alias("cs"), F.col("c.component").alias("cc"))
        mine, centre = F.struct("node", "component"), F.struct(F.col("cn").alias("node"), F.col("cc").alias("component"))
        pairs = work.write(
            apart.join(centres, "key")
            .where((F.col("component") != F.col("cc")) & _may_link(F.col("n"), F.col("cs"), how.percent))
            .select(F.greatest(mine, centre).alias("y"), F.least(mine, centre).alias("x"))
            .select(F.col("x.node").alias("a"), F.col("x.component").alias("ca"), F.col("y.node").alias("b"), F.col("y.component").alias("cb"))
            .distinct()
        )
        found = work.write(_verified(pairs, sets, how.percent))
        fresh, compared = found.count(), pairs.count()
        labelled = apart
        if fresh:
            steps.append(components(found, "ca", "cb"))
            labelled = _joined(apart, "component", steps[-1])
        # Buckets of one component are settled.
        open_keys = (
            labelled.groupBy("key")
            .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
            .where(F.col("lo") != F.col("hi"))
            .select("key")
        )
        apart = work.write(labelled.join(open_keys, "key", "left_semi"))
        if fresh < how.worth * compared or not compared:
            break
    if not apart.isEmpty():
        joined = work.write(_cross_links(apart, sets, how, work))
        if not joined.isEmpty():
            steps.append(components(joined))
    return signed, steps


def _joined(rows: DataFrame, name: str, step: DataFrame) -> DataFrame:
    """``rows`` with the components in column ``name`` as ``step`` joins them."""
    to = step.select(F.col("node").alias("_x"), F.col("component").alias("_y"))
    joined = rows.join(to, F.col(name) == F.col("_x"), "left")
    return joined.select(*[F.coalesce("_y", name).alias(name) if c == name else F.col(c) for c in rows.columns])


def near_components(docs: DataFrame, how: Near = NEAR) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest id reachable over links; ``kept`` marks
    the rows that have it. Equal shingle sets are linked, empty ones with
    nothing. Rows without an id take part by their text, but are never kept
    unless their component has no id at all, and cannot name a component.
    Repeated rows have equal results. No rows give no rows.
    """
    work = Scratch(docs.sparkSession)
    signed, steps = near_groups(docs, how, work)
    rows = signed.select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("g"))
    for step in steps:
        rows = _joined(rows, "g", step)
    rows = materialize(rows)
    work.drop()
    least = rows.where(F.col("g").isNotNull()).groupBy(F.col("g").alias("h")).agg(F.min("doc_id").alias("least"))
    named = rows.join(least, F.col("g") == F.col("h"), "left")
    component = F.when(F.col("g").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return named.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )
