"""Merkle manifest of a dataset: a hash tree over the rows of each source, and one over the sources.

Three neighbouring nodes give their parent, the digest of their digests as
text. A source's rows are cut into aligned blocks of ``3**height`` leaves. A
block is a complete subtree, stored as one binary in van Emde Boas order: the
upper half of its levels first, then the subtrees below it one after another,
each laid out the same way. :func:`address` computes a node's place from depth
and index alone; construction and sibling retrieval both go through it. The
roots of a source's blocks are the leaves of the next table of blocks, until
each source has one root; the roots of the sources go through the same steps.
So no task holds more than a block, and the tables of blocks shrink by
``3**height`` from one to the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustwatch.llm.common import Scratch, for_python

# Fixed values of the tree.
ARITY = 3
DIGEST = 32

#: Levels of a block below its root: 2,187 leaves, about 100 kB.
HEIGHT = 7


def nodes_of(levels: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Places of the nodes ``index`` at ``depth`` in the layout of a tree of ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return address(depth, index, upper)
    subtree, inside = np.divmod(index, ARITY ** (depth - upper))
    return nodes_of(upper) + subtree * nodes_of(levels - upper) + address(depth - upper, inside, levels - upper)


def height_of(leaves: int) -> int:
    """Levels below the root of the smallest tree that holds so many leaves."""
    height = 0
    while ARITY**height < leaves:
        height += 1
    return height


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


class Block:
    """A subtree of ``height`` levels over ``n`` leaves; nodes that the last leaves leave out do not exist."""

    def __init__(self, n: int, height: int, nodes: bytes | None = None) -> None:
        self.n, self.height, self.levels = n, height, height + 1
        size = nodes_of(self.levels)
        self.nodes = np.zeros((size, DIGEST), np.uint8) if nodes is None else np.frombuffer(nodes, np.uint8).reshape(size, DIGEST)

    def count(self, depth: int) -> int:
        return -(-self.n // ARITY ** (self.height - depth))

    def places(self, depth: int) -> np.ndarray:
        return address(depth, np.arange(self.count(depth)), self.levels)

    def texts(self, depth: int) -> list[str]:
        """The digests at ``depth`` as text, in order."""
        packed = self.nodes[self.places(depth)].tobytes().hex()
        return [packed[i : i + 2 * DIGEST] for i in range(0, len(packed), 2 * DIGEST)]

    def put(self, depth: int, digests: Sequence[bytes]) -> None:
        self.nodes[self.places(depth)] = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, DIGEST)

    @classmethod
    def build(cls, leaves: Sequence[bytes], height: int) -> Block:
        block = cls(len(leaves), height)
        block.put(height, leaves)
        for depth in range(height - 1, -1, -1):
            below = block.texts(depth + 1)
            runs = ("".join(below[i : i + ARITY]) for i in range(0, len(below), ARITY))
            block.put(depth, [hashlib.sha256(r.encode("ascii")).digest() for r in runs])
        return block

    def root(self) -> bytes:
        return self.nodes[0].tobytes()

    def paths(self, above: str) -> list[str]:
        """Per leaf, the siblings of each level up to the root: those to the left, a comma, those to the right, a semicolon."""
        paths = [above]
        for depth in range(1, self.levels):
            texts = self.texts(depth)
            paths = [
                f"{''.join(texts[i - i % ARITY : i])},{''.join(texts[i + 1 : i - i % ARITY + ARITY])};{paths[i // ARITY]}"
                for i in range(len(texts))
            ]
        return paths


def proof(path: str) -> str:
    """Digest of all siblings of a path, level by level, left to right."""
    return _digest(path.replace(",", "").replace(";", ""))


def folded(leaf: str, path: str) -> str:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    for level in path.split(";")[:-1]:
        left, right = level.split(",")
        leaf = _digest(left + leaf + right)
    return leaf


_BUILT = T.StructType([T.StructField("root", T.BinaryType()), T.StructField("nodes", T.BinaryType())])
_PROVED = T.ArrayType(T.StructType([T.StructField("proof", T.StringType()), T.StructField("folded", T.StringType())]))


@F.pandas_udf(_BUILT)
def _build(leaves: pd.Series, heights: pd.Series) -> pd.DataFrame:
    blocks = [Block.build(list(x), h) for x, h in zip(leaves, heights, strict=True)]
    return pd.DataFrame({"root": [b.root() for b in blocks], "nodes": [b.nodes.tobytes() for b in blocks]})


@F.pandas_udf(T.ArrayType(T.StringType()))
def _paths(n: pd.Series, heights: pd.Series, nodes: pd.Series, above: pd.Series) -> pd.Series:
    return pd.Series([Block(*x).paths(a) for *x, a in zip(n, heights, nodes, above, strict=True)], dtype=object)


@F.pandas_udf(_PROVED)
def _prove(n: pd.Series, heights: pd.Series, nodes: pd.Series, above: pd.Series, shown: pd.Series) -> pd.Series:
    out = []
    for *x, a, digests in zip(n, heights, nodes, above, shown, strict=True):
        paths = Block(*x).paths(a)
        out.append([{"proof": proof(p), "folded": folded(d.hex(), p)} for p, d in zip(paths, digests, strict=True)])
    return pd.Series(out, dtype=object)


def leaf_digest(*columns: Column) -> Column:
    """Digest, as bytes, of the columns as text: ``-`` for null, else the UTF-8 byte count, a colon, the value."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _height(total: Column, height: int) -> Column:
    """Levels of the block of a group of ``total`` nodes."""
    steps = F.lit(0)
    for h in range(height):
        steps = steps + (total > ARITY**h).cast("int")
    return steps


def ranked(rows: DataFrame, order: Sequence[str], scratch: Scratch) -> DataFrame:
    """``rank`` from 0 within ``group`` by ``order``, and ``total``, the group's rows.

    Rows are range-partitioned by group and order, so a large group is spread
    over many tasks; a rank is the rank within the task plus the rows of the
    group before it, one number per task and group.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = scratch.write(rows.repartitionByRange(tasks, "group", *order).withColumn("__task", F.spark_partition_id()))
    earlier = Window.partitionBy("group").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        ranges.groupBy("group", "__task")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(
            "group",
            "__task",
            F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
            F.sum("__n").over(Window.partitionBy("group")).alias("total"),
        )
    )
    within = Window.partitionBy("group", "__task").orderBy(*order)
    return (
        ranges.join(sizes, ["group", "__task"])
        .withColumn("rank", F.row_number().over(within) - 1 + F.col("__before"))
        .drop("__task", "__before")
    )


@dataclass(frozen=True)
class Forest:
    """Trees of groups: ``levels`` are the tables of blocks, from the leaves up; ``roots`` has a row per group."""

    levels: list[DataFrame]
    roots: DataFrame
    height: int


def plant(nodes: DataFrame, scratch: Scratch, height: int = HEIGHT, payload: Sequence[str] = ()) -> Forest:
    """Trees over ``nodes`` (group, rank, total, digest); the first table of blocks also keeps the ``payload`` columns in arrays."""
    for_python(nodes.sparkSession)
    levels: list[DataFrame] = []
    roots: list[DataFrame] = []
    width = ARITY**height
    while True:
        kept = ["digest", *(payload if not levels else ())]
        member = F.sort_array(F.collect_list(F.struct("rank", *kept)))
        blocks = (
            nodes.groupBy("group", "total", F.floor(F.col("rank") / width).alias("block"))
            .agg(member.alias("m"))
            .select(
                "group",
                "total",
                "block",
                F.size("m").alias("n"),
                _height(F.col("total"), height).alias("height"),
                *[F.col(f"m.{c}").alias(c) for c in kept],
            )
        )
        built = blocks.withColumn("__b", _build("digest", "height"))
        built = scratch.write(built.select(*blocks.columns, F.col("__b.root").alias("root"), F.col("__b.nodes").alias("nodes")))
        levels.append(built)
        roots.append(built.where(F.col("total") <= width).select("group", F.col("root").alias("digest")))
        nodes = built.where(F.col("total") > width).select(
            "group", F.ceil(F.col("total") / width).alias("total"), F.col("block").alias("rank"), F.col("root").alias("digest")
        )
        if nodes.isEmpty():
            break
    all_roots = roots[0]
    for more in roots[1:]:
        all_roots = all_roots.unionByName(more)
    return Forest(levels, all_roots, height)


def _with_paths(forest: Forest, level: int, top: DataFrame) -> DataFrame:
    """The blocks of ``level`` with ``above``, the path from their root up, and the columns of ``top`` (group, above, ...)."""
    blocks, width = forest.levels[level], ARITY**forest.height
    found = blocks.where(F.col("total") <= width).join(top, "group")
    if level + 1 == len(forest.levels):
        return found
    upper = _with_paths(forest, level + 1, top)
    paths = upper.select(
        "group",
        F.col("block").alias("__over"),
        *[c for c in top.columns if c not in ("group", "above")],
        F.posexplode(_paths("n", "height", "nodes", "above")).alias("__at", "above"),
    )
    paths = paths.withColumn("block", F.col("__over") * width + F.col("__at")).drop("__over", "__at")
    return found.unionByName(blocks.where(F.col("total") > width).join(paths, ["group", "block"]).select(found.columns))


def manifest(docs: DataFrame, group: str, order: str, leaf: Column, shown: Column, scratch: Scratch, height: int = HEIGHT) -> DataFrame:
    """A row per row of ``docs``: order column, leaf, subroot, root, proof, folded (what ``shown`` gives with the siblings of ``leaf``).

    ``leaf`` and ``shown`` are digests as bytes, such as :func:`leaf_digest`
    makes. A group's leaves stand in the order of ``order``, nulls first; rows
    with equal values there stand in the order of their digests, so that
    repeated rows give equal leaves in neighbouring places. Groups stand in the
    order of their names as bytes, null first. Nulls and empty texts in other
    columns are the business of the two digests. Other columns are not read.
    An empty table gives no rows.
    """
    # A name of its own for null, before all others.
    name = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    rows = docs.select(name.alias("group"), F.col(order).alias("id"), leaf.alias("digest"), shown.alias("shown"))
    forest = plant(ranked(rows, ["id", "digest", "shown"], scratch), scratch, height, payload=["id", "shown"])
    tops = forest.roots.select(F.lit("").alias("group"), F.col("group").alias("name"), "digest")
    crown = plant(ranked(tops, ["name"], scratch), scratch, height, payload=["name"])
    over = _with_paths(crown, 0, crown.roots.select("group", F.lit("").alias("above"), F.col("digest").alias("root_of_all")))
    trees = over.select(
        F.explode(F.arrays_zip("name", "digest", _paths("n", "height", "nodes", "above").alias("above"))).alias("t"), "root_of_all"
    )
    top = scratch.write(trees.select(F.col("t.name").alias("group"), F.col("t.digest").alias("subroot"), F.col("t.above").alias("above"), "root_of_all"))
    proved = _with_paths(forest, 0, top).withColumn("p", _prove("n", "height", "nodes", "above", "shown"))
    return proved.select(
        F.explode(F.arrays_zip("id", "digest", "p")).alias("t"), "subroot", "root_of_all"
    ).select(
        F.col("t.id").alias(order),
        F.lower(F.hex("t.digest")).alias("leaf"),
        F.lower(F.hex("subroot")).alias("subroot"),
        F.lower(F.hex("root_of_all")).alias("root"),
        F.col("t.p.proof").alias("proof"),
        F.col("t.p.folded").alias("folded"),
    )
