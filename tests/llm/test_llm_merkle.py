"""The manifest against a tree built level by level in plain Python."""

import hashlib

import numpy as np
import pytest
from llm_frames import awkward, clashing, empty
from pyspark.sql import functions as F

from gustwatch.llm.common import Scratch
from gustwatch.llm.merkle_manifest import Block, address, folded, height_of, leaf_digest, manifest, nodes_of, proof


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ladder(leaves):
    """All levels from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 3])) for i in range(0, len(below), 3)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 3 * 3 : i // 3 * 3 + 3]
        out.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        i //= 3
    return out


@pytest.mark.parametrize("levels", range(1, 8))
def test_address_is_a_layout(levels):
    places = np.concatenate([address(d, np.arange(3**d), levels) for d in range(levels)])
    assert sorted(places.tolist()) == list(range(nodes_of(levels))) and places[0] == 0
    if levels > 3:  # subtrees below the upper half are contiguous
        upper, lower = levels // 2, levels - levels // 2
        first = sorted(int(address(upper + d, np.array([i]), levels)[0]) for d in range(lower) for i in range(3**d))
        assert first == list(range(nodes_of(upper), nodes_of(upper) + nodes_of(lower)))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 80])
def test_block_like_a_plain_tree(n):
    leaves = [sha(str(i)) for i in range(n)]
    levels = ladder(leaves)
    block = Block.build([bytes.fromhex(x) for x in leaves], height_of(n))
    assert block.root().hex() == levels[-1][0]
    for i, path in enumerate(block.paths("")):
        assert path == "".join(f"{a},{b};" for a, b in siblings(levels, i))
        assert folded(leaves[i], path) == levels[-1][0]
        assert proof(path) == sha("".join(a + b for a, b in siblings(levels, i)))


def expected(rows):
    """Of (id, source, leaf, shown) rows: id, leaf, subroot, root, proof, folded."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])):
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    ladders = {g: ladder([r[2] for r in groups[g]]) for g in order}
    top = ladder([ladders[g][-1][0] for g in order]) if order else []
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            sides = siblings(ladders[g], i) + siblings(top, k)
            x = r[3]
            for a, b in sides:
                x = sha(a + x + b)
            out.append((r[0], r[2], ladders[g][-1][0], top[-1][0], sha("".join(a + b for a, b in sides)), x))
    return sorted(out, key=str)


def run(spark, docs, height, shown="text"):
    scratch = Scratch(spark)
    leaf = leaf_digest(F.col("doc_id"), F.col("source"), F.col("text"))
    other = leaf_digest(F.col("doc_id"), F.col("source"), F.col(shown))
    rows = manifest(docs, "source", "doc_id", leaf, other, scratch, height).collect()
    scratch.drop()
    return sorted((tuple(r) for r in rows), key=str)


def plain_leaf(*values):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return sha("".join(parts))


@pytest.mark.parametrize("height", [1, 2, 7])
def test_several_tables_of_blocks(spark, height):
    sizes = {None: 1, "": 2, "b": 200, "a": 31, "ä": 3, **{f"s{i}": 1 for i in range(12)}}
    rows, at = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((at * 7 % 1000, source, f"text {at}", f"other {at}" if at % 3 else f"text {at}"))
            at += 1
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, later string").repartition(5)
    want = expected([(i, s, plain_leaf(i, s, t), plain_leaf(i, s, o)) for i, s, t, o in rows])
    found = run(spark, docs, height, "later")
    assert found == want
    assert sum(r[5] == r[3] for r in found) == sum(t == o for _, _, t, o in rows)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["source"], plain_leaf(r["doc_id"], r["source"], r["text"])) for r in docs.collect()]
    want = expected([(*r, r[2]) for r in rows])
    assert run(spark, docs, 1) == want
    assert run(spark, clashing(docs).withColumn("group", F.lit(1)).withColumn("rank", F.lit("x")), 7) == want
    assert run(spark, empty(spark), 7) == []
