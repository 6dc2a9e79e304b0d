"""Scores of the backoff automaton against counts in dictionaries and the recursive formula."""

import math
import random
from collections import Counter
from dataclasses import replace

import pytest
from llm_frames import awkward, clashing, empty
from pyspark.sql import functions as F

from gustwatch.llm.lm_scoring import MODEL, _packed, _unpacked, score_texts

END = "\n"


def words(text):
    return (text or "").translate({i: chr(i + 32) for i in range(65, 91)}).split(" ") if text else []


def plain(rows, how):
    """Of (id, text, train): the scores by the formula."""
    count = Counter()
    for _, text, train in rows:
        seq = [*(w for w in words(text) if w), END]
        if train:
            for n in range(1, how.order + 1):
                count.update(tuple(seq[i : i + n]) for i in range(len(seq) - n + 1))
    size = sum(c for g, c in count.items() if len(g) == 1)
    kinds = sum(len(g) == 1 for g in count)

    def chance(gram):
        if len(gram) == 1:
            return (count[gram] + 1) / (size + kinds + 1)
        lower, context = chance(gram[1:]), count[gram[:-1]]
        return (count[gram] + how.mass * lower) / (context + how.mass) if context >= how.min_context else lower

    out = []
    for key, text, train in rows:
        seq = [*(w for w in words(text) if w), END]
        grams = [tuple(seq[max(0, i - how.order + 1) : i + 1]) for i in range(len(seq))]
        base = sum(math.log10(chance((w,))) for w in seq)
        out.append((key, train, len(seq), sum(count[(w,)] > 0 for w in seq), size, base, sum(math.log10(chance(g)) for g in grams)))
    return out


def close(found, want):
    assert len(found) == len(want)
    for a, b in zip(sorted(found, key=str), sorted(want, key=str), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def corpus(n, seed=3):
    pick = random.Random(seed)
    kinds = ["a", "b", "B", "c", "über", "漢", "the", "of"] + [f"w{i}" for i in range(40)]
    return [(i, " ".join(pick.choices(kinds, k=pick.randrange(0, 60))), pick.random() < 0.8) for i in range(n)]


@pytest.mark.parametrize(("order", "unit_bytes"), [(1, 10_000), (2, 500), (3, 500), (3, 1_000_000), (4, 500)])
def test_like_the_formula(spark, order, unit_bytes):
    how = replace(MODEL, order=order, unit_bytes=unit_bytes, bucket_bytes=4000, range_bytes=40)
    rows = corpus(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    close([tuple(r) for r in score_texts(docs, "doc_id", F.col("train"), how).collect()], plain(rows, how))


def test_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b", False), (2, None, None)], "doc_id long, text string, train boolean")
    found = {r["doc_id"]: (r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in score_texts(docs, "doc_id", F.col("train")).collect()}
    assert found == {1: (3, 0, 0, 0.0), 2: (1, 0, 0, 0.0)}


def test_awkward_rows(spark):
    docs = awkward(spark)
    plain_docs = score_texts(docs, "doc_id", F.col("doc_id") != 9).collect()
    assert len(plain_docs) == docs.count()
    assert sorted(r["n_tokens"] for r in plain_docs)[:4] == [1, 1, 1, 1]
    other = score_texts(clashing(docs).withColumn("id", F.lit(1)).withColumn("train", F.lit("x")), "doc_id", F.col("doc_id") != 9)
    assert sorted(map(str, other.collect())) == sorted(map(str, plain_docs))
    assert score_texts(empty(spark), "doc_id", F.lit(True)).count() == 0


def test_packing():
    import numpy as np

    for values in ([], [0], [1, 255, 256, 2**40], [2**56 - 1, 0]):
        packed = _packed(np.array(values, np.int64).astype(np.uint64))
        assert _unpacked(packed, len(values)).tolist() == values
