"""Repeated passages: results do not depend on the number of ranges, ids keep their type, nothing is left behind."""

import numpy as np
import pytest
from llm_frames import SCHEMA

from gustwatch.llm import repeated_passages
from gustwatch.llm.repeated_passages import Passages, pack, range_bits, unpack


def test_one_more_bit_whenever_the_text_doubles():
    how = Passages()
    bits = [range_bits(total, how) for total in (0, 1 << 30, 8 << 30, (8 << 30) + 256, 16 << 30, 1 << 40, 100 << 40)]
    assert bits == [8, 8, 8, 9, 9, 15, 22]
    for total in (1 << 34, 3 << 35, 1 << 40, 100 << 40):
        per_range = total >> range_bits(total, how)
        assert how.range_bytes // 2 <= per_range <= how.range_bytes


@pytest.mark.parametrize("bits", [8, 9, 15, 16, 17, 24])
def test_packed_names_stay_comparable(bits):
    names = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 500, dtype=np.uint64) >> np.uint64(bits)) | np.uint64(5 << (64 - bits))
    found = unpack(pack(names, bits), bits)
    kept = np.uint64((1 << (64 - bits // 8 * 8)) - 1)
    assert (found == (names & kept)).all() and len(pack(names, bits)) == len(names) * (8 - bits // 8)
    empty = np.empty(0, np.uint64)
    assert len(unpack(pack(empty, bits), bits)) == 0


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared = [word(400) for _ in range(5)]
    return [word(300) + shared[k % 5][k % 7 :] + word(200) if k % 2 else word(700) for k in range(80)]


def _found(spark, texts, how):
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], SCHEMA)
    return sorted(map(tuple, repeated_passages.remove_repeats(docs.repartition(2), how).collect()))


@pytest.mark.parametrize("bits", [9, 11])
def test_same_result_at_any_number_of_ranges(spark, texts, bits):
    total = sum(map(len, texts))
    how = Passages(unit_bytes=20_000, range_bytes=total >> bits)
    assert range_bits(total, how) == bits
    plain = _found(spark, texts, Passages(unit_bytes=20_000))
    assert _found(spark, texts, how) == plain
    assert any(r[2] for r in plain)


def test_buckets_follow_the_bytes(spark, texts):
    assert _found(spark, texts, Passages(unit_bytes=5_000, bucket_bytes=4_000)) == _found(spark, texts, Passages())


def test_string_ids_and_no_table_left(spark, texts):
    before = {t.name for t in spark.catalog.listTables()}
    docs = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)] + [(None, None)], "doc_id string, text string")
    found = repeated_passages.remove_repeats(docs).collect()
    assert {r["doc_id"] for r in found} == {None, *[f"d{k}" for k in range(len(texts))]}
    assert {t.name for t in spark.catalog.listTables()} == before
