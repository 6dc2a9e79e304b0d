"""Periodic runs against the plain definition: every lag, every stretch."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_frames import awkward, clashing, empty

from gustwatch.llm.periodic_runs import MIN_PERIODS, MIN_WORDS, add_runs, collapsed, find_runs


def plain_runs(words):
    spans = {}
    for q in range(1, len(words) // MIN_PERIODS + 1):
        at = q
        while at < len(words):
            end = at
            while end < len(words) and words[end] == words[end - q]:
                end += 1
            if end - at + q >= max(MIN_WORDS, MIN_PERIODS * q):
                spans[at - q, end] = min(q, spans.get((at - q, end), q))
            at = end + 1
    return sorted(((s, e - s, q) for (s, e), q in spans.items()), key=lambda r: (r[0], r[2]))


def found(words):
    return [(r.start, r.length, r.period) for r in find_runs(np.array(words, np.int64))]


pieces = st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 7), st.integers(0, 40))


@settings(max_examples=400, deadline=None)
@given(st.lists(pieces, max_size=5))
def test_like_the_definition(parts):
    words = [w for block, times, cut in parts for w in (block * times)[: len(block) * times - cut % (len(block) + 1)]]
    assert found(words) == plain_runs(words)


@pytest.mark.parametrize("period", [1, 2, 7, 8, 15, 16, 17, 31, 32, 33, 100])
@pytest.mark.parametrize("times", [3, 5])
def test_every_period(period, times):
    words = [-1, *(list(range(period)) * max(times, -(-MIN_WORDS // period))), -2]
    assert found(words) == [(1, len(words) - 2, period)]


def test_nested_runs_and_their_shortest_period():
    inner = [1, 2] * 12 + [3]
    words = inner * 4
    assert found(words) == plain_runs(words)
    assert (0, 100, 25) in found(words) and (0, 24, 2) in found(words)


def test_long_text_of_one_word():
    assert found([0] * 200_000) == [(0, 200_000, 1)]


def test_collapsed_keeps_first_period():
    words = [b"x", *([b"a", b"b"] * 12), b"y"]
    runs = find_runs(np.array([{b"x": 0, b"a": 1, b"b": 2, b"y": 3}[w] for w in words]))
    assert collapsed(words, runs) == [b"x", b"a", b"b", b"y"]


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = add_runs(docs).select("doc_id", "text", "__runs.*").collect()
    assert len(rows) == docs.count()
    for r in rows:
        words = (r["text"] or "").encode().split()
        ids = [sorted(set(words)).index(w) for w in words]
        assert r["n_words"] == len(words)
        if len(words) < 1000:
            assert [tuple(x) for x in r["runs"]] == plain_runs(ids)
        if not r["runs"]:
            assert r["collapsed"] == " ".join(w.decode() for w in words)
    other = add_runs(clashing(docs)).select("doc_id", "text", "__runs.*").collect()
    assert sorted(map(str, other)) == sorted(map(str, rows))
    assert add_runs(empty(spark)).count() == 0
