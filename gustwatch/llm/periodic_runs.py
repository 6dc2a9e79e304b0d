"""Periodic runs of words: stretches that repeat with a short period, found along diagonals of equal words.

Word ``i`` lies on diagonal ``q`` when it equals word ``i - q``. A run of
period ``q`` and length ``L`` is a stretch of ``L - q`` neighbouring places on
diagonal ``q``. Reading a text from left to right, earlier occurrences open or
lengthen diagonals, and a diagonal that ends is emitted at once if it is long
enough; nothing but the open stretch of a diagonal is remembered.

The table of diagonals is kept sparse by opening them from grams instead of
single words. With ``s >= 3`` and ``k = 2**s``, periods from ``k`` to
``2 * k - 1`` (for ``s = 3`` all below 16) are opened by grams of ``k`` words,
and only by a gram's three nearest earlier occurrences. No run is missed:
among any ``q`` neighbouring places of a run of smallest period ``q`` there is
one whose local period is ``q`` (critical factorisation), so the gram around it
has no period up to ``k / 2`` that is smaller than ``q``; its earlier
occurrences lie more than ``k / 2`` apart, or the nearest lies exactly ``q``
back. Hence at most one lies nearer than ``k`` and two from ``k`` to
``2 * k - 1`` (three below 16), and ``q`` back is one of them, since a run of
length ``max(24, 3 * q)`` holds that gram twice. So a text of ``n`` words opens
at most ``3 * n`` diagonals per gram length, however often its words repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustwatch.llm.common import for_python, whole

# Fixed values of what counts as a run.
MIN_WORDS = 24
MIN_PERIODS = 3

_SHORTEST = 8
_HOPS = 3
_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_SCHEMA = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())]
)


@dataclass(frozen=True)
class Run:
    start: int
    length: int
    period: int


def numbered(found: list[bytes]) -> np.ndarray:
    """A number per word, equal for equal words."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int64, len(found))


def _doubled(names: np.ndarray, k: int) -> tuple[np.ndarray, bool]:
    """Names of the grams of ``2 * k`` words from those of ``k`` words, by first word, and whether any repeats."""
    pair = names[:-k] * (int(names.max()) + 1) + names[k:]
    distinct, inverse = np.unique(pair, return_inverse=True)
    return inverse, len(distinct) < len(pair)


def _openings(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lag and place of grams that occurred before, per gram length; the lags of one length lie below those of the next."""
    n, names, k = len(ids), ids, 1
    while k < _SHORTEST:
        names, repeats = _doubled(names, k)
        if not repeats:
            return
        k *= 2
    while (k if k > _SHORTEST else 1) <= n // MIN_PERIODS:
        order = np.argsort(names, kind="stable")
        same = names[order[1:]] == names[order[:-1]]
        before = np.full(len(names) + 1, -1)
        before[order[1:][same]] = order[:-1][same]
        place, earlier = np.arange(len(names)), before[:-1]
        lags, places = [], []
        for _ in range(_HOPS):
            lag = place - earlier
            here = (earlier >= 0) & (lag >= (k if k > _SHORTEST else 1)) & (lag < 2 * k) & (lag <= n // MIN_PERIODS)
            lags.append(lag[here])
            places.append(place[here])
            earlier = before[earlier]
        yield np.concatenate(lags), np.concatenate(places)
        if 2 * k > len(names):
            return
        names, repeats = _doubled(names, k)
        if not repeats:
            return
        k *= 2


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Number of equal leading values."""
    done, step, n = 0, 32, min(len(a), len(b))
    a, b = a[:n], b[:n]
    while done < n:
        differ = a[done : done + step] != b[done : done + step]
        if differ.any():
            return min(n, done + int(differ.argmax()))
        done, step = done + step, step * 2
    return n


def find_runs(ids: np.ndarray) -> list[Run]:
    """All runs of a text by start, then period: smallest period ``q``, length at least ``max(24, 3 * q)``, not extensible."""
    n = len(ids)
    if n < MIN_WORDS:
        return []
    shortest: dict[tuple[int, int], int] = {}
    for lags, places in _openings(ids):
        keys = np.unique(lags * (n + 1) + places)
        at = 0
        while at < len(keys):
            lag, place = divmod(int(keys[at]), n + 1)
            first = place - _agreeing(ids[:place][::-1], ids[: place - lag][::-1])
            end = place + _agreeing(ids[place:], ids[place - lag :])
            span = (first - lag, end)
            if end - first + lag >= max(MIN_WORDS, MIN_PERIODS * lag):
                # A multiple of the smallest period gives the same stretch.
                shortest[span] = min(lag, shortest.get(span, lag))
            at = int(np.searchsorted(keys, lag * (n + 1) + max(end, place + 1)))
    runs = [Run(start, end - start, lag) for (start, end), lag in shortest.items()]
    return sorted(runs, key=lambda r: (r.start, r.period))


def collapsed(found: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run repeats: all of a run but its first period."""
    if not runs:
        return found
    depth = np.zeros(len(found) + 1, np.int64)
    for r in runs:
        depth[r.start + r.period] += 1
        depth[r.start + r.length] -= 1
    kept = np.cumsum(depth)[:-1] == 0
    return [w for w, k in zip(found, kept.tolist(), strict=True) if k]


def _one(text: str) -> tuple[int, list[dict], str]:
    found = text.encode("utf-8", "surrogatepass").split()
    runs = find_runs(numbered(found)) if len(found) >= MIN_WORDS else []
    rest = b" ".join(collapsed(found, runs)).decode("utf-8", "surrogatepass")
    return len(found), [{"start": r.start, "length": r.length, "period": r.period} for r in runs], rest


@F.pandas_udf(_SCHEMA)
def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = [_one(t) for t in texts]
        yield pd.DataFrame({"n_words": [r[0] for r in rows], "runs": [r[1] for r in rows], "collapsed": [r[2] for r in rows]})


def add_runs(docs: DataFrame, text: str = "text", out: str = "__runs") -> DataFrame:
    """Add ``out``: struct of n_words, runs (start, length, period, by start, then period) and the collapsed text.

    Words are what blanks and the controls from tab to carriage return part;
    the collapsed text has the kept words joined by one blank. All rows and
    columns of ``docs`` stay, in a map over its partitions without shuffle, so
    ties, repeated rows and clashing columns need no rule. Null and empty
    texts have no words, no runs and an empty collapsed text. An empty table
    stays empty. A text is held by one task, with about a hundred bytes a word.
    """
    for_python(docs.sparkSession)
    # Declared as not repeatable, so that the planner does not copy the call into the expressions that read its fields.
    return docs.withColumn(out, _scan.asNondeterministic()(whole(text)))
