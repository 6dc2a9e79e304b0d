"""Benchmark decontamination: one automaton over the windows of all test items scans each text once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustwatch.llm.common import for_python, whole, words
from gustwatch.session import materialize

WINDOW = 10
#: Words of test items in one automaton (a few hundred MB in a worker at most); more items are scanned block by block.
BLOCK_WORDS = 500_000

_SCHEMA = "n_words long, hits array<int>, items array<string>"
_WORD_PLACES = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


class Matcher:
    """Aho-Corasick over word numbers: windows of ``width`` words of every item, or the whole of a shorter item.

    Word numbers instead of characters: a match cannot begin inside a word, and
    the automaton has a node per word of a window, not per letter.
    """

    def __init__(self, items: list[tuple[str | None, str]], width: int = WINDOW) -> None:
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            known = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text or "")]
            for at in range(max(1, len(known) - width + 1) if known else 0):
                windows.setdefault(tuple(known[at : at + width]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, owners in windows.items():
            self.automaton.add_word(window, (len(window), frozenset(owners)))
        self.empty = not windows
        if windows:
            self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, list[int], set[str | None]]:
        """Number of words, hit stretches as first and end word in turn (merged), and the items found."""
        found = words(text)
        if self.empty or not found:
            return len(found), [], set()
        number = self.numbers.get
        spans: list[int] = []
        owners: set[str | None] = set()
        stretches = sorted(
            ((end - size + 1, end + 1, who) for end, (size, who) in self.automaton.iter(tuple([number(w, 0) for w in found]))),
            key=lambda s: s[:2],
        )
        for first, end, who in stretches:
            owners |= who
            if spans and first <= spans[-1]:
                spans[-1] = max(spans[-1], end)
            else:
                spans += [first, end]
        return len(found), spans, owners


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str | None, str]]]:
    """The items, in blocks of bounded size; the driver holds one block at a time."""
    block: list[tuple[str | None, str]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("string"), whole().alias("text")).toLocalIterator():
        many = len(row["text"]) // 2 + 1
        if block and size + many > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += many
    yield block


def _scanner(items: list[tuple[str | None, str]], width: int):
    @F.pandas_udf(_SCHEMA)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(items, width)
        for texts in batches:
            rows = [matcher.scan(text) for text in texts]
            yield pd.DataFrame(
                {
                    "n_words": [r[0] for r in rows],
                    "hits": [r[1] for r in rows],
                    "items": [sorted(i for i in r[2] if i is not None) for r in rows],
                }
            )

    return scan


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _united(*several: pd.Series) -> pd.Series:
    def one(lists) -> list[int]:
        out: list[int] = []
        for first, end in sorted(p for x in lists for p in zip(x[0::2], x[1::2], strict=True)):
            if out and first <= out[-1]:
                out[-1] = max(out[-1], end)
            else:
                out += [int(first), int(end)]
        return out

    return pd.Series([one(lists) for lists in zip(*several, strict=True)])


def add_hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, out: str = "__hits") -> DataFrame:
    """Add ``out``: struct of n_words, hits (first and end word of each hit stretch in turn) and items (sorted ids).

    All columns and rows of ``docs`` stay, in a map over its partitions without
    shuffle. Item ids are strings, sorted as such. Null or empty text has no
    words; items without words match nothing; items with a null id mark words
    but cannot be named. An empty ``benchmark`` hits nothing. A benchmark beyond
    ``BLOCK_WORDS`` is scanned in blocks, one pass each: what a pass found is
    written before the next block is fetched, so that neither the driver nor a
    task ever holds two blocks.
    """
    for_python(docs.sparkSession)
    blocks = _blocks(benchmark)
    marked = docs.withColumn(out, _scanner(next(blocks), width)(whole()))
    more = f"{out}_more"
    for items in blocks:
        both = materialize(marked).withColumn(more, _scanner(items, width)(whole()))
        united = F.struct(
            F.col(out)["n_words"].alias("n_words"),
            _united(F.col(out)["hits"], F.col(more)["hits"]).alias("hits"),
            F.array_sort(F.array_union(F.col(out)["items"], F.col(more)["items"])).alias("items"),
        )
        marked = both.withColumn(out, united).drop(more)
    return marked


def hit_words(hits: Column) -> Column:
    """Number of words in the stretches of ``hits``."""
    signed = F.transform(hits, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("long"))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)


def places(text: str, hits: list[int]) -> list[tuple[int, int]]:
    """Character offsets, in the original text, of stretches of hit words."""
    if not hits:
        return []
    at = [m.span() for m in _WORD_PLACES.finditer(text)]
    return [(at[first][0], at[end - 1][1]) for first, end in zip(hits[0::2], hits[1::2], strict=True)]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def hit_offsets(texts: pd.Series, hits: pd.Series) -> pd.Series:
    """Spans in the original text (code points, end exclusive) of the stretches found by :func:`add_hits`."""
    return pd.Series(
        [
            [{"start": a, "end": b} for a, b in places(t or "", [int(x) for x in h])]
            for t, h in zip(texts, hits, strict=True)
        ]
    )
