"""Language-model scores: smoothed n-grams as a weighted automaton with failure arcs, walked once per text.

The model. ``c`` counts n-grams in the training texts, each of which ends with
one end token; n-grams do not cross texts. A context ``h`` (one to
``order - 1`` tokens, seen ``min_context`` times at least) is a state. Its arc
for token ``w`` exists where ``c(hw) > 0`` and weighs
``log10((c(hw) + mass * p(w | h')) / (c(h) + mass))``, where ``h'`` is ``h``
without its first token; its failure arc leads to ``h'`` and weighs
``log10(mass / (c(h) + mass))``. At the root every token has an arc, of weight
``log10((c(w) + 1) / (N + V + 1))``. Weights out of each state add up to one,
counting one unknown token. Reading a text from left to right, the state is the
longest suffix read that is a context; a token without arc takes failure arcs
until it has one.

The work. Texts are packed into units of some MB, written once as a table
bucketed by unit, so that answers come to the texts and texts never travel. A
unit sends its distinct n-grams, 56-bit names sorted and cut into ranges, with
its training counts; a range adds up the counts of all units and sends the
totals back in the same order. Orders one and two go in one exchange, each
higher order in one more, and only with n-grams whose context is a state. With
the totals, a unit builds the states and arcs that its texts can reach, and
walks its texts. All tables grow with the input; no task holds the model.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gustwatch.llm.common import Scratch, for_python, tokens, whole
from gustwatch.session import checkpoint_root, materialize


@dataclass(frozen=True)
class Model:
    order: int = 3
    #: Weight of the lower order in a context, as a number of tokens.
    mass: float = 4.0
    #: Training count from which a context is a state.
    min_context: int = 2
    #: Text of one unit.
    unit_bytes: int = 8_000_000
    #: Text of one bucket of units, which one task reads unit by unit.
    bucket_bytes: int = 32_000_000
    #: Text whose n-grams go to one range.
    range_bytes: int = 8_000_000


MODEL = Model()

NAME_BITS = 56
#: Spark's own limit of buckets.
MOST_BUCKETS = 100_000
_END = b"\n"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """The tokens of a unit's texts in a row, and the distinct n-grams that end at each place."""

    def __init__(self, texts: list[str | None]) -> None:
        numbers: dict[bytes, int] = {}
        parts = []
        for text in texts:
            found = tokens(text or "")
            found.append(_END)
            parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int64, len(found)))
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        row = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        names = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in numbers], np.uint64)
        self.word = names[row] if len(row) else np.zeros(0, np.uint64)
        self.turn = (np.arange(len(row)) - np.repeat(self.firsts, self.sizes)).astype(np.int32)
        self.names: dict[int, np.ndarray] = {}
        self.at: dict[int, np.ndarray] = {}
        self._full = self.word

    def done(self) -> Grams:
        """Without what only further numbering needs."""
        self.names, self.word, self._full = {}, self.word[:0], self.word[:0]
        return self

    def add(self, n: int, allowed: np.ndarray | None = None) -> None:
        """Number the n-grams that end at each place (-1: none, or not ``allowed``), by ascending name. Call for 1, 2, ... in turn."""
        if n > 1:
            full = np.zeros_like(self.word)
            full[1:] = _mixed(self._full[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.word[1:])
            self._full = full
        here = self.turn >= n - 1
        if allowed is not None:
            here &= allowed
        place = np.flatnonzero(here)
        self.names[n], inverse = np.unique(_mixed(self._full[place]) >> np.uint64(64 - NAME_BITS), return_inverse=True)
        self.at[n] = np.full(len(self.word), -1, np.int32)
        self.at[n][place] = inverse

    def totals(self, n: int, told: dict[int, np.ndarray]) -> np.ndarray:
        """What ``told`` has of the n-gram of order ``n`` that ends at each place; 0 where there is none."""
        return np.append(told.get(n, np.zeros(0, np.int64)), 0)[self.at[n]]

    def counts(self, n: int, train: np.ndarray) -> np.ndarray:
        """Occurrences in the unit's training texts."""
        used = (self.at[n] >= 0) & np.repeat(train, self.sizes)
        return np.bincount(self.at[n][used], minlength=len(self.names[n]))


def _before(values: np.ndarray, turn: np.ndarray, none) -> np.ndarray:
    """What ``values`` have one place earlier in the same text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[turn == 0] = none
    return out


class Automaton:
    """States and arcs that the texts of a unit can reach, by place: ``arcs[s]`` weighs the arc of the token there out of the
    state of ``s`` tokens before it (NaN: none), ``fails[s]`` that state's failure arc, ``states`` the state after the token."""

    def __init__(self, grams: Grams, totals: dict[int, np.ndarray], size: int, kinds: int, how: Model) -> None:
        turn = grams.turn
        last = np.zeros(len(turn), bool)
        last[(grams.firsts + grams.sizes - 1)[grams.sizes > 0]] = True
        seen = grams.totals(1, totals)
        self.known = seen > 0
        chance = (seen + 1) / (size + kinds + 1)
        self.arcs = [np.log10(chance)]
        self.fails = [np.zeros(len(turn))]
        self.states = np.zeros(len(turn), np.int8)
        for n in range(2, how.order + 1):
            seen[last] = 0
            self.states += seen >= how.min_context
            context = _before(seen, turn, 0)
            state = context >= how.min_context
            seen = grams.totals(n, totals)
            chance = np.where(state, (seen + how.mass * chance) / (context + how.mass), chance)
            arc = np.log10(chance)
            arc[~state | (seen == 0)] = np.nan
            self.arcs.append(arc)
            self.fails.append(np.where(state, np.log10(how.mass / (context + how.mass)), 0.0))

    def walk(self, first: int, end: int) -> float:
        """Log-probability of the tokens from ``first`` to ``end``, a whole text."""
        arcs = [a[first:end].tolist() for a in self.arcs]
        fails = [f[first:end].tolist() for f in self.fails]
        total, state = 0.0, 0
        for i, after in enumerate(self.states[first:end].tolist()):
            weight = arcs[state][i]
            while weight != weight:
                total += fails[state][i]
                state -= 1
                weight = arcs[state][i]
            total += weight
            state = after
        return total


# -- messages ---------------------------------------------------------------


def _packed(values: np.ndarray) -> bytes:
    """As many bytes per value as the largest needs, first bytes first, so that equal high bytes compress."""
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    planes = np.frombuffer(data, np.uint8).reshape(-1, n) if n else np.zeros((1, 0), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").reshape(-1)


_MESSAGE = "unit long, n int, part long, many int, names binary, counts binary"
_MESSAGE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
_ANSWER = "unit long, n int, part long, many int, totals binary, kinds long, size long"


def _batch(rows: list[tuple], schema: str, types: list[pa.DataType]) -> pa.RecordBatch:
    names = [field.split()[0] for field in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def _messages(unit: int, n: int, names: np.ndarray, counts: np.ndarray, range_bits: int) -> list[tuple]:
    if not len(names):
        return []
    shift = np.uint64(NAME_BITS - range_bits)
    part = names >> shift
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    rows = []
    for a, b in zip(starts, np.r_[starts[1:], len(names)], strict=True):
        inside = names[a:b] & ((np.uint64(1) << shift) - np.uint64(1))
        rows.append((unit, n, int(part[a]), int(b - a), _packed(inside), _packed(counts[a:b])))
    return rows


def _add_up(messages: pd.DataFrame) -> pd.DataFrame:
    """Totals of one range for each unit that asked, and a row without unit: n-grams seen and their occurrences."""
    names = np.concatenate([_unpacked(x, m) for x, m in zip(messages["names"], messages["many"], strict=True)])
    counts = np.concatenate([_unpacked(x, m) for x, m in zip(messages["counts"], messages["many"], strict=True)])
    distinct, back = np.unique(names, return_inverse=True)
    order = np.argsort(back, kind="stable")
    totals = np.add.reduceat(counts[order].astype(np.int64), np.r_[0, np.cumsum(np.bincount(back))[:-1]])
    told = np.split(totals[back], np.cumsum(messages["many"].to_numpy())[:-1])
    out = messages[["unit", "n", "part", "many"]].assign(totals=[_packed(t) for t in told], kinds=0, size=0)
    n, part = messages["n"].iloc[0], messages["part"].iloc[0]
    out.loc[len(out)] = [None, n, part, 0, None, int((totals > 0).sum()), int(totals.sum())]
    return out


def _told(answers: list[dict]) -> dict[int, np.ndarray]:
    """Totals per order, in the order of the unit's sorted names."""
    out: dict[int, list[np.ndarray]] = {}
    for a in sorted(answers, key=lambda a: (a["n"], a["part"])):
        out.setdefault(a["n"], []).append(_unpacked(a["totals"], a["many"]).astype(np.int64))
    return {n: np.concatenate(parts) for n, parts in out.items()}


# -- units ------------------------------------------------------------------


def _gather(unit_bytes: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one unit in arrays; a unit is full with the batch that fills it."""
        turn = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column("text").nbytes
            if size >= unit_bytes:
                yield _unit(turn, held, size)
                held, size, turn = [], 0, turn + 1
        if held:
            yield _unit(turn, held, size)

    return gather


def _unit(number: int, held: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    lists = [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), c.combine_chunks()) for c in table.columns]
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), *lists, pa.array([size], pa.int64())], ["unit", *table.column_names, "bytes"]
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _known_grams(row: dict, orders: int, how: Model) -> tuple[Grams, dict[int, np.ndarray]]:
    """The n-grams of a unit up to ``orders``, and what it was told of those below."""
    grams, told = Grams(row.pop("text")), _told(row.pop("answers", None) or [])
    for n in range(1, orders + 1):
        allowed = None
        if n > 2:
            allowed = _before(grams.totals(n - 1, told) >= how.min_context, grams.turn, False)
        grams.add(n, allowed)
    return grams, told


def _ask(orders: tuple[int, ...], range_bits: int, how: Model):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            grams, _ = _known_grams(row, orders[-1], how)
            train = np.array(row["train"], bool)
            for n in orders:
                yield _batch(_messages(row["unit"], n, grams.names[n], grams.counts(n, train), range_bits), _MESSAGE, _MESSAGE_TYPES)

    return ask


_SCORES = "train boolean, n_tokens long, n_known long, base_score double, score double"


def _score(size: int, kinds: int, how: Model, id_type: pa.DataType):
    types = [id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            grams, told = _known_grams(row, how.order, how)
            automaton = Automaton(grams.done(), told, size, kinds, how)
            rows = []
            for key, train, first, many in zip(row["id"], row["train"], grams.firsts.tolist(), grams.sizes.tolist(), strict=True):
                end = first + many
                base = math.fsum(automaton.arcs[0][first:end].tolist())
                rows.append((key, train, many, int(automaton.known[first:end].sum()), base, automaton.walk(first, end)))
            yield _batch(rows, "id any, " + _SCORES, types)

    return score


def _exchange(messages: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.write(messages.groupBy("n", "part").applyInPandas(_add_up, _ANSWER))


def _per_unit(answers: DataFrame) -> DataFrame:
    told = answers.where(F.col("unit").isNotNull()).select("unit", F.struct("n", "part", "many", "totals").alias("a"))
    return told.groupBy("unit").agg(F.collect_list("a").alias("answers"))


def _with_answers(units: DataFrame, answers: DataFrame | None) -> DataFrame:
    return units if answers is None else units.join(_per_unit(answers), "unit", "left")


def _bucketed(spark: SparkSession, gathered: DataFrame, total: int, how: Model) -> str:
    name = f"gw_lm_{uuid.uuid4().hex}"
    buckets = min(MOST_BUCKETS, total // how.bucket_bytes + 1)
    path = f"{checkpoint_root(spark)}/{name}"
    gathered.write.option("path", path).option("compression", "zstd").bucketBy(buckets, "unit").saveAsTable(name)
    return name


def score_texts(docs: DataFrame, key: str, train: Column, how: Model = MODEL) -> DataFrame:
    """One row per row of ``docs``: key, train, n_tokens, n_known, train_tokens, base_score (by single tokens), score.

    The model learns from rows where ``train`` is true; null counts as false.
    Null and empty texts are one end token, in training too. Repeated rows
    count and are scored once each; null keys keep their rows; columns but
    ``key`` and the text are not read. Without training rows every token weighs
    log10(1). An empty table gives no rows. Scores do not depend on how texts
    are packed into units.
    """
    spark = for_python(docs.sparkSession)
    read = docs.select(F.col(key).alias("id"), whole().alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    id_type = read.schema["id"].dataType.simpleString()
    total = read.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    schema = f"unit long, id array<{id_type}>, text array<string>, train array<boolean>, bytes long"
    scratch = Scratch(spark)
    name = _bucketed(spark, read.mapInArrow(_gather(how.unit_bytes), schema), total, how)
    batch_rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        # A row of the table of units has some MB.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
        units = spark.table(name)
        range_bits = 8
        while (total >> range_bits) > how.range_bytes:
            range_bits += 1
        answers = None
        rounds = [tuple(range(1, min(2, how.order) + 1)), *[(n,) for n in range(3, how.order + 1)]]
        for orders in rounds:
            asked = _with_answers(units, answers).drop("id").mapInArrow(_ask(orders, range_bits, how), _MESSAGE)
            more = _exchange(asked, scratch)
            answers = more if answers is None else answers.unionByName(more)
        learned = answers.where("unit is null and n = 1").agg(F.sum("kinds"), F.sum("size")).first()
        kinds, size = learned[0] or 0, learned[1] or 0
        arrow_id = to_arrow_type(read.schema["id"].dataType)
        scored = _with_answers(units, answers).mapInArrow(_score(size, kinds, how, arrow_id), f"id {id_type}, {_SCORES}")
        found = materialize(scored.withColumn("train_tokens", F.lit(size).cast("long")))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        scratch.paths.append(f"{checkpoint_root(spark)}/{name}")
        scratch.drop()
    return found.select(F.col("id").alias(key), "train", "n_tokens", "n_known", "train_tokens", "base_score", "score")
