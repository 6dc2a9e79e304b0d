"""Repeated passages, exactly, by a distributed difference cover.

A plain suffix sort by sampled triples hands two thirds of all positions to a
shuffle at each of its five levels up to 200 bytes. Here the cover's period is
133 instead of 3 and nothing has to recurse: 12 of 133 residues hold every
difference, so two equal strings of 200 bytes, wherever they start, have
sampled positions at one common distance below 133 from their starts, and the
68 bytes from there are equal too. Names are 64-bit fingerprints, which tasks
compute without meeting.

1. Sampled suffixes are sorted by the name of their first 68 bytes, and
   neighbours compared: which sampled positions are repeated?
2. The remaining suffixes are merged: only those that reach a repeated sampled
   position can begin a repeated string. They are sorted by the name of their
   first 200 bytes, and neighbours compared.

Both sorts are one exchange: a unit of a few MB of text sends, per range of
names, its distinct names in sorted order as packed bytes, and gets one bit for
each back. A string that is everywhere is sent once per unit.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustwatch.llm.common import Scratch, for_python, whole
from gustwatch.session import checkpoint_root, materialize

#: A perfect difference set: the differences of its 12 elements are 1 to 132, modulo 133, each once. Fixed values.
PERIOD = 133
COVER = (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BLOCK = 1 << 19


@dataclass(frozen=True)
class Passages:
    """``width``: bytes of a repeated string, at least 133 + 16. ``unit_bytes``: text that a task holds at once (and one document)."""

    width: int = 200
    unit_bytes: int = 4 << 20
    #: Text per range of names at most; ranges are 256 at least, so that a name without its range has 7 bytes.
    range_bytes: int = 32 << 20
    #: Text per bucket of the unit table, and so per task of both exchanges.
    bucket_bytes: int = 128 << 20


PASSAGES = Passages()


def _powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base & _MASK, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Namer:
    """Names of all strings of ``width`` bytes: a polynomial over a random byte table modulo 2**64, then mixed."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.table = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
        self.up = _powers(_BASE, _BLOCK + width)
        self.down = _powers(pow(_BASE, -1, 1 << 64), _BLOCK + width)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        """The name at each start; the last ``width`` - 1 starts have none."""
        count = max(0, len(data) - self.width + 1)
        out = np.empty(count, np.uint64)
        for first in range(0, count, _BLOCK):
            here = min(_BLOCK, count - first)
            values = self.table[data[first : first + here + self.width - 1]]
            sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values * self.up[: len(values)], out=sums[1:])
            names = (sums[self.width :] - sums[: -self.width]) * self.down[:here]
            names ^= names >> np.uint64(31)
            names *= np.uint64(0xBF58476D1CE4E5B9)
            names ^= names >> np.uint64(29)
            names *= np.uint64(0x94D049BB133111EB)
            out[first : first + here] = names ^ (names >> np.uint64(32))
        return out


def range_bits(total: int, how: Passages) -> int:
    """Bits that number the ranges of ``total`` bytes of text: one more whenever the text doubles."""
    bits = 8
    while (total >> bits) > how.range_bytes:
        bits += 1
    return bits


def pack(names: np.ndarray, bits: int) -> bytes:
    """Sorted names of one range without the whole bytes that it fixes, byte plane by byte plane from the top: the first compress."""
    return names.astype(">u8").view(np.uint8).reshape(-1, 8)[:, bits // 8 :].T.tobytes()


def unpack(packed: bytes, bits: int) -> np.ndarray:
    """What :func:`pack` packed, with the range's whole bytes 0."""
    fixed = bits // 8
    data = np.frombuffer(packed, np.uint8).reshape(8 - fixed, -1)
    full = np.zeros((data.shape[1], 8), np.uint8)
    full[:, fixed:] = data.T
    return full.view(">u8").ravel().astype(np.uint64)


class Unit:
    """The texts of one unit, end to end, and what follows from the answers of both exchanges."""

    def __init__(self, texts: list[bytes], how: Passages) -> None:
        self.how, self.texts = how, texts
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.firsts = self.ends - np.array([len(t) for t in texts], np.int64)

    def _starts(self, width: int) -> np.ndarray:
        """Whether a string of ``width`` bytes from here ends inside its text, for each start that has a name."""
        inside = np.zeros(len(self.data) + 1, np.int32)
        for a, b in zip(self.firsts, self.ends, strict=True):
            if b - a >= width:
                inside[a] += 1
                inside[b - width + 1] -= 1
        return np.cumsum(inside)[: max(0, len(self.data) - width + 1)] > 0

    def copies(self) -> np.ndarray:
        """A name per text that may be repeated as a whole."""
        return np.array(
            [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "big") if len(t) >= self.how.width else 0 for t in self.texts],
            np.uint64,
        )

    def sampled(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions and their names."""
        width = self.how.width - PERIOD + 1
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        inside = self._starts(width)
        at = np.flatnonzero(inside & np.resize(cover, len(inside)))
        return at, Namer(width)(self.data)[at]

    def merged(self, at: np.ndarray, repeated: np.ndarray, left_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts that reach a repeated sampled position, and their names; without the texts ``left_out``."""
        marks = np.zeros(len(self.data) + 1, np.int32)
        marks[at[repeated] + 1] = 1
        so_far = np.cumsum(marks)
        inside = self._starts(self.how.width)
        for k in np.flatnonzero(left_out):
            inside[self.firsts[k] : self.ends[k]] = False
        starts = np.flatnonzero(inside)
        starts = starts[so_far[starts + PERIOD] > so_far[starts]]
        return starts, (Namer(self.how.width)(self.data)[starts] if len(starts) else np.empty(0, np.uint64))

    def results(self, starts: np.ndarray, gone: np.ndarray) -> list[tuple[int, int, int, str]]:
        """Per text: bytes, removed bytes, removed runs, SHA-256 of the rest. ``starts``: of repeated strings; ``gone``: whole texts."""
        marks = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + self.how.width, -1)
        removed = np.cumsum(marks)[: len(self.data)] > 0
        out = []
        for k, (a, b) in enumerate(zip(self.firsts, self.ends, strict=True)):
            here = np.ones(b - a, bool) if gone[k] else removed[a:b]
            runs = int(here[0]) + int(np.count_nonzero(here[1:] & ~here[:-1])) if b > a else 0
            kept = self.data[a:b][~here].tobytes()
            out.append((int(b - a), int(here.sum()), runs, hashlib.sha256(kept).hexdigest()))
        return out


def _ranges(names: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted distinct names cut into their ranges."""
    number = (names >> np.uint64(64 - bits)).astype(np.int64)
    firsts = np.flatnonzero(np.diff(number, prepend=-1))
    for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(names)], strict=True) if len(names) else ():
        yield int(number[a]), names[a:b]


def _messages(unit: int, kinds: dict[str, np.ndarray], bits: int) -> list[tuple[int, int, str, bytes]]:
    return [
        (unit, number, kind, pack(piece, bits))
        for kind, names in kinds.items()
        for number, piece in _ranges(np.unique(names), bits)
    ]


_MESSAGE = "unit long, number long, kind string, names binary"
_ANSWER = "unit long, number long, kind string, repeated binary, first binary"


def _compare(bits: int):
    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        """Sort the names of one range and kind and compare neighbours: is a name sent by two units, and who is the first?"""
        frame = frame.sort_values("unit")
        lists = [unpack(n, bits) for n in frame["names"]]
        sizes = [len(n) for n in lists]
        names = np.concatenate(lists)
        order = np.argsort(names, kind="stable")
        same = names[order[1:]] == names[order[:-1]]
        repeated, first = np.zeros(len(names), bool), np.ones(len(names), bool)
        repeated[order[1:]] |= same
        repeated[order[:-1]] |= same
        first[order[1:]] &= ~same
        cuts = np.cumsum(sizes)[:-1]
        return pd.DataFrame(
            {
                "unit": frame["unit"],
                "number": frame["number"],
                "kind": frame["kind"],
                "repeated": [np.packbits(x).tobytes() for x in np.split(repeated, cuts)],
                "first": [np.packbits(x).tobytes() if k == "copy" else b"" for x, k in zip(np.split(first, cuts), frame["kind"], strict=True)],
            }
        )

    return compare


def _exchange(messages: DataFrame, bits: int, scratch: Scratch) -> DataFrame:
    """Answers per unit, written: unit, answers (an array of number, kind, repeated, first)."""
    answers = messages.groupBy("number", "kind").applyInPandas(_compare(bits), _ANSWER)
    return scratch.write(
        answers.groupBy("unit").agg(F.collect_list(F.struct("number", "kind", "repeated", "first")).alias("answers"))
    )


def _known(names: np.ndarray, kind: str, answers: list[dict], bits: int, field: str = "repeated") -> np.ndarray:
    """For each of ``names`` the bit of the answer; a name twice in the unit counts as repeated without asking."""
    unique, back, counts = np.unique(names, return_inverse=True, return_counts=True)
    told = {a["number"]: a[field] for a in answers if a["kind"] == kind}
    told_bits = np.zeros(len(unique), bool)
    at = 0
    for number, piece in _ranges(unique, bits):
        told_bits[at : at + len(piece)] = np.unpackbits(np.frombuffer(told[number], np.uint8))[: len(piece)]
        at += len(piece)
    return told_bits[back] | (counts > 1)[back] if field == "repeated" else told_bits[back]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def _gather(how: Passages):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units of whole documents, numbered by partition and turn."""
        turn = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            schema = (["unit", "ids", "texts"], [pa.int64(), pa.list_(batch.column(0).type), pa.list_(pa.binary())])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if ids and size + len(data) > how.unit_bytes:
                    yield _batch([(turn, ids, texts)], *schema)
                    ids, texts, size, turn = [], [], 0, turn + 1
                ids.append(doc_id)
                texts.append(data)
                size += len(data)
        if ids:
            yield _batch([(turn, ids, texts)], *schema)

    return gather


def _bucketed(units: DataFrame, spark: SparkSession, buckets: int, scratch: Scratch) -> tuple[DataFrame, str]:
    """``units`` written as a table bucketed by unit, so that answers come to the texts and no text is shuffled."""
    name = f"gw_units_{uuid.uuid4().hex}"
    path = f"{checkpoint_root(spark)}/{name}"
    scratch.paths.append(path)
    units.write.option("path", path).option("compression", "zstd").bucketBy(buckets, "unit").saveAsTable(name)
    return spark.table(name), name


def _send_samples(how: Passages, bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            unit = Unit(row["texts"], how)
            copies = unit.copies()
            yield _sent(_messages(row["unit"], {"sample": unit.sampled()[1], "copy": copies[copies > 0]}, bits))

    return send


def _sent(messages: list[tuple]) -> pa.RecordBatch:
    return _batch(messages, ["unit", "number", "kind", "names"], [pa.int64(), pa.int64(), pa.string(), pa.binary()])


def _second(row: dict, how: Passages, bits: int) -> tuple[Unit, np.ndarray, np.ndarray, np.ndarray]:
    """The unit, whether each text is repeated as a whole, and the merged starts with their names."""
    unit, answers = Unit(row["texts"], how), row["answers"] or []
    copies = unit.copies()
    whole_names = copies > 0
    gone, left_out = np.zeros(len(copies), bool), np.zeros(len(copies), bool)
    if whole_names.any():
        held = copies[whole_names]
        gone[whole_names] = _known(held, "copy", answers, bits)
        # One of equal texts stands for all: the first of the first unit that has it.
        elsewhere = ~_known(held, "copy", answers, bits, "first")
        again = np.ones(len(held), bool)
        again[np.unique(held, return_index=True)[1]] = False
        left_out[whole_names] = elsewhere | again
    at, names = unit.sampled()
    starts, named = unit.merged(at, _known(names, "sample", answers, bits), left_out)
    return unit, gone, starts, named


def _send_merged(how: Passages, bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield _sent(_messages(row["unit"], {"start": _second(row, how, bits)[3]}, bits))

    return send


_RESULT = ("n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string")


def _finish(how: Passages, bits: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *[c.split()[0] for c in _RESULT]]
        for batch in batches:
            types = [batch.schema.field("ids").type.value_type, pa.int64(), pa.int64(), pa.int64(), pa.string()]
            for row in _rows(iter([batch])):
                unit, gone, starts, named = _second(row, how, bits)
                told = _known(named, "start", row["merged"] or [], bits)
                results = unit.results(starts[told], gone)
                yield _batch([(i, *r) for i, r in zip(row["ids"], results, strict=True)], names, types)

    return finish


def remove_repeats(docs: DataFrame, how: Passages = PASSAGES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed when a string of ``width`` bytes over it also starts
    anywhere else in the texts; strings never cross documents. Every copy goes,
    judged on the texts as they are. Null and empty texts have no bytes, texts
    shorter than ``width`` lose none; repeated rows are copies of each other;
    null ids keep their rows, and ids keep their type. No rows give no rows.

    The number of ranges doubles with the text, so that a task that compares
    has the names of ``range_bytes`` of text at any size; a unit sends a message
    a range. Tables of units and answers are dropped before the result returns.

    Equal texts are settled as a whole in the first exchange and take part in
    the second through one of them.
    """
    spark = for_python(docs.sparkSession)
    # A row of the unit table has some MB.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", whole().alias("text"))
    total = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = range_bits(total, how)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1, -(-total // how.bucket_bytes))
    gathered = read.mapInArrow(_gather(how), f"unit long, ids array<{id_type}>, texts array<binary>")
    scratch = Scratch(spark)
    units, name = _bucketed(gathered, spark, buckets, scratch)
    try:
        samples = _exchange(units.select("unit", "texts").mapInArrow(_send_samples(how, bits), _MESSAGE), bits, scratch)
        answered = units.join(samples, "unit", "left")
        sent = answered.select("unit", "texts", "answers").mapInArrow(_send_merged(how, bits), _MESSAGE)
        merged = _exchange(sent, bits, scratch).withColumnRenamed("answers", "merged")
        last = answered.join(merged, "unit", "left").select("ids", "texts", "answers", "merged")
        return materialize(last.mapInArrow(_finish(how, bits), ", ".join([f"doc_id {id_type}", *_RESULT])))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        scratch.drop()
