"""Personal data: fixed patterns, and terms whose presence gives away a protected entity, found by corpus co-occurrence."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustwatch.llm.common import for_python, whole
from gustwatch.session import materialize

#: In the order that settles equal starts; terms come last.
KINDS = ("email", "ip", "card", "phone", "term")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


@dataclass(frozen=True)
class Disclosure:
    """A term outside all entities is a neighbour of each entity of its text, or, with ``reach``, of those within so many words.

    It discloses an entity when it is its neighbour in ``min_texts`` different
    texts, in at least the share ``generalise`` of all texts that hold the
    term, and when that share is at least two to the ``min_bits`` times the
    share of the entity among all texts (pointwise information); from
    ``remove`` on it is removed instead of generalised.

    More than ``max_terms`` such terms of one entity are no name but a wording
    that its texts share. They disclose it only when ``min_texts`` of these
    texts are independent: near copies of each other count as one.
    """

    reach: int | None = None
    min_texts: int = 3
    generalise: float = 0.6
    remove: float = 0.9
    min_bits: float = 1.0
    min_letters: int = 4
    max_terms: int = 3
    #: Bits of the fixed-size filter that texts are tested with before anything is shuffled.
    filter_bits: int = 1 << 22


DISCLOSURE = Disclosure(min_letters=1)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches end to end from each ``@``, so that a long run without one costs nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > free and text[first - 1] in _LOCAL_SET:
            first -= 1
        domain = _DOMAIN.match(text, at) if first < at else None
        if domain:
            yield first, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the four patterns, in order; leftmost without overlap per kind, failing ones dropped."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _outside(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, term) of the terms that touch no span, in order."""
    out, merged, at = [], [], 0
    for a, _, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for m in _TERM.finditer(text):
        while at < len(merged) and merged[at][1] <= m.start():
            at += 1
        if at == len(merged) or m.end() <= merged[at][0]:
            out.append((m.start(), m.end(), m[0].lower()))
    return out


#: Bands of a text's sketch, of two coordinates each: texts that share half of their shingles meet in one of them at nine in ten.
_BANDS = 8
_TURNS = np.random.default_rng(20).integers(1, 2**63, (2, 2 * _BANDS), dtype=np.int64).astype(np.uint64) | np.uint64(1)


def _sketch(terms: list[str]) -> list[int]:
    """MinHash bands over the 3-term shingles of ``terms``; fewer terms are one shingle, none give no bands."""
    if not terms:
        return []
    codes = np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) + 1 for t in terms), np.uint64, len(terms))
    codes *= np.uint64(0x9E3779B97F4A7C15)
    if len(codes) < 3:
        codes = np.concatenate([codes, np.zeros(3 - len(codes), np.uint64)])
    shingles = codes[:-2] * np.uint64(0xBF58476D1CE4E5B9) + codes[1:-1] * np.uint64(0x94D049BB133111EB) + codes[2:]
    shingles = np.unique(shingles ^ (shingles >> np.uint64(31)))
    least = np.array([((shingles * a + b) >> np.uint64(8)).min() for a, b in _TURNS.T])
    return (least[0::2] * np.uint64(0x9E3779B97F4A7C15) + least[1::2]).view(np.int64).tolist()


def _entity(text: str, span: tuple[int, int, int]) -> str:
    return f"{KINDS[span[1]]}:{text[span[0] : span[2]].lower()}"


def _neighbours(text: str, spans: list[tuple[int, int, int]], terms: list[tuple[int, int, str]], how: Disclosure) -> set[tuple[str, str]]:
    """Terms within ``reach`` terms of each span, with the entity in it."""
    out: set[tuple[str, str]] = set()
    starts = [t[0] for t in terms]
    for span in spans:
        left, right = bisect_left(starts, span[0]), bisect_left(starts, span[2])
        near = terms[max(0, left - how.reach) : left] + terms[right : right + how.reach]
        out |= {(t, _entity(text, span)) for _, _, t in near if len(t) >= how.min_letters}
    return out


_FOUND = (
    "spans array<struct<start:int,kind:int,end:int>>, entities array<string>, "
    "pairs array<struct<term:string,entity:string>>, outside array<string>, terms array<string>, sketch array<long>"
)


def _detector(how: Disclosure):
    @F.pandas_udf(_FOUND)
    def detect(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            spans = base_spans(text)
            outside = _outside(text, spans) if spans else []
            pairs = _neighbours(text, spans, outside, how) if how.reach is not None else ()
            terms = {m[0].lower() for m in _TERM.finditer(text)} if outside else ()
            rows.append(
                (
                    [{"start": a, "kind": k, "end": b} for a, k, b in spans],
                    sorted({_entity(text, s) for s in spans}),
                    [{"term": t, "entity": e} for t, e in sorted(pairs)],
                    sorted({t for _, _, t in outside if len(t) >= how.min_letters}) if how.reach is None else [],
                    sorted(terms),
                    _sketch([t for _, _, t in outside]),
                )
            )
        return pd.DataFrame(rows, columns=["spans", "entities", "pairs", "outside", "terms", "sketch"])

    return detect


#: What one text counts; the numbers from 1 to 15 divide it.
_ONE = 720_720
_SALTS = 16


def _independent(texts: DataFrame) -> DataFrame:
    """digest and ``weight`` of ``texts`` (digest, sketch): one text's share of :data:`_ONE` among its near copies.

    A text's near copies are those it meets in the band where it meets most.
    Bands are counted before they are joined back, under salts, so that a large
    group of copies is no group of a task.
    """
    bands = texts.select("digest", F.posexplode("sketch").alias("band", "code"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    shared = bands.groupBy("band", "code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("*", salts)
    salted = bands.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(_SALTS)).cast("int"))
    met = salted.join(shared, ["band", "code", "salt"]).groupBy("digest").agg(F.max("n").alias("n"))
    return texts.select("digest").join(met, "digest", "left").select(
        "digest", F.floor(F.lit(_ONE) / F.coalesce("n", F.lit(1))).cast("long").alias("weight")
    )


def _bucket(term: str, bits: int) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % bits


def _spotter(packed: bytes, how: Disclosure):
    @F.pandas_udf("array<struct<term:string,start:int,end:int>>")
    def spot(texts: pd.Series) -> pd.Series:
        """Occurrences of terms that pass the filter."""
        bits = np.unpackbits(np.frombuffer(packed, np.uint8))
        # Each word as it is written, with its term if that passes; the whole text in lower case could have other words.
        known: dict[str, str | None] = {}
        rows = []
        for text in texts:
            if len(known) > 300_000:
                known.clear()
            some = False
            for word in set(_TERM.findall(text)):
                if word not in known:
                    term = word.lower()
                    passes = len(term) >= how.min_letters and bool(bits[_bucket(term, how.filter_bits)])
                    known[word] = term if passes else None
                some = some or known[word] is not None
            rows.append(
                [
                    {"term": known[m[0]], "start": m.start(), "end": m.end()}
                    for m in _TERM.finditer(text)
                    if known[m[0]] is not None
                ]
                if some
                else []
            )
        return pd.Series(rows)

    return spot


def find_personal_data(docs: DataFrame, how: Disclosure = DISCLOSURE) -> DataFrame:
    """One row per row of ``docs``: doc_id and spans, an array of (start, kind, end, action) by start, then kind.

    ``kind`` numbers :data:`KINDS`, offsets are code points, end exclusive;
    ``action`` is mask for patterns, generalise or remove for disclosing terms.
    Null texts are empty; repeated rows and null ids keep their rows. Texts
    count once in all statistics, however many copies they have.

    Statistics cover all texts: how many hold a term with an entity, how many
    hold the term at all, and how many hold the entity. Terms that already fail
    among the texts with entities (a lower bound of the second) leave first;
    the rest is turned into a filter of fixed size, so that only their
    occurrences are shuffled and counted exactly. Common terms therefore never
    travel; pairs are made only of terms and entities that can still pass, and
    entities that stand in the very same texts are paired as one.
    """
    for_python(docs.sparkSession)
    base = docs.select("doc_id", whole().alias("text")).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    found = materialize(base.withColumn("f", _detector(how)("text")).select("doc_id", "digest", "f.*"))
    n_texts = found.select("digest").distinct().count()

    per_text = found.where(F.size("entities") > 0).groupBy("digest").agg(
        *[F.first(c).alias(c) for c in ("entities", "pairs", "outside", "terms", "sketch")]
    )
    per_text = materialize(per_text)
    held_entities = per_text.select("digest", F.explode("entities").alias("entity"))
    common = held_entities.groupBy("entity").agg(
        F.count(F.lit(1)).alias("entity_texts"),
        *[F.bit_xor(F.xxhash64("digest", F.lit(k))).alias(f"x{k}") for k in range(2)],
    ).where(F.col("entity_texts") >= how.min_texts)
    local = per_text.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("local"))
    local = local.where(F.col("local") >= how.min_texts)
    can_pass = F.col("entity_texts") >= how.generalise * F.col("local")
    if how.reach is None:
        # Entities of the very same texts have the same statistics: a list of names and addresses is one of them.
        alike = F.concat_ws(":", "x0", "x1", "entity_texts").alias("entity")
        entities = materialize(held_entities.join(common, "entity").select("digest", alike, "entity_texts").distinct())
        most = entities.groupBy("digest").agg(F.max("entity_texts").alias("entity_texts"))
        terms = per_text.select("digest", F.explode("outside").alias("term")).join(most, "digest").join(local, "term").where(can_pass)
        pairs = terms.drop("entity_texts").join(entities, "digest").where(can_pass)
    else:
        named = common.select("entity", "entity_texts")
        pairs = per_text.select("digest", F.explode("pairs").alias("p")).select("digest", "p.*").join(named, "entity").join(local, "term")
    candidates = materialize(
        pairs.groupBy("term", "entity", "entity_texts", "local")
        .agg(F.count(F.lit(1)).alias("near"))
        .where((F.col("near") >= how.min_texts) & (F.col("near") >= how.generalise * F.col("local")))
        .select("term", "entity", "near", "entity_texts")
    )

    bits = np.zeros(how.filter_bits, np.uint8)
    # At most filter_bits numbers, however many candidates there are.
    places = candidates.select((F.crc32(F.col("term").cast("binary")) % how.filter_bits).cast("int").alias("b")).distinct()
    bits[places.toPandas()["b"].to_numpy(np.int64)] = 1
    packed = np.packbits(bits).tobytes()

    spotted = (
        base.select("digest", _spotter(packed, how)("text").alias("o"))
        .where(F.size("o") > 0)
        .groupBy("digest")
        .agg(F.first("o").alias("o"))
    )
    occurrences = materialize(spotted.select("digest", F.explode("o").alias("o")).select("digest", "o.*"))
    held = occurrences.join(candidates, "term", "left_semi").select("digest", "term").distinct().groupBy("term").agg(
        F.count(F.lit(1)).alias("texts")
    )
    share = F.col("near") / F.col("texts")
    passing = materialize(
        held.join(candidates, "term")
        .where((share >= how.generalise) & (share * n_texts >= 2**how.min_bits * F.col("entity_texts")))
        .select("term", "entity", share.alias("share"))
    )
    wordy = materialize(passing.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > how.max_terms).select("entity"))
    in_texts = pairs.select("digest", "term", "entity").join(passing.join(wordy, "entity", "left_semi"), ["term", "entity"], "left_semi")
    in_texts = materialize(in_texts)
    weights = _independent(per_text.select("digest", "sketch").join(in_texts.select("digest").distinct(), "digest", "left_semi"))
    apart = (
        in_texts.join(weights, "digest")
        .groupBy("term", "entity")
        .agg(F.sum("weight").alias("weight"))
        .where(F.col("weight") >= _ONE * how.min_texts)
    )
    told = passing.join(wordy, "entity", "left_anti").unionByName(passing.join(apart, ["term", "entity"], "left_semi"))
    telling = materialize(
        told.groupBy("term").agg(F.when(F.max("share") >= how.remove, "remove").otherwise("generalise").alias("action"))
    )
    terms = (
        occurrences.join(telling, "term")
        .groupBy("digest")
        .agg(F.collect_set(F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end", "action")).alias("told"))
    )
    masked = F.transform(
        "spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit("mask").alias("action"))
    )
    inside = lambda t: F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    outside = F.filter("told", lambda t: ~inside(t))
    return (
        found.select("doc_id", "digest", "spans")
        .join(terms, "digest", "left")
        .select("doc_id", F.sort_array(F.when(F.col("told").isNull(), masked).otherwise(F.concat(masked, outside))).alias("spans"))
    )


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def sanitised(text: str, spans: list) -> str:
    """``text`` with patterns masked, terms generalised to ``[TERM]`` or removed; overlapping spans are taken in order."""
    out, at = [], 0
    for span in spans:
        if span["start"] < at:
            at = max(at, span["end"])
            continue
        out.append(text[at : span["start"]])
        out.append({"mask": f"[{KINDS[span['kind']].upper()}]", "generalise": "[TERM]", "remove": ""}[span["action"]])
        at = span["end"]
    return "".join([*out, text[at:]])


def add_sanitised(docs: DataFrame, spans: DataFrame, out: str = "sanitised") -> DataFrame:
    """``docs`` joined with ``spans`` of :func:`find_personal_data` by id, with the sanitised text in ``out``; ids must be unique."""
    for_python(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([sanitised(t or "", list(s) if s is not None else []) for t, s in zip(texts, found, strict=True)])

    both = docs.join(spans.select(F.col("doc_id").alias("__id"), F.col("spans").alias("__spans")), F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return both.withColumn(out, clean("text", "__spans")).drop("__id", "__spans")
