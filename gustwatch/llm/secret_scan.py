"""Secret scans over an incremental blob ledger: each distinct text and rule version is scanned once, ever."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustwatch.llm.common import for_python, whole
from gustwatch.session import materialize


@dataclass(frozen=True)
class Rule:
    """``version`` is part of the ledger's key: raise it when the rule changes, and all blobs are scanned for it again.

    Matches are leftmost and do not overlap; those for which ``passes`` is
    false are dropped after matching. ``gate`` must be in every text with a match.
    """

    kind: str
    version: int
    pattern: re.Pattern
    passes: Callable[[re.Match], bool] = lambda match: True
    gate: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: str) -> list[tuple[int, int]]:
        if self.gate not in text:
            return []
        return [m.span() for m in self.pattern.finditer(text) if self.passes(m)]


_LONGER = re.compile("[:=]")


class Assigned(Rule):
    """Names a value by a keyword; texts without ``:`` or ``=`` cannot match."""

    def spans(self, text: str) -> list[tuple[int, int]]:
        return super().spans(text) if _LONGER.search(text) else []


#: In the order that settles equal starts. The first three are the base rules.
RULES: tuple[Rule, ...] = (
    Assigned(
        "assign",
        1,
        re.compile(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I
        ),
        lambda m: len(m[2]) >= 8,
    ),
    # A run that begins at AKIA and is too short holds no longer one further on.
    Rule("access", 1, re.compile(r"AKIA[A-Z0-9]{12,}"), gate="AKIA"),
    Rule("hex", 1, re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")),
    Rule("private_key", 1, re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"), gate="-----BEGIN "),
    Rule("jwt", 1, re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), gate="eyJ"),
    Rule("forge_token", 1, re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), gate="gh"),
)

_LEDGER = "blob binary, rule string, spans array<struct<start:int,end:int>>"


def _scanner(rules: tuple[Rule, ...]):
    by_key = {rule.key: rule for rule in rules}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A ledger row per blob and rule, also where nothing was found."""
        for frame in batches:
            rows = [
                (blob, key, [{"start": a, "end": b} for a, b in by_key[key].spans(text)])
                for blob, keys, text in zip(frame["blob"], frame["rules"], frame["text"], strict=True)
                for key in keys
            ]
            yield pd.DataFrame(rows, columns=["blob", "rule", "spans"])

    return scan


def blob_id(column: Column) -> Column:
    return F.unhex(F.sha2(column.cast("binary"), 256))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_LEDGER).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)


def scan_versions(
    versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Bring the ledger up to date with ``versions`` and return one row per version: path, blob, findings.

    ``versions`` has a row per path and historical version of its text;
    ``findings`` is an array of (start, rank, kind, end) by start, then the
    order of ``rules``; offsets in code points, end exclusive. Null text counts
    as empty. Repeated rows and null paths each keep their row. Blobs are
    content addresses (SHA-256), so copies are scanned once however many paths
    have them, and a blob and rule version already in the ledger is not
    scanned again. Only one text per unseen blob is moved. Hot blobs meet the
    findings in a join of narrow rows, which adaptive execution can split.
    """
    spark = for_python(versions.sparkSession)
    every = versions.select(F.col(path).alias("path"), whole(text).alias("text")).withColumn("blob", blob_id(F.col("text")))
    addressed = materialize(every.select("path", "blob"))
    # min() skips null paths: such a blob is found by its address alone, by way of a null-safe join.
    blobs = addressed.groupBy("blob").agg(F.min("path").alias("path"))
    wanted = blobs.withColumn("rule", F.explode(F.lit([rule.key for rule in rules])))
    unseen = (
        wanted.join(read_ledger(spark, ledger).select("blob", "rule").distinct(), ["blob", "rule"], "left_anti")
        .groupBy("blob", "path")
        .agg(F.collect_set("rule").alias("rules"))
    )
    texts = every.join(
        unseen.select(F.col("blob").alias("b"), F.col("path").alias("p"), "rules"),
        F.col("path").eqNullSafe(F.col("p")) & (F.col("blob") == F.col("b")),
    )
    fresh = texts.select("blob", "rules", "text").mapInPandas(_scanner(rules), _LEDGER)
    fresh.write.mode("append").parquet(ledger)

    order = F.create_map(*[F.lit(x) for k, rule in enumerate(rules) for x in (rule.key, k)])
    current = read_ledger(spark, ledger).where(F.size("spans") > 0).withColumn("rank", order[F.col("rule")])
    # A path that holds a blob twice has scanned it twice in one run: distinct.
    found = (
        current.where(F.col("rank").isNotNull())
        .select("blob", "rank", F.split("rule", "@")[0].alias("kind"), F.explode("spans").alias("s"))
        .select("blob", F.struct("s.start", "rank", "kind", "s.end").alias("f"))
        .groupBy("blob")
        .agg(F.sort_array(F.collect_set("f")).alias("findings"))
    )
    return addressed.join(found, "blob", "left").select(
        "path", "blob", F.coalesce("findings", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")).alias("findings")
    )


def joined(findings: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


@F.pandas_udf(T.StringType())
def _redacted(texts: pd.Series, findings: pd.Series) -> pd.Series:
    """Texts with ``[SECRET]`` in place of each found stretch; overlapping findings make one stretch."""

    def one(text: str | None, found: list | None) -> str | None:
        if text is None or found is None:
            return text
        out, at = [], 0
        for span in found:
            if span["start"] >= at:
                out += [text[at : span["start"]], "[SECRET]"]
            at = max(at, span["end"])
        return "".join([*out, text[at:]])

    return pd.Series([one(t, f) for t, f in zip(texts, findings, strict=True)], dtype="object")


def redact(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with secrets replaced in ``text``; all rows and columns stay. Findings meet the texts by content address.

    Texts without findings are not handed to Python. A null text stays null.
    """
    found = scan_versions(docs, ledger, rules, path, text).where(F.size("findings") > 0)
    told = materialize(found.select(F.col("blob").alias("__b"), F.col("findings").alias("__f")).dropDuplicates(["__b"]))
    both = docs.join(told, blob_id(whole(text)) == F.col("__b"), "left")
    clean = _redacted(F.when(F.col("__f").isNotNull(), F.col(text)), F.col("__f"))
    return both.withColumn(text, F.when(F.col("__f").isNotNull(), clean).otherwise(F.col(text))).drop("__b", "__f")
