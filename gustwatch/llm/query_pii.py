"""op4: personal data in all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustwatch.llm.common import table
from gustwatch.llm.pii import KINDS, find_personal_data, joined

NAME = "op4_disclosing_terms"
#: DuckDB gives no offsets of regular expression matches; a brute-force test checks the spans.
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    term = KINDS.index("term")

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in range(len(KINDS))],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != term)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
