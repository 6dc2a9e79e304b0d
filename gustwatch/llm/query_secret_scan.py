"""op2: secrets in all documents, by way of a blob ledger of this run."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustwatch.llm.common import table
from gustwatch.llm.secret_scan import joined, scan_versions
from gustwatch.session import checkpoint_root

NAME = "op2_secret_scan"
#: DuckDB gives no offsets of regular expression matches; a brute-force test checks the spans.
SQL = None
BASE = ("assign", "access", "hex")


def new_ledger(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/ledger-{uuid.uuid4().hex}"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_versions(docs, new_ledger(spark))

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("findings", lambda f: f["kind"].isin(*BASE))
    return found.select(
        F.col("path").alias("doc_id"),
        *[count(kind) for kind in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )
