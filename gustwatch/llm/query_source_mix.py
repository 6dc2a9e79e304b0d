"""op3: all documents mixed to target weights over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustwatch.llm.common import table
from gustwatch.llm.source_mix import mix_documents

NAME = "op3_source_mix"
#: Places on the word axis follow a hash that DuckDB lacks; tests check targets and sums by brute force.
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    first = F.get("positions", F.lit(0))
    return mixed.select(
        "doc_id", "source", "size", "source_size", "target", "taken", first.alias("first_position"), F.get("positions", F.lit(1)).alias("second_position")
    ).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")
