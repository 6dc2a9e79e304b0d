"""op5: quality scores of all documents, learned from the labels outside the held-out third."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustwatch.llm.common import table
from gustwatch.llm.quality_classifier import SETTINGS, Model, add_score, fit

NAME = "op5_quality_classifier"
#: Held-out accuracy and temperature need numbers that SQL cannot learn; tests measure them.
SQL = None


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model | None:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return fit(docs, labels.where(~held_out(F.col("doc_id"))), SETTINGS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = add_score(docs, fitted(spark, docs, sf_dir))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
