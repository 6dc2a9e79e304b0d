"""The corpus pipeline: five stages from raw documents to a training order.

Each stage takes (spark, docs, sf_dir) and works on all documents that its
predecessor kept; all but the last return the columns of ``docs``. Helper
columns begin with two underscores and a name of their own, so that further
columns of ``docs`` stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gustwatch.llm.common import table
from gustwatch.llm.decontaminate import add_hits
from gustwatch.llm.near_duplicates import Near, near_components
from gustwatch.llm.quality_classifier import add_score
from gustwatch.llm.query_quality_classifier import fitted
from gustwatch.llm.query_secret_scan import new_ledger
from gustwatch.llm.secret_scan import redact
from gustwatch.llm.source_mix import mix_documents, training_order
from gustwatch.session import materialize

#: Five words and 80 %; 32 bands of 4 miss a link at 80 % with a chance of 5e-8.
NEAR = Near(words=5, percent=80, bands=32)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half go. Empty texts are scored like any other; without labels all stay."""
    scored = add_score(docs, fitted(spark, docs, sf_dir), out="__quality")
    return scored.where(F.col("__quality") >= 0.5).drop("__quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id.

    Rows that repeat an id count as one document, of which one row stays. Rows
    without an id cannot be told apart by it and stay.
    """
    gone = near_components(docs, NEAR).where(~F.col("kept") & F.col("doc_id").isNotNull())
    gone = materialize(gone.select(F.col("doc_id").alias("__gone")).distinct())
    left = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    again = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    once = left.where(F.col("doc_id").isNotNull()).withColumn("__turn", F.row_number().over(again)).where("__turn = 1")
    return once.drop("__turn").unionByName(left.where(F.col("doc_id").isNull()))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a test item go."""
    marked = add_hits(docs, table(spark, sf_dir, "benchmark"), out="__hits")
    return marked.where(F.size("__hits.hits") == 0).drop("__hits")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; ``n_chars`` follows. All documents stay."""
    clean = redact(docs, new_ledger(spark))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.coalesce(length, "n_chars"))
    return clean.select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: a row per pass over a document that the mix takes, by position."""
    return training_order(mix_documents(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scan", secrets),
    ("source mix", mixing),
]

#: SQL cannot express a learned classifier; the stages after it are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes from stage to stage is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialize(docs)
    return docs
