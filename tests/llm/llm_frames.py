"""Small frames with the awkward cases that every operator has to take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf near the river bank today."
SENTENCES = " ".join(f"word{i} follows word{i + 1} here." for i in range(60))


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty and long texts, ties, repeated rows, no letters, several scripts."""
    rows = [
        (1, PROSE, "en", "a", 100),
        (1, PROSE, "en", "a", 100),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (None, PROSE + " more", "en", "b", 5),
        (None, None, None, None, None),
        (4, "   \t\n ", "en", "b", 6),
        (5, SENTENCES * 40, "en", None, 1),
        (6, "Ünïcödé 漢字 😀 " * 30, "de", "b", 1),
        (7, "x" * 30_000, "en", "c", 30_000),
        (8, SENTENCES, "en", "c", 1),
        (9, SENTENCES, "en", "c", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(docs: DataFrame) -> DataFrame:
    """Further columns under names that operators use themselves."""
    names = ["score", "kept", "words", "n", "node", "key", "bucket", "component", "spans", "f", "h", "size", "target", "path", "blob", "unit", "label"]
    for k, name in enumerate(names):
        docs = docs.selectExpr("*", f"{k} AS {name}")
    return docs


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
