"""The registered queries against their SQL, and the pipeline stage by stage."""

import corpus_pipeline
import pytest
from compare import difference, duckdb_views
from pyspark.sql import functions as F

from gustwatch.llm import registry
from gustwatch.llm.query_quality_classifier import held_out

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    assert difference(registry.queries()[name](spark, SF), duckdb_views(SF), registry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_one_row_per_document(spark, name):
    assert registry.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_held_out_third(spark):
    import zlib

    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.limit(1).select("*").withColumn("doc_id", F.lit(10_000).cast("long"))
    secret = first.withColumn("text", F.concat("text", F.lit(" token = abcdefghijklmnop"))).withColumn("doc_id", F.lit(10_001).cast("long"))
    docs = corpus_pipeline.materialize(docs.unionByName(first).unionByName(secret))
    columns, n = docs.columns, docs.count()
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.materialize(stage(spark, docs, SF))
        if number < 4:
            assert out.columns == columns and 0 < out.count() <= n
            assert out.select("doc_id").distinct().count() == out.count()
            n = out.count()
        docs = out
    assert docs.where((F.col("taken") > 2 * F.col("size")) | F.col("position").isNull()).count() == 0
