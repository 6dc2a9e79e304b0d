"""The pipeline over rows with nulls, repeated rows, clashing columns and over an empty table."""

import corpus_pipeline
from llm_frames import awkward, clashing, empty

SF = "/root/testdata/sf0.001"


def tables(spark, folder, docs):
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_awkward_rows_beside_documents(spark, tmp_path):
    known = spark.read.parquet(f"{SF}/documents.parquet")
    shifted = awkward(spark).selectExpr("doc_id + 1000000 AS doc_id", "text", "lang", "source", "n_chars")
    docs = clashing(known.unionByName(shifted, allowMissingColumns=True))
    found = corpus_pipeline.run(spark, tables(spark, tmp_path, docs)).collect()
    assert found and all(r["taken"] <= 2 * r["size"] for r in found if r["size"])
    ids = {r["doc_id"] for r in found}
    plain_ids = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()}
    # Further rows and columns leave most of the other documents where they were: the classifier learns from the same labels.
    assert len(plain_ids & ids) > 0.9 * len(plain_ids)
    positions = [r["position"] for r in found]
    assert None not in positions


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, empty(spark))).count() == 0
