"""Every operator takes awkward rows, clashing columns and empty tables, and gives one defined row per row."""

import pytest
from llm_frames import awkward, clashing, empty
from pyspark.sql import functions as F

from gustwatch.llm import decontaminate, license_scan, near_duplicates, pii, quality_classifier, quality_rules
from gustwatch.llm import repeated_passages, secret_scan, source_mix, url_filter

BENCH = "item_id long, text string"


def op1(spark, docs):
    return license_scan.scan_licenses(docs)


def op2(spark, docs):
    from gustwatch.llm.query_secret_scan import new_ledger

    return secret_scan.scan_versions(docs, new_ledger(spark)).withColumnRenamed("path", "doc_id")


def op3(spark, docs):
    return source_mix.mix_documents(docs)


def op4(spark, docs):
    return pii.find_personal_data(docs)


def op5(spark, docs):
    labels = spark.createDataFrame([(1, 1), (8, 0), (None, 1), (9, None), (5, 0)], "doc_id long, label int")
    return quality_classifier.add_score(docs, quality_classifier.fit(docs, labels), out="p").select("doc_id", "p")


def op7(spark, docs):
    items = spark.createDataFrame([(1, "the quick brown fox"), (2, None), (None, "lazy dog"), (3, "")], BENCH)
    return decontaminate.add_hits(docs, items).select("doc_id", "__hits")


def op8(spark, docs):
    return near_duplicates.near_components(docs)


def op9(spark, docs):
    return quality_rules.line_quality(docs)


def op10(spark, docs):
    return repeated_passages.remove_repeats(docs, repeated_passages.Passages(unit_bytes=5_000))


OPERATORS = [op1, op2, op3, op4, op5, op7, op8, op9, op10]


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_awkward_rows(spark, operator):
    docs = awkward(spark)
    plain = operator(spark, docs).collect()
    assert sorted(str(r["doc_id"]) for r in plain) == sorted(str(r["doc_id"]) for r in docs.collect())
    ones = [str(r) for r in plain if r["doc_id"] == 1]
    if operator is not op3:  # equal rows lie one after the other on their source's axis
        assert len(ones) == 2 and ones[0] == ones[1]
    assert sorted(map(str, operator(spark, clashing(docs)).collect())) == sorted(map(str, plain)) or operator is op2


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_empty_table(spark, operator):
    assert operator(spark, empty(spark)).count() == 0


def test_empty_benchmark_hits_nothing(spark):
    marked = decontaminate.add_hits(awkward(spark), spark.createDataFrame([], BENCH))
    assert marked.where(F.size("__hits.hits") > 0).count() == 0


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame(
        [
            (1, None, None),
            (2, "no scheme", "<link rel='canonical' href='/x'>"),
            (3, "http://A.Example.com", None),
            (None, "http://b.net/es/1", ""),
            (3, "http://A.Example.com", None),
            (4, "x://?q", None),
        ],
        "page_id long, url string, html string",
    )
    rules = url_filter.rule_table(spark, [("net", "/es/", "block")])
    found = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages.withColumn("u", F.lit(1)), rules).collect()]
    assert sorted(found, key=str) == sorted(
        [
            (1, "", "", None, "allow"),
            (2, "", "", None, "allow"),
            (3, "a.example.com", "", None, "allow"),
            (3, "a.example.com", "", None, "allow"),
            (None, "b.net", "/es/1", "net/es/", "block"),
            (4, "", "", None, "allow"),
        ],
        key=str,
    )
    assert url_filter.judge(pages.limit(0), rules).count() == 0
