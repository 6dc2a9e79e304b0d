"""op8: near duplicates among all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gustwatch.llm.common import NO_SPACE, table
from gustwatch.llm.near_duplicates import NEAR, near_components

NAME = "op8_circulant_minhash"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


_K = NEAR.words
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{NO_SPACE}') AS ws
  FROM documents
),
s AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(ws) - {_K} + 1, 1) + 1),
                                              lambda i: array_to_string(ws[i : i + {_K} - 1], ' '))) AS ss
  FROM d WHERE len(ws) > 0
),
x AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
          FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= {NEAR.percent} * (na + nb - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON both_ways.a = reach.other
),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(ss), 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN s USING (doc_id)
"""
