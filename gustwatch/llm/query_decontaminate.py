"""op7: test passages in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustwatch.llm.common import WORD, table
from gustwatch.llm.decontaminate import WINDOW, add_hits, hit_words

NAME = "op7_benchmark_decontamination"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = add_hits(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "__hits")
    n_hit = hit_words(F.col("__hits.hits"))
    return found.select(
        "doc_id",
        F.col("__hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__hits.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


SQL = f"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '{WORD}') AS ws
  FROM documents, low
),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '{WORD}') AS ws FROM benchmark, low
),
bw AS (SELECT item_id, ws, len(ws) AS n, unnest(range(1, greatest(len(ws) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, least(n, {WINDOW}) AS k, array_to_string(ws[i : i + least(n, {WINDOW}) - 1], ' ') AS g FROM bw),
kinds AS (SELECT DISTINCT k FROM win),
dw AS (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, kinds WHERE len(ws) >= k),
hit AS (
  SELECT dw.r, dw.i, dw.k, win.item_id
  FROM dw JOIN win ON win.k = dw.k AND win.g = array_to_string(ws[i : i + dw.k - 1], ' ')
),
covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r
),
items AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
