"""op10: bytes of passages that occur more than once, in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gustwatch.llm.common import table
from gustwatch.llm.repeated_passages import PASSAGES, remove_repeats

NAME = "op10_repeated_passages"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
l AS (
  SELECT r, list_transform(range(0, CAST(length(h) // 2 AS BIGINT) - {PASSAGES.width} + 1),
                           lambda p: md5_number(substr(h, 2 * p + 1, {2 * PASSAGES.width}))) AS gs
  FROM d WHERE length(h) // 2 >= {PASSAGES.width}
),
w AS (SELECT r, unnest(gs) AS g, generate_subscripts(gs, 1) - 1 AS p FROM l),
twice AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
hit AS (SELECT r, p FROM w SEMI JOIN twice USING (g)),
runs AS (
  SELECT r, min(p) AS a, max(p) + {PASSAGES.width} AS b
  FROM (SELECT r, p, sum(CASE WHEN p - before <= {PASSAGES.width} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS k
        FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM hit))
  GROUP BY r, k
),
kept AS (
  SELECT r, h, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since, lead(a) OVER (PARTITION BY r ORDER BY a) AS upto
  FROM runs JOIN d USING (r)
),
joined AS (
  SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, CAST(2 * since + 1 AS BIGINT), CAST(2 * (a - since) AS BIGINT))
           || CASE WHEN upto IS NULL THEN substr(h, CAST(2 * b + 1 AS BIGINT)) ELSE '' END, '' ORDER BY a) AS rest
  FROM kept GROUP BY r
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN joined USING (r)
"""
