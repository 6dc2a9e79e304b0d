"""op12: log-probability of every document under a model of six sevenths of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustwatch.llm import query_sql
from gustwatch.llm.common import table
from gustwatch.llm.lm_scoring import MODEL, score_texts

NAME = "op12_lm_scoring"
#: Sums of logarithms are given to this many digits, so that the order of adding does not show.
DIGITS = 6


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = score_texts(docs, "doc_id", ~F.coalesce(held_out, F.lit(False)))
    return scored.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        F.round("base_score", DIGITS).alias("base_score"),
        F.round("score", DIGITS).alias("score"),
    )


def _chance(n: int) -> str:
    """Of the token under its longest context, by the counts c1, c2, ... of the n-grams that end there and h1, ... of their contexts."""
    if n == 1:
        return "(c1 + 1e0) / (total + kinds + 1)"
    lower = _chance(n - 1)
    return (
        f"CASE WHEN h{n - 1} >= {MODEL.min_context} "
        f"THEN (c{n} + {MODEL.mass!r} * ({lower})) / (h{n - 1} + {MODEL.mass!r}) ELSE {lower} END"
    )


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({query_sql.crc32('CAST(doc_id AS VARCHAR)')} % 7 = 2, false) AS held_out,
         list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), [chr(10)]) AS w
  FROM documents
),
t AS (SELECT r, held_out, unnest(w) AS w1, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
g AS (SELECT *, lag(w1) OVER p AS w2, lag(w1, 2) OVER p AS w3 FROM t WINDOW p AS (PARTITION BY r ORDER BY i)),
one AS (SELECT w1, count(*) AS c FROM g WHERE NOT held_out GROUP BY ALL),
two AS (SELECT w2, w1, count(*) AS c FROM g WHERE NOT held_out AND w2 IS NOT NULL GROUP BY ALL),
three AS (SELECT w3, w2, w1, count(*) AS c FROM g WHERE NOT held_out AND w3 IS NOT NULL GROUP BY ALL),
learned AS (SELECT coalesce(sum(c), 0) AS total, count(*) AS kinds FROM one),
counted AS (
  SELECT g.r, total, kinds, coalesce(a.c, 0) AS c1, coalesce(b.c, 0) AS c2, coalesce(e.c, 0) AS c3, coalesce(h.c, 0) AS h1, coalesce(k.c, 0) AS h2
  FROM g CROSS JOIN learned
  LEFT JOIN one a ON a.w1 = g.w1
  LEFT JOIN two b ON b.w2 = g.w2 AND b.w1 = g.w1
  LEFT JOIN three e ON e.w3 = g.w3 AND e.w2 = g.w2 AND e.w1 = g.w1
  LEFT JOIN one h ON h.w1 = g.w2
  LEFT JOIN two k ON k.w2 = g.w3 AND k.w1 = g.w2
),
summed AS (
  SELECT r, count(*) AS n_tokens, count(*) FILTER (c1 > 0) AS n_known, max(total) AS train_tokens,
         round(fsum(log10((c1 + 1e0) / (total + kinds + 1))), {DIGITS}) AS base_score, round(fsum(log10({_chance(3)})), {DIGITS}) AS score
  FROM counted GROUP BY r
)
SELECT doc_id, held_out, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_known AS BIGINT) AS n_known, CAST(train_tokens AS BIGINT) AS train_tokens, base_score, score
FROM d JOIN summed USING (r)
"""
