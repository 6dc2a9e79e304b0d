"""op1: licence notices in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustwatch.llm.common import WORD, table
from gustwatch.llm.license_scan import NOTICES, labels, scan_licenses

NAME = "op1_license_scan"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base_numbers = [i for i, n in enumerate(NOTICES) if n.base]
    base = found.withColumn("base", F.filter("places", lambda p: p["notice"].isin(base_numbers)))
    starts = F.transform("base", lambda p: p["start"].cast("long"))
    return base.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


_ROWS = ", ".join(
    f"('{n.label}', string_split('{n.text}', ' '), '{n.phrase}', {len(n.key)}, {n.offset}, {str(n.base).lower()})" for n in NOTICES
)
SQL = f"""
WITH notice(label, words, phrase, k, o, base) AS (VALUES {_ROWS}),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws
  FROM documents
),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
hit AS (
  SELECT r, i, label, base,
         CAST(len(list_filter(range(1, len(words) + 1), lambda j: i - o + j - 1 >= 1 AND ws[i - o + j - 1] = words[j])) AS DOUBLE)
           / len(words) AS share
  FROM w JOIN notice ON w.w = split_part(notice.phrase, ' ', 1) JOIN d USING (r)
  WHERE array_to_string(ws[i : i + k - 1], ' ') = phrase
),
s AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(i - 1) FILTER (base) AS first_word, max(i - 1) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM hit GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN s USING (r)
"""
