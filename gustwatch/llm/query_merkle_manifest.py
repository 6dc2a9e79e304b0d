"""op13: hash tree over all documents, and what a changed document does to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustwatch.llm import query_sql
from gustwatch.llm.common import Scratch, table
from gustwatch.llm.merkle_manifest import leaf_digest, manifest
from gustwatch.session import materialize

NAME = "op13_merkle_manifest"


def _leaf(text: Column) -> Column:
    return leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    scratch = Scratch(spark)
    try:
        found = materialize(manifest(docs, "source", "doc_id", _leaf(F.col("text")), _leaf(changed), scratch))
    finally:
        scratch.drop()
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.col("proof").alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def _part(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


_FIELDS = " || ".join(_part(c) for c in ("doc_id", "source", "lang", "n_chars"))

SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS g, sha256({_FIELDS} || {_part('text')}) AS leaf,
         CASE WHEN {query_sql.crc32('CAST(doc_id AS VARCHAR)')} % 2 = 0
              THEN sha256({_FIELDS} || {_part("replace(text, chr(10), '')")}) ELSE sha256({_FIELDS} || {_part('text')}) END AS shown
  FROM documents
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, shown) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d
),
tree(g, lvl, i, x, n) AS (
  SELECT g, 0, i, leaf, n FROM leaves
  UNION ALL
  SELECT g, lvl + 1, i // 3, sha256(string_agg(x, '' ORDER BY i)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY g, lvl, i // 3, n
),
subroots AS (SELECT g, x FROM tree WHERE n = 1),
tops AS (SELECT g, x, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM subroots),
crown(lvl, i, x, n) AS (
  SELECT 0, i, x, n FROM tops
  UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(x, '' ORDER BY i)), (n + 2) // 3 FROM crown WHERE n > 1 GROUP BY lvl, i // 3, n
),
-- One ladder of levels per source: its own tree, then the tree of the sources.
tall AS (SELECT g, max(lvl) AS height FROM tree GROUP BY g),
sides AS (
  SELECT g, lvl, i, n, x, string_agg(x, '') OVER (PARTITION BY g, lvl, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
         string_agg(x, '') OVER (PARTITION BY g, lvl, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM tree WHERE n > 1
),
crown_sides AS (
  SELECT lvl, i, string_agg(x, '') OVER (PARTITION BY lvl, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
         string_agg(x, '') OVER (PARTITION BY lvl, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM crown WHERE n > 1
),
up(r, g, lvl, i, siblings, x) AS (
  SELECT r, g, 0, i, '', shown FROM leaves
  UNION ALL
  SELECT u.r, u.g, u.lvl + 1, u.i // 3, u.siblings || coalesce(s.l, '') || coalesce(s.r, ''), sha256(coalesce(s.l, '') || u.x || coalesce(s.r, ''))
  FROM up u JOIN sides s ON s.g = u.g AND s.lvl = u.lvl AND s.i = u.i
),
mid AS (SELECT u.r, u.g, t.i, u.siblings, u.x FROM up u JOIN tall USING (g) JOIN tops t ON t.g = u.g WHERE u.lvl = tall.height),
over(r, lvl, i, siblings, x) AS (
  SELECT r, 0, i, siblings, x FROM mid
  UNION ALL
  SELECT u.r, u.lvl + 1, u.i // 3, u.siblings || coalesce(s.l, '') || coalesce(s.r, ''), sha256(coalesce(s.l, '') || u.x || coalesce(s.r, ''))
  FROM over u JOIN crown_sides s ON s.lvl = u.lvl AND s.i = u.i
),
root AS (SELECT x AS root, lvl AS height FROM crown WHERE n = 1)
SELECT doc_id, leaf, s.x AS subroot, root, sha256(siblings) AS proof_sha256, o.x AS folded_root, o.x = root AS verified
FROM d JOIN subroots s USING (g) JOIN root ON true JOIN over o ON o.r = d.r AND o.lvl = root.height
"""
