"""op9: line-first quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gustwatch.llm.common import NO_SPACE, table
from gustwatch.llm.quality_rules import RULES, line_quality

NAME = "op9_line_first_cleaning"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_failed_lines",
        "lost_share",
    )


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), {_text(NO_SPACE)}) AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_text(NO_SPACE)})) AS ls
  FROM documents
),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
g AS (
  SELECT r, i, w || ' ' || lead(w, 1) OVER (PARTITION BY r ORDER BY i) || ' ' || lead(w, 2) OVER (PARTITION BY r ORDER BY i) AS g
  FROM w
),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g WHERE g IS NOT NULL) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep CROSS JOIN (VALUES (0), (1), (2)) v(k) GROUP BY r),
c AS (
  SELECT t.*, list_transform(ls, lambda x: len(regexp_extract_all(x, {_text(NO_SPACE)}))) AS lw,
         list_transform(ls, lambda x: len(regexp_extract_all(x, {_text(RULES.separators)}))) AS lp,
         list_transform(ls, lambda x: NOT regexp_matches(x, {_text(RULES.closing)})) AS lo
  FROM t
),
e AS (SELECT c.*, list_transform(lw, lambda n, i: n <= {RULES.menu_words} AND lo[i]) AS le FROM c),
x AS (SELECT e.*, list_concat([false, false], le, [false, false]) AS pe FROM e),
l AS (
  SELECT x.*, list_filter(ls, lambda y, i: NOT (
      len(regexp_extract_all(y, {_text(RULES.symbols)}))
        > {RULES.max_symbol_share} * length(regexp_replace(y, '[\\x20\\x09-\\x0D]+', '', 'g'))
      OR (lp[i] >= {RULES.min_separators} AND lw[i] <= {RULES.separated_words} * lp[i])
      OR (lw[i] <= {RULES.boilerplate_words} AND regexp_matches(y, {_text(RULES.boilerplate)}))
      OR (lw[i] < {RULES.fragment_words} AND lo[i])
      OR (pe[i] AND pe[i + 1] AND pe[i + 2]) OR (pe[i + 1] AND pe[i + 2] AND pe[i + 3])
      OR (pe[i + 2] AND pe[i + 3] AND pe[i + 4]))) AS ok
  FROM x
),
m AS (
  SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(ls) - len(ok) AS BIGINT) AS n_failed_lines,
         length(regexp_replace(array_to_string(ok, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS kept_chars
  FROM l LEFT JOIN cov USING (r)
),
v AS (
  SELECT *, CASE WHEN word_chars > 0 THEN 1 - CAST(kept_chars AS DOUBLE) / word_chars ELSE 0.0 END AS lost_share,
         n_words < {RULES.min_words} OR 100 * n_repeat_words > {RULES.max_repeat_percent} * n_words AS base_failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost_share <= {RULES.max_loss} AS kept, n_failed_lines, lost_share
FROM v
"""
