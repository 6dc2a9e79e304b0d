"""op6: verdicts on all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gustwatch.llm import url_filter
from gustwatch.llm.common import table

NAME = "op6_url_filter"
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), url_filter.rule_table(spark, RULES))


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: Links as the SQL reads them: plain patterns, without comments, scripts or lists of words.
_LINKS = (
    r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)",
    r"(?is)<link\b[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)[^>]*?\brel\s*=\s*[\"']?canonical\b",
    r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)",
)
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_HOST = (
    f"coalesce(translate(regexp_extract(url, {_q(url_filter._PARTS)}, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
)
_PATH = f"coalesce(regexp_extract(url, {_q(url_filter._PARTS)}, 2), '')"
_FORM = f"""CASE WHEN host = '' THEN url ELSE host || regexp_replace(path, '(?:/|\\.html?)\\z', '')
    || CASE WHEN query = '' THEN '' ELSE '?' || query END END"""
_KEPT = f"""array_to_string(list_filter(string_split(regexp_extract(url, {_q(url_filter._QUERY)}, 1), '&'),
    lambda q: q <> '' AND NOT regexp_matches(q, {_q(url_filter._TRACKING)})), '&')"""
_TARGETS = " || ".join(
    f"regexp_extract_all(coalesce(html, ''), {_q(p)}, 1)" for p in _LINKS
)
SQL = f"""
WITH RECURSIVE rules(h, p, d) AS (VALUES {_RULE_ROWS}),
targets AS (SELECT url, {_HOST} AS host, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme, unnest({_TARGETS}) AS t FROM pages WHERE url IS NOT NULL),
links AS (
  SELECT url, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN scheme || ':' || t
                   WHEN starts_with(t, '/') THEN scheme || '://' || host || t END AS target FROM targets
),
urls AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT target FROM links WHERE target IS NOT NULL),
parts AS (SELECT url, {_HOST} AS host, {_PATH} AS path, {_KEPT} AS query FROM urls),
nodes AS (SELECT url, host, path, {_FORM} AS node FROM parts),
best AS (
  SELECT url, arg_max(h || p, length(h || p)) AS rule, arg_max(d, length(h || p)) AS verdict
  FROM nodes JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY url
),
edges AS (
  SELECT a.node AS a, b.node AS b FROM links JOIN nodes a USING (url) JOIN nodes b ON b.url = links.target
),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, other) AS (
  SELECT node, node FROM nodes UNION SELECT reach.node, b FROM reach JOIN both_ways ON both_ways.a = reach.other
),
alias AS (SELECT node, min(other) AS alias FROM reach GROUP BY node),
judged AS (SELECT nodes.*, rule, verdict, alias FROM nodes LEFT JOIN best USING (url) JOIN alias USING (node)),
verdicts AS (SELECT alias, bool_or(verdict = 'allow') AS allowed, bool_or(verdict = 'block') AS blocked FROM judged GROUP BY alias)
SELECT page_id, {_HOST.replace('url', 'pages.url')} AS host, {_PATH.replace('url', 'pages.url')} AS path, rule,
       coalesce(verdict, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM pages LEFT JOIN judged ON judged.url = pages.url LEFT JOIN verdicts USING (alias)
"""
