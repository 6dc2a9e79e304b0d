"""op11: periodic runs of words in every document, a tenth of which is made periodic first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustwatch.llm import query_sql
from gustwatch.llm.common import SPACE, table, whole
from gustwatch.llm.periodic_runs import MIN_PERIODS, MIN_WORDS, add_runs

NAME = "op11_periodic_runs"


def _periodic(text: Column, h: Column) -> Column:
    """The text whose words repeat with a period from a place on, both taken from ``h``."""
    found = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, g = F.size(found), F.floor(h / 10).cast("long")
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
    period = F.slice(found, a + 1, p)
    rest = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when(n > 0, F.array_join(F.concat(F.slice(found, F.lit(1), a), rest), " ")).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", whole().alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    changed = docs.withColumn("text", F.when(h % 10 == 0, _periodic(F.col("text"), h)).otherwise(F.col("text")))
    found = add_runs(changed, out="found").select("doc_id", "found.*")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    ranked = F.transform(
        "runs",
        lambda r: F.struct((r["length"] / r["period"]).alias("times"), (-r["start"]).alias("s"), (-r["period"]).alias("q"), r["length"].alias("length")),
    )
    best = F.array_max(ranked)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-best["s"]).alias("start"),
        best["length"].alias("length"),
        (-best["q"]).alias("period"),
        F.floor(1000 * best["length"] / -best["q"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {query_sql.words('text')} AS w, {query_sql.crc32('CAST(doc_id AS VARCHAR)')} AS h FROM documents
),
g AS (SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
m AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: w[CAST(1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS BIGINT)]) ELSE w END AS w FROM p
),
t AS (SELECT r, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM m),
pairs AS (
  SELECT x.r, x.i, x.i - y.i AS q FROM t x JOIN t y ON x.r = y.r AND x.word = y.word AND y.i < x.i
  WHERE {MIN_PERIODS} * (x.i - y.i) <= x.n
),
parts AS (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pairs),
stretches AS (
  SELECT r, q, min(i) - q AS s, max(i) + 1 AS e FROM parts GROUP BY r, q, k
  HAVING max(i) + 1 - min(i) + q >= greatest({MIN_WORDS}, {MIN_PERIODS} * q)
),
runs AS (SELECT r, s, e - s AS size, min(q) AS q FROM stretches GROUP BY r, s, e),
listed AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || size || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
         first(struct_pack(s, size, q) ORDER BY size / q DESC, s, q) AS best
  FROM runs GROUP BY r
),
dropped AS (SELECT DISTINCT r, unnest(range(s + q, s + size)) AS i FROM runs),
kept AS (SELECT t.r, string_agg(word, ' ' ORDER BY t.i) AS rest FROM t ANTI JOIN dropped USING (r, i) GROUP BY t.r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.size AS BIGINT) AS length,
       CAST(best.q AS BIGINT) AS period, CAST(1000 * best.size // best.q AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM m LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""
