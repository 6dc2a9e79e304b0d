"""URL filters with redirect equivalence. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustwatch.llm.components import components
from gustwatch.session import materialize

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_QUERY = r"(?s)^[^?#]*\?([^#]*)"
_TRACKING = r"^(?:utm_[a-z]+|ref|fbclid|gclid)(?:=|\z)"
#: Comments, scripts and styles hold no links; one that is never closed reaches to the end.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
#: A name and its value. Attributes are read one after the other, so that text inside a value is none.
_ATTRIBUTE = r"([^\s\"'>/=]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
_REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s]+)"
_AMPERSAND = r"(?i)&(?:amp|#0*38|#x0*26);"
_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def lower_host(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_host(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical_form(url: Column) -> Column:
    """What servers redirect to the same page: without scheme, fragment, tracking parameters, closing slash or ``.html``."""
    path = F.regexp_replace(path_of(url), r"(?:/|\.html?)\z", "")
    kept = F.filter(F.split(F.regexp_extract(url, _QUERY, 1), "&"), lambda q: (q != "") & ~q.rlike(_TRACKING))
    query = F.array_join(kept, "&")
    form = F.concat(host_of(url), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host_of(url) == "", url).otherwise(form)


def _without_dots(path: Column) -> Column:
    """A path from ``/`` on, with ``.`` and ``..`` segments carried out."""
    segments = F.split(F.substring(path, 2, 1 << 30), "/")
    nothing = F.array().cast("array<string>")

    def step(kept: Column, segment: Column) -> Column:
        parent = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(segment == ".", kept).when(segment == "..", parent).otherwise(F.concat(kept, F.array(segment)))

    kept = F.aggregate(segments, nothing, step)
    closed = F.element_at(segments, -1).isin(".", "..") & (F.size(kept) > 0)
    dotless = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(closed, "/").otherwise(""))
    return F.when(path.contains("/."), dotless).otherwise(path)


def resolved(target: Column, base: Column) -> Column:
    """``target`` as an absolute url seen from ``base``; null for other schemes (``mailto:``) and without a host to start from."""
    root = F.concat(F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.lit("://"), host_of(base))
    query = F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1)
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    path, rest = (F.regexp_extract(target, r"(?s)^([^?#]*)(.*)", i) for i in (1, 2))
    own = F.regexp_extract(target, r"(?s)^([^?#]*?://[^/?#]*)", 1)
    with_authority = F.concat(own, _without_dots(F.regexp_extract(target, _PARTS, 2)), rest)
    relative = (
        F.when(path.startswith("/"), F.concat(root, _without_dots(path), rest))
        .when(path != "", F.concat(root, _without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), path)), rest))
        .when(rest.startswith("?"), F.concat(root, path_of(base), rest))
        .otherwise(F.concat(root, path_of(base), query, rest))
    )
    return (
        F.when(target.rlike(_ABSOLUTE), F.when(own != "", with_authority))
        .when(host_of(base) == "", F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?://)", 1), F.substring(target, 3, 1 << 30)))
        .otherwise(relative)
    )


def _tags(html: Column, name: str) -> Column:
    """The tags of a name; a tag ends at its first ``>``."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}(?=[\s/])[^>]*>"), F.lit(0))


def _attribute(tag: Column, name: str) -> Column:
    """The value of the first attribute of this very name, without quotes; null if there is none."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(1)), F.lower)
    values = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(2))
    return F.regexp_replace(F.get(values, F.array_position(names, F.lit(name)).cast("int") - 1), r"^[\"']|[\"']\z", "")


def link_targets(url: Column, html: Column) -> Column:
    """Targets of canonical links and refresh redirects as absolute urls, relative ones seen from the page or its base href.

    ``rel`` is a list of words, of which one is canonical. Comments, scripts
    and styles are cut out first.
    """

    def decoded(value: Column) -> Column:
        return F.regexp_replace(value, _AMPERSAND, "&")

    def in_page(page: Column) -> Column:
        canonical = F.filter(
            _tags(page, "link"), lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), F.lit("canonical"))
        )
        refresh = F.filter(_tags(page, "meta"), lambda t: F.lower(F.trim(_attribute(t, "http-equiv"))) == "refresh")
        found = F.concat(
            F.transform(canonical, lambda t: F.trim(_attribute(t, "href"))),
            F.transform(refresh, lambda t: F.regexp_extract(_attribute(t, "content"), _REFRESH_URL, 1)),
        )
        named = decoded(F.get(F.filter(F.transform(_tags(page, "base"), lambda t: _attribute(t, "href")), F.isnotnull), F.lit(0)))
        base = F.when(F.coalesce(named, F.lit("")) == "", url).otherwise(F.coalesce(resolved(named, url), url))
        # The base is bound once, so that a page with many links is not searched for it again and again.
        seen = F.filter(found, lambda t: F.coalesce(t, F.lit("")) != "")
        return F.flatten(F.transform(F.array(base), lambda b: F.transform(seen, lambda t: resolved(decoded(t), b))))

    linked = html.rlike(r"(?i)\bcanonical\b|\bhttp-equiv\b")
    targets = F.flatten(F.transform(F.array(F.regexp_replace(html, _HIDDEN, " ")), in_page))
    return F.when(linked, F.array_compact(targets)).otherwise(F.array().cast("array<string>"))


def matched_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule (host, path, verdict) that fits each distinct ``url``: url, rule, verdict; urls without one are missing.

    A rule fits its host and all subdomains, if the path begins with its path.
    Hosts are looked up by each of their suffixes in an equi-join, so the rule
    list may be of any size.
    """
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    fitting = (
        parts.select("url", "path", F.explode(suffixes).alias("suffix"))
        .join(rules.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("verdict").alias("d")), F.col("suffix") == F.col("h"))
        .where(F.col("path").startswith(F.col("p")))
    )
    rule = F.concat("h", "p")
    best = fitting.groupBy("url").agg(F.max(F.struct(F.length(rule), F.length("h"), rule.alias("rule"), F.col("d").alias("verdict"))).alias("best"))
    return best.select("url", "best.rule", "best.verdict")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", spelling: bool = True) -> DataFrame:
    """One row per row of ``pages`` (id, url, html): id, host, path, rule, verdict.

    A page with a fitting rule has that rule's verdict. Others take the verdict
    of their aliases: urls of one canonical form, and forms joined by canonical
    links or refresh redirects, make a component; it is allowed if a rule
    allows any of its urls, else blocked if a rule blocks one, else allowed.
    Without ``spelling`` a url is its own form, so that only links join urls.
    Null urls have empty host and path, no aliases, and are allowed; null html
    has no links; repeated rows and null ids keep their rows. Pages are read
    once; only urls are shuffled, after removal of repeats.
    """
    form = canonical_form if spelling else lambda url: url
    read = materialize(
        pages.select(
            F.col(id_col).alias("id"),
            F.col("url").cast("string").alias("url"),
            link_targets(F.col("url"), F.coalesce(F.col("html"), F.lit(""))).alias("targets"),
        )
    )
    links = read.where(F.col("url").isNotNull()).select("url", F.explode("targets").alias("target"))
    forms = links.select(form(F.col("url")).alias("a"), form(F.col("target")).alias("b"))
    linked = components(forms.distinct())
    urls = (
        read.select("url").unionByName(links.select(F.col("target").alias("url"))).where(F.col("url").isNotNull()).distinct()
    )
    ruled = materialize(
        urls.join(matched_rules(urls, rules), "url", "left").select("url", form(F.col("url")).alias("node"), "rule", "verdict")
    )
    grouped = ruled.join(linked, "node", "left").withColumn("alias", F.coalesce("component", "node"))
    verdicts = grouped.groupBy("alias").agg(
        F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked")
    )
    judged = grouped.join(verdicts, "alias").select(
        F.col("url").alias("u"),
        "rule",
        F.coalesce("verdict", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block"), F.lit("allow")).alias("verdict"),
    )
    return read.join(judged, F.col("url") == F.col("u"), "left").select(
        F.col("id").alias(id_col),
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
    )
