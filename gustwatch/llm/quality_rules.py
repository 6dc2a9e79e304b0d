"""Line-first cleaning: judge lines, drop failing ones, then reject documents that lose too much. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustwatch.llm.common import NO_SPACE, SPACE, whole


@dataclass(frozen=True)
class LineRules:
    """``max_loss``: share of a document's word characters that failing lines may hold before it is rejected."""

    symbols: str = r"[#*$%&|<>!{}\[\]\\^~]"
    max_symbol_share: float = 0.1
    #: A line is navigation when it has this many separators, and at most ``separated_words`` words for each.
    separators: str = r"[|>»•]"
    min_separators: int = 3
    separated_words: int = 6
    boilerplate: str = (
        r"(?i)lorem ipsum|enable javascript|cookie policy|privacy policy|terms of (?:use|service)|all rights reserved"
    )
    #: Longer lines are prose that mentions a phrase of ``boilerplate``.
    boilerplate_words: int = 25
    #: A line without a closing mark is a heading or menu entry when it has fewer words than this.
    fragment_words: int = 3
    #: Lines without a closing mark of up to ``menu_words`` words are a menu where three or more of them follow each other.
    menu_words: int = 5
    closing: str = r"[.!?:;…\"'”’)\]。！？][\x20\x09-\x0D]*\z"
    max_loss: float = 0.5
    min_words: int = 50
    max_repeat_percent: int = 50


RULES = LineRules()


def _judged(line: Column, rules: LineRules) -> Column:
    """The line, whether it fails by itself, and whether it could be an entry of a menu."""
    bare = F.length(F.regexp_replace(line, SPACE, ""))
    words = F.regexp_count(line, F.lit(NO_SPACE))
    separators = F.regexp_count(line, F.lit(rules.separators))
    is_open = ~line.rlike(rules.closing)
    fails = (
        (F.regexp_count(line, F.lit(rules.symbols)) > rules.max_symbol_share * bare)
        | ((separators >= rules.min_separators) & (words <= rules.separated_words * separators))
        | ((words <= rules.boilerplate_words) & line.rlike(rules.boilerplate))
        | ((words < rules.fragment_words) & is_open)
    )
    return F.struct(line.alias("line"), fails.alias("fails"), ((words <= rules.menu_words) & is_open).alias("entry"))


def _in_menu(lines: Column, place: Column) -> Column:
    """Whether the line at ``place`` is an entry among three or more that follow each other."""
    at = [F.coalesce(F.get(lines, place + k)["entry"], F.lit(False)) for k in range(-2, 3)]
    return at[2] & ((at[1] & (at[0] | at[3])) | (at[3] & at[4]))


def repeated_words(frame: DataFrame, words: str, out: str) -> DataFrame:
    """Add ``out``: the words of ``words`` inside 3-word windows that occur twice or more.

    Window hashes (64 bits) are sorted with their places inside the row; equal
    neighbours are repeats. Rows without repeats stop at a distinct count.
    Each step is a projection of its own, so that no array is built again per element.
    """
    size = F.size(words)
    hashed = frame.withColumn(
        "__h",
        F.when(
            size >= 3,
            F.transform(
                F.slice(F.col(words), F.lit(1), size - 2),
                lambda w, i: F.xxhash64(w, F.get(F.col(words), i + 1), F.get(F.col(words), i + 2)),
            ),
        ),
    )
    some = F.size(F.array_distinct("__h")) < F.size("__h")
    placed = hashed.withColumn(
        "__s", F.when(some, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))
    )
    near = lambda e, k: F.get(F.col("__s"), k)["h"].eqNullSafe(e["h"])
    starts = placed.withColumn(
        "__p",
        F.sort_array(F.transform(F.filter("__s", lambda e, k: near(e, k - 1) | near(e, k + 1)), lambda e: e["p"])),
    )
    gaps = F.transform("__p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col("__p"), k + 1) - p, F.lit(3))))
    total = F.aggregate(gaps, F.lit(0), lambda a, g: a + g)
    return starts.withColumn(out, F.coalesce(total, F.lit(0)).cast("long")).drop("__h", "__s", "__p")


def line_quality(docs: DataFrame, rules: LineRules = RULES) -> DataFrame:
    """Per row of ``docs``: measures, the text without failing lines, and the verdict.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_failed_lines, lost_share, base_failed, kept, clean_text.
    A null or empty text has zeros everywhere and fails the base rule. Repeated
    rows and null ids each give their own row; other columns are not read.
    """
    base = docs.select("doc_id", whole().alias("__t"))
    cut = base.select(
        "doc_id",
        "__t",
        F.array_remove(F.split("__t", SPACE), "").alias("__w"),
        F.filter(F.split("__t", "\n"), lambda x: x.rlike(NO_SPACE)).alias("__l"),
    )
    lines = repeated_words(cut, "__w", "n_repeat_words").withColumn("__j", F.transform("__l", lambda x: _judged(x, rules)))
    passed = F.filter("__j", lambda x, i: ~x["fails"] & ~_in_menu(F.col("__j"), i))
    judged = lines.withColumn("__ok", F.transform(passed, lambda x: x["line"]))
    measured = judged.select(
        "doc_id",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        (F.size("__l") - F.size("__ok")).cast("long").alias("n_failed_lines"),
        F.length(F.regexp_replace(F.array_join("__ok", ""), SPACE, "")).alias("__kept_chars"),
        F.array_join("__ok", "\n").alias("clean_text"),
    )
    lost = F.when(F.col("word_chars") > 0, 1 - F.col("__kept_chars") / F.col("word_chars")).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    return (
        measured.withColumn("lost_share", lost)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("lost_share") <= rules.max_loss))
        .drop("__kept_chars")
    )
