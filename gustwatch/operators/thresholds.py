"""Threshold sweeps, confusion rates, class weights and average precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustwatch.functions.expressions import above, f_beta, ratio
from gustwatch.operators.ranks import global_running
from gustwatch.operators.percentiles import exact_percentiles, percentile_column
from gustwatch.settings import (
    LIMITS,
    MIN_RECALL,
    POSITIVE_WEIGHT_CAP,
    SWEEP_PERCENTILES,
    Limits,
)


#: The two grids below.
def probability_grid() -> list[float]:
    """Thresholds 0.35 to 0.95 in 80 steps and on to 0.999 in 40."""
    return [float(t) for t in np.unique(np.concatenate([np.linspace(0.35, 0.95, 80), np.linspace(0.95, 0.999, 40)]))]


def f1_grid() -> list[float]:
    """Thresholds 0.05 to 0.95 in steps of 0.05."""
    return [float(t) for t in np.linspace(0.05, 0.95, 19)]


def rate_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {
        "detection_rate": ratio(tp, tp + fn),
        "false_alarm_rate": ratio(fp, fp + tn),
        "precision": ratio(tp, tp + fp),
    }


def confusion(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """One row of counts and rates at a threshold; a row is flagged strictly above it, never without a score."""
    flagged, positive = above(score, threshold), F.col(label) == 1
    counts = df.agg(
        F.count_if(flagged & positive).alias("tp"),
        F.count_if(flagged & ~positive).alias("fp"),
        F.count_if(~flagged & positive).alias("fn"),
        F.count_if(~flagged & ~positive).alias("tn"),
    )
    rates = rate_columns(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return counts.select("*", *[c.alias(n) for n, c in rates.items()])


def sweep_grid(df: DataFrame, score: str, label: str, grid: Sequence[float]) -> DataFrame:
    """Counts and rates at every threshold of a fixed grid, in one pass over the rows."""
    return sweep_grids(df, [score], label, grid).drop("score")


def sweep_grids(df: DataFrame, scores: Sequence[str], label: str, grid: Sequence[float]) -> DataFrame:
    """``sweep_grid`` of several scores at once, one row per ``score`` and threshold.

    A row is counted once per score, in the bucket of the greatest threshold
    below its score; suffix sums over the buckets (one row per threshold) give
    the counts of each threshold. Null and NaN scores are below all of them.
    """
    # The bucketizer's ranges include their lower end; on negated values that leaves scores strictly above.
    splits = [-float("inf"), *[-t for t in reversed(grid)], float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol="_negated", outputCol="_bucket")
    values = [F.struct(F.lit(s).alias("score"), (-F.col(s).cast("double")).alias("negated")) for s in scores]
    long = df.select((F.col(label) == 1).alias("_positive"), F.explode(F.array(*values)).alias("_v"))
    negated = F.nanvl(F.coalesce("_v.negated", F.lit(float("inf"))), F.lit(float("inf")))
    known = long.select("_positive", "_v.score", negated.alias("_negated"))
    counted = (
        bucketizer.transform(known)
        .groupBy("score", (F.lit(len(grid)) - F.col("_bucket").cast("int")).alias("_above"))
        .agg(F.count_if(F.col("_positive")).alias("pos"), F.count_if(~F.col("_positive")).alias("neg"))
    )
    steps = df.sparkSession.createDataFrame(
        [(s, i, float(t)) for s in scores for i, t in enumerate([float("-inf"), *grid])],
        "score string, _above int, threshold double",
    )
    higher, every = Window.partitionBy("score").orderBy(F.desc("_above")), Window.partitionBy("score")
    filled = steps.join(counted, ["score", "_above"], "left").fillna(0, ["pos", "neg"])
    sums = filled.select(
        "score",
        "_above",
        "threshold",
        F.sum("pos").over(higher).alias("tp"),
        F.sum("neg").over(higher).alias("fp"),
        F.sum("pos").over(every).alias("_pos"),
        F.sum("neg").over(every).alias("_neg"),
    ).filter("_above > 0")
    fn, tn = F.col("_pos") - F.col("tp"), F.col("_neg") - F.col("fp")
    counts = sums.select("score", "threshold", "tp", "fp", fn.alias("fn"), tn.alias("tn"))
    rates = rate_columns(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    rates["f1"] = f_beta(rates["precision"], rates["detection_rate"])
    rates["f05"] = f_beta(rates["precision"], rates["detection_rate"], 0.5)
    return counts.select("*", *[c.alias(n) for n, c in rates.items()])


def round_rates(swept: DataFrame, places: int = 4) -> DataFrame:
    names = ("detection_rate", "false_alarm_rate", "precision", "f1", "f05")
    return swept.withColumns({n: F.round(n, places) for n in names if n in swept.columns})


def choose_probability_threshold(swept: DataFrame, min_recall: float = MIN_RECALL) -> DataFrame:
    """Best row of a sweep: most precise with enough recall, else best F0.5; the lowest threshold on ties.

    Rates are rounded to four places before they are compared.
    """
    enough = F.col("detection_rate") >= min_recall
    merit = F.when(enough, F.col("precision")).otherwise(F.col("f05"))
    return round_rates(swept).orderBy(F.desc(enough), F.desc(merit), "threshold").limit(1)


def best_f1(swept: DataFrame) -> DataFrame:
    """Row of the best F1; the lowest threshold on ties."""
    return swept.orderBy(F.desc("f1"), "threshold").limit(1)


def sweep_percentiles(
    scores: DataFrame,
    labelled: DataFrame,
    score: str,
    percents: Sequence[int] = SWEEP_PERCENTILES,
    limits: Limits = LIMITS,
) -> DataFrame:
    """Counts and rates at percentiles of the score.

    ``labelled`` has the score of rows in windows with boolean ``anomalous``
    and ``normal``; a row may be both. The few thresholds pass the driver.
    """
    found = exact_percentiles(scores, score, percents, limits=limits).first()
    thresholds = [(p, found[percentile_column(p)]) for p in percents]
    counts = labelled.agg(
        *[
            F.struct(
                F.lit(p).alias("percentile"),
                F.lit(t).alias("threshold"),
                F.count_if(flagged & F.col("anomalous")).alias("tp"),
                F.count_if(flagged & F.col("normal")).alias("fp"),
                F.count_if(~flagged & F.col("anomalous")).alias("fn"),
                F.count_if(~flagged & F.col("normal")).alias("tn"),
            ).alias(f"p{p}")
            for p, t in thresholds
            for flagged in [above(score, t)]
        ]
    )
    rows = counts.select(F.explode(F.array(*counts.columns)).alias("s")).select("s.*")
    rates = rate_columns(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return rows.select("*", *[rates[n].alias(n) for n in ("detection_rate", "false_alarm_rate")])


def choose_percentile(swept: DataFrame, max_false_alarm: float, fallback: int | None = None) -> DataFrame:
    """Most detection among percentiles with few false alarms; the lowest percentile on ties.

    If none has few enough: ``fallback`` when given, else the best difference of the rates.
    """
    few = F.col("false_alarm_rate") < max_false_alarm
    if fallback is None:
        otherwise = F.col("detection_rate") - F.col("false_alarm_rate")
    else:
        otherwise = (F.col("percentile") == fallback).cast("double")
    merit = F.when(few, F.col("detection_rate")).otherwise(otherwise)
    return swept.orderBy(F.desc(few), F.desc(merit), "percentile").limit(1)


def class_weights(df: DataFrame, label: str, cap: float = POSITIVE_WEIGHT_CAP) -> DataFrame:
    """Balanced class weights and the capped weight of positives; all 1 with one class only."""
    counts = df.agg(F.count_if(F.col(label) == 0).alias("n_neg"), F.count_if(F.col(label) == 1).alias("n_pos"))
    both = (F.col("n_neg") > 0) & (F.col("n_pos") > 0)
    total = F.col("n_neg") + F.col("n_pos")

    def either(value):
        return F.when(both, value).otherwise(F.lit(1.0))

    return counts.select(
        "*",
        either(F.try_divide(total.cast("double"), 2 * F.col("n_neg"))).alias("weight_neg"),
        either(F.try_divide(total.cast("double"), 2 * F.col("n_pos"))).alias("weight_pos"),
        either(F.least(F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos")), F.lit(cap))).alias(
            "scale_pos_weight"
        ),
        (F.least("n_neg", "n_pos") < 10).alias("oversample"),
    )


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the precision-recall steps, one step per distinct score."""
    per_score = df.groupBy(F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count(F.lit(1)).alias("_rows")
    )
    stepped = global_running(per_score, [F.desc("_score")], _tp=F.col("_pos"), _flagged=F.col("_rows"))
    gained = F.sum(F.col("_pos") * F.col("_tp") / F.col("_flagged"))
    return stepped.agg(
        F.sum("_pos").alias("positives"),
        F.coalesce(F.try_divide(gained, F.sum("_pos")), F.lit(0.0)).alias("average_precision"),
    )


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    pairs = df.groupBy(F.col(label).alias("_l"), F.col(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("_l").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("flagged")),
                F.struct(F.col("_p").alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("flagged")),
            )
        ).alias("s"),
        F.when((F.col("_l") == F.col("_p")), F.col("n")).otherwise(F.lit(0)).alias("hit"),
    )
    totals = sides.groupBy("s.class").agg(
        F.sum("s.actual").alias("support"), F.sum("s.flagged").alias("flagged"), (F.sum("hit") / 2).alias("hits")
    )
    precision, recall = ratio(F.col("hits"), F.col("flagged")), ratio(F.col("hits"), F.col("support"))
    return totals.select(
        "class", precision.alias("precision"), recall.alias("recall"), f_beta(precision, recall).alias("f1"), "support"
    )
