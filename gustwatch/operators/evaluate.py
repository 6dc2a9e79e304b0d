"""Evaluation of scores and alerts against event windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustwatch.functions.expressions import epoch_seconds, one_row_per_column
from gustwatch.operators.intervals import event_rows
from gustwatch.settings import LIMITS, Limits


def score_by(tagged: DataFrame, score: str, by: str) -> DataFrame:
    """Mean, sample deviation and count of a score per group."""
    return tagged.groupBy(by).agg(
        F.avg(score).alias("mean_score"), F.stddev_samp(score).alias("std_score"), F.count(score).alias("n")
    )


def separation(tagged: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Mean in anomaly and normal windows per score, their difference, and whether it points the right way."""
    label = F.col("event_label")
    one = tagged.agg(
        *[
            F.struct(
                F.avg(F.when(label == "normal", F.col(s))).alias("normal_mean"),
                F.avg(F.when(label == "anomaly", F.col(s))).alias("anomaly_mean"),
            ).alias(s)
            for s in scores
        ]
    )
    gap = F.col("anomaly_mean") - F.col("normal_mean")
    return one_row_per_column(one, list(scores), "score").select(
        "*",
        gap.alias("separation"),
        F.when(gap > 0, "OK").otherwise("WRONG").alias("direction"),
    )


def feature_separation(
    tagged: DataFrame,
    rows: DataFrame,
    features: Sequence[str],
    hours: str | None = "hours_to_anomaly_linked_downtime",
    normal_status: int = 0,
    horizon: float = 168.0,
    batch: int = 80,
) -> DataFrame:
    """Feature means in anomaly windows, in normal windows and before downtime, by size of the difference.

    The three groups are averaged with one pass per table and per ``batch`` of
    features. Missing means count 0 in the differences.
    """
    label = F.col("event_label")
    tables = []
    for start in range(0, len(features), batch):
        part = list(features[start : start + batch])
        in_windows = tagged.agg(
            *[
                F.struct(
                    F.avg(F.when(label == "anomaly", F.col(c))).alias("anomaly"),
                    F.avg(F.when(label == "normal", F.col(c))).alias("normal"),
                ).alias(c)
                for c in part
            ]
        )
        in_windows = one_row_per_column(in_windows, part, "feature")
        if hours is None:
            before = in_windows.select("feature", F.lit(None).cast("double").alias("pre"))
        else:
            soon = (F.col("status_type_id") == normal_status) & (F.col(hours) > 0) & (F.col(hours) <= horizon)
            before = rows.filter(soon).agg(*[F.avg(c).alias(c) for c in part]).unpivot([], part, "feature", "pre")
        tables.append(in_windows.join(before, "feature"))
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table)

    def zero(name):
        return F.coalesce(F.col(name), F.lit(0.0))

    gap = zero("anomaly") - zero("normal")
    pre_gap = zero("pre") - zero("normal") if hours is not None else F.lit(None).cast("double")
    return merged.select(
        "feature",
        F.col("anomaly").alias("anomaly_window_mean"),
        F.col("normal").alias("normal_window_mean"),
        F.col("pre").alias("pre_transition_mean"),
        gap.alias("separation_anomaly_minus_normal"),
        pre_gap.alias("separation_pre_minus_normal"),
        gap.alias("separation_score"),
    ).orderBy(F.desc(F.abs(F.col("separation_score"))), "feature")


def top_separating(tagged: DataFrame, features: Sequence[str], n: int = 50, as_integer: bool = False) -> DataFrame:
    """The ``n`` features that are most higher in anomaly windows than in normal ones."""
    label = F.col("event_label")

    def value(name):
        return F.col(name).cast("int") if as_integer else F.col(name)

    one = tagged.agg(
        *[
            F.struct(
                F.avg(F.when(label == "anomaly", value(c))).alias("anomaly_mean"),
                F.avg(F.when(label == "normal", value(c))).alias("normal_mean"),
            ).alias(c)
            for c in features
        ]
    )
    return (
        one_row_per_column(one, list(features), "feature")
        .withColumn("separation_score", F.col("anomaly_mean") - F.col("normal_mean"))
        .orderBy(F.desc("separation_score"), "feature")
        .limit(n)
    )


def event_coverage(alerts: DataFrame, events: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Per event: rows and alerts in its window; for anomalies the alert share and the lead time.

    The lead runs from the first alert to the last row of the window.
    """
    wanted = events.select(
        "asset_id", "event_id", "event_label", "event_description", "event_start_id", "event_end_id"
    )
    needed = alerts.select("asset_id", "id", "time_stamp", "alert_triggered")
    triggered = F.col("alert_triggered") == 1
    anomalous = F.col("event_label") == "anomaly"
    per_event = (
        event_rows(needed, wanted, limits)
        .groupBy("event_id", "asset_id", "event_label", F.coalesce("event_description", F.lit("")).alias("fault_type"))
        .agg(
            F.count(F.lit(1)).alias("window_rows"),
            F.count_if(triggered).alias("alerts_triggered"),
            F.max(epoch_seconds("time_stamp")).alias("_last"),
            F.min(F.when(triggered, epoch_seconds("time_stamp"))).alias("_first"),
        )
    )
    return per_event.select(
        "event_id",
        "asset_id",
        "event_label",
        "fault_type",
        "window_rows",
        "alerts_triggered",
        F.when(anomalous, F.col("alerts_triggered") / F.col("window_rows")).alias("coverage"),
        F.when(anomalous, (F.col("_last") - F.col("_first")) / F.lit(3600.0)).alias("earliness_h"),
    )


def reliability(coverage: DataFrame) -> DataFrame:
    """One minus the alert rate over rows of normal windows; 1 if there are none.

    A row in two windows counts twice, so the per-event counts can be summed.
    """
    normal = F.col("event_label") == "normal"
    rows = F.sum(F.when(normal, F.col("window_rows")))
    alerts = F.sum(F.when(normal, F.col("alerts_triggered")))
    return coverage.agg(
        F.coalesce(rows, F.lit(0)).alias("normal_rows"),
        F.coalesce(F.lit(1.0) - F.try_divide(alerts, rows), F.lit(1.0)).alias("reliability"),
    )


def coverage_by_fault(coverage: DataFrame) -> DataFrame:
    """Mean coverage and lead of anomalies per fault type, and over all under an empty type."""
    anomalies = coverage.filter("event_label = 'anomaly'")
    means = [
        F.avg("coverage").alias("mean_coverage"),
        F.avg("earliness_h").alias("mean_earliness_h"),
        F.count(F.lit(1)).alias("events"),
    ]
    per_fault = anomalies.groupBy("fault_type").agg(*means)
    return per_fault.unionByName(anomalies.agg(*means).withColumn("fault_type", F.lit("(all)")))


def fault_detection(tagged: DataFrame, flag: str) -> DataFrame:
    """Share of flagged rows per fault type in anomaly windows."""
    return (
        tagged.filter("event_label = 'anomaly'")
        .groupBy("event_description")
        .agg(F.avg(flag).alias("detection_rate"), F.sum(flag).alias("flagged"), F.count(F.lit(1)).alias("n"))
    )


def flag_rate(scores: DataFrame, flag: str, score: str) -> DataFrame:
    """Flagged rows, their share and the mean score per asset."""
    return scores.groupBy("asset_id").agg(
        F.sum(flag).alias("flagged"), F.avg(flag).alias("flag_rate"), F.avg(score).alias("mean_score")
    )


def fold_rmse(predicted: DataFrame, fold: str, target: str, prediction: str) -> DataFrame:
    """Root mean squared error per fold."""
    error = F.col(target) - F.col(prediction)
    return predicted.groupBy(fold).agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def rmse_summary(folds: DataFrame) -> DataFrame:
    return folds.agg(
        F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std"), F.count(F.lit(1)).alias("folds")
    )
