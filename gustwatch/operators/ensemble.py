"""Joining model scores, weighting them, and turning them into alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustwatch.functions.expressions import above, status_threshold, urgency
from gustwatch.operators.ordered import Ordered
from gustwatch.operators.quality import require_columns, require_unique
from gustwatch.operators.thresholds import best_f1, f1_grid, sweep_grid, sweep_grids
from gustwatch.settings import KEY, LIMITS, WEIGHT_FLOOR, Limits

CONSECUTIVE = 3


def dedupe_scores(scores: DataFrame, values: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """One row per key with the greatest of each value."""
    return scores.groupBy(*key).agg(*[F.max(c).alias(c) for c in values])


def join_scores(
    base: DataFrame, others: Mapping[str, DataFrame | None], key: Sequence[str] = KEY, fill: Sequence[str] = ()
) -> DataFrame:
    """Left joins of score tables, each ``{column: table}``; a missing table gives a null column.

    Null scores named in ``fill`` become 0. All joins are on the same key and share its partitioning.
    """
    joined = base
    for column, table in others.items():
        if table is None:
            joined = joined.withColumn(column, F.lit(None).cast("double"))
        else:
            joined = joined.join(require_columns(table, [*key, column], column).select(*key, column), list(key), "left")
    return joined.fillna(0, list(fill)) if fill else joined


def joined_once(joined: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return require_unique(joined, key)


def model_weights(validation: DataFrame, scores: Sequence[str], label: str = "y_window") -> dict[str, tuple[float, float]]:
    """Best F1 and normalized weight per score; weights are proportional to the F1."""
    swept = sweep_grids(validation, scores, label, f1_grid())
    best = {r["score"]: r["f1"] for r in swept.groupBy("score").agg(F.max("f1").alias("f1")).collect()}
    raw = {s: max(f, WEIGHT_FLOOR) for s, f in best.items()}
    return {s: (best[s], raw[s] / sum(raw.values())) for s in scores}


def add_ensemble(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Equal mean ``ensemble_simple`` and weighted mean ``ensemble_score`` of the scores."""
    total = sum(weights.values())
    simple = sum((F.col(s) for s in weights), F.lit(0.0)) / F.lit(float(len(weights)))
    weighted = sum((F.col(s) * F.lit(w / total) for s, w in weights.items()), F.lit(0.0))
    return df.select("*", simple.alias("ensemble_simple"), weighted.alias("ensemble_score"))


def ensemble_threshold(validation: DataFrame, label: str = "y_window", score: str = "ensemble_simple") -> float:
    """Threshold of the best F1; tuned on the equal mean."""
    return float(best_f1(sweep_grid(validation, score, label, f1_grid())).first()["threshold"])


def add_alerts(df: DataFrame, score: str, threshold: float, limits: Limits = LIMITS) -> DataFrame:
    """``alert_triggered``: this row and the two before it in the asset lie above the threshold."""

    def debounce(rows, window):
        run = F.sum(above(score, threshold).cast("int")).over(window.rowsBetween(1 - CONSECUTIVE, 0))
        return rows.select(
            "*",
            (run >= CONSECUTIVE).cast("int").alias("alert_triggered"),
            F.lit(float(threshold)).alias("threshold_used"),
        )

    return Ordered.of(df, ["asset_id"], ["time_stamp", "id"], limits).lookback(CONSECUTIVE, debounce).result()


def add_contextual_alerts(df: DataFrame, score: str, status: str = "status_type_id") -> DataFrame:
    """``alert_contextual``: above the threshold of the row's operating status."""
    limit = status_threshold(status)
    return df.select(
        "*",
        limit.alias("threshold_contextual"),
        above(score, limit).cast("int").alias("alert_contextual"),
    )


def alert_summary(alerts: DataFrame, score: str = "ensemble_score") -> DataFrame:
    """One row per triggered alert with its id and urgency."""
    return alerts.filter("alert_triggered = 1").select(
        F.concat_ws("_", F.col("asset_id").cast("string"), F.col("time_stamp").cast("string")).alias("alert_id"),
        "asset_id",
        F.col("time_stamp").alias("alert_time"),
        F.col(score).alias("ensemble_score"),
        "xgb_fault_type",
        "ttf_hours",
        urgency("ttf_hours").alias("urgency"),
    )


def fault_type_of(flag: str, predicted: str, normal: str = "normal"):
    """Predicted fault of flagged rows, ``normal`` for the others."""
    return F.when(F.col(flag) == 1, F.coalesce(F.col(predicted), F.lit("unknown"))).otherwise(F.lit(normal))
