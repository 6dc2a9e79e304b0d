"""From score tables to alerts and their evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustwatch.operators import ensemble, evaluate, quality, scaling
from gustwatch.operators.intervals import normalize_events, window_labels
from gustwatch.session import materialize
from gustwatch.settings import KEY, LIMITS, META_COLUMNS, Limits

# Columns of the alert table.
ALERT_COLUMNS = (
    *KEY,
    "train_test",
    "status_type",
    "if_anomaly_score",
    "lstm_anomaly_score",
    "xgb_anomaly_prob",
    "ensemble_score",
    "alert_triggered",
    "alert_contextual",
    "threshold_used",
)


@dataclass(frozen=True)
class AlertTables:
    alerts: DataFrame
    summary: DataFrame
    coverage: DataFrame
    #: Best F1 and weight per normalized score.
    weights: dict[str, tuple[float, float]]
    threshold: float


def build_alerts(
    forest_scores: DataFrame,
    classifier_scores: DataFrame,
    events: DataFrame,
    sequence_scores: DataFrame | None = None,
    horizons: DataFrame | None = None,
    limits: Limits = LIMITS,
) -> AlertTables:
    """Join, normalize, weight, debounce, evaluate. Sequence scores and horizons may be missing.

    Ranges, weights and the threshold come from rows of the train split only.
    """
    quality.require_columns(classifier_scores, [*META_COLUMNS, "xgb_anomaly_prob", "xgb_fault_type"], "classifier scores")
    quality.require_columns(forest_scores, [*KEY, "if_anomaly_score"], "forest scores")
    events = normalize_events(events)
    base = classifier_scores.select(*META_COLUMNS, "xgb_anomaly_prob", "xgb_fault_type")
    values = ["if_anomaly_score", "lstm_anomaly_score", "xgb_anomaly_prob"]
    joined = ensemble.join_scores(
        base,
        {
            "if_anomaly_score": ensemble.dedupe_scores(forest_scores, ["if_anomaly_score"]),
            "lstm_anomaly_score": sequence_scores,
            "ttf_hours": horizons,
        },
        fill=values,
    )
    joined = ensemble.joined_once(materialize(joined))

    used = [v for v in values if v != "lstm_anomaly_score" or sequence_scores is not None]
    norms = {v: f"{v}_norm" for v in used}
    train = F.col("train_test") == "train"
    quality.require_rows(joined.filter(train), "train rows to normalize by")
    rows = scaling.minmax(joined, norms, train, clip=False)

    # Only labelled train rows are read again and again; they are few compared with all rows.
    inside = window_labels(rows.filter(train).select(*KEY, *norms.values()), events, limits)
    validation = materialize(inside.withColumnRenamed("label", "y_window"))
    quality.require_rows(validation, "train rows inside labelled event windows")
    weights = ensemble.model_weights(validation, list(norms.values()))
    shares = {s: w for s, (_, w) in weights.items()}
    threshold = ensemble.ensemble_threshold(ensemble.add_ensemble(validation, shares))

    scored = ensemble.add_ensemble(rows, shares)
    alerts = ensemble.add_alerts(scored, "ensemble_score", threshold, limits)
    alerts = ensemble.add_contextual_alerts(alerts, "ensemble_score")
    alerts = alerts.withColumn("status_type", F.col("status_type_id").cast("string"))
    quality.require_columns(alerts, ALERT_COLUMNS, "alerts")
    return AlertTables(
        alerts=alerts.select(*ALERT_COLUMNS),
        summary=ensemble.alert_summary(alerts),
        coverage=evaluate.event_coverage(alerts, events, limits),
        weights=weights,
        threshold=threshold,
    )
