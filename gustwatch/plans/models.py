"""The event classifier end to end: from features and events to a checked score table, diagnostics and a run log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustwatch.functions.expressions import above, probability_tier
from gustwatch.operators import quality, supervised, thresholds
from gustwatch.operators.boosting import TreeSettings
from gustwatch.operators.ensemble import fault_type_of
from gustwatch.operators.intervals import window_labels
from gustwatch.operators.oversample import SMALL_CLASS, oversample
from gustwatch.operators.supervised import EVENT_TREES, FAULT_TREES
from gustwatch.plans.scores import Scored
from gustwatch.session import beside, materialize, ship_package
from gustwatch.settings import KEY, LIMITS, Limits
from gustwatch.sources.tables import run_rows

# Columns of the classifier's score table.
SCORE_COLUMNS = (*KEY, "xgb_anomaly_prob", "xgb_anomaly_flag", "xgb_fault_type", "xgb_risk_tier")


@dataclass(frozen=True)
class ClassifierScores:
    #: One row per input row, :data:`SCORE_COLUMNS`.
    scores: DataFrame
    #: F1, precision and recall per forward-chained fold.
    folds: DataFrame
    #: Rates at every threshold, from labelled rows with their probability.
    sweep: DataFrame
    #: Parameters and metrics of the run.
    log: DataFrame
    threshold: float

    def publish(self, root: str, run: str) -> bool:
        """Scores, log, folds and sweep below ``root`` as ``run``; False when the run was published before."""
        return Scored(self.scores, self.log, {"folds": self.folds, "sweep": self.sweep}).publish(root, run, SCORE_COLUMNS)


def build_classifier_scores(
    rows: DataFrame,
    events: DataFrame,
    features: Sequence[str],
    event_trees: TreeSettings = EVENT_TREES,
    fault_trees: TreeSettings = FAULT_TREES,
    run: str = "event_classifier",
    small_class: int = SMALL_CLASS,
    limits: Limits = LIMITS,
) -> ClassifierScores:
    """Label rows in event windows, validate on forward-chained folds, fit, tune the threshold, and score every row.

    Training data with a class below ``small_class`` rows is oversampled, in
    the folds and in the final fit, never the rows that are validated. The
    fault type is predicted for flagged rows only. Keys must be unique.
    """
    features = list(features)
    quality.require_columns(rows, [*KEY, *features], "feature table")
    quality.require_unique(rows, KEY)
    spark = ship_package(rows.sparkSession)
    folded = materialize(supervised.add_time_folds(window_labels(rows.select(*KEY, *features), events, limits)))
    train = folded.filter("not holdout")
    anomalies = train.filter("label = 1")
    with beside(spark, lambda: materialize(supervised.cross_validate(folded, features, event_trees, small_class))) as folds:
        balanced = oversample(train, "label", features, seed=event_trees.seed, small_class=small_class)
        model = supervised.fit_event_model(balanced, features, event_trees, supervised.positive_weight(folded))
        faults = supervised.fit_fault_model(anomalies, features, fault_trees)
        folds = folds()

    validated = materialize(supervised.add_probability(folded, model, features).select("holdout", "label", "xgb_anomaly_prob"))
    threshold = supervised.tuned_threshold(validated)
    held = validated.filter("holdout")
    precision = thresholds.average_precision(held, "xgb_anomaly_prob", "label").first()
    only = anomalies.select("fault_type").limit(1).first()

    scored = supervised.add_probability(rows.select(*KEY, *features), model, features)
    scored = scored.withColumn("xgb_anomaly_flag", above("xgb_anomaly_prob", threshold).cast("int"))
    named = supervised.add_fault_type(scored, faults, features, only["fault_type"] if only else None)
    table = named.select(
        *KEY,
        "xgb_anomaly_prob",
        "xgb_anomaly_flag",
        fault_type_of("xgb_anomaly_flag", "fault_prediction").alias("xgb_fault_type"),
        probability_tier("xgb_anomaly_prob").alias("xgb_risk_tier"),
    )
    means = folds.agg(*[F.avg(c).alias(c) for c in ("f1", "precision", "recall")]).first()
    metrics = {
        "threshold": threshold,
        "holdout_average_precision": precision["average_precision"],
        "holdout_positives": precision["positives"] or 0,
        **{f"cv_{c}": means[c] or 0.0 for c in ("f1", "precision", "recall")},
    }
    log = run_rows(rows.sparkSession, run, {**asdict(event_trees), "small_class": small_class, "features": len(features)}, metrics)
    sweep = thresholds.sweep_grid(validated, "xgb_anomaly_prob", "label", thresholds.probability_grid())
    return ClassifierScores(table, folds, sweep, log, threshold)
