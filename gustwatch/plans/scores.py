"""Score tables of the forest, sequence and horizon models, end to end, with diagnostics and run logs that can be published."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustwatch.operators import autoencoder, contributions, evaluate, forest, intervals, labels, neural_sequence, quality, scaling, supervised
from gustwatch.operators.boosting import TreeSettings
from gustwatch.operators.evaluate import rmse_summary
from gustwatch.operators.neural_sequence import Training
from gustwatch.session import beside, materialize, ship_package
from gustwatch.settings import KEY, LIMITS, META_COLUMNS, Limits
from gustwatch.sources.published import publish
from gustwatch.sources.tables import metric_rows, run_rows

# Columns of the score tables.
MASKS = ("if_fit_eligible", "in_anomaly_window")
FOREST_COLUMNS = (*META_COLUMNS, *MASKS, "if_anomaly_score", "if_anomaly_score_norm", "if_anomaly_flag")
SEQUENCE_COLUMNS = (*META_COLUMNS, "lstm_recon_error", "lstm_recon_error_norm", *MASKS)
HORIZON_COLUMNS = (
    *META_COLUMNS,
    "next_anomaly_event_id",
    *MASKS,
    "xgb_pred_hours_to_operator_warning",
    "xgb_risk_score_tiered",
    "xgb_risk_score_norm",
)


@dataclass(frozen=True)
class Scored:
    #: One row per input row.
    scores: DataFrame
    #: Parameters and metrics of the run and of its child runs.
    log: DataFrame
    diagnostics: dict[str, DataFrame] = field(default_factory=dict)

    def publish(self, root: str, run: str, columns: Sequence[str]) -> bool:
        """All tables below ``root`` as ``run``, the scores last; False when the run was published before."""
        for name, table in {"log": self.log, **self.diagnostics}.items():
            publish(table, f"{root}/{name}", run)
        return publish(self.scores, f"{root}/scores", run, check=lambda rows: quality.require_columns(rows, columns, "scores"))


def build_forest_scores(
    rows: DataFrame, events: DataFrame, features: Sequence[str], run: str = "forest", strict: bool = True, limits: Limits = LIMITS
) -> Scored:
    """Isolation scores of all rows, fitted per asset on rows that ``if_fit_eligible`` allows; diagnostics: feature separation."""
    quality.require_columns(rows, [*META_COLUMNS, *MASKS, *features], "feature table")
    keep = ["train_test", "status_type_id", *MASKS]
    scored = forest.isolation_scores(rows, features, F.col("if_fit_eligible"), keep, strict=strict, limits=limits)
    normed = materialize(scaling.minmax(scored, {"if_anomaly_score": "if_anomaly_score_norm"}, F.col("if_fit_eligible")))
    flags = evaluate.flag_rate(normed, "if_anomaly_flag", "if_anomaly_score")
    log = run_rows(rows.sparkSession, run, {"features": len(features), "trees": forest.TREES, "sample": forest.SAMPLE})
    log = log.unionByName(metric_rows(flags, "asset_id", run, ["flagged", "flag_rate", "mean_score"]))
    hours = "hours_to_anomaly_linked_downtime"
    tagged = intervals.event_rows(rows, events.select("asset_id", "event_label", "event_start_id", "event_end_id"), limits)
    separation = evaluate.feature_separation(tagged, rows, features, hours if hours in rows.columns else None)
    return Scored(normed.select(*FOREST_COLUMNS), log, {"separation": separation, "flag_rates": flags})


def build_sequence_scores(
    rows: DataFrame,
    features: Sequence[str],
    length: int,
    max_gap_minutes: float | None,
    components: int,
    training: Training = neural_sequence.TRAINING,
    run: str = "sequence",
    limits: Limits = LIMITS,
) -> Scored:
    """Reconstruction errors of all rows by the non-linear sequence model; diagnostics: losses per step, errors per feature."""
    quality.require_columns(rows, [*META_COLUMNS, *MASKS, *features], "feature table")
    spark = rows.sparkSession
    narrow = materialize(rows.select(*META_COLUMNS, *MASKS, *features))
    model = neural_sequence.fit_nonlinear_model(narrow, features, length, max_gap_minutes, components, training=training, limits=limits)
    scored = materialize(autoencoder.reconstruction_errors(narrow, model, limits))
    steps = [(str(i), float(a), float(b)) for i, (a, b) in enumerate(model.history)]
    history = spark.createDataFrame(steps, "step string, train_loss double, val_loss double")
    best = min(model.history, key=lambda h: h[1])
    params = {**asdict(training), "length": length, "max_gap_minutes": max_gap_minutes, "components": components, "features": len(features)}
    metrics = {"final_train_loss": best[0], "final_val_loss": best[1], "steps_ran": len(model.history)}
    log = run_rows(spark, run, params, metrics).unionByName(metric_rows(history, "step", run, ["train_loss", "val_loss"]))
    by_feature = autoencoder.error_by_feature(scored, features)
    return Scored(autoencoder.normalized_errors(scored).select(*SEQUENCE_COLUMNS), log, {"by_feature": by_feature, "history": history})


def build_horizon_scores(
    rows: DataFrame,
    features: Sequence[str],
    folds: int,
    target: str = "hours_to_next_operator_warning",
    normal_status: Sequence[int] = (0,),
    trees: TreeSettings = supervised.HORIZON_TREES,
    run: str = "horizon",
) -> Scored:
    """Hours to the next operator warning for all rows, from usable events; diagnostics: errors of events left out, contributions."""
    quality.require_columns(rows, [*META_COLUMNS, *MASKS, target, "next_anomaly_event_id", labels.USABLE, *features], "feature table")
    learned = materialize(labels.supervised_rows(rows, target, normal_status))
    spark = ship_package(rows.sparkSession)
    with beside(spark, lambda: materialize(supervised.leave_event_out(learned, features, target, settings=trees, folds=folds))) as errors:
        model = supervised.fit_horizon_model(learned, features, target, trees)
        importance = contributions.mean_contributions(learned, model)
        errors = errors()
    kept = [*META_COLUMNS, "next_anomaly_event_id", *MASKS]
    scored = supervised.horizon_scores(rows, model, features, kept)
    summary = rmse_summary(errors).first().asDict()
    log = run_rows(rows.sparkSession, run, {**asdict(trees), "folds": folds, "features": len(features)}, summary)
    log = log.unionByName(metric_rows(errors, "fold", run, ["rmse", "n"]))
    return Scored(scored.select(*HORIZON_COLUMNS), log, {"left_out": errors, "contributions": importance})


def require_scores(scores: DataFrame, rows: DataFrame, columns: Sequence[str]) -> None:
    """As many rows as went in, unique keys, all columns."""
    quality.require_columns(scores, columns, "scores")
    quality.require_unique(scores, KEY)
    if scores.count() != rows.count():
        raise ValueError("scores have not as many rows as the features")
