"""Time-ordered folds and boosted-tree models on event windows and horizons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustwatch.functions.expressions import f_beta, risk_tier
from gustwatch.operators.boosting import MOST_MODELS, Boosted, TreeSettings, fit_boosted, margins
from gustwatch.operators.evaluate import fold_rmse
from gustwatch.operators.oversample import SMALL_CLASS, oversample
from gustwatch.operators.ranks import global_ranks
from gustwatch.operators.scaling import minmax_inverted
from gustwatch.operators.thresholds import choose_probability_threshold, class_weights, probability_grid, sweep_grid
from gustwatch.session import materialize

FOLD_GAP = 20


def holdout_start(n: int) -> int:
    """Rank at which the hold-out begins: the last fifth, with guards for few rows."""
    start = max(50, int(n * (1.0 - 0.20)))
    return int(n * 0.85) if start >= n - 20 else start


def fold_count(fit_rows: int) -> int:
    return min(5, max(2, fit_rows // 200))


def add_time_folds(df: DataFrame) -> DataFrame:
    """Rank ``nth`` by time, ``holdout``, and ``fold``, the fold a row validates (null: none).

    Fold ``f`` trains on rows with ``nth < fold_start(f) - FOLD_GAP``. Only the
    keys are ranked; the other columns come back by a join.
    """
    key = [c for c in ("time_stamp", "id", "asset_id") if c in df.columns]
    rows = df.join(global_ranks(df.select(*key), key), key).select(*df.columns, "nth")
    start = holdout_start(df.count())
    splits = fold_count(start)
    size = start // (splits + 1)
    first = start - splits * size
    inside = (F.col("nth") >= first) & (F.col("nth") < start)
    fold = F.floor((F.col("nth") - first) / F.lit(max(1, size))).cast("bigint")
    return rows.select("*", (F.col("nth") >= start).alias("holdout"), F.when(inside, fold).alias("fold"))


def fold_start(fit_rows: int, fold: int) -> int:
    splits = fold_count(fit_rows)
    return fit_rows - (splits - fold) * (fit_rows // (splits + 1))


# -- boosted trees ----------------------------------------------------------

# Fixed values of the three models.
EVENT_TREES = TreeSettings(
    rounds=400, depth=5, learning_rate=0.05, subsample=0.85, feature_share=0.85, min_hessian=4.0, min_gain=0.15, l2=2.5, l1=0.3
)
FAULT_TREES = TreeSettings(rounds=300, depth=4, learning_rate=0.05, subsample=0.9, feature_share=0.9, min_hessian=2.0, l2=1.5)
HORIZON_TREES = TreeSettings(rounds=200, depth=6, learning_rate=0.05, subsample=0.8, feature_share=0.8)


def positive_weight(labelled: DataFrame) -> float:
    """Weight of positives: the capped ratio of the classes."""
    return float(class_weights(labelled, "label").first()["scale_pos_weight"])


def _weighted(weight: float) -> Column:
    return F.when(F.col("label") == 1, F.lit(weight)).otherwise(F.lit(1.0))


def logistic(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def fit_event_model(
    labelled: DataFrame, features: Sequence[str], settings: TreeSettings = EVENT_TREES, weight: float | None = None
) -> Boosted:
    """Boosted classifier of ``label``, positives weighted by ``weight``, by default that of ``labelled``."""
    weight = positive_weight(labelled) if weight is None else weight
    return fit_boosted(labelled, features, F.col("label"), "logistic", settings, weight=_weighted(weight))[0]


def add_probability(df: DataFrame, model: Boosted, features: Sequence[str], output: str = "xgb_anomaly_prob") -> DataFrame:
    """Probability of an anomaly for every row, in one pass."""
    return df.withColumn(output, logistic(margins([model])[0]))


def cross_validate(
    folded: DataFrame,
    features: Sequence[str],
    settings: TreeSettings = EVENT_TREES,
    small_class: int = SMALL_CLASS,
) -> DataFrame:
    """F1, precision and recall per fold of ``add_time_folds`` output; one-class training data gives 0.

    The models of all folds are fitted together. A training fold with a class
    below ``small_class`` rows is oversampled; its synthetic rows belong to
    that fold alone.
    """
    folded = materialize(folded.select("id", "nth", "holdout", "fold", "label", *features))
    fit_rows = folded.filter("not holdout").count()
    before = [F.col("nth") < fold_start(fit_rows, f) - FOLD_GAP for f in range(fold_count(fit_rows))]
    counts = folded.agg(
        *[F.struct(*[F.count_if(b & (F.col("label") == c)).alias(f"c{c}") for c in (0, 1)]) for b in before]
    ).first()
    trained = [f for f, n in enumerate(counts) if min(n) > 0]
    learned = folded.select("id", "nth", "label", *features, F.lit(None).cast("int").alias("_only"))
    for f in trained:
        if 2 <= min(counts[f]) < small_class:
            more = oversample(folded.filter(before[f]), "label", features, settings.seed, small_class).filter("id < 0")
            learned = learned.unionByName(more.withColumn("_only", F.lit(f)), allowMissingColumns=True)
    p = F.lit(0.0)
    if trained:
        members = [F.coalesce(F.col("_only") == f, before[f]) for f in trained]
        weight = _weighted(positive_weight(folded))
        models = fit_boosted(learned, features, F.col("label"), "logistic", settings, weight=weight, members=members)
        which = F.create_map(*[F.lit(x) for i, f in enumerate(trained) for x in (f, i)])[F.col("fold").cast("int")]
        p = F.coalesce(logistic(margins(models, which)[0]), p)
    scored = folded.filter("fold is not null").select(F.col("fold").cast("int").alias("fold"), "label", (p > 0.5).alias("hit"))
    tallied = scored.groupBy("fold").agg(
        F.count_if(F.col("hit") & (F.col("label") == 1)).alias("tp"),
        F.count_if("hit").alias("flagged"),
        F.count(F.lit(1)).alias("val_size"),
        F.count_if(F.col("label") == 1).alias("val_pos"),
    )
    precision = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("flagged")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("val_pos")), F.lit(0.0))
    rated = tallied.withColumns({"precision": precision, "recall": recall})
    return rated.select("fold", f_beta(F.col("precision"), F.col("recall")).alias("f1"), "precision", "recall", "val_size", "val_pos")


def tuned_threshold(scored: DataFrame, score: str = "xgb_anomaly_prob") -> float:
    """Threshold from the hold-out, or from all labelled rows where that is small or one-sided."""
    holdout = scored.filter("holdout")
    size, classes = holdout.agg(F.count(F.lit(1)), F.countDistinct("label")).first()
    used = scored if size < 40 or classes < 2 else holdout
    return float(choose_probability_threshold(sweep_grid(used, score, "label", probability_grid())).first()["threshold"])


@dataclass(frozen=True)
class FaultModel:
    """One margin per fault type, in the order of the names."""

    names: tuple[str, ...]
    model: Boosted


def fit_fault_model(anomalies: DataFrame, features: Sequence[str], settings: TreeSettings = FAULT_TREES) -> FaultModel | None:
    """Boosted trees with one margin per fault type of anomaly rows, or None with fewer than five rows or a single type."""
    types = anomalies.groupBy("fault_type").count().orderBy("fault_type").collect()
    if sum(r["count"] for r in types) < 5 or len(types) < 2:
        return None
    names = tuple(r["fault_type"] for r in types)
    place = F.array_position(F.array(*map(F.lit, names)), F.col("fault_type")) - 1
    return FaultModel(names, fit_boosted(anomalies, features, place, "softmax", settings, classes=len(names))[0])


def add_fault_type(
    df: DataFrame, model: FaultModel | None, features: Sequence[str], only: str | None = None, output: str = "fault_prediction"
) -> DataFrame:
    """Predicted fault type of every row; without a model the only known type, or ``unknown``."""
    if model is None:
        return df.withColumn(output, F.lit(only or "unknown"))
    scored = df.withColumn("_margins", margins([model.model]))
    best = F.array_position("_margins", F.array_max("_margins")).cast("int") - 1
    return scored.select(*df.columns, F.array(*map(F.lit, model.names))[best].alias(output))


def add_fault_probabilities(df: DataFrame, model: FaultModel, output: str = "fault_probabilities") -> DataFrame:
    """Probability per fault type, in the order of the model's names."""
    scored = df.withColumn("_margins", margins([model.model]))
    raised = F.transform("_margins", lambda m: F.exp(m - F.array_max("_margins")))
    total = F.aggregate("_raised", F.lit(0.0), lambda a, x: a + x)
    scored = scored.withColumn("_raised", raised)
    return scored.select(*df.columns, F.transform("_raised", lambda x: x / total).alias(output))


# -- horizon regression -----------------------------------------------------


def fit_horizon_model(
    rows: DataFrame, features: Sequence[str], target: str, settings: TreeSettings = HORIZON_TREES, key: Sequence[str] = ("id",)
) -> Boosted:
    return fit_boosted(rows, features, F.col(target), "squared", settings, key=key)[0]


def add_prediction(df: DataFrame, model: Boosted, features: Sequence[str], output: str) -> DataFrame:
    return df.withColumn(output, margins([model])[0])


def add_event_folds(rows: DataFrame, event: str, events: Sequence) -> DataFrame:
    """Fold per listed event; rows of other events have none and are only trained on."""
    if not events:
        raise ValueError("no events to leave out")
    fold = F.create_map(*[F.lit(x) for i, e in enumerate(events) for x in (e, i)])[F.col(event)]
    return rows.withColumn("fold", fold)


def add_hashed_event_folds(rows: DataFrame, event: str, folds: int) -> DataFrame:
    """All events hashed to ``folds`` folds, each of which is held out once."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(event), F.lit(folds)).cast("int"))


def leave_event_out(
    rows: DataFrame,
    features: Sequence[str],
    target: str,
    event: str = "next_anomaly_event_id",
    settings: TreeSettings = HORIZON_TREES,
    *,
    events: Sequence | None = None,
    folds: int | None = None,
) -> DataFrame:
    """Error per fold of a model that has not seen the fold's events; folds without rows on a side are left out.

    The caller states the rule: ``events`` to leave out one by one, or a number
    of ``folds`` that all events are hashed to. It does not depend on the data.
    The models of all folds are fitted together.
    """
    if (events is None) == (folds is None):
        raise ValueError("give either events or folds")
    narrow = rows.select("id", event, target, *features)
    folded = materialize(
        add_event_folds(narrow, event, events) if events is not None else add_hashed_event_folds(narrow, event, folds)
    )
    sizes = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
    held = sorted(f for f, n in sizes.items() if f is not None and n < sum(sizes.values()))
    if not held:
        raise ValueError("fewer than two events to leave one out of")
    predicted = []
    for start in range(0, len(held), MOST_MODELS):
        some = held[start : start + MOST_MODELS]
        members = [~F.col("fold").eqNullSafe(F.lit(f)) for f in some]
        models = fit_boosted(folded, features, F.col(target), "squared", settings, members=members)
        which = F.create_map(*[F.lit(x) for i, f in enumerate(some) for x in (f, i)])[F.col("fold")]
        mine = folded.filter(F.col("fold").isin(some))
        predicted.append(mine.select("fold", target, margins(models, which)[0].alias("prediction")))
    return fold_rmse(reduce(DataFrame.unionByName, predicted), "fold", target, "prediction")


def horizon_scores(rows: DataFrame, model: Boosted, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Predicted hours, their tier, and their urgency between 0 and 1, for every row."""
    hours = "xgb_pred_hours_to_operator_warning"
    predicted = add_prediction(rows, model, features, hours).select(*keep, hours)
    tiered = predicted.withColumn("xgb_risk_score_tiered", risk_tier(hours))
    return minmax_inverted(tiered, hours, "xgb_risk_score_norm")


# -- importance -------------------------------------------------------------


def gain_importance(spark: SparkSession, model: Boosted, features: Sequence[str]) -> DataFrame:
    """Mean gain of a feature's splits as a share of all features' means, largest first."""
    split = model.trees.feature >= 0
    used, gains = model.trees.feature[split], model.trees.gain[split]
    sums, counts = (np.bincount(used, w, len(features)) for w in (gains, np.ones(len(used))))
    means = sums / np.maximum(counts, 1)
    rows = [(f, float(v)) for f, v in zip(features, means / (means.sum() or 1.0), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
