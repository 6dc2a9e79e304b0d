"""Edges on small hand-made tables."""

import numpy as np
import pytest
from frames import EVENTS, at, events, telemetry
from pyspark.sql import functions as F

from gustwatch.functions import expressions as ex
from gustwatch.operators import (
    ensemble,
    evaluate,
    forest,
    intervals,
    labels,
    oversample,
    quality,
    scaling,
    select,
    sequences,
    supervised,
    thresholds,
)
from gustwatch.operators.asof import next_event
from gustwatch.operators.rolling import add_rolling, drop_all_null, fill_zero
from gustwatch.operators.status import add_status_history
from gustwatch.settings import FarmSettings, Limits


def column(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


# -- expressions ------------------------------------------------------------


def test_tiers_include_their_upper_bound(spark):
    hours = spark.createDataFrame([(i, h) for i, h in enumerate([0.1, 24.0, 24.01, 72.0, 168.0, 336.0, 336.1, None])], "id int, h double")
    assert column(hours.withColumn("t", ex.risk_tier("h")), "t") == [1.0, 1.0, 0.9, 0.9, 0.6, 0.3, 0.0, 0.0]
    p = spark.createDataFrame([(i, x) for i, x in enumerate([0.0, 0.3, 0.31, 0.6, 0.9, 1.0, None])], "id int, p double")
    tiers = ["low", "low", "medium", "medium", "high", "critical", None]
    assert column(p.withColumn("t", ex.probability_tier("p")), "t") == tiers


def test_urgency_and_status_threshold(spark):
    rows = spark.createDataFrame([(1, 23.9, "0"), (2, 24.0, "4"), (3, 72.0, "9"), (4, None, None), (5, 1.0, "x")], "id int, h double, s string")
    assert column(rows.withColumn("u", ex.urgency("h")), "u") == ["CRITICAL", "HIGH", "MONITOR", "MONITOR", "CRITICAL"]
    assert column(rows.withColumn("t", ex.status_threshold("s")), "t") == [0.65, 0.9, 0.65, 0.65, 0.65]


def test_text_numbers(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["12", " -3 ", "4.5", "abc", "", None, "1e3", "NaN"])], "id int, t string")
    assert column(rows.withColumn("n", ex.text_to_bigint("t")), "n") == [12, -3, None, None, None, None, None, None]
    found = column(rows.withColumn("n", ex.text_to_double("t")), "n")
    assert found[:7] == [12.0, -3.0, 4.5, None, None, None, 1000.0] and np.isnan(found[7])


# -- rolling and status -----------------------------------------------------


def test_first_row_and_short_windows(spark):
    rows = telemetry(spark, [(1, 10 * i, i, 0, float(i)) for i in range(8)] + [(2, 0, 100, 0, 5.0)])
    rolled = add_rolling(rows, ["s"])
    assert column(rolled, "s_roll_mean_1h") == [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.5, 4.5, 5.0]
    std = column(rolled, "s_roll_std_6")
    assert std[0] is None and std[-1] is None and std[1] == pytest.approx(np.std([0, 1], ddof=1))
    assert column(rolled, "s_delta")[:2] == [None, 1.0]


def test_counter_reset_and_missing_value(spark):
    rows = telemetry(spark, [(1, i, i, 0, v) for i, v in enumerate([5.0, 7.0, 2.0, None, 4.0])])
    rolled = add_rolling(rows, ["s"], {"s": "counter"})
    # Increments 0, 2, 0, null, 0.
    assert column(rolled, "s_roll_mean_1h") == pytest.approx([0.0, 1.0, 2 / 3, 2 / 3, 0.5])


def test_angles_wrap(spark):
    rows = telemetry(spark, [(1, 0, 0, 0, 359.0), (1, 1, 1, 0, 1.0), (1, 2, 2, 0, 181.0)])
    rolled = add_rolling(rows, ["s"], {"s": "angle"})
    assert column(rolled, "s_delta") == pytest.approx([None, 2.0, 180.0])
    assert column(rolled, "s_roll_mean_1h")[:2] == pytest.approx([-1.0, 0.0], abs=1e-9)
    assert column(rolled, "s_roll_std_6")[0] == pytest.approx(0.0, abs=1e-5)


def test_status_history(spark):
    day = 24 * 60
    rows = telemetry(spark, [(1, 0, 0, 0, 1.0), (1, day, 1, 4, 1.0), (1, day + 1, 2, 1, 1.0), (1, 40 * day, 3, 0, 1.0)])
    history = add_status_history(rows)
    assert column(history, "downtime_frac_24h") == pytest.approx([0.0, 0.5, 0.5, 0.0])
    assert column(history, "derated_frac_30d") == pytest.approx([0.0, 0.0, 1 / 3, 0.0])
    assert column(history, "status_change_count_7d") == [0.0, 1.0, 2.0, 1.0]
    assert column(history, "hours_since_last_downtime") == pytest.approx([None, 0.0, 1 / 60, 39 * 24.0])


def test_fill_and_drop(spark):
    rows = spark.createDataFrame([(1, None, None, "a"), (2, float("nan"), None, None), (3, 1.0, 2.0, "b")], "id int, x double, y double, t string")
    filled = fill_zero(rows, ["x", "t"])
    assert column(filled, "x") == [0.0, 0.0, 1.0] and column(filled, "t") == ["a", None, "b"]
    assert column(drop_all_null(rows, ["x", "y"]), "id") == [2, 3]


# -- events -----------------------------------------------------------------


def test_next_event_is_strictly_later_and_ties_go_to_the_smaller_id(spark):
    rows = telemetry(spark, [(1, 0, 0, 0, 1.0), (1, 10, 1, 0, 1.0), (1, 11, 2, 0, 1.0), (2, 0, 3, 0, 1.0)])
    starts = events(spark, [(1, 7, "anomaly", 10, 0, 1, ""), (1, 5, "anomaly", 10, 0, 1, ""), (1, 9, "anomaly", 11, 0, 1, "")])
    for limits in (Limits(), Limits(task_rows=2, broadcast_rows=0)):
        found = next_event(rows, starts, limits=limits).orderBy("id").collect()
        assert [r._next and r._next.event_id for r in found] == [5, 9, None, None]


def test_event_normalization(spark):
    raw = spark.createDataFrame(
        [("1", "2", "  Anomaly ", "5", "9", "2024-01-01 00:00:00"), ("x", "3", "NORMAL", "1", "n", "bad")],
        "asset string, event_id string, event_label string, event_start_id string, event_end_id string, event_start string",
    )
    fixed = intervals.normalize_events(raw)
    first, second = fixed.orderBy("event_id").collect()
    assert (first.asset_id, first.event_label, first.event_end_id, first.event_start) == (1, "anomaly", 9, at(0))
    assert second.asset_id is None and second.event_end_id is None and second.event_start is None
    assert intervals.invalid_events(fixed).count() == 1
    with pytest.raises(ValueError):
        intervals.require_valid_events(fixed)


def test_labels_of_overlapping_windows(spark):
    rows = telemetry(spark, [(1, i, i, 0, 1.0) for i in range(6)])
    windows = events(
        spark,
        [(1, 1, "anomaly", 0, 1, 3, "a"), (1, 2, "anomaly", 0, 3, 4, None), (1, 3, "normal", 0, 0, 4, "n"), (2, 4, "anomaly", 0, 0, 9, "z")],
    ).drop("event_start")
    found = intervals.window_labels(rows, windows).orderBy("id").collect()
    assert [(r.id, r.label, r.fault_type) for r in found] == [
        (0, 0, "normal"), (1, 1, "a"), (2, 1, "a"), (3, 1, "anomaly"), (4, 1, "anomaly"),
    ]
    assert column(intervals.rows_outside_windows(rows, windows), "id") == [5]


def test_horizons_and_fit_mask(spark):
    rows = telemetry(spark, [(1, 60 * i, i, 4 if i == 3 else 0, 1.0) for i in range(6)])
    windows = events(spark, [(1, 9, "anomaly", 120, 2, 4, "a")])
    labelled = labels.add_event_horizon(rows, windows)
    assert column(labelled, "hours_to_next_anomaly") == [2.0, 1.0, None, None, None, None]
    warned = labels.add_downtime_horizon(labelled, windows, rows, [4])
    assert column(warned, "hours_to_anomaly_linked_downtime") == [3.0, 2.0, 1.0, None, None, None]
    assert column(warned, "hours_to_next_operator_warning") == [2.0, 1.0, 1.0, None, None, None]
    settings = FarmSettings(fit_cutoff="2024-01-01 05:00:00")
    assert column(labels.add_fit_mask(rows, windows, settings), "if_fit_eligible") == [True, True, False, False, False, False]
    expected = [True, True, None, None, None, None]
    assert column(labels.add_usable_flag(labelled, [9]), labels.USABLE) == expected
    many = spark.createDataFrame([(9,), (8,), (9,)], "event_id bigint")
    flagged = labels.add_usable_flag(labelled, many)
    assert column(flagged, labels.USABLE) == expected
    assert column(labels.supervised_rows(flagged, "hours_to_next_anomaly", [0]), "id") == [0, 1]
    assert set(column(labels.add_usable_flag(labelled, []), labels.USABLE)) == {False}


def test_no_events_at_all(spark):
    rows = telemetry(spark, [(1, 0, 0, 0, 1.0)])
    none = spark.createDataFrame([], EVENTS)
    assert column(labels.add_event_horizon(rows, none), "risk_score") == [0.0]
    assert column(intervals.add_window_flag(rows, none, "f"), "f") == [False]
    assert evaluate.reliability(evaluate.event_coverage(rows.withColumn("alert_triggered", F.lit(1)), none)).first()["reliability"] == 1.0


# -- scaling and thresholds -------------------------------------------------


def test_minmax_of_flat_column(spark):
    rows = spark.createDataFrame([(1, 2.0, 2.0), (2, 2.0, 5.0)], "id int, a double, b double")
    mask = F.col("id") == 1
    assert column(scaling.minmax(rows, {"b": "n"}, mask), "n") == [0.0, 1.0]
    assert column(scaling.minmax(rows, {"b": "n"}, mask, clip=False), "n") == [0.0, 3.0]
    assert column(scaling.minmax(rows, {"b": "n"}, mask, flat=0.5), "n") == [0.5, 0.5]
    with pytest.raises(ValueError):
        scaling.minmax(rows, {"b": "n"}, F.col("id") == 9)


def test_minmax_inverted(spark):
    def inverted(values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, h double")
        return column(scaling.minmax_inverted(rows, "h", "n"), "n")

    assert inverted([1.0, 3.0, 2.0, -5.0]) == [1.0, 0.0, 0.5, 1.0]
    assert inverted([4.0, 4.0]) == [0.5, 0.5]
    assert inverted([None, -1.0]) == [0.0, 0.0]


def test_scale_without_deviation(spark):
    rows = spark.createDataFrame([(1, 3.0, None), (2, 3.0, None)], "id int, a double, b double")
    stats = scaling.scaler_stats(rows, ["a", "b"])
    scaled = scaling.standard_scale(rows.withColumn("b", F.lit(4.0)), stats)
    assert column(scaled, "a") == [0.0, 0.0] and column(scaled, "b") == [4.0, 4.0]


def test_sweep_counts_strictly_above(spark):
    rng = np.random.default_rng(3)
    scores = np.concatenate([np.round(rng.random(200), 2), thresholds.f1_grid()])
    truth = (rng.random(len(scores)) < 0.4).astype(int)
    rows = spark.createDataFrame([(float(s), int(y)) for s, y in zip(scores, truth)], "s double, y int")
    for r in thresholds.sweep_grid(rows, "s", "y", thresholds.f1_grid()).collect():
        above = scores > r.threshold
        assert (r.tp, r.fp, r.fn, r.tn) == (
            (above & (truth == 1)).sum(), (above & (truth == 0)).sum(), (~above & (truth == 1)).sum(), (~above & (truth == 0)).sum(),
        )


def test_grid_sizes():
    assert len(thresholds.probability_grid()) == 119 and len(thresholds.f1_grid()) == 19


def test_threshold_choices(spark):
    names = "threshold double, detection_rate double, false_alarm_rate double, precision double, f1 double, f05 double"
    swept = spark.createDataFrame([(0.1, 0.9, 0.5, 0.50001, 0.6, 0.5), (0.2, 0.8, 0.4, 0.50003, 0.6, 0.55), (0.3, 0.2, 0.1, 0.9, 0.3, 0.6)], names)
    # The first two precisions are equal after rounding, so the lower threshold wins.
    assert thresholds.choose_probability_threshold(swept).first()["threshold"] == 0.1
    assert thresholds.choose_probability_threshold(swept, min_recall=0.95).first()["threshold"] == 0.3
    percents = spark.createDataFrame([(90, 0.9, 0.3), (95, 0.6, 0.2), (99, 0.2, 0.05)], "percentile int, detection_rate double, false_alarm_rate double")
    assert thresholds.choose_percentile(percents, 0.10).first()["percentile"] == 99
    assert thresholds.choose_percentile(percents, 0.01).first()["percentile"] == 90
    assert thresholds.choose_percentile(percents, 0.01, fallback=95).first()["percentile"] == 95


def test_one_class_only(spark):
    rows = spark.createDataFrame([(0.5, 1), (0.6, 1)], "s double, y int")
    weights = thresholds.class_weights(rows, "y").first()
    assert (weights.weight_neg, weights.weight_pos, weights.scale_pos_weight) == (1.0, 1.0, 1.0)
    counts = thresholds.confusion(rows, "s", "y", 0.55).first()
    assert (counts.detection_rate, counts.false_alarm_rate, counts.precision) == (0.5, 0.0, 1.0)


# -- alerts -----------------------------------------------------------------


def test_three_rows_make_an_alert(spark):
    rows = telemetry(spark, [(1, i, i, 0, v) for i, v in enumerate([9.0, 9.0, 1.0, 9.0, 9.0, 9.0, 9.0, None])])
    assert column(ensemble.add_alerts(rows, "s", 5.0), "alert_triggered") == [0, 0, 0, 0, 0, 1, 1, 0]
    assert set(column(ensemble.add_alerts(rows, "s", 9.0), "alert_triggered")) == {0}


def test_coverage_and_lead(spark):
    rows = telemetry(spark, [(1, 60 * i, i, 0, 1.0) for i in range(6)]).withColumn("alert_triggered", (F.col("id") >= 3).cast("int"))
    windows = events(spark, [(1, 1, "anomaly", 0, 1, 4, "a"), (1, 2, "normal", 0, 4, 5, None), (1, 3, "anomaly", 0, 0, 1, "b")])
    covered = {r.event_id: r for r in evaluate.event_coverage(rows, windows).collect()}
    assert (covered[1].coverage, covered[1].earliness_h, covered[1].window_rows) == (0.5, 1.0, 4)
    assert covered[2].coverage is None and covered[2].fault_type == ""
    assert covered[3].coverage == 0.0 and covered[3].earliness_h is None
    assert evaluate.reliability(evaluate.event_coverage(rows, windows)).first()["reliability"] == 0.0


def test_missing_score_table(spark):
    rows = telemetry(spark, [(1, 0, 0, 0, 1.0)])
    joined = ensemble.join_scores(rows.select("asset_id", "time_stamp", "id"), {"lstm": None}, fill=["lstm"])
    assert column(joined, "lstm") == [0.0]
    twice = rows.unionByName(rows)
    with pytest.raises(ValueError):
        ensemble.joined_once(twice)


# -- sequences --------------------------------------------------------------


def test_gap_exactly_at_the_limit(spark):
    rows = telemetry(spark, [(1, m, i, 0, 1.0) for i, m in enumerate([0, 15, 30.1, 45, 61])])
    cut = sequences.gap_segments(rows, 15)
    assert column(cut, "segment") == [1, 1, 2, 2, 3] and column(cut, "segment_row") == [1, 2, 1, 2, 1]


def test_windows_need_all_rows_eligible(spark):
    rows = telemetry(spark, [(1, i, i, 4 if i == 2 else 0, float(i)) for i in range(6)] + [(2, 0, 9, 0, 1.0)])
    rows = rows.withColumn("if_fit_eligible", F.col("status_type_id") == 0)
    found = sequences.sequence_payload(rows, ["s"], 2, 15)
    assert column(found, "id") == [1, 2, 3, 4, 5] and column(found, "trainable") == [True, False, False, True, True]
    assert column(found, "payload")[0] == [0.0, 1.0]
    stats = {r.asset_id: r for r in sequences.window_statistics(rows, 2, 15).collect()}
    assert (stats[1].scored, stats[1].trainable, stats[1].skipped_ineligible, stats[1].too_short) == (5, 3, 2, 0)
    assert (stats[2].scored, stats[2].too_short) == (0, 1)


# -- choice of columns and checks -------------------------------------------


def test_column_choice(spark):
    names = ["asset_id", "id", "a_avg", "a_max", "a_std", "b", "time_stamp", "train_test", "status_type_id"]
    assert select.sensor_columns(names) == ["a_avg", "b"]
    assert select.feature_columns([*names, "risk_score"]) == ["a_avg", "a_max", "a_std", "b"]
    described = spark.createDataFrame(
        [("a", "Gearbox OIL temp", "C", "false", "TRUE"), ("b", "Active power", "kW", "true", None), ("c", "reactive active power", "k", None, None), ("z", "vibration", "g", "true", "true")],
        "sensor_name string, description string, unit string, is_angle string, is_counter string",
    )
    roles = select.sensors_by_role(described, names)
    assert roles["gearbox_oil"] == ["a_avg"] and roles["power"] == ["b"] and roles["vibration"] == []
    assert select.sensor_kinds(described, names) == {"a_avg": "counter", "b": "angle"}
    assert select.interaction_pairs(roles) == {"gearbox_oil_x_power": ("a_avg", "b")}
    assert select.interaction_pairs({"temperature": ["t"], "vibration": ["v", "w", "x"]}, "vibration") == {"oil_x_vib": ("t", "v"), "temp_x_rpm": ("t", "w")}


def test_checks(spark):
    rows = telemetry(spark, [(1, 0, 0, 0, 1.0)])
    with pytest.raises(ValueError, match="nope"):
        quality.require_columns(rows, ["id", "nope"])
    with pytest.raises(ValueError):
        quality.require_rows(rows.filter("id > 5"), "late rows")
    with pytest.raises(ValueError, match="s_delta"):
        quality.require_feature_contract(rows, ["id"], ["s"])
    with pytest.raises(ValueError):
        quality.require_unique(rows.unionByName(rows), ["id"])


# -- models -----------------------------------------------------------------


def test_holdout_and_folds():
    assert [supervised.holdout_start(n) for n in (1000, 100, 60)] == [800, 85, 51]
    assert [supervised.fold_count(n) for n in (100, 500, 5000)] == [2, 2, 5]
    # Five folds of 166 rows, the last of 1000.
    assert [supervised.fold_start(1000, f) for f in range(5)] == [170, 336, 502, 668, 834]


def test_trees_separate_an_outlier():
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=(255, 3)), [[9.0, 9.0, 9.0]]])
    feature, threshold, left, right, path = forest.grow_trees(values, 50, 256, 8, rng)
    inner = left != np.arange(len(left))
    assert (right[inner] == left[inner] + 1).all() and np.isinf(threshold[~inner]).all()
    # Every node but the roots is the child of exactly one node.
    assert sorted(np.concatenate([left[inner], right[inner]])) == list(range(50, len(left)))
    node = np.tile(np.arange(50), (len(values), 1))
    for _ in range(8):
        node = np.where(values[np.arange(len(values))[:, None], feature[node]] <= threshold[node], left[node], right[node])
    scores = 2.0 ** (-path[node].mean(axis=1) / forest.mean_path(256))
    assert scores.argmax() == 255 and 0 < scores.min() < scores.max() < 1


def test_forest_is_the_same_on_any_partitioning_and_by_groups(spark):
    rng = np.random.default_rng(1)
    rows = telemetry(spark, [(i % 3, i, i, 0, float(v)) for i, v in enumerate(rng.normal(size=300))])
    mask = F.col("id") < 250
    first = forest.isolation_scores(rows.repartition(7, "id"), ["s"], mask, trees=10)
    second = forest.isolation_scores(rows.coalesce(1), ["s"], mask, trees=10, limits=Limits(broadcast_rows=0, python_rows=20))
    shown = ["if_anomaly_score", "if_anomaly_flag"]
    a, b = (df.orderBy("id").select(*shown).collect() for df in (first, second))
    assert np.allclose([r[0] for r in a], [r[0] for r in b]) and [r[1] for r in a] == [r[1] for r in b]
    assert len(a) == 300 and 0 < sum(r[1] for r in a) <= 18


def test_models_made_from_the_rows_meet_them_in_groups(spark, monkeypatch):
    """Models that share columns with the rows, small and cut assets, one without a model, rows without an asset or id."""
    made = telemetry(spark, [(i % 7 if i % 11 else None, i, i if i % 13 else None, 0, float(i % 17)) for i in range(200)])
    tree = {"feature": [0, 0, 0], "threshold": [8.0, float("inf"), float("inf")], "left": [1, 1, 2], "right": [2, 1, 2], "path": [0.0, 1.0, 2.0]}
    given = made.select("asset_id").distinct().filter("asset_id is null or asset_id <> 4").select(
        "asset_id", F.lit(9).cast("bigint").alias("fit_rows"), F.array(F.lit(0)).alias("roots"), *[F.lit(v).alias(c) for c, v in tree.items()]
    )
    shown = ["asset_id", "time_stamp", "id", "s", "if_raw_score"]
    want = sorted(map(str, forest.score_forest(made, given, ["s"]).select(*shown).collect()))
    monkeypatch.setattr(forest, "BROADCAST_NODES", 4)
    for limits in (Limits(), Limits(python_rows=25)):
        found = forest.score_forest(made, given, ["s"], limits=limits)
        assert sorted(map(str, found.select(*shown).collect())) == want
    assert len(want) == 200 and sum("if_raw_score=None" in r for r in want) == sum(i % 7 == 4 and i % 11 > 0 for i in range(200))


def test_small_assets_are_fitted_and_scored_in_one_pass(spark, monkeypatch):
    """As by written models, without writing any, whatever batches assets fall into; rows without an asset stay."""
    rng = np.random.default_rng(5)
    made = telemetry(spark, [(i % 7 if i % 50 else None, i, i, 0, float(v)) for i, v in enumerate(rng.normal(size=300))])
    rows = made.withColumn("_fit", F.coalesce((F.col("id") < 200) & (F.col("asset_id") != 3), F.lit(False)))
    models = forest.fit_forest(rows, ["s"], F.col("_fit"), trees=10)
    want = {r["id"]: r["if_raw_score"] for r in forest.score_forest(rows, models, ["s"]).collect()}
    monkeypatch.setattr(forest, "fit_forest", None)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        found = forest.fit_and_score(rows.filter("asset_id is not null"), ["s"], "_fit", trees=10).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(found) == 294 and all(r["if_raw_score"] == (x if (x := want[r["id"]]) is None else pytest.approx(x, rel=1e-12)) for r in found)
    assert forest.isolation_scores(rows.drop("_fit"), ["s"], F.col("id") < 200, trees=10, strict=False).count() == 300


def test_asset_without_rows_to_fit_on(spark):
    rows = telemetry(spark, [(i % 2, i, i, 0, float(i)) for i in range(40)])
    mask = F.col("asset_id") == 0
    with pytest.raises(ValueError, match=r"\[1\]"):
        forest.isolation_scores(rows, ["s"], mask, trees=5)
    for limits in (Limits(), Limits(broadcast_rows=0)):
        scored = forest.isolation_scores(rows, ["s"], mask, trees=5, strict=False, limits=limits)
        assert scored.filter("asset_id = 1 and if_anomaly_score is null and if_anomaly_flag = 0").count() == 20
        assert scored.filter("asset_id = 0 and if_anomaly_score is not null").count() == 20


def test_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    points = rng.random((8, 2))
    rows = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id bigint, x double, y double")
    found = {}
    for r in oversample.nearest_neighbours(rows, ["x", "y"], 3).orderBy("id", "rank").collect():
        found.setdefault(r.id, []).append(r.neighbour)
    for i, p in enumerate(points):
        order = np.argsort(((points - p) ** 2).sum(axis=1), kind="stable")
        assert found[i] == [j for j in order if j != i][:3]
    many = spark.range(20).select("id", F.rand(1).alias("x"), F.rand(2).alias("y"))
    with pytest.raises(ValueError):
        oversample.nearest_neighbours(many, ["x", "y"], 3)


def test_oversampling_balances_between_neighbours(spark):
    rows = spark.createDataFrame([(i, int(i < 4), float(i)) for i in range(40)], "id bigint, y int, x double")
    balanced = oversample.oversample(rows, "y", ["x"])
    assert {r["y"]: r["count"] for r in balanced.groupBy("y").count().collect()} == {0: 36, 1: 36}
    made = [r.x for r in balanced.filter("id < 0").collect()]
    assert all(0.0 <= x <= 3.0 for x in made) and len(set(made)) > 5
    enough = rows.withColumn("y", (F.col("id") < 15).cast("int"))
    assert oversample.oversample(enough, "y", ["x"]).count() == 40


def test_event_folds_hold_every_event_out_once(spark):
    rows = spark.createDataFrame([(i, i % 5) for i in range(50)], "id bigint, e bigint")
    own = supervised.add_event_folds(rows, "e", [0, 1, 2, 3, 4])
    assert own.select("fold").distinct().count() == 5
    assert own.groupBy("e").agg(F.countDistinct("fold").alias("n")).filter("n <> 1").isEmpty()
    some = supervised.add_event_folds(rows, "e", [3])
    assert {(r["e"], r["fold"]) for r in some.select("e", "fold").distinct().collect()} == {(0, None), (1, None), (2, None), (3, 0), (4, None)}
    shared = supervised.add_hashed_event_folds(rows, "e", 2)
    assert shared.groupBy("e").agg(F.countDistinct("fold").alias("n")).filter("n <> 1").isEmpty()
    assert set(column(shared.select("fold").distinct(), "fold", "fold")) <= {0, 1}


def test_no_score_is_never_above(spark):
    rows = spark.createDataFrame(
        [(0.9, 1), (float("nan"), 1), (None, 1), (0.2, 1), (0.8, 0), (float("nan"), 0), (None, 0)], "s double, y int"
    )
    once = thresholds.confusion(rows, "s", "y", 0.5).first()
    swept = thresholds.sweep_grid(rows, "s", "y", [0.3, 0.5]).filter("threshold = 0.5").first()
    wanted = {"tp": 1, "fp": 1, "fn": 3, "tn": 2}
    assert {k: once[k] for k in wanted} == {k: swept[k] for k in wanted} == wanted


def test_window_labels_do_not_group_rows(spark):
    rows = spark.createDataFrame([(1, i, 0.0) for i in range(20)], "asset_id bigint, id bigint, x double").withColumn(
        "time_stamp", F.lit(0).cast("timestamp")
    )
    events = spark.createDataFrame(
        [(1, 5, "anomaly", "gear", 3, 9), (1, 6, "anomaly", None, 8, 8), (1, 7, "normal", "n", 1, 12), (1, 8, "other", "o", 15, 16)],
        "asset_id bigint, event_id bigint, event_label string, event_description string, event_start_id bigint, event_end_id bigint",
    )
    found = intervals.window_labels(rows, events)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["id"]: (r["label"], r["fault_type"]) for r in found.collect()} == {
        **{i: (0, "normal") for i in range(1, 13)},
        **{i: (1, "gear") for i in range(3, 10)},
        8: (1, "anomaly"),
    }


def test_interactions_follow_the_setting_and_fall_back(spark):
    described = spark.createDataFrame(
        [("sensor_10", "temp", "C"), ("sensor_2", "temp", "C"), ("sensor_7", "vibration", "g")],
        "sensor_name string, description string, unit string",
    )
    columns = ["sensor_10_avg", "sensor_2_avg", "sensor_7", "sensor_12_avg", "sensor_30_avg"]
    roles = select.sensors_by_role(described, columns)
    assert roles["temperature"] == ["sensor_2_avg", "sensor_10_avg"]
    assert select.interaction_pairs(roles) == {"gearbox_oil_x_power": ("sensor_12_avg", "sensor_30_avg")}
    assert select.interaction_pairs(roles, "vibration")["oil_x_vib"] == ("sensor_2_avg", "sensor_7")
