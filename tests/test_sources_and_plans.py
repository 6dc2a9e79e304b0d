"""Files and tables, and the end-to-end plans."""

import inspect
from unittest.mock import MagicMock

import numpy as np
import pytest
from frames import at, events
from pyspark.sql import functions as F

from gustwatch.catalogue import model_checks, models
from gustwatch.operators import autoencoder, supervised
from gustwatch.operators.boosting import TreeSettings
from gustwatch.plans.alerts import ALERT_COLUMNS, build_alerts
from gustwatch.plans.features import build_feature_table
from gustwatch.session import checkpoint_root, fits, materialize
from gustwatch.settings import FEATURE_SUFFIXES, FarmSettings, Limits
from gustwatch.sources import published, tables


def test_csv_with_and_without_types(spark, tmp_path):
    schema = tables.telemetry_schema(["s"])
    folder = tmp_path / "csv"
    folder.mkdir()
    header = "asset_id;time_stamp;id;train_test;status_type_id;s\n"
    (folder / "a.csv").write_text(header + "1;2024-01-01 00:00:00;5;train;0;1.5\n")
    (folder / "b.csv").write_text(header + "1;2024-01-01 00:10:00;6;train;4;oops\n")
    text = tables.read_csv_as_text(spark, str(folder), schema).orderBy("id").collect()
    assert [(r.id, r.status_type_id, r.s, r.time_stamp) for r in text] == [(5, 0, 1.5, at(0)), (6, 4, None, at(10))]
    assert tables.read_csv(spark, str(folder), schema).schema == schema


def test_tables(spark, tmp_path):
    rows = spark.range(20).withColumn("part", F.col("id") % 3)
    tables.write_table(rows, "stored", path=str(tmp_path / "t"), partition_by=["part"])
    assert sorted(p.name for p in (tmp_path / "t").glob("part=*")) == ["part=0", "part=1", "part=2"]
    tables.write_table(rows.limit(5).withColumn("more", F.lit(1)), "stored", path=str(tmp_path / "t"))
    assert tables.read_table(spark, "stored").columns == ["id", "part", "more"]
    assert tables.optional_table(spark, "absent") is None
    assert tables.optional_table(spark, "stored").count() == 5
    assert tables.quoted("a-b", "c") == "`a-b`.`c`"


def test_run_log(spark):
    rows = tables.run_rows(spark, "child", {"depth": 5}, {"rmse": 1.5}, parent="top").collect()
    assert {(r.run, r.parent, r.kind, r.key, r.value) for r in rows} == {
        ("child", "top", "param", "depth", "5"), ("child", "top", "metric", "rmse", "1.5"),
    }


def test_materialized_rows_lie_below_the_checkpoint_folder(spark):
    rows = materialize(spark.range(10))
    assert rows.count() == 10
    assert all(checkpoint_root(spark).removeprefix("file:") in f for f in rows.inputFiles())


def test_size_checks(spark):
    rows = spark.range(10).select((F.col("id") % 2).alias("asset_id"))
    assert fits(rows, Limits(broadcast_rows=10)) and not fits(rows, Limits(broadcast_rows=9))
    assert not fits(rows, Limits(broadcast_rows=10, candidates_per_key=4))
    assert fits(rows.limit(0), Limits(broadcast_rows=0))


@pytest.fixture(scope="module")
def farm(spark):
    rng = np.random.default_rng(4)
    made = []
    for asset in (1, 2):
        for i in range(200):
            split = "train" if i < 150 else "prediction"
            status = 4 if i in (60, 61, 170) else 0
            made.append((asset, at(10 * i), asset * 1000 + i, split, status, float(rng.normal()), float(i % 360), 7.0))
    schema = (
        "asset_id bigint, time_stamp timestamp, id bigint, train_test string, status_type_id int, "
        "oil_avg double, dir_avg double, dead_avg double"
    )
    telemetry = spark.createDataFrame(made, schema)
    windows = events(spark, [(1, 1, " Anomaly", 500, 1050, 1065, "gear"), (1, 2, "normal", 100, 1010, 1030, None), (2, 3, "anomaly", 1600, 2160, 2175, "fan")])
    described = spark.createDataFrame(
        [("oil", "gearbox oil temp", "C", "false", "false"), ("dir", "wind speed direction", "deg", "true", "false")],
        "sensor_name string, description string, unit string, is_angle string, is_counter string",
    )
    return telemetry, windows, described


@pytest.mark.parametrize("as_text", [False, True])
def test_feature_table(spark, farm, as_text):
    telemetry, windows, described = farm
    if as_text:
        telemetry = telemetry.select(*[F.col(c).cast("string").alias(c) for c in telemetry.columns])
    built = build_feature_table(telemetry, windows, described, FarmSettings(fit_cutoff="2024-01-01 08:00:00"))
    assert built.sensors == ["dir_avg", "oil_avg"] and built.rows.count() == 400
    assert {s + x for s in built.sensors for x in FEATURE_SUFFIXES} <= set(built.rows.columns)
    normal = built.rows.filter("train_test = 'train' and status_type_id = 0")
    mean, std = normal.agg(F.avg("oil_avg_roll_mean_1h"), F.stddev_pop("oil_avg_roll_mean_1h")).first()
    assert mean == pytest.approx(0, abs=1e-9) and std == pytest.approx(1)
    assert built.rows.filter("in_anomaly_window").count() == 32
    assert built.rows.filter("if_fit_eligible and (in_anomaly_window or status_type_id <> 0)").isEmpty()
    assert "gearbox_oil_x_wind" in built.rows.columns


def test_feature_table_is_the_same_for_hot_assets(spark, farm):
    telemetry, windows, described = farm
    settings = FarmSettings(fit_cutoff="2024-01-01 08:00:00", roll_by_split=True)
    whole = build_feature_table(telemetry, windows, described, settings)
    cut = build_feature_table(telemetry, windows, described, settings, Limits(task_rows=90, broadcast_rows=0))
    names = [c for c, t in whole.rows.dtypes if t in ("double", "boolean")]
    a, b = (t.rows.orderBy("id").select(*[F.col(n).cast("double") for n in names]).toPandas().astype(float) for t in (whole, cut))
    np.testing.assert_allclose(a.to_numpy(), b.to_numpy(), atol=1e-6)


def test_alerts_without_sequence_scores(spark, farm):
    telemetry, windows, _ = farm
    scored = telemetry.withColumns(
        {
            "xgb_anomaly_prob": F.when(F.col("id").between(1050, 1065), 0.9).otherwise(F.abs("oil_avg") / 10),
            "xgb_fault_type": F.lit("gear"),
            "if_anomaly_score": F.abs("oil_avg"),
        }
    )
    built = build_alerts(scored, scored, windows)
    assert built.alerts.columns == list(ALERT_COLUMNS) and built.alerts.count() == 400
    assert set(built.weights) == {"if_anomaly_score_norm", "xgb_anomaly_prob_norm"}
    assert sum(w for _, w in built.weights.values()) == pytest.approx(1)
    assert {r.urgency for r in built.summary.collect()} == {"MONITOR"}
    covered = {r.event_id: r for r in built.coverage.collect()}
    assert covered[1].coverage > 0.5 and covered[3].window_rows == 16 and covered[2].coverage is None


def test_reconstruction_of_a_full_basis_is_exact(spark, farm):
    telemetry, _, _ = farm
    rows = telemetry.withColumn("if_fit_eligible", F.col("status_type_id") == 0).drop("dead_avg")
    features = ["oil_avg", "dir_avg"]
    full = autoencoder.fit_sequence_model(rows, features, 3, 15, components=6)
    scored = autoencoder.reconstruction_errors(rows, full)
    assert scored.count() == 400 and scored.filter("has_window").count() == 2 * 198
    assert scored.agg(F.max("lstm_recon_error")).first()[0] < 1e-18
    small = autoencoder.fit_sequence_model(rows, features, 3, 15, components=2)
    scored = autoencoder.reconstruction_errors(rows, small).orderBy("id")
    cut = autoencoder.reconstruction_errors(rows, small, Limits(task_rows=50)).orderBy("id")
    a, b = ([r.lstm_recon_error for r in t.collect()] for t in (scored, cut))
    assert max(a) > 1e-3 and np.allclose(a, b)
    # The same from all windows held in memory.
    values = rows.orderBy("id").toPandas()
    stats = {r.feature: (r["mean"], r["std"]) for r in small.stats.collect()}
    one = values[values.asset_id == 1]
    x = np.stack([(one[f] - stats[f][0]) / stats[f][1] for f in features], axis=1)
    windows = np.stack([x[i : i + 3].ravel() for i in range(198)]) - small.mean
    missed = windows - windows @ small.components @ small.components.T
    assert np.allclose(a[2:200], (missed**2).mean(axis=1))
    by_feature = autoencoder.error_by_feature(autoencoder.reconstruction_errors(rows, small), features).collect()
    assert {r.feature for r in by_feature} == set(features)


def test_components_are_the_principal_ones(spark):
    rng = np.random.default_rng(1)
    features = [f"f{i}" for i in range(3)]
    table = rng.normal(size=(300, 3)).cumsum(axis=0)
    rows = spark.createDataFrame(
        [(1, 600 * i, i, bool(i % 40), *map(float, table[i])) for i in range(300)],
        "asset_id bigint, t bigint, id bigint, if_fit_eligible boolean, " + ", ".join(f"{f} double" for f in features),
    ).withColumn("time_stamp", F.timestamp_seconds("t"))
    length = 4
    eligible = np.array([bool(i % 40) for i in range(300)])
    x = (table - table[eligible].mean(axis=0)) / table[eligible].std(axis=0, ddof=1)
    ends = [i for i in range(length - 1, 300) if eligible[i - length + 1 : i + 1].all()]
    cut = np.percentile(ends, 80)
    windows = np.stack([x[i - length + 1 : i + 1].ravel() for i in ends if i <= cut])
    for limits in (Limits(), Limits(task_rows=60)):
        model = autoencoder.fit_sequence_model(rows, features, length, 15, components=2, limits=limits)
        wanted = np.linalg.svd(windows - model.mean)[2][:2].T
        # The same plane, whatever scaling by count or by count less one.
        assert np.allclose(model.components @ model.components.T, wanted @ wanted.T, atol=0.02)


def test_wide_windows_need_no_square_matrix(spark):
    names = [f"f{i}" for i in range(60)]
    rows = spark.range(400).select(
        F.lit(1).cast("bigint").alias("asset_id"),
        F.timestamp_seconds(F.col("id") * 600).alias("time_stamp"),
        "id",
        F.lit(True).alias("if_fit_eligible"),
        *[F.sin(F.col("id") * (i + 1) / 50).alias(c) for i, c in enumerate(names)],
    )
    model = autoencoder.fit_sequence_model(rows, names, 144, 15, components=3, passes=3)
    assert model.components.shape == (144 * 60, 3)
    assert np.allclose(model.components.T @ model.components, np.eye(3), atol=1e-8)


def test_classifiers(spark, farm):
    telemetry, _, _ = farm
    labelled = telemetry.withColumn("label", (F.col("oil_avg") > 0.5).cast("int")).withColumn(
        "fault_type", F.when(F.col("dir_avg") < 100, "low").otherwise("high")
    )
    folded = supervised.add_time_folds(labelled)
    assert folded.filter("holdout").count() == 80
    size = 320 // 3
    assert [r["count"] for r in folded.filter("fold is not null").groupBy("fold").count().orderBy("fold").collect()] == [size, size]
    trees = TreeSettings(rounds=8, depth=2, learning_rate=0.3)
    model = supervised.fit_event_model(folded.filter("not holdout"), ["oil_avg", "dir_avg"], trees)
    scored = supervised.add_probability(folded, model, ["oil_avg", "dir_avg"])
    means = {r.label: r.m for r in scored.groupBy("label").agg(F.avg("xgb_anomaly_prob").alias("m")).collect()}
    assert means[1] > means[0] + 0.1
    assert 0.35 <= supervised.tuned_threshold(scored) <= 0.999
    assert supervised.gain_importance(spark, model, ["oil_avg", "dir_avg"]).first()["feature"] == "oil_avg"
    faults = supervised.fit_fault_model(labelled.filter("label = 1"), ["dir_avg"], trees)
    named = supervised.add_fault_type(labelled, faults, ["dir_avg"])
    assert named.filter("fault_type <> fault_prediction").count() < 20
    assert supervised.fit_fault_model(labelled.filter("dir_avg < 100"), ["dir_avg"], trees) is None
    assert supervised.add_fault_type(labelled, None, ["dir_avg"], "low").first()["fault_prediction"] == "low"


def test_model_queries_train_with_the_default_trees(monkeypatch):
    taken = {}

    def spy(module, name):
        original = getattr(module, name)

        def called(*args, **named):
            bound = inspect.signature(original).bind(*args, **named)
            bound.apply_defaults()
            taken.setdefault(current, []).extend(v for v in bound.arguments.values() if isinstance(v, TreeSettings))
            raise StopIteration

        monkeypatch.setattr(module, name, called)

    for name in ("cross_validate", "fit_event_model", "fit_fault_model", "fit_horizon_model", "leave_event_out"):
        spy(supervised, name)
    spy(model_checks, "build_classifier_scores")
    monkeypatch.setattr(supervised, "positive_weight", lambda _: 1.0)
    frame = MagicMock()
    for name in ("_folded", "_featured", "event_info"):
        monkeypatch.setattr(models, name, lambda *_: frame)
    monkeypatch.setattr(model_checks, "event_info", lambda *_: frame)
    monkeypatch.setattr(models, "_horizon_rows", lambda *_: (frame, frame))
    monkeypatch.setattr(models, "F", MagicMock())
    event, fault, horizon = supervised.EVENT_TREES, supervised.FAULT_TREES, supervised.HORIZON_TREES
    assert (event.rounds, fault.rounds, horizon.rounds, horizon.depth) == (400, 300, 200, 6)
    expected = {
        models.gbt_cross_validation: [event],
        models.gbt_event_prob: [event],
        models.fault_classifier: [fault],
        models.loeo_rmse: [horizon],
        models.horizon_scores: [horizon],
        models.feature_importance: [horizon],
        model_checks.gbt_invariants: [event],
        model_checks.horizon_invariants: [horizon],
        model_checks.importance_invariants: [horizon],
        model_checks.classifier_scores: [event, fault],
        model_checks.contributions_add_up: [horizon],
    }
    for current in expected:
        with pytest.raises(StopIteration):
            current(None, "")
    assert taken == expected


def test_every_event_is_left_out_once(spark, monkeypatch):
    original, held = supervised.fit_boosted, []

    def fit_small(rows, features, target, kind, settings, **how):
        held.extend(rows.filter(~m).count() for m in how["members"])
        return original(rows, features, target, kind, TreeSettings(rounds=1, depth=1), **how)

    _, learned = models._horizon_rows(spark, "/root/testdata/sf0.001")
    events = learned.select("next_anomaly_event_id").distinct().count()
    monkeypatch.setattr(supervised, "fit_boosted", fit_small)
    folds = models.loeo_rmse(spark, "/root/testdata/sf0.001").collect()
    assert events > 12 and 10 < len(folds) <= models.LOEO_FOLDS
    assert sum(r["n"] for r in folds) == learned.count() and sorted(r["n"] for r in folds) == sorted(held)


def test_published_runs(spark, tmp_path):
    rows, path = spark.range(10).select("id"), str(tmp_path / "table")
    assert published.published(spark, path) == []
    with pytest.raises(ValueError, match="nothing published"):
        published.read_published(spark, path)
    assert published.publish(rows, path, "a") and not published.publish(rows.filter("id < 3"), path, "a")
    assert published.publish(rows.withColumn("more", F.lit(1)), path, "b")
    found = published.read_published(spark, path)
    assert found.count() == 20 and found.filter("run = 'a' and more is null").count() == 10

    def refuse(written):
        assert written.count() == 10
        raise RuntimeError("withheld")

    with pytest.raises(RuntimeError, match="withheld"):
        published.publish(rows, path, "c", check=refuse)
    assert [r["run"] for r in published.published(spark, path)] == ["a", "b"]
    # Another writer names its run first: this one takes the next version and keeps both.
    count = len(published._versions(spark, path))
    assert not published._create(spark, f"{path}/_versions/{count - 1:012d}.json", "[]")
    assert published.publish(rows.filter("id < 4"), path, "d", mode="overwrite")
    assert published.read_published(spark, path).count() == 4
