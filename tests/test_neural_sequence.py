"""The non-linear sequence model and the blocks it reads."""

from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gustwatch.operators import autoencoder, neural_sequence, sequences
from gustwatch.operators.neural_sequence import Training, Weights, fit_nonlinear_model
from gustwatch.settings import Limits

NAMES = ["c1", "s1", "c2", "s2"]


@pytest.fixture(scope="module")
def circle(spark):
    """Readings on a circle and its double: two numbers tell all four, but not by a linear map."""
    start, rows = datetime(2024, 1, 1), []
    for asset in range(3):
        for i in range(300):
            t = 0.37 * i + asset
            rows.append((asset, i, start + timedelta(minutes=10 * i), True, np.cos(t), np.sin(t), np.cos(2 * t), np.sin(2 * t)))
    frame = pd.DataFrame(rows, columns=["asset_id", "id", "time_stamp", "if_fit_eligible", *NAMES])
    return spark.createDataFrame(frame).cache()


def test_gradient_by_differences():
    draw = np.random.default_rng(2)
    weights = Weights.start(np.linalg.qr(draw.normal(size=(6, 2)))[0], 3, 1)
    weights = weights.like(weights.flat() + 0.1 * draw.normal(size=weights.flat().size))
    x, flat, step = draw.normal(size=(5, 6)), weights.flat(), 1e-6
    loss, slope = weights.gradient(x)
    assert loss == pytest.approx(weights.loss(x))
    for i in range(flat.size):
        up, down = flat.copy(), flat.copy()
        up[i] += step
        down[i] -= step
        assert slope[i] == pytest.approx((weights.like(up).loss(x) - weights.like(down).loss(x)) / (2 * step), abs=1e-6)


def test_beats_the_linear_model_where_readings_lie_on_a_curve(circle):
    linear = autoencoder.fit_sequence_model(circle, NAMES, 2, 15, components=2)
    model = fit_nonlinear_model(circle, NAMES, 2, 15, components=2, training=Training(hidden=24, steps=80, rate=0.02))
    mean = [
        autoencoder.reconstruction_errors(circle, m).filter("has_window").agg(F.avg("lstm_recon_error")).first()[0] for m in (linear, model)
    ]
    assert mean[1] < mean[0] / 3
    assert model.history[0][1] > 3 * min(h[1] for h in model.history)


def test_same_weights_on_any_partitioning(circle):
    short = Training(hidden=8, steps=5, rate=0.02)
    one = fit_nonlinear_model(circle.coalesce(1), NAMES, 3, 15, components=2, training=short)
    other = fit_nonlinear_model(circle.repartition(7), NAMES, 3, 15, components=2, training=short, limits=Limits(task_rows=100))
    assert np.allclose(abs(one.components.T @ other.components), np.eye(2), atol=1e-6)
    assert np.allclose([h for h in one.history], [h for h in other.history], atol=1e-6)


def test_stops_when_later_windows_get_worse(circle):
    wild = Training(hidden=8, steps=60, patience=3, rate=5.0)
    model = fit_nonlinear_model(circle, NAMES, 2, 15, components=2, training=wild)
    held = [h[1] for h in model.history]
    assert len(held) < 20 and held.index(min(held)) == len(held) - 1 - wild.patience
    linear = replace(model, weights=Weights.start(model.components, 8, wild.seed))
    assert (held.index(min(held)) > 0) or np.array_equal(model.weights.flat(), linear.weights.flat())


def plain_windows(rows, length, stride):
    out = {}
    for i in range(length - 1, len(rows)):
        if (i + 1 - length) % stride == 0:
            cut = rows[i + 1 - length : i + 1]
            out[rows[i][0]] = ([v for r in cut for v in r[1]], all(r[2] for r in cut))
    return out


@pytest.mark.parametrize(("length", "stride"), [(1, 1), (2, 1), (5, 3), (16, 1)])
def test_blocks_hold_all_windows(spark, length, stride):
    start, rows, want = datetime(2024, 1, 1), [], {}
    for asset, n in ((0, 150), (1, 3), (2, 41)):
        part = [(1000 * asset + i, [float(i), float(i * i % 7)], i % 11 != 5) for i in range(n)]
        want |= plain_windows(part, length, stride)
        rows += [(asset, k, start + timedelta(minutes=k), ok, *v) for k, v, ok in part]
    df = spark.createDataFrame(rows, "asset_id long, id long, time_stamp timestamp, if_fit_eligible boolean, a double, b double")
    blocks = sequences.sequence_blocks(df.repartition(3), ["a", "b"], length, None, stride=stride, keep=["id"])
    found = {r["id"]: (r["payload"], r["trainable"]) for r in sequences.expand_blocks(blocks, 2, length).collect()}
    assert found == want
    # An eighth more than the rows, at any length.
    stored = blocks.agg(F.sum(F.size("values"))).first()[0]
    assert stored <= 2 * len(rows) * (1 + 1 / sequences.BLOCK_LENGTHS)
    assert blocks.groupBy(*sequences.BLOCK).count().filter("count > 1").count() == 0


def test_blocks_at_full_length_stay_below_twice_the_rows(spark):
    df = spark.range(3000).select(
        F.lit(1).alias("asset_id"),
        "id",
        F.timestamp_seconds(F.col("id") * 600).alias("time_stamp"),
        F.lit(True).alias("if_fit_eligible"),
        F.col("id").cast("double").alias("a"),
    )
    blocks = sequences.sequence_blocks(df, ["a"], 144, 15, keep=["id"])
    stored, windows = blocks.agg(F.sum(F.size("values")), F.sum(F.size("windows"))).first()
    assert windows == 3000 - 143 and stored < 2 * 3000


def test_steps_read_packs_and_sort_nothing(circle, monkeypatch):
    """Passes and steps read arrays written once: no pass sorts the rows or takes nested lists apart again."""
    plans = []

    def watch(module, name):
        own = getattr(module, name)

        def watched(df, *more, **named):
            plans.append((df.dtypes, df._jdf.queryExecution().executedPlan().toString()))
            return own(df, *more, **named)

        monkeypatch.setattr(module, name, watched)

    watch(autoencoder, "_added")
    watch(neural_sequence, "_step")
    fit_nonlinear_model(circle, NAMES, 2, 15, components=2, training=Training(hidden=4, steps=2))
    assert len(plans) > 4
    assert all({t for _, t in types} == {"binary"} and "Sort" not in plan and "Exchange" not in plan for types, plan in plans)
