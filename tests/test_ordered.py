"""Ordered operations give the same whether keys are cut into runs or not."""

import numpy as np
import pytest
from compare import bag
from frames import events, random_telemetry
from pyspark.sql import functions as F

from gustwatch.operators import intervals, sequences
from gustwatch.operators.asof import next_event
from gustwatch.operators.ensemble import add_alerts
from gustwatch.operators.ordered import RUN, Ordered
from gustwatch.operators.percentiles import exact_percentiles
from gustwatch.operators.rolling import add_rolling
from gustwatch.operators.status import add_status_history
from gustwatch.operators.thresholds import average_precision
from gustwatch.settings import Limits

WHOLE = Limits()


def same(left, right, places=9):
    def rounded(df):
        columns = [F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
        return bag(df.columns, df.select(*columns).collect())

    a, b = rounded(left), rounded(right)
    assert sorted(left.columns) == sorted(right.columns)
    assert a == b, (list((a - b))[:3], list((b - a))[:3])


@pytest.fixture(scope="module", params=[12, 60])
def cut(request):
    return Limits(task_rows=request.param, broadcast_rows=0, python_rows=10)


@pytest.fixture(scope="module")
def rows(spark):
    return random_telemetry(spark, np.random.default_rng(5)).cache()


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(6)
    made = []
    for e in range(60):
        first = int(rng.integers(0, 400))
        asset = 0 if rng.random() < 0.5 else int(rng.integers(1, 6))
        label = "anomaly" if rng.random() < 0.6 else "normal"
        made.append((asset, e, label, float(rng.integers(0, 1300)), first, first + int(rng.integers(-3, 60)), f"f{e % 3}"))
    return events(spark, made).cache()


def test_runs_are_bounded_and_in_order(rows):
    cut_rows = Ordered.of(rows, ["asset_id"], ["time_stamp", "id"], Limits(task_rows=20))
    assert cut_rows.split
    sizes = [r["count"] for r in cut_rows.df.groupBy("asset_id", RUN).count().collect()]
    assert sum(sizes) == 400 and max(sizes) <= 60
    spans = cut_rows.df.groupBy("asset_id", RUN).agg(
        F.min(F.struct("time_stamp", "id")).alias("lo"), F.max(F.struct("time_stamp", "id")).alias("hi")
    )
    per_asset = {}
    for r in sorted(spans.collect(), key=lambda r: (r.asset_id, r[RUN])):
        assert per_asset.get(r.asset_id) is None or tuple(per_asset[r.asset_id]) < tuple(r.lo)
        per_asset[r.asset_id] = r.hi


def test_small_keys_are_not_cut(rows):
    assert not Ordered.of(rows, ["asset_id"], ["time_stamp", "id"]).split


@pytest.mark.parametrize("kinds", [{}, {"s": "angle"}, {"s": "counter"}])
def test_rolling(rows, cut, kinds):
    same(add_rolling(rows, ["s"], kinds, limits=cut), add_rolling(rows, ["s"], kinds), places=6)


def test_rolling_by_split(rows, cut):
    split = rows.withColumn("train_test", F.when(F.col("id") < 250, "train").otherwise("prediction"))
    same(add_rolling(split, ["s"], by_split=True, limits=cut), add_rolling(split, ["s"], by_split=True))
    # The same as rolling each split for itself.
    parts = [add_rolling(split.filter(F.col("train_test") == s), ["s"]) for s in ("train", "prediction")]
    same(add_rolling(split, ["s"], by_split=True), parts[0].unionByName(parts[1]))


def test_status_history(rows, cut):
    same(add_status_history(rows, limits=cut), add_status_history(rows))


def test_status_history_moves_rows_once(rows):
    plan = add_status_history(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_status_history_without_time(rows, cut):
    # Some rows have no time, some share a second, some differ by exactly a range.
    hour = F.expr("timestampadd(HOUR, 24 * (id % 40), timestamp'2024-01-01 00:00:00')")
    some = rows.withColumn("time_stamp", F.when(F.col("id") % 9 > 0, hour))
    some = some.withColumn("status_type_id", F.when(F.col("id") % 7 > 0, F.col("status_type_id")))
    history = add_status_history(some)
    same(add_status_history(some, limits=cut), history)
    per_day = some.filter("time_stamp is not null").alias("a").join(
        some.alias("b"),
        F.expr("a.asset_id = b.asset_id and b.time_stamp between a.time_stamp - interval 24 hours and a.time_stamp"),
    )
    share = F.try_divide(F.count_if(F.col("b.status_type_id") == 4), F.count("b.status_type_id")).alias("downtime_frac_24h")
    same(history.select("id", "downtime_frac_24h"), per_day.groupBy("a.id").agg(share))


def test_next_event_derives_events_once(spark, rows, windows):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    starts = windows.select("asset_id", "event_id", "event_start")
    watched = starts.mapInPandas(count, starts.schema)
    same(next_event(rows, watched, limits=Limits(broadcast_rows=0)), next_event(rows, windows))
    # ``same`` reads the result once.
    assert seen.value == windows.count()


def test_window_flag_derives_windows_once(spark, rows, windows):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    ranges = windows.select("asset_id", "event_start_id", "event_end_id")
    watched = ranges.mapInPandas(count, ranges.schema)
    same(intervals.add_window_flag(rows, watched, "inside", Limits(broadcast_rows=0)), intervals.add_window_flag(rows, windows, "inside"))
    # Counted per key, then united.
    assert seen.value <= 2 * windows.count()


def test_next_event(rows, windows, cut):
    same(next_event(rows, windows, limits=cut), next_event(rows, windows))


def test_next_event_is_theta_join(rows, windows):
    joined = rows.join(windows.select(F.col("asset_id").alias("a"), "event_id", "event_start"),
                       (F.col("asset_id") == F.col("a")) & (F.col("event_start") > F.col("time_stamp")), "left")
    expected = joined.groupBy(*rows.columns).agg(F.min(F.when(F.col("event_start").isNotNull(), F.struct(F.col("event_start").alias("time"), "event_id"))).alias("_next"))
    same(next_event(rows, windows), expected)


def test_event_rows(rows, windows, cut):
    other = windows.drop("event_start")
    same(intervals.event_rows(rows, other, cut), intervals.event_rows(rows, other))


def test_window_flag(rows, windows, cut):
    flagged = intervals.add_window_flag(rows, windows, "inside")
    same(intervals.add_window_flag(rows, windows, "inside", cut), flagged)
    members = intervals.event_rows(rows, windows.drop("event_start")).select("id").distinct().count()
    assert flagged.count() == rows.count() and flagged.filter("inside").count() == members


def test_merged_windows_do_not_overlap(windows, cut):
    merged = intervals.merged_windows(windows)
    same(intervals.merged_windows(windows, cut), merged)
    spans = sorted(tuple(r) for r in merged.select("asset_id", "event_start_id", "event_end_id").collect())
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(spans, spans[1:]))


def test_alerts(rows, cut):
    same(add_alerts(rows, "s", 10.0, cut), add_alerts(rows, "s", 10.0))


def test_sequences(rows, cut):
    eligible = rows.withColumn("if_fit_eligible", F.col("status_type_id") != 4)
    for build in (
        lambda limits: sequences.gap_segments(rows, 5, limits),
        lambda limits: sequences.sequence_windows(eligible, 4, 10, limits=limits),
        lambda limits: sequences.sequence_payload(eligible, ["s"], 3, None, stride=2, limits=limits),
        lambda limits: sequences.window_statistics(eligible, 3, 10, limits=limits),
    ):
        same(build(cut), build(WHOLE))


def test_percentiles(rows, cut):
    for by in ([], ["asset_id"]):
        percents = [0, 12.5, 50, 95, 100]
        assert exact_percentiles(rows, "s", percents, by).count() >= 1
        same(exact_percentiles(rows, "s", percents, by, cut), exact_percentiles(rows, "s", percents, by))
    values = [r.s for r in rows.filter("s is not null").collect()]
    found = exact_percentiles(rows, "s", [12.5, 95], limits=cut).first()
    assert np.allclose(list(found), np.percentile(values, [12.5, 95]))


def test_average_precision(rows):
    labelled = rows.filter("s is not null").withColumn("y", F.col("status_type_id") % 2)
    pairs = sorted(((r["s"], r["y"]) for r in labelled.collect()), reverse=True)
    positives, gained, tp = sum(y == 1 for _, y in pairs), 0.0, 0
    for value in sorted({x for x, _ in pairs}, reverse=True):
        here = sum(y == 1 for x, y in pairs if x == value)
        tp += here
        gained += here * tp / sum(x >= value for x, _ in pairs)
    found = average_precision(labelled, "s", "y").first()
    assert found["positives"] == positives and found["average_precision"] == pytest.approx(gained / positives)
