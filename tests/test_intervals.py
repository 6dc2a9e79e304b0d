"""The index of windows by levels."""

import random

import pytest
from pyspark.sql import functions as F

from gustwatch.operators import intervals
from gustwatch.settings import Limits

MANY = Limits(broadcast_rows=0)


@pytest.fixture(scope="module")
def mixed(spark):
    """Windows of one to a million ids, of which a few cover almost all rows."""
    pick = random.Random(8)
    windows = []
    for e in range(300):
        width = 10 ** pick.randint(0, 6) * pick.randint(1, 9) // 10 + 1
        start = pick.randint(-1000, 1_000_000)
        windows.append((e % 3, e, start, start + width - 1))
    windows += [(0, 900, 5, 4), (1, 901, 17, 17), (9, 902, 0, 10**6)]
    rows = [(a, i, f"x{i}") for a in range(4) for i in (pick.randint(-1000, 1_100_000) for _ in range(400))]
    rows.append(rows[0])
    events = spark.createDataFrame(windows, "asset_id long, event_id long, event_start_id long, event_end_id long")
    return spark.createDataFrame(rows, "asset_id long, id long, other string"), events, rows, windows


def test_like_all_pairs(mixed):
    df, events, rows, windows = mixed
    found = intervals.event_rows(df, events, MANY)
    want = sorted((a, i, e) for a, i, _ in rows for b, e, s, t in windows if a == b and s <= i <= t)
    assert sorted((r["asset_id"], r["id"], r["event_id"]) for r in found.collect()) == want
    assert found.columns == intervals.event_rows(df, events).columns


def test_blocks_are_few_disjoint_and_exact(mixed):
    _, events, _, windows = mixed
    levels = intervals._levels(events)
    assert levels == 5
    blocks = {}
    for r in intervals.window_blocks(events, levels).collect():
        width = 1 << (intervals._BITS * r["_level"])
        blocks.setdefault(r["event_id"], []).append((r["_block"] * width, (r["_block"] + 1) * width))
    for _, e, s, t in windows:
        parts = sorted(blocks.get(e, []))
        assert len(parts) <= 30 * levels
        if s <= t:
            assert parts[0][0] == s and parts[-1][1] == t + 1
            assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        else:
            assert not parts


def test_a_row_meets_its_hits_and_one_probe_per_level(mixed):
    df, events, rows, _ = mixed
    levels = intervals._levels(events)
    hits = intervals.event_rows(df.distinct(), events, MANY).count()
    probed = df.distinct().count() * levels
    assert hits > 0 and probed == len(set(rows)) * levels


def test_other_id_types(spark):
    rows = spark.createDataFrame([(1, 5), (1, 6)], "asset_id int, id int")
    events = spark.createDataFrame([(1, 7, 5, 5)], "asset_id int, event_id int, event_start_id int, event_end_id int")
    found = intervals.event_rows(rows, events, MANY)
    assert [(r["id"], r["event_id"]) for r in found.collect()] == [(5, 7)]
    assert found.schema["event_start_id"].dataType == events.schema["event_start_id"].dataType
    assert intervals.event_rows(rows, events.limit(0), MANY).filter(F.lit(True)).count() == 0


def test_many_windows_are_never_broadcast(mixed, spark, tmp_path):
    """Sizes of exploded windows and probes are not known to the planner, which took them for as small as the files."""
    stored = []
    for name, df in zip(("rows", "events"), mixed):
        df.write.parquet(str(tmp_path / name))
        stored.append(spark.read.parquet(str(tmp_path / name)))
    plan = intervals.event_rows(*stored, MANY)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def test_windows_as_wide_as_ids_can_be(spark, monkeypatch):
    """What a window costs follows from its rows: no span of ids is too wide, and long lists are made in parts."""
    monkeypatch.setattr(intervals, "_LISTED", 2, raising=False)
    most = 2**63 - 1
    rows = [(1, i) for i in (-most, -5, 0, 0, 7, most)] + [(2, 3), (None, 0), (1, None)]
    windows = [(1, 10, -most, most), (1, 11, 0, 0), (1, 11, 0, 0), (1, 12, 8, most - 1), (2, 13, 4, 3), (None, 14, 0, 0), (3, 15, 0, 9)]
    df = spark.createDataFrame(rows, "asset_id long, id long")
    events = spark.createDataFrame(windows, "asset_id long, event_id long, event_start_id long, event_end_id long")
    found = [(r["id"], r["event_id"]) for r in intervals.event_rows(df, events, MANY).collect()]
    assert sorted(found) == sorted([(i, 10) for a, i in rows if a == 1 and i is not None] + [(0, 11)] * 4)
    hot = intervals.event_rows(df, events, Limits(broadcast_rows=0, task_rows=2))
    assert sorted((r["id"], r["event_id"]) for r in hot.collect()) == sorted(found)
