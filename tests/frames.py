"""Small hand-made tables."""

from datetime import datetime, timedelta

START = datetime(2024, 1, 1)

TELEMETRY = "asset_id bigint, time_stamp timestamp, id bigint, train_test string, status_type_id int, s double"
EVENTS = (
    "asset_id bigint, event_id bigint, event_label string, event_start timestamp, event_start_id bigint, "
    "event_end_id bigint, event_description string"
)


def at(minutes: float) -> datetime:
    return START + timedelta(minutes=minutes)


def telemetry(spark, rows):
    """Rows ``(asset, minute, id, status, value)``."""
    return spark.createDataFrame(
        [(a, at(m), i, "train", status, value) for a, m, i, status, value in rows], TELEMETRY
    )


def events(spark, rows):
    """Rows ``(asset, event, label, start minute, first id, last id, description)``."""
    return spark.createDataFrame([(a, e, l, at(m), f, t, d) for a, e, l, m, f, t, d in rows], EVENTS)


def random_telemetry(spark, rng, rows=400, assets=5):
    """One asset has half of the rows; times repeat, values may be missing."""
    made = []
    for i in range(rows):
        asset = 0 if rng.random() < 0.5 else int(rng.integers(1, assets))
        value = None if rng.random() < 0.1 else float(rng.integers(0, 50))
        made.append((asset, float(rng.integers(0, rows * 3)), i, int(rng.choice([0, 1, 4])), value))
    return telemetry(spark, made)
