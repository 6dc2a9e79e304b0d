"""From telemetry, events and sensor metadata to the labelled, scaled feature table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustwatch.operators import labels, quality, scaling, select
from gustwatch.operators.intervals import normalize_events, require_valid_events
from gustwatch.operators.rolling import add_rolling, drop_all_null, fill_zero, rolling_names
from gustwatch.operators.status import add_status_history
from gustwatch.session import materialize, sized
from gustwatch.settings import LIMITS, META_COLUMNS, FarmSettings, Limits


@dataclass(frozen=True)
class FeatureTable:
    rows: DataFrame
    #: ``(feature, mean, std)`` of the scaling applied to ``rows``.
    stats: DataFrame
    sensors: list[str]


def build_feature_table(
    telemetry: DataFrame,
    events: DataFrame,
    descriptions: DataFrame,
    settings: FarmSettings,
    limits: Limits = LIMITS,
) -> FeatureTable:
    quality.require_columns(telemetry, META_COLUMNS, "telemetry")
    events = require_valid_events(normalize_events(events))
    normal_train = (F.col("train_test") == "train") & F.col("status_type_id").isin(*settings.normal_status)

    candidates = select.sensor_columns(telemetry.columns)
    telemetry = select.cast_sensors(select.cast_meta(telemetry.select(*META_COLUMNS, *candidates)), candidates)
    quality.require_rows(telemetry.filter(normal_train), "normal rows of the train split")
    sensors = sorted(select.pick_sensors(telemetry.filter(normal_train), candidates, settings.top_sensors))
    # Products may need sensors that are not kept themselves.
    pairs = select.interaction_pairs(select.sensors_by_role(descriptions, candidates), settings.interactions)
    factors = sorted({c for pair in pairs.values() for c in pair} - set(sensors))
    telemetry = telemetry.select(*META_COLUMNS, *sensors, *factors)
    if settings.normal_train_and_test:
        telemetry = select.normal_train_and_test(telemetry, settings.normal_status, settings.test_split)

    kinds = {**select.sensor_kinds(descriptions, sensors), **settings.sensor_kinds}
    rolled = rolling_names(sensors)
    windowed = add_rolling(telemetry, sensors, kinds, settings.roll_by_split, limits)
    windowed = fill_zero(drop_all_null(windowed, rolled), rolled)
    windowed = add_status_history(windowed, settings.downtime_status, settings.derated_status, limits, telemetry)
    # Read three times from here on: for the baselines, for the statistics, and for the result.
    windowed = materialize(select.add_products(windowed, pairs).drop(*factors))

    baseline = sized(scaling.asset_baseline(windowed.filter(normal_train), sensors))
    features = [*sensors, *rolled, *[f"{s}_deviation" for s in sensors], *pairs]
    derived = fill_zero(scaling.add_deviation(windowed, baseline, sensors), features)
    train = (F.col("train_test") == "train") if settings.scale_by_all_train else normal_train
    stats = scaling.scaler_stats(derived.filter(train), features)
    scaled = scaling.standard_scale(derived, stats)

    labelled = labels.add_event_horizon(scaled, events, limits)
    labelled = labels.add_usable_flag(labelled, settings.usable_events)
    labelled = labels.add_downtime_horizon(labelled, events, telemetry, settings.downtime_status, limits)
    labelled = labels.add_fit_mask(labelled, events, settings, limits=limits)
    quality.require_feature_contract(labelled, [*META_COLUMNS, *select.LABEL_COLUMNS, *sensors], sensors)
    return FeatureTable(labelled, stats, sensors)
