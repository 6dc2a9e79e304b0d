"""Horizon labels, supervised masks and fit masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustwatch.functions.expressions import hours_between, risk_tier, sooner
from gustwatch.operators.asof import NEXT, next_event
from gustwatch.operators.intervals import add_window_flag, first_downtime
from gustwatch.settings import LIMITS, FarmSettings, Limits


USABLE = "is_usable_supervised_next"


def add_usable_flag(rows: DataFrame, usable: Sequence[int] | DataFrame, event: str = "next_anomaly_event_id") -> DataFrame:
    """Whether the next event may be learned from; no next event stays null, an empty list means none.

    ``usable`` is a list of ids, or a table ``(event_id)`` where there are many.
    """
    if isinstance(usable, DataFrame):
        listed = usable.select(F.col("event_id").alias(event)).distinct().withColumn("_listed", F.lit(True))
        flag = F.when(F.col(event).isNotNull(), F.col("_listed").isNotNull())
        return rows.join(listed, event, "left").select(*rows.columns, flag.alias(USABLE))
    return rows.withColumn(USABLE, F.col(event).isin(*usable) if usable else F.lit(False))


def add_event_horizon(rows: DataFrame, events: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Hours to the next anomaly, its id and its risk tier."""
    anomalies = events.filter(F.col("event_label") == "anomaly")
    return (
        next_event(rows, anomalies, limits=limits)
        .withColumn("next_anomaly_event_id", F.col(f"{NEXT}.event_id"))
        .withColumn("hours_to_next_anomaly", hours_between(f"{NEXT}.time", "time_stamp"))
        .drop(NEXT)
        .withColumn("risk_score", risk_tier("hours_to_next_anomaly"))
    )


def add_downtime_horizon(
    rows: DataFrame, events: DataFrame, telemetry: DataFrame, downtime: Sequence[int], limits: Limits = LIMITS
) -> DataFrame:
    """Hours to the next first downtime of an anomaly, and the sooner of both horizons with its tier."""
    anomalies = events.filter(F.col("event_label") == "anomaly")
    stops = first_downtime(telemetry, anomalies, downtime, limits)
    hours = "hours_to_anomaly_linked_downtime"
    warning = "hours_to_next_operator_warning"
    return (
        next_event(rows, stops, event_time="first_downtime", limits=limits)
        .withColumn(hours, hours_between(f"{NEXT}.time", "time_stamp"))
        .drop(NEXT)
        .withColumn("risk_score_anomaly_linked_downtime", risk_tier(hours))
        .withColumn(warning, sooner("hours_to_next_anomaly", hours))
        .withColumn("risk_score_operator_warning", risk_tier(warning))
    )


def add_fit_mask(
    rows: DataFrame,
    events: DataFrame,
    settings: FarmSettings,
    use_split: bool = False,
    limits: Limits = LIMITS,
) -> DataFrame:
    """``in_anomaly_window`` and ``if_fit_eligible``: early, normal rows outside anomaly windows.

    With ``use_split`` the train split decides instead.
    """
    anomalies = events.filter(F.col("event_label") == "anomaly")
    flagged = add_window_flag(rows, anomalies, "in_anomaly_window", limits)
    if use_split:
        return flagged.withColumn("if_fit_eligible", F.col("train_test") == "train")
    early = F.col("time_stamp") < F.to_timestamp(F.lit(settings.fit_cutoff))
    normal = F.col("status_type_id").isin(*settings.normal_status)
    return flagged.withColumn("if_fit_eligible", early & ~F.col("in_anomaly_window") & normal)


def supervised_rows(rows: DataFrame, target: str, normal_status: Sequence[int]) -> DataFrame:
    """Rows to learn the horizon from: known target, usable next event, normal status."""
    return rows.filter(F.col(target).isNotNull() & F.col(USABLE) & F.col("status_type_id").isin(*normal_status))
