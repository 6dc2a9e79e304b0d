"""Rolling, circular and counter features over the last rows of an asset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from gustwatch.functions.expressions import (
    all_of,
    circular_mean,
    circular_spread,
    counter_increment,
    wrapped_difference,
)
from gustwatch.operators.ordered import Ordered
from gustwatch.settings import LIMITS, ROLLING_ROWS, STD_ROWS, Limits

ORDER = ("time_stamp", "id")
PLAIN, ANGLE, COUNTER = "plain", "angle", "counter"


def last_rows(window: WindowSpec, rows: int) -> WindowSpec:
    """Frame of the current row and the ``rows - 1`` before it."""
    return window.rowsBetween(1 - rows, 0)


def rolling_columns(sensor: str, kind: str, window: WindowSpec) -> list[Column]:
    """The rolling means, spread and step of one sensor; needs ``helper_columns``."""
    if kind == ANGLE:
        def mean_of(part, rows):
            return F.avg(f"{sensor}__{part}").over(last_rows(window, rows))

        means = {
            name: circular_mean(mean_of("sin", rows), mean_of("cos", rows)) for name, rows in ROLLING_ROWS.items()
        }
        spread = circular_spread(mean_of("sin", STD_ROWS), mean_of("cos", STD_ROWS))
        step = wrapped_difference(F.col(sensor), F.lag(sensor).over(window))
    else:
        source = F.col(f"{sensor}__rate") if kind == COUNTER else F.col(sensor)
        means = {name: F.avg(source).over(last_rows(window, rows)) for name, rows in ROLLING_ROWS.items()}
        spread = F.stddev_samp(source).over(last_rows(window, STD_ROWS))
        step = source - F.lag(source).over(window)
    return [
        *[mean.alias(f"{sensor}_roll_mean_{name}") for name, mean in means.items()],
        spread.alias(f"{sensor}_roll_std_{STD_ROWS}"),
        step.alias(f"{sensor}_delta"),
    ]


def helper_columns(sensors: Sequence[str], kinds: Mapping[str, str], window: WindowSpec) -> list[Column]:
    """Sine and cosine of angles, increments of counters."""
    columns = []
    for sensor in sensors:
        kind = kinds.get(sensor, PLAIN)
        if kind == ANGLE:
            radians = F.radians(F.col(sensor))
            columns += [F.sin(radians).alias(f"{sensor}__sin"), F.cos(radians).alias(f"{sensor}__cos")]
        elif kind == COUNTER:
            columns.append(counter_increment(F.col(sensor), window).alias(f"{sensor}__rate"))
    return columns


def rolling_names(sensors: Sequence[str]) -> list[str]:
    suffixes = [f"_roll_mean_{name}" for name in ROLLING_ROWS] + [f"_roll_std_{STD_ROWS}", "_delta"]
    return [sensor + suffix for sensor in sensors for suffix in suffixes]


def add_rolling(
    df: DataFrame,
    sensors: Sequence[str],
    kinds: Mapping[str, str] | None = None,
    by_split: bool = False,
    limits: Limits = LIMITS,
    sensors_per_select: int = 40,
) -> DataFrame:
    """Add five rolling columns per sensor.

    All frames share one exchange and one sort. Sensors go in batches of
    ``sensors_per_select`` to bound the size of one projection; batches have
    the same window and so reuse the partitioning and order.
    """
    kinds = kinds or {}
    farthest = max(ROLLING_ROWS.values())
    by_asset = Ordered.of(df, ["asset_id"], ORDER, limits)

    def prepare(rows: DataFrame, window: WindowSpec) -> DataFrame:
        return rows.select("*", *helper_columns(sensors, kinds, window))

    def roll(rows: DataFrame, window: WindowSpec) -> DataFrame:
        for start in range(0, len(sensors), sensors_per_select):
            batch = sensors[start : start + sensors_per_select]
            rows = rows.select("*", *[c for s in batch for c in rolling_columns(s, kinds.get(s, PLAIN), window)])
        return rows

    if by_split:
        # Counter increments run over the whole asset, frames stay within the split.
        prepared = by_asset.lookback(1, prepare).result()
        by_part = Ordered.of(prepared, ["asset_id", "train_test"], ORDER, limits, measured=df)
        rolled = by_part.lookback(farthest, roll)
    else:
        rolled = by_asset.lookback(farthest, lambda rows, window: roll(prepare(rows, window), window))
    helpers = [c for c in rolled.df.columns if c.endswith(("__sin", "__cos", "__rate"))]
    return rolled.result().drop(*helpers)


def drop_all_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows in which every one of ``columns`` is null."""
    return df.filter(~all_of([F.col(c).isNull() for c in columns]))


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace null and NaN by 0 in numeric ``columns``; text is left alone."""
    return df.fillna(0, subset=list(columns))
