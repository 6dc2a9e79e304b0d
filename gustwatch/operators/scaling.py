"""Baselines, standard scaling and min-max normalization."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustwatch.functions.expressions import one_row_per_column


def asset_baseline(normal_train: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Mean of each sensor per asset."""
    return normal_train.groupBy("asset_id").agg(*[F.avg(c).alias(f"{c}_baseline") for c in sensors])


def add_deviation(df: DataFrame, baseline: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Each sensor minus its asset's baseline; the baseline has one row per asset."""
    joined = df.join(baseline, "asset_id", "left")
    return joined.select(
        *df.columns, *[(F.col(c) - F.col(f"{c}_baseline")).alias(f"{c}_deviation") for c in sensors]
    )


def scaler_stats(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows ``(feature, mean, std)`` with the population deviation, from one aggregate."""
    one = train.agg(
        *[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns]
    )
    return one_row_per_column(one, list(columns), "feature")


def standard_scale(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Scale the columns named in ``stats`` (one row per column) to mean 0 and deviation 1.

    A missing mean counts 0, a missing or zero deviation 1.
    """
    known = {r.feature: (r.mean or 0.0, r.std or 1.0) for r in stats.collect()}

    def scaled(name: str) -> Column:
        mean, std = known[name]
        return ((F.col(name) - F.lit(mean)) / F.lit(std)).alias(name)

    return df.select(*[scaled(c) if c in known else F.col(c) for c in df.columns])


def bounds(df: DataFrame, columns: Sequence[str], mask: Column) -> dict[str, tuple[float, float]]:
    """Minimum and maximum of each column over the masked rows, in one pass."""
    row = df.filter(mask).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns}


def minmax(
    df: DataFrame,
    columns: Mapping[str, str],
    mask: Column,
    clip: bool = True,
    flat: float | None = None,
) -> DataFrame:
    """Add normalized columns ``{input: output}``, with the range taken from the masked rows.

    A column without range gets ``flat``, or is divided by 1 when ``flat`` is None.
    """
    limits = bounds(df, list(columns), mask)
    if any(lo is None for lo, _ in limits.values()):
        raise ValueError("no rows to take the range from")

    def scaled(name: str) -> Column:
        lo, hi = limits[name]
        if hi <= lo and flat is not None:
            return F.lit(float(flat))
        value = (F.col(name) - F.lit(lo)) / F.lit((hi - lo) if hi > lo else 1.0)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) if clip else value

    return df.select("*", *[scaled(c).alias(out) for c, out in columns.items()])


def minmax_inverted(df: DataFrame, hours: str, output: str) -> DataFrame:
    """1 for the smallest horizon, 0 for the largest; 0.5 if all are equal, 0 if none is usable."""
    value = F.col(hours).cast("double")
    lo, hi = df.filter(~F.isnan(value) & (value >= 0) & (value < float("inf"))).agg(F.min(value), F.max(value)).first()
    if lo is None:
        return df.withColumn(output, F.lit(0.0))
    if hi <= lo:
        return df.withColumn(output, F.lit(0.5))
    clipped = F.when(value.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), value)))
    return df.withColumn(output, F.lit(1.0) - (clipped - F.lit(lo)) / F.lit(hi - lo))
