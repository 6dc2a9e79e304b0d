"""Checks and profiles of input and output tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustwatch.functions.expressions import one_row_per_column
from gustwatch.settings import FEATURE_SUFFIXES


def require_columns(df: DataFrame, columns: Iterable[str], name: str = "table") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks columns {missing}")
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df


def require_feature_contract(df: DataFrame, base: Iterable[str], sensors: Iterable[str]) -> DataFrame:
    """The feature table has its base columns and every derived column of every sensor."""
    derived = [sensor + suffix for sensor in sensors for suffix in FEATURE_SUFFIXES]
    return require_columns(df, [*base, *derived], "feature table")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows ``(column_name, nulls)`` from one aggregate over all columns."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], list(columns), "column_name", "nulls")


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(*columns)


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts of ``row`` by ``column``, one output column per value, 0 where empty."""
    return df.groupBy(row).pivot(column, list(values)).count().fillna(0)


def time_range(df: DataFrame, by: str, time: str = "time_stamp") -> DataFrame:
    return df.groupBy(by).agg(
        F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count(F.lit(1)).alias("n")
    )


def key_counts(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys and assets: group first, so that copies collapse before the count."""
    keys = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.countDistinct("asset_id").alias("distinct_assets"),
    )


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def require_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    if not duplicate_keys(df, key).isEmpty():
        raise ValueError(f"duplicate keys {tuple(key)}")
    return df


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation and range, one row per column."""
    stats = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    one = df.agg(*[F.struct(*[f(c).cast("double").alias(s) for s, f in stats.items()]).alias(c) for c in columns])
    return one_row_per_column(one, list(columns), "column_name")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
