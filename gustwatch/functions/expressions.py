"""Column expressions for tiers, angles, counters and rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from gustwatch.settings import (
    DEFAULT_STATUS_THRESHOLD,
    PROBABILITY_TIERS,
    RISK_TIERS,
    STATUS_THRESHOLDS,
    URGENCY_HOURS,
)


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text_to_bigint(text: str | Column) -> Column:
    """Whole number in a text, else null; the pattern spares the failed cast, which is slow."""
    value = as_column(text).cast("string")
    return F.when(value.rlike(r"^\s*[+-]?[0-9]+\s*$"), value.try_cast("bigint"))


def text_to_double(text: str | Column) -> Column:
    """Number in a text, else null; text that cannot begin a number is not tried."""
    value = as_column(text).cast("string")
    return F.when(value.rlike(r"^\s*[-+.0-9nNiI]"), value.try_cast("double"))


def epoch_seconds(time: str | Column) -> Column:
    return F.unix_timestamp(as_column(time))


def hours_between(later: str | Column, earlier: str | Column) -> Column:
    return (epoch_seconds(later) - epoch_seconds(earlier)) / F.lit(3600.0)


def _steps(value: Column, steps, compare, default: Column) -> Column:
    (bound, result), *rest = steps
    chain = F.when(compare(value, bound), F.lit(result))
    for bound, result in rest:
        chain = chain.when(compare(value, bound), F.lit(result))
    return chain.otherwise(default)


def risk_tier(hours: str | Column) -> Column:
    """Risk of an event this many hours ahead; null or far away is 0."""
    return _steps(as_column(hours), RISK_TIERS, lambda v, b: v <= b, F.lit(0.0))


def probability_tier(probability: str | Column) -> Column:
    """Text tier of a probability; null stays null."""
    p = as_column(probability)
    return F.when(p > -0.01, _steps(p, PROBABILITY_TIERS, lambda v, b: v <= b, F.lit(None).cast("string")))


def urgency(hours: str | Column) -> Column:
    """Urgency of an alert; an unknown horizon is MONITOR."""
    return _steps(F.coalesce(as_column(hours), F.lit(999.0)), URGENCY_HOURS, lambda v, b: v < b, F.lit("MONITOR"))


def status_threshold(status: str | Column) -> Column:
    """Alert threshold by operating status; other or unreadable codes count as normal."""
    code = F.coalesce(as_column(status).cast("string").try_cast("int"), F.lit(0))
    by_code = F.create_map(*[F.lit(x) for item in STATUS_THRESHOLDS.items() for x in item])
    return F.coalesce(F.try_element_at(by_code, code), F.lit(DEFAULT_STATUS_THRESHOLD))


def sooner(first: str | Column, second: str | Column) -> Column:
    """The smaller of two horizons, ignoring a missing one."""
    return F.least(as_column(first), as_column(second))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where the whole is empty."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    weight = beta * beta
    return ratio((1.0 + weight) * precision * recall, weight * precision + recall)


def rounded(value: str | Column, places: int = 6) -> Column:
    """Rounded for comparison; adding 0.0 turns a negative zero into zero."""
    return F.round(as_column(value), places) + F.lit(0.0)


def circular_mean(sin: Column, cos: Column) -> Column:
    return F.degrees(F.atan2(sin, cos))


def circular_spread(sin: Column, cos: Column) -> Column:
    """Circular standard deviation in degrees from mean sine and cosine."""
    length = F.sqrt(sin * sin + cos * cos)
    tiny = F.lit(1e-12)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.lit(-2.0) * F.log(F.greatest(tiny, length))))
    return F.when(length <= tiny, F.lit(0.0)).otherwise(F.degrees(spread))


def wrapped_difference(angle: Column, before: Column) -> Column:
    """Turn from ``before`` to ``angle`` the short way round, within 180 degrees."""
    turn = angle - before
    return F.when(turn > 180, turn - 360).when(turn < -180, turn + 360).otherwise(turn)


def counter_increment(counter: Column, window: WindowSpec) -> Column:
    """Growth of a counter since the row before; the first row and a reset count 0."""
    before = F.lag(counter).over(window)
    return F.when(before.isNull() | (counter < before), F.lit(0.0)).otherwise(counter - before)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def one_row_per_column(wide: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Turn a single row of struct columns into rows ``(name, fields of the struct)``."""
    entries = [F.struct(F.lit(c).alias(name), F.col(c).alias("_s")) for c in columns]
    return wide.select(F.explode(F.array(*entries)).alias("_r")).select(f"_r.{name}", "_r._s.*")


def above(score: str | Column, threshold) -> Column:
    """Whether a score is strictly above a threshold; never for null or NaN, which Spark orders above all numbers."""
    value = (F.col(score) if isinstance(score, str) else score).cast("double")
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.coalesce(~F.isnan(value) & (value > limit), F.lit(False))
