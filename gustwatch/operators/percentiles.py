"""Exact percentiles with linear interpolation, per group or over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustwatch.session import materialize
from gustwatch.settings import LIMITS, Limits


def percentile_column(percent: float) -> str:
    return f"p{percent:g}".replace(".", "_")


def exact_percentiles(
    df: DataFrame,
    column: str,
    percents: Sequence[float],
    by: Sequence[str] = (),
    limits: Limits = LIMITS,
) -> DataFrame:
    """One row per group with a column ``p<percent>`` for each percent.

    The built-in aggregate keeps all distinct values of a group in one task.
    Where a group has more than ``Limits.task_rows`` rows, the two values
    around each position are found by their bits instead, see
    :func:`values_at`.
    """
    known = df.filter(F.col(column).isNotNull() & ~F.isnan(column)).select(*by, F.col(column).cast("double").alias("_value"))
    sizes = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    heaviest = sizes.agg(F.max("_n")).first()[0] or 0
    if heaviest > limits.task_rows:
        return _by_bits(known, sizes, percents, by)
    shares = F.array(*[F.lit(p / 100.0) for p in percents])
    grouped = known.groupBy(*by).agg(F.percentile("_value", shares).alias("_p"))
    return grouped.select(*by, *[F.col("_p")[i].alias(percentile_column(p)) for i, p in enumerate(percents)])


def _by_bits(known: DataFrame, sizes: DataFrame, percents: Sequence[float], by: Sequence[str]) -> DataFrame:
    def position(p):
        return (F.col("_n") - 1) * F.lit(p / 100.0)

    ranks = [f(position(p)).cast("long") for p in percents for f in (F.floor, F.ceil)]
    wanted = sizes.select(*by, F.explode(F.array_distinct(F.array(*ranks))).alias("_rank"))
    found = values_at(known, "_value", wanted, by)
    pairs = found.groupBy("_group").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_found"))).alias("_at"))
    both = sizes.withColumn("_group", _group(by)).join(pairs, "_group")

    def between(p):
        low, high = (F.col("_at")[f(position(p)).cast("long")] for f in (F.floor, F.ceil))
        return low + (high - low) * (position(p) - F.floor(position(p)))

    return both.select(*by, *[between(p).alias(percentile_column(p)) for p in percents])


def _group(by: Sequence[str]) -> Column:
    """The group as one value, in which nulls equal each other."""
    return F.struct(*by) if by else F.lit(0)


_MANTISSA = 52
_LOWEST = -1022
#: Bits that one pass settles: at most so many counts per group and wanted rank, 2 ** DIGIT.
DIGIT = 13


def ordered_bits(value: Column) -> Column:
    """A whole number per double that is ordered as the doubles are: exponent and mantissa, negated for negative values."""
    size = F.abs(value)
    guess = F.floor(F.log2(size)).cast("int")
    # The logarithm may be rounded over a power of two.
    low = F.pow(F.lit(2.0), guess)
    exponent = F.greatest(F.when(size < low, guess - 1).when(size / low >= 2.0, guess + 1).otherwise(guess), F.lit(_LOWEST))
    normal = size >= F.lit(2.0**_LOWEST)
    fraction = F.when(normal, size / F.pow(F.lit(2.0), exponent) - 1.0).otherwise(size * F.lit(2.0**-_LOWEST))
    steps = (fraction * F.lit(2.0**_MANTISSA)).cast("long")
    head = F.when(normal, (exponent - _LOWEST + 1).cast("long")).otherwise(F.lit(0).cast("long"))
    whole = (
        F.when(size == 0, F.lit(0).cast("long"))
        .when(size == float("inf"), F.lit((2 * -_LOWEST + 3) << _MANTISSA).cast("long"))
        .otherwise(head * F.lit(1 << _MANTISSA) + steps)
    )
    return F.when(value < 0, -whole).otherwise(whole)


def from_bits(bits: Column) -> Column:
    """The double of :func:`ordered_bits`."""
    size = F.abs(bits)
    head = F.shiftright(size, _MANTISSA)
    steps = size.bitwiseAND(F.lit((1 << _MANTISSA) - 1)).cast("double")
    normal = (steps / F.lit(2.0**_MANTISSA) + 1.0) * F.pow(F.lit(2.0), (head - 1 + _LOWEST).cast("double"))
    small = steps * F.lit(2.0**-_MANTISSA) * F.lit(2.0**_LOWEST)
    whole = F.when(head == 2 * -_LOWEST + 3, F.lit(float("inf"))).when(head == 0, small).otherwise(normal)
    return F.when(bits < 0, -whole).otherwise(whole)


def values_at(known: DataFrame, column: str, wanted: DataFrame, by: Sequence[str]) -> DataFrame:
    """``_group``, ``_rank`` and ``_found``, the value of that rank in its group, for each row of ``wanted`` (by..., ``_rank`` from 0).

    The ordered bits of the values are settled from the highest down, a few
    passes of :data:`DIGIT` bits: a pass counts the rows under each prefix that
    a rank lies in by their next bits. Nothing is sorted and no values are
    gathered: what a task holds are counts, whose number does not depend on
    the rows or on how many values differ.
    """
    names = ["_group"]
    rows = materialize(known.select(_group(by).alias("_group"), ordered_bits(F.col(column)).alias("_bits")))
    state = wanted.select(_group(by).alias("_group"), F.col("_rank"), F.lit(0).cast("long").alias("_prefix"), F.col("_rank").alias("_left"))
    # Arithmetic shifts: the first prefix is -1 or 0, both under one start.
    left = 64
    while left:
        width = min(DIGIT, left)
        first, left = left == 64, left - width
        under = F.lit(0).cast("long") if first else F.shiftright("_bits", left + width)
        digits = rows.select(*names, under.alias("_prefix"), F.shiftright("_bits", left).alias("_next"))
        if not first:
            digits = digits.join(state.select(*names, "_prefix").distinct(), [*names, "_prefix"])
        counts = digits.groupBy(*names, "_prefix", "_next").agg(F.count(F.lit(1)).alias("_c"))
        upto = Window.partitionBy(*names, "_prefix").orderBy("_next").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = counts.withColumn("_upto", F.sum("_c").over(upto))
        held = state.join(placed, [*names, "_prefix"]).filter((F.col("_left") < F.col("_upto")) & (F.col("_left") >= F.col("_upto") - F.col("_c")))
        # Written, so that the planner knows how small it is.
        state = materialize(
            held.select(*names, "_rank", F.col("_next").alias("_prefix"), (F.col("_left") - F.col("_upto") + F.col("_c")).alias("_left"))
        )
    return state.select("_group", "_rank", from_bits(F.col("_prefix")).alias("_found"))
