"""Ordered operations per key that stay balanced when one key is hot.

A window partitioned by asset puts all rows of an asset into one task. That is
the cheapest plan while every asset is small, so it is used as long as a count
per key shows no asset above ``Limits.task_rows``. Beyond that the order of the
hot keys, and of these alone, is cut at bounds taken from a counted sample of
their rows: a *run* is what lies between two bounds. A row's run follows from
the row and the small table of bounds, so rows are still hash-partitioned, by
key and run: cold keys have one run and stay as they were, no range exchange
is needed, and nothing is written. Two things then carry over from earlier
runs of a hot key:

* row frames need the last ``n`` rows before the run: copied in by ``lookback``;
* running aggregates need the aggregate of all earlier runs of the key: one
  number per run, added by ``running``.

Both are exact. The order must be unique within a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustwatch.session import sized
from gustwatch.settings import LIMITS, Limits

RUN = "_run"
_COPY = "_copied"

_COMBINE = {
    # Null only as long as no value was seen in any run.
    "sum": lambda carry, local: F.coalesce(carry + local, carry, local),
    "max": F.greatest,
    "min": F.least,
}
_AGGREGATE = {"sum": F.sum, "max": F.max, "min": F.min}


class Ordered:
    """Rows with an order per key; ``split`` tells whether keys are cut into runs."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], split: bool):
        self.df = df
        self.keys = list(keys)
        self.order = list(order)
        self.split = split

    @classmethod
    def of(
        cls,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        limits: Limits = LIMITS,
        measured: DataFrame | None = None,
    ) -> Ordered:
        """Order ``df``, cutting hot keys.

        ``measured`` is a table with at least the rows of ``df`` per key that is
        cheaper to count, such as the input ``df`` was derived from.
        """
        per_key = (df if measured is None else measured).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        heaviest = per_key.agg(F.max("n")).first()[0]
        plain = cls(df, keys, order, split=False)
        if (heaviest or 0) <= limits.task_rows:
            return plain
        return cls(_with_runs(df, keys, order, per_key.filter(F.col("n") > limits.task_rows), limits), keys, order, split=True)

    @property
    def groups(self) -> list[str]:
        return self.keys + [RUN] if self.split else self.keys

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.groups).orderBy(*map(_direction, self.order))

    def with_rows(self, df: DataFrame) -> Ordered:
        """The same ordering over rows derived from this one's rows."""
        return Ordered(df, self.keys, self.order, self.split)

    def result(self) -> DataFrame:
        return self.df.drop(RUN)

    # -- row frames ---------------------------------------------------------

    def lookback(self, rows: int, step: Callable[[DataFrame, WindowSpec], DataFrame]) -> Ordered:
        """Apply ``step(df, window)``, whose results reach at most ``rows`` rows back."""
        if not self.split:
            return self.with_rows(step(self.df, self.window))
        widened = self.df.withColumn(_COPY, F.lit(False)).unionByName(self._copies(rows))
        return self.with_rows(step(widened, self.window).filter(~F.col(_COPY)).drop(_COPY))

    def _copies(self, rows: int) -> DataFrame:
        """The last ``rows`` rows before each run, labelled with that run."""
        sizes = self.df.groupBy(*self.groups).agg(F.count(F.lit(1)).alias("n"))
        in_key = Window.partitionBy(*self.keys).orderBy(RUN)
        sizes = sizes.withColumn("end", F.sum("n").over(in_key))
        # A run holds a row at least, so no run further than `rows` runs ahead can need this one.
        ahead = F.collect_list(F.struct(F.col(RUN).alias("run"), (F.col("end") - F.col("n")).alias("start")))
        targets = sizes.withColumn("ahead", ahead.over(in_key.rowsBetween(1, rows))).select(
            *self.groups,
            F.expr(f"filter(ahead, a -> a.start - end < {rows})").alias("_ahead"),
            F.col("end").alias("_end"),
        )
        # One row per run that some later run of the same key still needs; runs grow with the rows, so the planner sees the size.
        targets = sized(targets.filter(F.size("_ahead") > 0))
        backwards = Window.partitionBy(*self.groups).orderBy(*[_direction(o, reverse=True) for o in self.order])
        tail = (
            self.df.join(targets, self.groups)
            .withColumn("_back", F.row_number().over(backwards))
            .filter(F.col("_back") <= rows)
        )
        copies = tail.withColumn(
            "_to", F.explode(F.expr(f"filter(_ahead, a -> _back + a.start - _end <= {rows})"))
        )
        return copies.select(
            *[c for c in self.df.columns if c != RUN],
            F.col("_to.run").alias(RUN),
            F.lit(True).alias(_COPY),
        )

    # -- running aggregates -------------------------------------------------

    def running(self, **columns: tuple[str, Column]) -> Ordered:
        """Add running ``sum``/``max``/``min`` columns from the key's first row to the current one."""
        frame = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = {name: _AGGREGATE[kind](value).over(frame) for name, (kind, value) in columns.items()}
        if not self.split:
            return self.with_rows(self.df.select("*", *[v.alias(n) for n, v in local.items()]))
        per_run = self.df.groupBy(*self.groups).agg(
            *[_AGGREGATE[kind](value).alias(f"_c_{name}") for name, (kind, value) in columns.items()]
        )
        in_key = Window.partitionBy(*self.keys).orderBy(RUN)
        before = in_key.rowsBetween(Window.unboundedPreceding, -1)
        carry = (
            per_run.select(
                *self.groups,
                F.row_number().over(in_key).alias("_nth"),
                *[_AGGREGATE[kind](f"_c_{name}").over(before).alias(f"_c_{name}") for name, (kind, _) in columns.items()],
            )
            .filter("_nth > 1")
            .drop("_nth")
        )
        # At most one key continues into each run, so the carry has no more rows than there are runs; written, so that the
        # planner broadcasts it only while it is small.
        joined = self.df.select("*", *[v.alias(n) for n, v in local.items()]).join(sized(carry), self.groups, "left")
        combined = {
            name: _COMBINE[kind](F.col(f"_c_{name}"), F.col(name)) for name, (kind, _) in columns.items()
        }
        return self.with_rows(
            joined.select(
                *self.df.columns,
                *[value.alias(name) for name, value in combined.items()],
            )
        )


#: Sampled rows per run that its bounds are taken from.
_SAMPLED = 50


def _rising(df: DataFrame, order: Sequence[str]) -> Column:
    """The order as one struct in which earlier rows are smaller; it ends before the first item that cannot be negated."""
    items = []
    for k, o in enumerate(order):
        column, kind = F.col(o.lstrip("-")), df.schema[o.lstrip("-")].dataType
        if o.startswith("-"):
            if isinstance(kind, T.TimestampType):
                column = F.unix_micros(column)
            elif not isinstance(kind, T.NumericType):
                break
            column = -column
        items.append(column.alias(f"o{k}"))
    return F.struct(*items)


def _with_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: DataFrame, limits: Limits) -> DataFrame:
    """``df`` with ``RUN``: 0 for keys that are not ``hot``, else the number of bounds of the key up to the row."""
    rising = _rising(df, order)
    of_hot = [F.col(k).alias(f"_h_{k}") for k in keys]
    # Runs of half the rows that a task may have, so that an uneven sample does no harm.
    sizes = sized(hot.select(*of_hot, F.ceil(2 * F.col("n") / limits.task_rows).alias("_runs"), F.col("n").alias("_n")))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys], F.lit(True))
    names = [f"_h_{k}" for k in keys]
    one_in = F.greatest(F.floor(F.col("_n") / (F.col("_runs") * _SAMPLED)), F.lit(1))
    sample = df.select(*keys, rising.alias("_o")).join(sizes, same).filter(F.pmod(F.xxhash64("_o"), one_in) == 0)
    taken = sample.groupBy(*names).agg(F.sort_array(F.collect_list("_o")).alias("_s"), F.first("_runs").alias("_runs"))
    every = F.greatest(F.floor(F.size("_s") / F.col("_runs")).cast("int"), F.lit(1))
    bounds = taken.select(*names, F.filter("_s", lambda x, i: (i > 0) & (i % every == 0)).alias("_bounds"))
    # One row per hot key; written, so that the planner knows how small it is and the bounds stay the same.
    marked = df.withColumn("_o", rising).join(sized(bounds), same, "left")
    run = F.coalesce(F.size(F.filter("_bounds", lambda x: x <= F.col("_o"))), F.lit(0))
    return marked.withColumn(RUN, F.greatest(run, F.lit(0))).drop(*names, "_bounds", "_o")


def _direction(order: str, reverse: bool = False) -> Column:
    """Sort column of an order item; a leading minus means descending."""
    descending = order.startswith("-") != reverse
    column = F.col(order.lstrip("-"))
    return column.desc() if descending else column.asc()
