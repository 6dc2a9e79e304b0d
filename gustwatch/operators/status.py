"""Operating history of an asset: status shares, changes, time since downtime."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustwatch.functions.expressions import epoch_seconds
from gustwatch.operators.ordered import Ordered
from gustwatch.operators.rolling import ORDER
from gustwatch.session import sized
from gustwatch.settings import LIMITS, STATUS_RANGES, Limits

_SEC, _DOWN, _DERATED, _CHANGED = "_sec", "_down", "_derated", "_changed"
_COUNTED = ("7d", "30d")


def add_status_history(
    df: DataFrame,
    downtime: Sequence[int] = (4,),
    derated: Sequence[int] = (1,),
    limits: Limits = LIMITS,
    measured: DataFrame | None = None,
) -> DataFrame:
    """Share of rows in downtime and derated status, status changes, hours since downtime.

    The shares are shares of rows within the last 24 hours, 7 and 30 days.
    ``measured`` is as for ``Ordered.of``.
    """
    flagged = df.select(
        "*",
        epoch_seconds("time_stamp").alias(_SEC),
        F.col("status_type_id").isin(*downtime).cast("int").alias(_DOWN),
        (F.col("status_type_id").isin(*derated).cast("int") if derated else F.lit(0)).alias(_DERATED),
    )
    rows = Ordered.of(flagged, ["asset_id"], ORDER, limits, measured).lookback(
        1,
        lambda part, window: part.withColumn(
            _CHANGED,
            F.coalesce(F.col("status_type_id") != F.lag("status_type_id").over(window), F.lit(False)).cast("int"),
        ),
    )
    rows = rows.running(_last_down=("max", F.when(F.col(_DOWN) == 1, F.col(_SEC))))
    since = (F.col(_SEC) - F.col("_last_down")) / F.lit(3600.0)
    rows = rows.with_rows(rows.df.withColumn("hours_since_last_downtime", since).drop("_last_down"))
    return _range_sums(rows, limits).drop(_SEC, _DOWN, _DERATED, _CHANGED)


def _history_columns(down, derated, changed, count):
    """Output columns from functions giving the sum of a flag and the rows of a range."""
    return [
        *[F.try_divide(down(r), count(r)).alias(f"downtime_frac_{r}") for r in STATUS_RANGES],
        *[F.try_divide(derated(r), count(r)).alias(f"derated_frac_{r}") for r in STATUS_RANGES],
        *[changed(r).cast("double").alias(f"status_change_count_{r}") for r in _COUNTED],
    ]


def _known():
    """1 where the status is known; rows without one count in no share."""
    return F.col("status_type_id").isNotNull().cast("int")


def _measures():
    return {"count": _known(), "down": F.col(_DOWN), "derated": F.col(_DERATED), "changed": F.col(_CHANGED)}


def _range_sums(rows: Ordered, limits: Limits) -> DataFrame:
    """Range sums as differences of running totals: linear in the rows, however many a range holds."""
    return _sums_of_runs(rows, limits) if rows.split else _sums_in_place(rows)


def _sums_in_place(rows: Ordered) -> DataFrame:
    """The total up to a row's second, less the total just before the range.

    Both frames begin with the asset's first row and only grow, so each row is
    added once per frame. Rows stay where the windows before this one left
    them: nothing is moved, joined or derived twice.
    """

    def up_to(end: int):
        return Window.partitionBy(*rows.groups).orderBy(_SEC).rangeBetween(Window.unboundedPreceding, end)

    measures = _measures()
    totals = [F.sum(v).over(up_to(Window.currentRow)).alias(f"_t_{n}") for n, v in measures.items()]
    before = [
        F.coalesce(F.sum(v).over(up_to(-s - 1)), F.lit(0)).alias(f"_b_{n}_{r}") for n, v in measures.items() for r, s in STATUS_RANGES.items()
    ]

    def total(name):
        return lambda r: F.col(f"_t_{name}") - F.col(f"_b_{name}_{r}")

    known = rows.df.filter(F.col("asset_id").isNotNull() & F.col(_SEC).isNotNull())
    return known.select("*", *totals, *before).select(
        *rows.df.columns, *_history_columns(total("down"), total("derated"), total("changed"), total("count"))
    )


def _sums_of_runs(rows: Ordered, limits: Limits) -> DataFrame:
    """The same where a key is too large for one task.

    The total just before a range is looked up as the greatest running total
    at an earlier second: totals of 0/1 flags never fall, so a running maximum
    over points and lookups does it. Both passes are cut into runs again.
    """

    def ordered(df: DataFrame, order: Sequence[str]) -> Ordered:
        return Ordered.of(df, ["asset_id"], order, limits)

    measures = _measures()
    per_second = rows.df.groupBy("asset_id", _SEC).agg(*[F.sum(v).alias(f"s_{n}") for n, v in measures.items()])
    totals = ordered(per_second, [_SEC]).running(
        **{f"t_{n}": ("sum", F.col(f"s_{n}")) for n in measures}
    )
    # Read three times.
    points = sized(totals.result().select("asset_id", _SEC, *[f"t_{n}" for n in measures]))
    lookups = points.select(
        "asset_id",
        F.col(_SEC).alias("_of"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("range"), F.lit(s).alias("secs")) for n, s in STATUS_RANGES.items()])).alias("_r"),
    ).select("asset_id", "_of", F.col("_r.range").alias("_range"), (F.col("_of") - F.col("_r.secs") - 1).alias(_SEC))
    merged = points.withColumn("_kind", F.lit("")).unionByName(
        lookups.withColumn("_kind", F.col("_range")), allowMissingColumns=True
    )
    found = (
        ordered(merged, [_SEC, "_kind"])
        .running(**{f"b_{n}": ("max", F.col(f"t_{n}")) for n in measures})
        .result()
        .filter("_range is not null")
    )
    before = found.groupBy("asset_id", F.col("_of").alias(_SEC)).agg(
        *[
            F.coalesce(F.max(F.when(F.col("_range") == r, F.col(f"b_{n}"))), F.lit(0)).alias(f"b_{n}_{r}")
            for n in measures
            for r in STATUS_RANGES
        ]
    )
    per_range = points.join(before, ["asset_id", _SEC])

    def total(name):
        return lambda r: F.col(f"t_{name}") - F.col(f"b_{name}_{r}")

    history = per_range.select(
        "asset_id", _SEC, *_history_columns(total("down"), total("derated"), total("changed"), total("count"))
    )
    wanted = [c for c in rows.df.columns if c != "_run"]
    return rows.df.select(*wanted).join(history, ["asset_id", _SEC])
