"""Gap segments and sliding windows of consecutive rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustwatch.functions.expressions import epoch_seconds
from gustwatch.operators.ordered import Ordered
from gustwatch.settings import LIMITS, Limits

ORDER = ["time_stamp", "id"]


def segment_rows(df: DataFrame, max_gap_minutes: float | None, limits: Limits) -> Ordered:
    """Rows with ``segment`` (1, 2, ... per asset) and ``segment_row`` (1, 2, ... per segment)."""
    rows = Ordered.of(df, ["asset_id"], ORDER, limits)

    def opening(part, window):
        gap = epoch_seconds("time_stamp") - F.lag(epoch_seconds("time_stamp")).over(window)
        # Without a limit only the first row of the asset opens a segment.
        opens = gap.isNull() if max_gap_minutes is None else gap.isNull() | (gap > max_gap_minutes * 60)
        return part.withColumn("_opens", opens.cast("int"))

    counted = rows.lookback(1, opening).running(segment=("sum", F.col("_opens")), _nth=("sum", F.lit(1)))
    placed = counted.running(_start=("max", F.when(F.col("_opens") == 1, F.col("_nth"))))
    return placed.with_rows(
        placed.df.withColumn("segment_row", F.col("_nth") - F.col("_start") + 1).drop("_opens", "_nth", "_start")
    )


def gap_segments(df: DataFrame, max_gap_minutes: float | None, limits: Limits = LIMITS) -> DataFrame:
    """Rows numbered by segment; a gap above the limit starts a new one, None never does."""
    return segment_rows(df, max_gap_minutes, limits).result()


def sequence_windows(
    df: DataFrame,
    length: int,
    max_gap_minutes: float | None,
    eligible: str = "if_fit_eligible",
    stride: int = 1,
    limits: Limits = LIMITS,
) -> DataFrame:
    """Windows of ``length`` consecutive rows inside a segment, each shown by its last row.

    ``trainable`` tells whether all rows of the window are eligible.
    """
    closed = _closed(df, length, max_gap_minutes, eligible, limits)
    full = (F.col("segment_row") >= length) & ((F.col("segment_row") - length) % stride == 0)
    return closed.filter(full).withColumn("trainable", F.col("_all") == 1).drop("_all")


#: Rows of a block, in window lengths: a block repeats one length of rows of the block before it.
BLOCK_LENGTHS = 8
BLOCK = ("asset_id", "segment", "block")


def numbers(features: Sequence[str]) -> Column:
    """The features as one array; null and NaN count 0."""
    return F.array(*[F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features])


def sequence_blocks(
    df: DataFrame,
    features: Sequence[str],
    length: int,
    max_gap_minutes: float | None,
    eligible: str = "if_fit_eligible",
    stride: int = 1,
    keep: Sequence[str] = ORDER,
    limits: Limits = LIMITS,
) -> DataFrame:
    """Windows stored as blocks of consecutive rows instead of one copy of the rows per window.

    A row per block of a segment: ``values``, the features of its rows, row
    after row, null as 0, and ``windows``, an entry per window that ends in the
    block: ``at``, the place of its last row in ``values``, ``trainable``,
    whether all its rows are eligible, and ``row``, the ``keep`` columns of its
    last row. A block begins with the ``length - 1`` rows before it, so that
    no window reaches beyond it, and holds ``BLOCK_LENGTHS * length`` rows of
    its own: an eighth more than the rows themselves, whatever the length.
    """
    step = BLOCK_LENGTHS * length
    place, own = F.col("segment_row") - 1, F.floor((F.col("segment_row") - 1) / step)
    # The last rows of a block also open the next one.
    shared = place % step > step - length
    rows = _closed(df, length, max_gap_minutes, eligible, limits).select(
        "asset_id",
        "segment",
        F.explode(F.when(shared, F.array(own, own + 1)).otherwise(F.array(own))).alias("block"),
        F.struct(
            place.alias("place"),
            own.alias("own"),
            numbers(features).alias("values"),
            (F.col("_all") == 1).alias("trainable"),
            F.struct(*keep).alias("row"),
        ).alias("r"),
    )
    gathered = rows.groupBy(*BLOCK).agg(F.sort_array(F.collect_list("r")).alias("r"))
    ends = F.transform("r", lambda r, i: F.struct(i.alias("at"), r["trainable"].alias("trainable"), r["row"].alias("row"), r["own"].alias("own"), r["place"].alias("place")))
    closing = F.filter(
        ends, lambda e: (e["own"] == F.col("block")) & (e["place"] >= length - 1) & ((e["place"] - (length - 1)) % stride == 0)
    )
    windows = F.transform(closing, lambda e: F.struct(e["at"].alias("at"), e["trainable"].alias("trainable"), e["row"].alias("row")))
    blocks = gathered.select(*BLOCK, F.flatten("r.values").alias("values"), windows.alias("windows"))
    return blocks.filter(F.size("windows") > 0)


def expand_blocks(blocks: DataFrame, width: int, length: int) -> DataFrame:
    """A row per window of ``sequence_blocks`` with ``width`` features: its last row's columns, ``trainable`` and ``payload``."""
    windows = blocks.select(*BLOCK, "values", F.explode("windows").alias("w"))
    payload = F.slice("values", (F.col("w.at") + 1 - length) * width + 1, F.lit(length * width))
    return windows.select("segment", "w.row.*", "w.trainable", payload.alias("payload"))


def sequence_payload(
    df: DataFrame,
    features: Sequence[str],
    length: int,
    max_gap_minutes: float | None,
    eligible: str = "if_fit_eligible",
    stride: int = 1,
    limits: Limits = LIMITS,
) -> DataFrame:
    """``sequence_windows`` with column ``payload``: the window's features, row after row, null as 0.

    Expanded from blocks; what can cut windows itself should read the blocks.
    """
    blocks = sequence_blocks(df, features, length, max_gap_minutes, eligible, stride, [*df.columns, "segment_row"], limits)
    return expand_blocks(blocks, len(features), length)


def _closed(df: DataFrame, length: int, max_gap_minutes: float | None, eligible: str, limits: Limits) -> DataFrame:
    """Rows by segment, with ``_all``: 1 where the last ``length`` rows are all eligible."""
    segments = segment_rows(df, max_gap_minutes, limits)

    def close(rows, window):
        frame = window.rowsBetween(1 - length, 0)
        return rows.withColumn("_all", F.min(F.coalesce(F.col(eligible), F.lit(False)).cast("int")).over(frame))

    return segments.lookback(length, close).result()


def window_statistics(
    df: DataFrame, length: int, max_gap_minutes: float, eligible: str = "if_fit_eligible", limits: Limits = LIMITS
) -> DataFrame:
    """Per asset: scored, trainable and ineligible windows, and segments too short for one."""
    rows = _closed(df, length, max_gap_minutes, eligible, limits)
    full = F.col("segment_row") >= length
    return rows.groupBy("asset_id").agg(
        F.count_if(full).alias("scored"),
        F.count_if(full & (F.col("_all") == 1)).alias("trainable"),
        F.count_if(full & (F.col("_all") == 0)).alias("skipped_ineligible"),
        # A segment is long enough exactly if it has a row number `length`.
        (F.count_if(F.col("segment_row") == 1) - F.count_if(F.col("segment_row") == length)).alias("too_short"),
    )
