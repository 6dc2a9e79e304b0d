"""Linear sequence autoencoder: principal components of windows, and reconstruction errors of it and of the models built on it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustwatch.operators.ordered import Ordered
from gustwatch.operators.percentiles import exact_percentiles, percentile_column
from gustwatch.operators.scaling import minmax, scaler_stats, standard_scale
from gustwatch.operators.sequences import ORDER, segment_rows
from gustwatch.session import materialize, row_by_row, spread
from gustwatch.settings import LIMITS, Limits

#: Values of the windows that a task holds at once while fitting (32 MB).
_VALUES_AT_ONCE = 1 << 22
#: Partial sums are added up in so many groups before they come to the driver.
_SLOTS = 16
_ROWS_AT_ONCE = 1000


@dataclass(frozen=True)
class SequenceModel:
    features: tuple[str, ...]
    length: int
    max_gap_minutes: float | None
    stats: DataFrame
    mean: np.ndarray
    components: np.ndarray

    def errors(self, windows: np.ndarray) -> np.ndarray:
        """Mean squared error per window and feature."""
        centred = windows - self.mean
        missed = centred - (centred @ self.components) @ self.components.T
        return (missed**2).reshape(len(windows), self.length, len(self.features)).mean(axis=1)


_PACK = "_copied boolean, values binary, starts binary"
_PARTIAL = "slot int, n long, sums binary, products binary"


def _packs(names: Sequence[str], length: int):
    """The rows of each batch behind the ``length - 1`` rows before them, and the first rows of the windows in use."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = np.zeros((length - 1, len(names)))
        for batch in batches:
            values = np.concatenate([before, batch[list(names)].to_numpy(dtype=float)])
            used = np.flatnonzero(batch["_use"].to_numpy(dtype=bool))
            if len(used):
                yield pd.DataFrame({"_copied": [False], "values": [values.tobytes()], "starts": [used.astype(np.int64).tobytes()]})
            before = values[len(values) - length + 1 :]

    return pack


def _packed(rows: Ordered, names: Sequence[str], length: int) -> DataFrame:
    """Windows in use as written arrays, so that no pass has to sort the rows again."""

    def step(part: DataFrame, window) -> DataFrame:
        used = part.withColumn("_use", F.col("_use") & ~F.col("_copied")) if "_copied" in part.columns else part
        arranged = spread(used, *rows.groups).sortWithinPartitions(*rows.groups, *ORDER)
        return arranged.mapInPandas(_packs(names, length), _PACK)

    return materialize(rows.lookback(length, step).df.select("values", "starts"))


def _window_sums(features: int, length: int, mean: np.ndarray | None, basis: np.ndarray | None):
    """Sums over the windows in use: their number, their values, and with ``basis`` covariance times basis."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = length * features
        n, sums = 0, np.zeros(width)
        products = np.zeros((width, 0 if basis is None else basis.shape[1]))
        at_once = max(1, _VALUES_AT_ONCE // width)
        for batch in batches:
            for packed, starts in zip(batch["values"], batch["starts"], strict=True):
                cut = np.lib.stride_tricks.sliding_window_view(np.frombuffer(packed).reshape(-1, features), length, axis=0)
                used = np.frombuffer(starts, np.int64)
                for start in range(0, len(used), at_once):
                    windows = cut[used[start : start + at_once]].transpose(0, 2, 1).reshape(-1, width)
                    n, sums = n + len(windows), sums + windows.sum(axis=0)
                    if basis is not None:
                        centred = windows - mean
                        products += centred.T @ (centred @ basis)
        slot = TaskContext.get().partitionId() % _SLOTS
        yield pd.DataFrame({"slot": [slot], "n": [n], "sums": [sums.tobytes()], "products": [products.tobytes()]})

    return add


def _added(packs: DataFrame, features: int, length: int, mean=None, basis=None) -> tuple[int, np.ndarray, np.ndarray]:
    def total(frame: pd.DataFrame) -> pd.DataFrame:
        parts = {c: np.sum([np.frombuffer(x) for x in frame[c]], axis=0).tobytes() for c in ("sums", "products")}
        return pd.DataFrame({"n": [int(frame["n"].sum())], **{c: [v] for c, v in parts.items()}})

    partial = packs.mapInPandas(_window_sums(features, length, mean, basis), _PARTIAL)
    summed = partial.groupBy("slot").applyInPandas(total, "n long, sums binary, products binary")
    n, sums, products = 0, np.zeros(length * features), 0.0
    with row_by_row(packs.sparkSession):
        for row in summed.toLocalIterator():
            n, sums = n + row["n"], sums + np.frombuffer(row["sums"])
            products = products + np.frombuffer(row["products"]).reshape(length * features, -1)
    return n, sums, products


def fit_sequence_model(
    df: DataFrame,
    features: Sequence[str],
    length: int,
    max_gap_minutes: float | None,
    components: int,
    eligible: str = "if_fit_eligible",
    fit_share: float = 0.8,
    stride: int = 1,
    passes: int = 12,
    limits: Limits = LIMITS,
) -> SequenceModel:
    """Fit on windows of eligible rows only, from the earlier ``fit_share`` of them.

    Features are scaled by the statistics of eligible rows first. Windows are
    cut from sorted rows inside the task, never stored. Components come from
    subspace iteration: a pass over the rows multiplies a thin basis (window
    width x components) by the covariance, so no square matrix of the window's
    width exists anywhere. At most ``passes`` passes; fewer once the basis stands.
    """
    width = length * len(features)
    stats = scaler_stats(df.filter(F.col(eligible)), features)
    scaled = standard_scale(df.fillna(0.0, list(features)), stats)
    segments = segment_rows(scaled, max_gap_minutes, limits)

    def close(rows, window):
        whole = F.min(F.coalesce(F.col(eligible), F.lit(False)).cast("int")).over(window.rowsBetween(1 - length, 0)) == 1
        full = (F.col("segment_row") >= length) & ((F.col("segment_row") - length) % stride == 0)
        return rows.withColumn("_use", whole & full)

    closed = segments.lookback(length, close)
    written = closed.with_rows(materialize(closed.df.select(*closed.groups, *ORDER, "_use", *features)))
    at = F.unix_micros("time_stamp").cast("double")
    last = exact_percentiles(written.df.filter("_use").select(at.alias("_at")), "_at", [100 * fit_share], limits=limits).first()
    if last is None:
        raise ValueError("no window of eligible rows to fit on")
    early = at <= F.lit(last[percentile_column(100 * fit_share)])
    rows = written.with_rows(written.df.withColumn("_use", F.col("_use") & early))
    packs = _packed(rows, features, length)
    n, sums, _ = _added(packs, len(features), length)
    mean = sums / n
    kept = min(components, width)
    # A few columns more than are kept make the iteration settle sooner.
    columns = min(width, kept + 4)
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(width, columns)))[0]
    for _ in range(passes):
        products = _added(packs, len(features), length, mean, basis)[2]
        following = np.linalg.qr(products)[0]
        moved = following - basis @ (basis.T @ following)
        if np.abs(moved).max() < 1e-9 or columns == width:
            break
        basis, products = following, None
    if products is None:
        products = _added(packs, len(features), length, mean, basis)[2]
    values, turned = np.linalg.eigh((basis.T @ products + products.T @ basis) / 2)
    found = basis @ turned[:, np.argsort(-values)[:kept]]
    return SequenceModel(tuple(features), length, max_gap_minutes, stats, mean, found)


def reconstruction_errors(df: DataFrame, model: SequenceModel, limits: Limits = LIMITS) -> DataFrame:
    """Rows without their features but with ``lstm_recon_error``, ``has_window`` and ``errors`` per feature.

    The error of a window goes to its last row; rows that end no window get 0.
    Windows are cut from the sorted rows inside the task, so no row is copied
    once per window it lies in.
    """
    scaled = standard_scale(df.fillna(0.0, list(model.features)), model.stats)
    segments = segment_rows(scaled, model.max_gap_minutes, limits)
    length, names = model.length, list(model.features)
    model_errors = _error_function(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = np.zeros((length - 1, len(names)))
        for batch in batches:
            values = np.concatenate([before, batch[names].to_numpy(dtype=float)])
            errors = np.zeros((len(batch), len(names)))
            whole = batch.segment_row.to_numpy() >= length
            for start in range(0, len(batch), _ROWS_AT_ONCE):
                part = values[start : start + _ROWS_AT_ONCE + length - 1]
                cut = np.lib.stride_tricks.sliding_window_view(part, length, axis=0).transpose(0, 2, 1)
                errors[start : start + _ROWS_AT_ONCE] = model_errors(cut.reshape(len(cut), -1))
            errors[~whole] = 0.0
            before = values[len(values) - length + 1 :]
            yield batch.assign(lstm_recon_error=errors.mean(axis=1), has_window=whole, errors=list(errors))

    def step(rows: DataFrame, window) -> DataFrame:
        # Rows of one group lie together and in order; a full window never reaches beyond its segment.
        arranged = spread(rows, *segments.groups).sortWithinPartitions(*segments.groups, *ORDER)
        schema = T.StructType(
            [
                *rows.schema.fields,
                T.StructField("lstm_recon_error", T.DoubleType()),
                T.StructField("has_window", T.BooleanType()),
                T.StructField("errors", T.ArrayType(T.DoubleType())),
            ]
        )
        return arranged.mapInPandas(score, schema)

    return segments.lookback(length, step).result().drop("segment", "segment_row", *names)


def _error_function(model: SequenceModel):
    """The error computation without the model's Spark table, so that it can be sent to tasks."""
    return replace(model, stats=None).errors


def normalized_errors(scored: DataFrame, eligible: str = "if_fit_eligible") -> DataFrame:
    """``lstm_recon_error_norm``: range of eligible rows, clipped; 0.5 if it has none."""
    return minmax(scored, {"lstm_recon_error": "lstm_recon_error_norm"}, F.col(eligible), flat=0.5)


def error_by_feature(scored: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean reconstruction error per feature over all windows, largest first."""
    per_feature = scored.filter("has_window").select(F.posexplode("errors").alias("place", "error"))
    names = F.array(*[F.lit(c) for c in features])
    means = per_feature.groupBy("place").agg(F.avg("error").alias("mean_recon_mse"))
    return means.select(names[F.col("place")].alias("feature"), "mean_recon_mse").orderBy(F.desc("mean_recon_mse"))
