"""Non-linear sequence autoencoder: an encoder-decoder over windows, trained by gradient sums from all partitions.

A window goes to a code of a few numbers through a linear map plus a hidden
layer, and back the same way. Training starts from the principal components,
where the hidden layers add nothing, and takes synchronous steps: each is one
Spark job over packs of blocks, whose tasks cut windows as views, and return
loss and gradient sums of the size of the model. The latest fifth of the
windows is not learned from; when its loss has not fallen for ``patience``
steps, the best weights so far are kept. All windows take part in every step,
so weights do not depend on the partitioning but for rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustwatch.operators.autoencoder import SequenceModel, fit_sequence_model
from gustwatch.operators.percentiles import exact_percentiles, percentile_column
from gustwatch.operators.scaling import standard_scale
from gustwatch.operators.sequences import sequence_blocks
from gustwatch.session import materialize, row_by_row
from gustwatch.settings import LIMITS, Limits

_VALUES_AT_ONCE = 1 << 22
#: Partial sums are added up in so many groups before they come to the driver.
_SLOTS = 16


@dataclass(frozen=True)
class Training:
    hidden: int = 64
    steps: int = 120
    patience: int = 10
    rate: float = 0.01
    fit_share: float = 0.8
    seed: int = 7


TRAINING = Training()


@dataclass(frozen=True)
class Weights:
    """Encoder ``x code + tanh(x inner + inner_shift) inner_code``, decoder ``z back + tanh(z outer + outer_shift) outer_back``."""

    code: np.ndarray
    inner: np.ndarray
    inner_shift: np.ndarray
    inner_code: np.ndarray
    back: np.ndarray
    outer: np.ndarray
    outer_shift: np.ndarray
    outer_back: np.ndarray

    @classmethod
    def start(cls, components: np.ndarray, hidden: int, seed: int) -> Weights:
        """The principal components, with hidden layers that add nothing yet."""
        draw = np.random.default_rng(seed)
        width, code = components.shape
        return cls(
            components.copy(),
            draw.normal(size=(width, hidden)) / np.sqrt(width),
            np.zeros(hidden),
            np.zeros((hidden, code)),
            components.T.copy(),
            draw.normal(size=(code, hidden)) / np.sqrt(code),
            draw.normal(size=hidden),
            np.zeros((hidden, width)),
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in vars(self).values()])

    def like(self, flat: np.ndarray) -> Weights:
        out, at = [], 0
        for v in vars(self).values():
            out.append(flat[at : at + v.size].reshape(v.shape))
            at += v.size
        return Weights(*out)

    def rebuilt(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.code + np.tanh(x @ self.inner + self.inner_shift) @ self.inner_code
        return z @ self.back + np.tanh(z @ self.outer + self.outer_shift) @ self.outer_back

    def loss(self, x: np.ndarray) -> float:
        """Sum over windows of the mean squared error."""
        return float(((self.rebuilt(x) - x) ** 2).mean(axis=1).sum())

    def gradient(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """The loss and its derivatives, flat."""
        h = np.tanh(x @ self.inner + self.inner_shift)
        z = x @ self.code + h @ self.inner_code
        g = np.tanh(z @ self.outer + self.outer_shift)
        missed = z @ self.back + g @ self.outer_back - x
        r = 2 * missed / x.shape[1]
        before_g = (r @ self.outer_back.T) * (1 - g * g)
        at_z = r @ self.back.T + before_g @ self.outer.T
        before_h = (at_z @ self.inner_code.T) * (1 - h * h)
        parts = Weights(
            x.T @ at_z, x.T @ before_h, before_h.sum(axis=0), h.T @ at_z, z.T @ r, z.T @ before_g, before_g.sum(axis=0), g.T @ r
        )
        return float((missed**2).mean(axis=1).sum()), parts.flat()


@dataclass(frozen=True)
class NonlinearModel(SequenceModel):
    weights: Weights | None = None
    #: Mean loss of learned and of held windows after each step.
    history: tuple[tuple[float, float], ...] = field(default=())

    def errors(self, windows: np.ndarray) -> np.ndarray:
        x = windows - self.mean
        return ((self.weights.rebuilt(x) - x) ** 2).reshape(len(x), self.length, len(self.features)).mean(axis=1)


#: Rows of a pack, a bounded number of values (8 MB at most, if no block is larger).
_PACK_VALUES = 1 << 20
_PACK = "values binary, learned binary, held binary"


def _packs(width: int, length: int, cut: float) -> Callable:
    """Blocks put together: their rows' values one after the other, and the first rows of the windows to learn from and to hold."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, starts, size = [], ([], []), 0

        def packed() -> pd.DataFrame:
            learned, held = (np.array(s, np.int64).tobytes() for s in starts)
            return pd.DataFrame({"values": [np.concatenate(values).tobytes()], "learned": [learned], "held": [held]})

        for batch in batches:
            for block, windows in zip(batch["values"], batch["windows"], strict=True):
                first = size // width - length + 1
                for w in windows:
                    if w["trainable"]:
                        starts[w["row"]["at"] > cut].append(first + w["at"])
                values.append(np.asarray(block, np.float64))
                size += len(block)
                if size >= _PACK_VALUES:
                    yield packed()
                    values, starts, size = [], ([], []), 0
        if size:
            yield packed()

    return pack


def _windows(row: dict, width: int, length: int, mean: np.ndarray) -> Iterator[tuple[bool, np.ndarray]]:
    """Eligible windows of a pack, less the mean, a bounded number at once; whether they are learned from."""
    views = np.lib.stride_tricks.sliding_window_view(np.frombuffer(row["values"]).reshape(-1, width), length, axis=0)
    at_once = max(1, _VALUES_AT_ONCE // (width * length))
    for learned in (True, False):
        some = np.frombuffer(row["learned" if learned else "held"], np.int64)
        for i in range(0, len(some), at_once):
            yield learned, views[some[i : i + at_once]].transpose(0, 2, 1).reshape(-1, width * length) - mean


_SUMS = "slot int, sums binary"


def _sums(weights: Weights, width: int, length: int, mean: np.ndarray) -> Callable:
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Number and loss of learned windows, the same of held ones, then the gradient.
        sums = np.zeros(4 + weights.flat().size)
        for batch in batches:
            for row in batch.to_dict("records"):
                for learned, x in _windows(row, width, length, mean):
                    if learned:
                        loss, gradient = weights.gradient(x)
                        sums[4:] += gradient
                    else:
                        loss = weights.loss(x)
                    sums[0 if learned else 2] += len(x)
                    sums[1 if learned else 3] += loss
        yield pd.DataFrame({"slot": [TaskContext.get().partitionId() % _SLOTS], "sums": [sums.tobytes()]})

    return add


def _total(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"slot": [int(frame["slot"].iloc[0])], "sums": [np.sum([np.frombuffer(x) for x in frame["sums"]], axis=0).tobytes()]})


def _step(packs: DataFrame, weights: Weights, width: int, length: int, mean: np.ndarray) -> np.ndarray:
    partial = packs.mapInPandas(_sums(weights, width, length, mean), _SUMS)
    added = partial.groupBy("slot").applyInPandas(_total, _SUMS)
    total = np.zeros(4 + weights.flat().size)
    for row in added.toLocalIterator():
        total = total + np.frombuffer(row["sums"])
    return total


def fit_nonlinear_model(
    df: DataFrame,
    features: Sequence[str],
    length: int,
    max_gap_minutes: float | None,
    components: int,
    eligible: str = "if_fit_eligible",
    training: Training = TRAINING,
    stride: int = 1,
    limits: Limits = LIMITS,
) -> NonlinearModel:
    """Fit on windows of eligible rows, learning from the earlier ``fit_share`` of them and stopping by the rest."""
    linear = fit_sequence_model(df, features, length, max_gap_minutes, components, eligible, training.fit_share, stride, limits=limits)
    scaled = standard_scale(df.fillna(0.0, list(features)), linear.stats).withColumn("at", F.unix_micros("time_stamp").cast("double"))
    blocks = materialize(sequence_blocks(scaled, features, length, max_gap_minutes, eligible, stride, ["at"], limits))
    ends = blocks.select(F.explode("windows").alias("w")).filter("w.trainable").select(F.col("w.row.at").alias("at"))
    share = 100 * training.fit_share
    cut = exact_percentiles(ends, "at", [share], limits=limits).first()[percentile_column(share)]
    # Every step reads the windows: as arrays of many blocks, not as rows of nested lists.
    packs = materialize(blocks.select("values", "windows").mapInPandas(_packs(len(features), length, cut), _PACK))

    weights = Weights.start(linear.components, training.hidden, training.seed)
    flat = weights.flat()
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    best, best_loss, since, history = flat, np.inf, 0, []
    for step in range(1, training.steps + 2):
        with row_by_row(df.sparkSession):
            sums = _step(packs, weights.like(flat), len(features), length, linear.mean)
        n, loss, held, held_loss = sums[:4]
        loss, held_loss = loss / n, held_loss / held if held else loss / n
        history.append((loss, held_loss))
        if held_loss < best_loss:
            best, best_loss, since = flat, held_loss, 0
        else:
            since += 1
        if since >= training.patience or step > training.steps:
            break
        slope = sums[4:] / n
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        flat = flat - training.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return NonlinearModel(
        linear.features, length, max_gap_minutes, linear.stats, linear.mean, linear.components, weights.like(best), tuple(history)
    )
