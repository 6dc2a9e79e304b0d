"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated by temperature."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustwatch.llm.common import for_python, whole
from gustwatch.session import materialize

_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\x00-\x20\x7f0-9A-Za-z\x80-\xff]+")


@dataclass(frozen=True)
class Settings:
    """``max_fit_rows`` bounds the labelled rows that the model is fitted on, chosen by a hash of their ids."""

    max_fit_rows: int = 6000
    buckets: int = 1 << 14
    width: int = 64
    nonzero: int = 6
    window: int = 2
    hidden: int = 24
    epochs: int = 60
    batch: int = 128
    rate: float = 0.003
    decay: float = 1e-4
    calibration_share: int = 5
    seed: int = 7
    #: Words cached per Python worker.
    cache_words: int = 400_000


SETTINGS = Settings()

#: Numbers of tokens that stand for a shape instead of a word.
_UPPER, _NUMBER, _AGAIN, _RESERVED = 0, 1, 2, 3


class Indexer:
    """Token numbers of a text: words by a hash, capitals and numbers by one number each, plus a mark per immediate repeat."""

    def __init__(self, settings: Settings) -> None:
        self.buckets, self.limit = settings.buckets, settings.cache_words
        self.known: dict[bytes, int] = {}

    def _number(self, token: bytes) -> int:
        if token.isdigit():
            return _NUMBER
        if len(token) > 1 and token.isupper():
            return _UPPER
        return _RESERVED + zlib.crc32(token.lower()) % (self.buckets - _RESERVED)

    def __call__(self, text: str) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        found = _TOKEN.findall(text.encode("utf-8", "surrogatepass"))
        for token in set(found):
            if token not in known:
                known[token] = self._number(token)
        return np.fromiter(map(known.__getitem__, found), np.int32, len(found))


def index_vectors(settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Of every bucket: places of its non-zero entries, and their signs."""
    random = np.random.default_rng(settings.seed)
    places = random.integers(0, settings.width, (settings.buckets, settings.nonzero))
    signs = random.choice(np.array([-1.0, 1.0]), (settings.buckets, settings.nonzero))
    return places, signs


def _context_sums(settings: Settings):
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row: for every bucket the sum of the index vectors of its neighbours in these texts."""
        places, signs = index_vectors(settings)
        indexer, size = Indexer(settings), settings.buckets * settings.width
        total = np.zeros(size)
        for frame in batches:
            for text in frame["text"]:
                numbers = indexer(text)
                for step in range(1, settings.window + 1):
                    left, right = numbers[:-step].astype(np.int64), numbers[step:].astype(np.int64)
                    for a, b in ((left, right), (right, left)):
                        flat = (a[:, None] * settings.width + places[b]).ravel()
                        np.add.at(total, flat, signs[b].ravel())
        yield pd.DataFrame({"sums": [total.astype(np.float32).tobytes()]})

    return sums


def word_vectors(texts: DataFrame, settings: Settings) -> np.ndarray:
    """Random-indexing vectors of all buckets: own index vector plus the normed sum of the neighbours' index vectors.

    ``texts`` is the bounded fit sample. Each of at most four tasks sends one
    matrix of fixed size (buckets x width) to the driver.
    """
    total = np.zeros((settings.buckets, settings.width), np.float64)
    for row in texts.select("text").coalesce(4).mapInPandas(_context_sums(settings), "sums binary").toLocalIterator():
        total += np.frombuffer(row["sums"], np.float32).reshape(total.shape)
    norms = np.linalg.norm(total, axis=1, keepdims=True)
    vectors = np.divide(total, norms, out=np.zeros_like(total), where=norms > 0)
    places, signs = index_vectors(settings)
    np.add.at(vectors, (np.arange(settings.buckets)[:, None], places), signs / np.sqrt(settings.nonzero))
    return vectors.astype(np.float32)


def pooled(text: str, indexer: Indexer, vectors: np.ndarray) -> np.ndarray:
    """Mean of the token vectors; zeros for a text without tokens. Built in slices, so that a long text needs no large array."""
    numbers = indexer(text)
    if not len(numbers):
        return np.zeros(vectors.shape[1])
    repeats = int(np.count_nonzero(numbers[1:] == numbers[:-1]))
    total = vectors[_AGAIN].astype(np.float64) * repeats
    for at in range(0, len(numbers), 4096):
        total += vectors[numbers[at : at + 4096]].sum(axis=0, dtype=np.float64)
    return total / len(numbers)


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((features - self.mean) / self.spread) @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -60, 60)))


def train(features: np.ndarray, labels: np.ndarray, settings: Settings) -> tuple[np.ndarray, ...]:
    """Weights of a tanh layer and a logistic output by Adam on mini-batches."""
    random = np.random.default_rng(settings.seed)
    sizes = (features.shape[1], settings.hidden)
    weights = [random.normal(0, 1 / np.sqrt(sizes[0]), sizes), np.zeros(sizes[1]), random.normal(0, 1 / np.sqrt(sizes[1]), sizes[1]), np.zeros(1)]
    means, squares = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(settings.epochs):
        order = random.permutation(len(features))
        for at in range(0, len(order), settings.batch):
            x, y = features[order[at : at + settings.batch]], labels[order[at : at + settings.batch]]
            hidden = np.tanh(x @ weights[0] + weights[1])
            wrong = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3][0], -60, 60))) - y) / len(y)
            back = np.outer(wrong, weights[2]) * (1 - hidden**2)
            gradients = [x.T @ back, back.sum(axis=0), hidden.T @ wrong, np.array([wrong.sum()])]
            step += 1
            for k, gradient in enumerate(gradients):
                gradient = gradient + settings.decay * weights[k]
                means[k] = 0.9 * means[k] + 0.1 * gradient
                squares[k] = 0.999 * squares[k] + 0.001 * gradient**2
                weights[k] = weights[k] - settings.rate * (means[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.999**step)) + 1e-8)
    return tuple(weights)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows the network was not trained on."""
    if not len(labels):
        return 1.0
    choices = np.exp(np.linspace(np.log(0.25), np.log(8.0), 61))
    losses = [np.mean(np.logaddexp(0, logits / t) - labels * logits / t) for t in choices]
    return float(choices[int(np.argmin(losses))])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> Model | None:
    """Fit on labelled rows: ``labels`` has doc_id and label (0 or 1), one label per id.

    At most ``max_fit_rows`` rows are taken, by a hash of the id, whatever the
    size of the tables; only their ids are broadcast. None when there is no
    row of each label. Nulls in id or label are left out; several labels of
    an id count as their mean, at 0.5 as 1.
    """
    spark = for_python(docs.sparkSession)
    one = (
        labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    )
    # The smallest hashes: a top-k, not a sort of all rows.
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_fit_rows)
    rows = (
        docs.select("doc_id", whole().alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(settings.calibration_share)) == 0)
    )
    sample = materialize(rows)
    vectors = word_vectors(sample, settings)

    @F.pandas_udf("array<float>")
    def pool(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        indexer = Indexer(settings)
        for texts in batches:
            yield pd.Series([pooled(t, indexer, vectors).astype(np.float32).tolist() for t in texts])

    fitted = sample.select("doc_id", "label", "held", pool("text").alias("f")).toPandas()
    # Order must not depend on partitions: training sees rows by id, equal ids by their features.
    fitted = fitted.assign(k=fitted["f"].map(tuple)).sort_values(["doc_id", "k"])
    if fitted["label"].nunique() < 2:
        return None
    features, truth = np.array(fitted["f"].tolist(), np.float64), fitted["label"].to_numpy(np.float64)
    held = fitted["held"].to_numpy(bool)
    if len(np.unique(truth[~held])) < 2:
        held = np.zeros(len(truth), bool)
    mean, spread = features[~held].mean(axis=0), features[~held].std(axis=0) + 1e-6
    first, first_bias, second, second_bias = train((features[~held] - mean) / spread, truth[~held], settings)
    model = Model(vectors, mean, spread, first, first_bias, second, float(second_bias[0]), 1.0)
    model.temperature = temperature(model.logits(features[held]), truth[held])
    return model


def add_score(docs: DataFrame, model: Model | None, settings: Settings = SETTINGS, out: str = "score") -> DataFrame:
    """Add ``out``: the probability of label 1, from the text alone; null and empty texts are scored as texts without words.

    Rows and columns of ``docs`` stay, an equally named column is replaced; a
    map without shuffle. Without a model every score is 0.5. The model has a
    fixed size (buckets x width floats and the network).
    """
    if model is None:
        return docs.withColumn(out, F.lit(0.5))
    spark = for_python(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        indexer, own = Indexer(settings), shared.value
        for texts in batches:
            features = np.array([pooled(t, indexer, own.vectors) for t in texts]).reshape(len(texts), -1)
            yield pd.Series(own.scores(features) if len(texts) else [], dtype="float64")

    return docs.withColumn(out, score(whole()))
