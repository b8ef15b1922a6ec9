"""Quality: a factorisation machine over hashed words, structure statistics and lengths.

score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j); the pair term is half of the sum over factors
of (sum v_if x_i)^2 - sum (v_if x_i)^2, linear in the number of features.  Features: distinct words hashed into 2^13
buckets (as a unit vector), statistics of the text's structure, and its lengths as metadata; lang, source and doc_id
are not used.  A bounded sample of labelled rows is turned into features by tasks and fitted with Adam; scoring is
one pass over each whole text without a shuffle.

A null or empty text has no words and zero statistics, and is scored like any other.  Without labels of both classes
the score is the smoothed share of good rows.  Repeated rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import crc_mod, give_back, slices, texts
from .samples import labelled_sample

WORD_BUCKETS = 1 << 13
RANK = 6
TRAIN_ROWS = 16_000  # bound of the labelled sample
EPOCHS = 25
BATCH = 256
WORD_SCALE = 0.3

BYTE = np.arange(256)
IS_UPPER = (BYTE >= 65) & (BYTE <= 90)
IS_LOWER = (BYTE >= 97) & (BYTE <= 122)
IS_DIGIT = (BYTE >= 48) & (BYTE <= 57)
IS_SPACE = (BYTE == 32) | ((BYTE >= 9) & (BYTE <= 13))
IS_SYMBOL = (BYTE < 128) & (BYTE > 32) & ~IS_UPPER & ~IS_LOWER & ~IS_DIGIT
STATISTICS = 14


def statistics(text: bytes, words: list[bytes]) -> np.ndarray:
    """Structure of a text: shares of kinds of characters and words, repetition, and lengths."""
    out = np.zeros(STATISTICS)
    if not words:
        return out
    data = np.frombuffer(text, np.uint8)
    count = np.bincount(data, minlength=256)
    n, w, lines = len(data), len(words), int(count[10]) + 1
    symbol = IS_SYMBOL[data]
    doubled = int(((data[1:] == data[:-1]) & symbol[1:]).sum())
    distinct = len(set(words))
    same_next = sum(map(operator.eq, words, words[1:]))
    symbols = int(count[IS_SYMBOL].sum())
    alone = sum(1 for x in words if len(x) == 1 and IS_SYMBOL[x[0]])
    out[:] = [
        np.sqrt(count[IS_UPPER].sum() / n), np.sqrt(symbols / n), np.sqrt(doubled / n), np.sqrt(count[IS_DIGIT].sum() / n),
        count[IS_SPACE].sum() / n, np.sqrt(alone / w), np.sqrt(same_next / w), distinct / w, np.log1p(n), np.log1p(w), np.log(n / w),
        np.log1p(w / lines), np.sqrt(count[128:].sum() / n), np.log1p(max(0, n - distinct * 8) / (distinct + 1)),
    ]
    return out


def hashed_words(words: list[bytes]) -> np.ndarray:
    return np.unique(np.fromiter((zlib.crc32(x) for x in set(words)), np.int64) & (WORD_BUCKETS - 1))


@dataclass
class Model:
    """Parameters over word buckets, then statistics; mean and spread standardize the statistics."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def raw(self, col: np.ndarray, value: np.ndarray) -> float:
        vx = self.factors[col] * value[:, None]
        return self.bias + self.linear[col] @ value + 0.5 * float((vx.sum(axis=0) ** 2 - (vx**2).sum(axis=0)).sum())

    def score(self, text: bytes) -> float:
        words = text.split()
        col, value = joined(hashed_words(words), self.standard(statistics(text, words)))
        return float(1 / (1 + np.exp(-np.clip(self.raw(col, value), -40, 40))))

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.spread, -5, 5)


def joined(words: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one row."""
    share = WORD_SCALE / np.sqrt(len(words)) if len(words) else 0.0
    return np.concatenate((words, WORD_BUCKETS + np.arange(STATISTICS))), np.concatenate((np.full(len(words), share), stats))


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words, stats = [], []
        for text in texts(batch, "text"):
            found = text.split()
            words.append(hashed_words(found).astype("i4").tobytes())
            stats.append(statistics(text, found).tolist())
        arrays = [batch.column("label"), pa.array(words, pa.binary()), pa.array(stats, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["label", "words", "stats"])


def fit(sample: DataFrame, epochs: int = EPOCHS, rank: int = RANK, penalty: float = 2e-4, seed: int = 7) -> Model:
    """Fit on a (bounded) frame of text and label; rows are put into a fixed order first."""
    rows = sample.mapInArrow(extract, "label double, words binary, stats array<double>").toPandas()
    rows = rows.sort_values(["words", "label"], kind="stable")
    width = WORD_BUCKETS + STATISTICS
    y = (rows["label"].to_numpy(float) > 0.5).astype(float)
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        zero = np.zeros(STATISTICS)
        return Model(float(np.log((pos + 0.5) / (neg + 0.5))), np.zeros(width), np.zeros((width, rank)), zero, zero + 1)
    stats = np.array(rows["stats"].tolist())
    mean, spread = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    words = [np.frombuffer(x, "i4") for x in rows["words"]]
    pairs = [joined(w, s) for w, s in zip(words, np.clip((stats - mean) / spread, -5, 5), strict=True)]
    rng = np.random.default_rng(seed)
    linear, factors = np.zeros(width), rng.normal(0, 0.02, (width, rank))
    bias = np.array([np.log(pos / neg)])
    params = [bias, linear, factors]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    total = epochs * -(-len(y) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            chosen = order[at : at + BATCH]
            col = np.concatenate([pairs[k][0] for k in chosen])
            value = np.concatenate([pairs[k][1] for k in chosen])
            starts = np.cumsum([0, *(len(pairs[k][0]) for k in chosen[:-1])])
            row = np.repeat(np.arange(len(chosen)), np.diff([*starts, len(col)]))
            vx = factors[col] * value[:, None]
            sums = np.add.reduceat(vx, starts, axis=0)
            raw = bias[0] + np.add.reduceat(linear[col] * value, starts) + 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), starts))
            residual = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y[chosen]) / len(chosen)
            rv = residual[row] * value
            grads = [np.array([residual.sum()]), np.bincount(col, rv, width), np.empty_like(factors)]
            inner = rv[:, None] * (sums[row] - vx)
            for f in range(rank):
                grads[2][:, f] = np.bincount(col, inner[:, f], width)
            step += 1
            rate = 0.02 * (1 - step / (total + 1))
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g = g + (penalty * p if p is not bias else 0)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(float(bias[0]), linear, factors, mean, spread)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn from labelled rows whose crc32(doc_id) mod 5 is not 0."""
    model = fit(labelled_sample(docs, labels, "quality", 5, 0, rows))
    give_back()
    return model


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = [shared.value.score(t) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns kept, that score at least the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = [shared.value.score(t) >= threshold for t in texts(batch, "text")]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
