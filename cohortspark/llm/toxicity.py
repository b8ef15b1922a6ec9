"""Toxicity: linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased, ASCII punctuation becomes a space, and every n-gram of 4 to 6 characters (code points; a space at
either end of each word) is hashed into one of 2^21 buckets; presence counts, not frequency.  Training takes a bounded
sample of labelled rows: document counts by class are summed over partitions, the most telling buckets stay, each
feature is its log-count ratio, and a logistic regression over them is fitted.  Scoring is one pass over each whole
text without a shuffle; its model is as large as the number of features that stay, which is a parameter.

A null or empty text has no n-grams: its score is the model's at the intercept.  Without labels of both classes the
score is the smoothed share of toxic rows.  Repeated rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import WORD_BYTES, crc_mod, give_back, slices
from .samples import labelled_sample

SIZES = (4, 5, 6)
BUCKET_BITS = 21
CHUNK_CHARS = 1 << 18  # of text whose n-grams are hashed at once, but always whole texts
# Odd multipliers, one for each place of an n-gram.
PLACES = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) ^ (0xD1B54A32D192ED03 * k)) % 2**64 | 1) for k in range(max(SIZES))]
TRAIN_ROWS = 16_000  # bound of the labelled sample
FEATURES = 8_192
FEATURES_PER_ROW = 4
LEAST_DOCS = 4  # a bucket in fewer training documents tells nothing


@dataclass
class Model:
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    intercept: float


def normalized(text: str) -> str:
    return (b" " + b" ".join((text if text.isascii() else text.lower()).encode().translate(WORD_BYTES).split()) + b" ").decode()


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Normalized texts in chunks, with the number of each chunk's first text."""
    first, chunk, size = 0, [], 0
    for n, text in enumerate(texts):
        chunk.append(normalized(text))
        size += len(chunk[-1])
        if size >= CHUNK_CHARS or n + 1 == len(texts):
            yield first, chunk
            first, chunk, size = n + 1, [], 0


def hashed(texts: list[str], keep: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, bucket) of every n-gram whose bucket is in keep (a mask), repeats included."""
    data = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(t) for t in texts])
    mixed = data * PLACES[0]
    for n in range(2, max(SIZES) + 1):
        if len(data) < n:
            return
        mixed = mixed[: len(data) - n + 1] + data[n - 1 :] * PLACES[n - 1]
        if n in SIZES:
            z = mixed ^ mixed >> np.uint64(29)
            bucket = ((z + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)).view(np.int64)
            at = np.flatnonzero(keep[bucket])
            doc = np.searchsorted(ends, at, "right")
            inside = at + n <= ends[doc]
            yield doc[inside], bucket[at[inside]]


def features(texts: list[str], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs, sorted."""
    found = [d << BUCKET_BITS | b for d, b in hashed(texts, keep)]
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return pairs >> BUCKET_BITS, pairs & ((1 << BUCKET_BITS) - 1)


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class that have a bucket, per task."""
    keep = np.ones(1 << BUCKET_BITS, bool)
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch in slices(batches):
        label = np.asarray(batch.column("label").to_pylist(), float) > 0.5
        for first, part in chunks(batch.column("text").to_pylist()):
            doc, bucket = features(part, keep)
            toxic = label[first + doc]
            np.add.at(counts[1], bucket[toxic], 1)
            np.add.at(counts[0], bucket[~toxic], 1)
    for at in np.array_split(np.flatnonzero(counts.any(axis=0)), 32):
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[1, at]), pa.array(counts[0, at])], names=["bucket", "pos", "neg"])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, width: int, penalty: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows with an L2 penalty, by full-batch Adam."""
    w, b = np.zeros(width), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=w[col] * value, minlength=len(y)) + b
        r = (sigmoid(z) - y) / len(y)
        g, gb = np.bincount(col, weights=r[row] * value, minlength=width) + penalty * w, r.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 * min(1.0, 2 * (1 - t / (rounds + 1)))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, b


def fit(sample: DataFrame, width: int = FEATURES) -> Model:
    """Train on a (bounded) frame of text and label."""
    counts = {r.label > 0.5: r.n for r in sample.groupBy((F.col("label") > 0.5).cast("double").alias("label")).agg(F.count("*").alias("n")).collect()}
    pos, neg = counts.get(True, 0), counts.get(False, 0)
    if not pos or not neg:
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log((pos + 0.5) / (neg + 0.5))))
    width = min(width, FEATURES_PER_ROW * (pos + neg))  # a small sample bears few features
    share_pos, share_neg = F.col("pos") / pos, F.col("neg") / neg
    both = (F.col("pos") + F.col("neg")) / (pos + neg)
    chosen = (
        sample.mapInArrow(count_batches, "bucket long, pos long, neg long")
        .groupBy("bucket")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where(F.col("pos") + F.col("neg") >= LEAST_DOCS)
        .orderBy(F.desc((share_pos - share_neg) ** 2 / (both * (1 - both) + 1e-9)), "bucket")
        .limit(width)
        .collect()
    )
    chosen.sort(key=lambda r: r.bucket)
    buckets = np.array([r.bucket for r in chosen], np.int64)
    p, q = np.array([r.pos for r in chosen]) + 0.5, np.array([r.neg for r in chosen]) + 0.5
    ratio = np.log((p / (pos + 1)) / (q / (neg + 1)))

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(1 << BUCKET_BITS, bool)
        keep[buckets] = True
        for batch in slices(batches):
            rows = []
            for _, part in chunks(batch.column("text").to_pylist()):
                doc, bucket = features(part, keep)
                rows += np.split(np.searchsorted(buckets, bucket).astype("i4"), np.searchsorted(doc, np.arange(1, len(part))))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["label", "active"])

    rows = sample.mapInArrow(active, "label double, active binary").toPandas()
    y = (rows["label"].to_numpy() > 0.5).astype(float)
    sets = [np.frombuffer(r, "i4") for r in rows["active"]]
    col = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    w, b = fit_logistic(row, col, ratio[col], y, len(buckets))
    return Model(buckets, w * ratio, b)


def scores(model: Model, texts: list[str]) -> np.ndarray:
    keep = np.zeros(1 << BUCKET_BITS, bool)
    keep[model.buckets] = True
    out = np.full(len(texts), model.intercept)
    for first, part in chunks(texts):
        doc, bucket = features(part, keep)
        if len(doc):
            out[first : first + len(part)] += np.bincount(doc, model.weights[np.searchsorted(model.buckets, bucket)], len(part))
    return sigmoid(out)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn from labelled rows whose crc32(doc_id) mod 4 is not 2."""
    model = fit(labelled_sample(docs, labels, "toxic", 4, 2, rows))
    give_back()
    return model


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = scores(shared.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns kept, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = scores(shared.value, [t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(score < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
