"""Held-out accuracy, the linear-time identity, and odd rows."""

import random
import zlib

import numpy as np
import pytest

from cohortspark.llm import quality, toxicity
from cohortspark.llm.samples import labelled_sample

SF = "/root/testdata/sf0.01"


def held(i, modulus, remainder):
    return zlib.crc32(str(i).encode()) % modulus == remainder


@pytest.mark.parametrize(("module", "label", "modulus", "remainder"), [(toxicity, "toxic", 4, 2), (quality, "quality", 5, 0)])
def test_held_out(spark, module, label, modulus, remainder):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in module.score_documents(docs, module.train(docs, labels)).collect()}
    assert len(got) == docs.count()
    rows = [(got[r.doc_id].predicted, r[label]) for r in labels.collect() if held(r.doc_id, modulus, remainder)]
    assert np.mean([p == y for p, y in rows]) > 0.9
    for i, r in got.items():
        assert r.held_out == held(i, modulus, remainder) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, module):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["good", "fine", "bad!!", "x"]) for _ in range(30)) for _ in range(60)]
    rows = [(i, t, 0.5) for i, t in enumerate(texts)] + [(60, None, 1.0), (61, "", 1.0), (None, "z " * 50_000, 1.0), (5, texts[5], 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    label = "toxic" if module is toxicity else "quality"
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1), (7, None), (None, 1), (999, 0)], f"doc_id long, {label} int")
    a = module.score_documents(docs, module.train(docs, labels)).collect()
    assert len(a) == len(rows) and all(0 <= r.score <= 1 for r in a)
    b = module.score_documents(docs.repartition(3), module.train(docs.repartition(5), labels)).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in a) == sorted((str(r.doc_id), round(r.score, 9)) for r in b)
    none = module.train(docs, labels.limit(0))
    assert {round(r.score, 6) for r in module.score_documents(docs, none).collect()} == {0.5}
    assert module.score_documents(docs.limit(0), none).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 50, f"t{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int")
    assert labelled_sample(docs, labels, "toxic", 4, 2, 20).count() == 20


def test_identity():
    rng = np.random.default_rng(1)
    width = quality.WORD_BUCKETS + quality.STATISTICS
    m = quality.Model(0.3, rng.normal(size=width), rng.normal(size=(width, 4)), np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    col, value = np.array([1, 5, 9000 % width, 70]), rng.normal(size=4)
    pairs = sum(m.factors[a] @ m.factors[b] * value[i] * value[j] for i, a in enumerate(col) for j, b in enumerate(col) if i < j)
    assert np.isclose(m.raw(col, value), 0.3 + m.linear[col] @ value + pairs)


def test_ngrams():
    texts = [toxicity.normalized("Ab cd!"), toxicity.normalized("ÉA ab"), toxicity.normalized("漢字かな交じり文 дом")]
    assert texts[1] == " éa ab "
    keep = np.ones(1 << toxicity.BUCKET_BITS, bool)
    doc, bucket = toxicity.features(texts, keep)
    for k, t in enumerate(texts):
        want = set()
        for n in toxicity.SIZES:
            for at in range(len(t) - n + 1):
                mixed = sum(ord(c) * int(m) for c, m in zip(t[at : at + n], toxicity.PLACES, strict=False)) % 2**64
                want.add(((mixed ^ mixed >> 29) + n) * 0x9E3779B97F4A7C15 % 2**64 >> (64 - toxicity.BUCKET_BITS))
        assert set(bucket[doc == k].tolist()) == want


def test_fits_against_slow_ones(spark):
    """The log-count ratios against sets of n-grams, and the fitted weights against plain gradient descent."""
    rng = random.Random(4)
    rows = [(" ".join(rng.choice(["good", "fine", "word"] if k % 2 else ["awful", "bad", "word"]) for _ in range(8)), float(k % 2 == 0)) for k in range(60)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label double"), 64)
    sets = []
    for text, _ in rows:
        doc, bucket = toxicity.features([toxicity.normalized(text)], np.ones(1 << toxicity.BUCKET_BITS, bool))
        sets.append(set(bucket.tolist()))
    y = np.array([v for _, v in rows])
    ratio = []
    for b in model.buckets.tolist():
        p, q = (sum(b in s for s, v in zip(sets, y, strict=True) if v == side) + 0.5 for side in (1.0, 0.0))
        ratio.append(np.log((p / (y.sum() + 1)) / (q / ((1 - y).sum() + 1))))
    x = np.array([[r * (b in s) for b, r in zip(model.buckets.tolist(), ratio, strict=True)] for s in sets])
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(20_000):
        left = (toxicity.sigmoid(x @ w + b) - y) / len(y)
        w, b = w - 0.05 * (x.T @ left + 1e-3 * w), b - 0.05 * left.sum()
    slow = toxicity.sigmoid(x @ w + b)
    fast = toxicity.scores(model, [t for t, _ in rows])
    assert np.abs(slow - fast).max() < 0.05 and ((fast > 0.5) == y.astype(bool)).all()
