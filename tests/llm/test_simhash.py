"""Fingerprints against Spark's own hash, links and components against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from cohortspark.llm import simhash
from cohortspark.llm.simhash import components, fingerprint, near_fingerprints, trie_pairs


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    import xxhash

    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def test_fingerprint(spark):
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 700):
        text = " ".join(rng.choice(["The", "é", "x,", "Z"]) for _ in range(n))
        assert fingerprint(text.encode()) == plain(text)
    one = spark.range(1).select(F.xxhash64(F.lit("a é c"))).first()[0]
    assert fingerprint("A é\tc".encode()) == one & (2**64 - 1)


def test_trie_pairs():
    rng = np.random.default_rng(2)
    v = np.unique(np.concatenate([rng.integers(0, 2**64, 300, np.uint64), *(np.uint64(7) << np.uint64(k) for k in [np.arange(60, dtype=np.uint64)])]))
    for budget in (0, 1, 2, 5):
        want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if int(v[i] ^ v[j]).bit_count() <= budget}
        got = [(int(i), int(j)) for a, b in trie_pairs(v, v, 0, 0, budget, True) for i, j in zip(a, b, strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(500, k) for k in range(600, 650)]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == root


def test_query(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_LEAVES", 4)
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.choice([1, 4, 200]))) for _ in range(120)]
    texts += [t + " tail" for t in texts if len(t) > 300] + [None, "", "  ", texts[5], texts[5]]
    rows = [(i if i % 40 else None, t, "fp") for i, t in enumerate(texts)] + [(7, texts[7], "fp")]
    got = near_fingerprints(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    fps = [plain(t) for _, t, _ in rows]
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        before = list(label)
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    ids = {}
    for (doc, _, _), root in zip(rows, label, strict=True):
        ids.setdefault(root, []).append(doc)
    want = sorted((str(d), f"{f:016x}", str(min((x for x in ids[r] if x is not None), default=None))) for (d, _, _), f, r in zip(rows, fps, label, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert near_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
