"""Against brute force, with ties, copies, clusters and odd vectors."""

import math

import numpy as np

from cohortspark.llm import knn


def brute(rows, k, every):
    good = [(n, i, [math.floor(256 * float(x)) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v in good:
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), math.inf if j is None else j, m) for m, j, w in good if m != n)[:k]
        out += [(i, r + 1, None if j == math.inf else j, -s) for r, (s, j, _) in enumerate(scored)]
    return sorted(out, key=str)


def check(spark, rows, **kw):
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = [tuple(r) for r in knn.top_k(frame, every=5, **kw).collect()]
    rounded = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(got, key=str) == brute(rounded, kw.get("k", 5), 5)


def test_mixed(spark, monkeypatch):
    monkeypatch.setattr(knn, "DATA_BLOCK", 50)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(150)] + [(200 + i, [0.5] * 6) for i in range(60)]
    rows += [(300, None), (301, [1.0, None] * 3), (305, [math.nan] * 6), (310, [math.inf] + [0.0] * 5), (5, rows[7][1]), (None, rows[8][1]), (315, []), (320, [1.0, 2.0])]
    check(spark, rows)


def test_clusters(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(8, 5)) * 50
    rows = [(i, (centre[i % 8] + rng.normal(size=5) * 0.1).tolist()) for i in range(400)]
    check(spark, rows, k=3, pivots=8)


def test_small(spark):
    check(spark, [(0, [1.0, 2.0])])
    check(spark, [(0, [1.0, 2.0]), (1, [1e7, -1e7]), (5, [3e5, 1.0])])
    assert knn.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bounds_prune(spark, monkeypatch):
    """On clusters a row goes to a small part of the query blocks; on noise never to more than there are."""
    monkeypatch.setattr(knn, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(16, 12)) * 20
    for spread, most in ((0.05, 2.0), (40.0, 1e9)):
        rows = [(i, (centre[i % 16] + rng.normal(size=12) * spread).tolist(), 1) for i in range(640)]
        placed = knn.place(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"), 10, pivots=16)
        groups = knn.plan_groups(placed, 3)
        blocks = len(set(groups.block.tolist()))
        sent = knn.data_rows(placed, groups).count()
        assert blocks >= 5 and sent <= min(most, blocks) * 640
