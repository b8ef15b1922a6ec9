"""Whitening against a plain eigendecomposition."""

import math

import numpy as np
import pytest

from cohortspark.llm.whiten import deviations, shifted_factor, solved, whiten


def check(spark, rows, k=4):
    """rows: (vec_id, vector or None)."""
    frame = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, x string, whitened double").repartition(3)
    got = {}
    for r in whiten(frame).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    good = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)}
    width = max(map(len, good.values()))
    good = {i: v + [0] * (width - len(v)) for i, v in good.items()}
    fit = np.array(sorted({tuple(v) for v in good.values()}), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, width)
    assert set(got) == set(good)
    signs = {}
    for i, v in good.items():
        assert sorted(got[i]) == list(range(1, k + 1))
        for c, r in got[i].items():
            assert r.n == n and r.deviation == sum((n * a - int(b)) ** 2 for a, b in zip(v, sums, strict=True))
            if values[0] <= 0:
                assert r.explained is None and r.whitened is None
                continue
            assert r.explained == pytest.approx(max(values[c - 1], 0) / values.sum(), rel=1e-9, abs=1e-12)
            if values[c - 1] < 1e-12 * values.sum():
                assert r.whitened is None
                continue
            want = (np.array(v) - sums / n) @ vectors[:, c - 1] / math.sqrt(values[c - 1])
            if abs(want) > 1e-6:
                signs.setdefault(c, np.sign(want) * np.sign(r.whitened))
                assert r.whitened == pytest.approx(signs[c] * want, rel=1e-7, abs=1e-7)
            assert r.identity_error <= 1e-9
    return got


def test_against_eigenvectors(spark):
    rng = np.random.default_rng(4)
    scales = np.array([3, 2, 1.3, 0.9, 0.5, 0.2, 0.1])
    rows = [(k, (rng.standard_normal(7) * scales).astype(float).tolist()) for k in range(400)]
    rows += [(1000 + k, rows[0][1]) for k in range(200)]  # copies count once
    rows += [(2000, None), (2001, []), (2002, [None] * 7), (2003, [float("nan")] * 7), (2004, [1.0] * 6 + [float("inf")])]
    check(spark, rows)


def test_dependent_and_constant_columns(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-500, 500, (60, 3))
    rows = [(k, [float(a) / 256, float(b) / 256, float(a + b) / 256, 2.0, float(c) / 256]) for k, (a, b, c) in enumerate(base)]
    check(spark, rows)
    check(spark, [(k, [float(k % 3), 1.0, 2.0, 3.0, 4.0]) for k in range(9)])


def test_few_and_ragged(spark):
    check(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    check(spark, [(1, [1.0, -2.0]), (2, [3.0]), (3, [0.5, 0.25, -1.0]), (4, [2.0, 0.0, 0.0])])
    frame = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert whiten(frame).collect() == [] and len(whiten(frame).columns) == 7


def test_factors():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((300, 5)) @ np.diag([1, 1e-3, 1e-6, 1e-9, 1e-11]) @ rng.standard_normal((5, 5))
    factors = []
    for _ in range(6):
        q = solved(a, factors)
        factors.append(shifted_factor(q.T @ q, len(a)))
    q = solved(a, factors)
    assert np.abs(q.T @ q - np.eye(5)).max() < 1e-9
    big = np.array([[2**40, -(2**41)], [3, 4]])
    assert deviations(big) == [2**80 + 2**82, 25]
