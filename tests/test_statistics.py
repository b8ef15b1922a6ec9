"""Golden values of the four-sample cohort, and special functions."""

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.cohort import Cohort
from cohortspark.functions import special
from cohortspark.plans import permutation as perm
from cohortspark.plans import statistics as st

ONE = [(0, 1, 2, 2), (1, 1, 0, 0), (0, 1, 0, 0), (1, 1, 0, 1)]
TWO = [(0, 1, 2, 2), (1, 1, 0, 0), (0, 0, 0, 0), (1, 1, 0, 1)]
WEIGHTS = (0.5, 1.5, 3.0, 0.5)


@pytest.fixture(scope="module")
def golden(spark):
    samples = spark.createDataFrame([(i, int(i < 2), [0.2, 1.1, 1.7, 2.4][i]) for i in range(4)], "sample_id long, y int, trait double")
    rows, calls = [], []
    for t, matrix in (("t1", ONE), ("t2", TWO)):
        for j in range(4):
            v = f"{t}v{j}"
            rows.append((v, "g", t, "SNV", "nonsynonymous", WEIGHTS[j]))
            calls += [(i, v, matrix[i][j], False) for i in range(4) if matrix[i][j]]
    variants = spark.createDataFrame(rows, "variant_id string, gene string, transcript string, type string, function string, weight double")
    return Cohort(samples, variants, spark.createDataFrame(calls, "sample_id long, variant_id string, dosage int, missing boolean"))


def values(df, name):
    return [round(r[name], 5) for r in df.orderBy("transcript").collect()]


def test_golden(golden):
    assert values(st.calpha(golden), "calpha") == [-2.0, -1.5]
    assert values(st.wss(golden), "wss") == [14.62902, 14.7115]
    assert values(st.variable_threshold(golden), "vt") == [0.45227, 0.53452]
    assert values(st.vaast(golden, penalty=2.0, cap=0.5), "vaast") == [3.64941, 3.64941]


def test_permutations(golden, spark):
    labels = perm.uniform_permutations(golden, 1, 20, 3)
    assert {r.s for r in labels.groupBy("perm_id").agg(F.sum("y").alias("s")).collect()} == {2}
    assert sorted(labels.collect()) == sorted(perm.uniform_permutations(golden, 1, 20, 3).repartition(7).collect())
    observed = st.calpha(golden).withColumnRenamed("calpha", "stat")
    whole = perm.empirical(perm.count_hits(perm.hits(observed, perm.permuted_calpha(golden, labels))), 20)
    blocks = perm.run_blocks(golden, observed, 20, 6, 10**6, 3)
    assert sorted(map(str, whole.select(*sorted(whole.columns)).collect())) == sorted(map(str, blocks.select(*sorted(whole.columns)).collect()))


def test_special():
    assert math.isclose(special.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(special.chi2_sf(200.0, 100), 1.1e-8, rel_tol=0.3)
    for df in (0.5, 1, 3.7, 40):
        for p in (0.999, 0.5, 1e-3, 1e-12):
            assert math.isclose(special.chi2_sf(special.chi2_isf(p, df), df), p, rel_tol=1e-8)
    assert math.isclose(special.f_sf(4.0, 1, 10), 0.07338803, rel_tol=1e-5)
    low, high = special.poisson_ci(5, 100)
    assert math.isclose(low, 0.01623486, rel_tol=1e-5) and math.isclose(high, 0.1166833, rel_tol=1e-5)
    rng = np.random.default_rng(1)
    draws = rng.noncentral_chisquare(3, 4, 200_000)
    assert abs((draws > 9).mean() - special.noncentral_chi2_sf(9, 3, 4)) < 0.004
    assert math.isclose(special.fisher_odds_ratio(3, 1, 1, 3), 6.408309, rel_tol=1e-5)
    assert math.isclose(special.hypergeometric_sf(3, 8, 4, 4), 17 / 70, rel_tol=1e-12)


def test_jvm_tails(spark):
    row = spark.range(1).select(special.chi2_sf_col(F.lit(3.841458820694124), 1).alias("c"), special.f_sf_col(F.lit(4.0), F.lit(1.0), F.lit(10.0)).alias("f")).first()
    assert math.isclose(row.c, 0.05, rel_tol=1e-9) and math.isclose(row.f, 0.07338803, rel_tol=1e-5)


def test_odds_ratio_of_large_tables():
    """Equal to sums over all cells, and bounded in memory however many cells the law has."""
    lg = np.vectorize(math.lgamma)
    for a, b, c, d in ((1, 40, 3, 2), (700, 300, 1200, 900), (2, 5, 820, 1785), (1, 3219, 898, 1)):
        k = np.arange(max(0, a - d), min(a + b, a + c) + 1)
        base = -(lg(k + 1.0) + lg(a + c - k + 1.0) + lg(a + b - k + 1.0) + lg(d - a + k + 1.0))
        w = base + k * math.log(special.fisher_odds_ratio(a, b, c, d))
        w = np.exp(w - w.max())
        assert math.isclose((w * k).sum() / w.sum(), a, rel_tol=1e-8)
    tracemalloc.start()
    found = special.fisher_odds_ratio(128_000, 192_000, 32_400, 47_600)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert math.isclose(found, 128_000 * 47_600 / (192_000 * 32_400), rel_tol=1e-4) and peak < 2_000_000
