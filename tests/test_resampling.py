"""Adjusted permutations, bootstrap, effect sizes and streams of shards."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.cohort import Cohort, from_tables
from cohortspark.config import AssocConfig
from cohortspark.functions.special import fisher_odds_ratio
from cohortspark.plans import association
from cohortspark.plans import permutation as perm
from cohortspark.plans import reports as rp
from cohortspark.plans import resampling as rs
from cohortspark.plans import statistics as st
from cohortspark.streaming.blocks import merge_stream

SF = "/root/testdata/sf0.001"


def test_bins():
    bins, means = rs.odds_bins(np.array([0.98, 0.10, 0.92, 0.15]), 0.1)
    assert np.bincount(bins).tolist() == [2, 2] and np.allclose(means, [0.125, 0.95])


def test_bins_across_ranges(spark):
    """Bins of unrounded odds over many ranges equal the greedy loop, in sparse and crowded places, with repeats."""
    rng = np.random.default_rng(5)
    for epsilon in (0.003, 0.05, 5.0):
        odds = np.concatenate((rng.exponential(1, 400), rng.uniform(0.5, 0.52, 300), np.repeat(0.7, 50), [40.0, 40.0 + epsilon, 40.0 + 2 * epsilon]))
        want, means = rs.odds_bins(odds, epsilon)
        frame = spark.createDataFrame([(k, float(v)) for k, v in enumerate(odds)], "sample_id long, odds double").repartition(3)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            dealt, sizes, got_means = rs.binned(frame, epsilon)
            got = {r.sample_id: r.bin for r in dealt.collect()}
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert [got[k] for k in range(len(odds))] == want.tolist()
        assert sizes.tolist() == np.bincount(want).tolist() and np.allclose(got_means, means)


@pytest.fixture(scope="module")
def cohort(spark):
    return from_tables(spark, SF)


def test_adjusted_permutations(spark, cohort):
    _, cases = cohort.sizes
    odds = cohort.samples.select("sample_id", (F.col("cov_cat") + 1.0).alias("odds"))
    got = rs.adjusted_permutations(cohort, odds, 1, 15)
    assert {r.s for r in got.groupBy("perm_id").agg(F.sum("y").alias("s")).collect()} == {cases}
    assert sorted(got.collect()) == sorted(rs.adjusted_permutations(cohort, odds.repartition(5), 1, 15).collect())
    rate = {r.cov_cat: r.p for r in got.join(cohort.samples.select("sample_id", "cov_cat"), "sample_id").groupBy("cov_cat").agg(F.avg("y").alias("p")).collect()}
    assert rate[4] > rate[0]


def test_bootstrap_and_power(cohort):
    drawn = rs.bootstrap(cohort, 2, 30, 50)
    assert drawn.count() == 160 and drawn.where("y = 1").count() == 60
    assert drawn.where("rep = 1").select("sample_id").distinct().count() < 80
    won = rs.power(cohort, 10, 40, 40, (0.05, 1.0)).collect()
    assert all(r.ratio <= 1 for r in won) and all(r.alpha < 1 or r.successes > 0 for r in won)
    several = rs.permuted_power(cohort, AssocConfig(method="WSS", nperm=10), 3, 40, 40, (0.05, 0.9)).collect()
    assert {r.alpha for r in several} == {0.05, 0.9} and all(0 <= r.ratio <= 1 and r.bootstraps == 3 for r in several)
    odds = cohort.samples.select("sample_id", (F.col("cov_cat") + 1.0).alias("odds"))
    assert all(0 <= r.ratio <= 1 for r in rs.permuted_power(cohort, AssocConfig(method="CALPHA", nperm=12), 2, 30, 30, (0.5,), odds).collect())
    assert all(r.or_ci_low <= r.or_ci_high and 0 < r.p_value <= 1 for r in rs.effect_sizes(cohort, 20).collect() if not math.isnan(r.or_ci_low))
    assert rs.testable(cohort).where("testable").count() > 0
    # By odds: the same counts as from labels made one by one.
    labels = rs.adjusted_permutations(cohort, odds, 1, 12).toPandas()
    cases_of = {k: set(f["sample_id"][f["y"] == 1]) for k, f in labels.groupby("perm_id")}
    held = st.carriers(cohort).select("gene", "transcript", "sample_id").toPandas()
    want = {key: sorted(len(cases_of[k] & set(f["sample_id"])) for k in range(1, 13)) for key, f in held.groupby(["gene", "transcript"])}
    assert {(r.gene, r.transcript): list(r.all) for r in rs.adjusted_carriers(cohort, 12, 1, odds, 1e-4).collect()} == want
    assert all(0 < r.p_value <= 1 for r in rs.effect_sizes(cohort, 12, odds=odds).collect())
    config = AssocConfig(method="CALPHA", nperm=9)
    best = rs.extreme_statistic(cohort, config)
    seen = association.statistic(cohort, config)
    n, cases = cohort.sizes
    calls = cohort.calls.where("dosage > 0").select("variant_id", "sample_id").toPandas()
    got = {(r.gene, r.transcript): r.stat for r in best.collect()}
    for key, part in cohort.variants.toPandas().groupby(["gene", "transcript"]):
        mine = calls[calls["variant_id"].isin(part["variant_id"])]
        first = set(sorted(mine["sample_id"].unique())[:cases])
        terms = [(c.isin(first).sum() - len(c) * cases / n) ** 2 - len(c) * cases / n * (1 - cases / n) for _, c in mine.groupby("variant_id")["sample_id"]]
        assert math.isclose(got[key], sum(terms), rel_tol=1e-9, abs_tol=1e-6)
    low = seen.select("gene", "transcript", (F.col("stat") - 1e6).alias("stat"))
    assert rs.testable_by(cohort, config, low.unionByName(low), 0.5).where("testable").count() == seen.count()


def test_runs(spark):
    frame = spark.createDataFrame([(1, v) for v in (1, 2, 3, 7, 9, 10)], "k int, v int")
    assert rp.runs(frame, ["k"], "v", "t").first().t == "1-3,7,9-10"


def test_stream_of_shards(spark, tmp_path):
    rows = [("g", "t", 3, 2.5, 10), ("g", "t", 1, 1.0, 5)]
    names = "gene string, transcript string, successes long, mid_successes double, permutations long"
    for r in rows:
        spark.createDataFrame([r], names).write.mode("append").parquet(str(tmp_path / "shards"))
    q = merge_stream(spark, str(tmp_path / "shards")).writeStream.outputMode("complete").format("memory").queryName("shards_total").start()
    q.processAllAvailable()
    q.stop()
    want = perm.combine_shards(spark.createDataFrame(rows, names)).collect()
    assert spark.sql("SELECT * FROM shards_total").collect() == want


def test_adjusted_labels_are_joined_with_nothing(spark, cohort):
    """Labels come with their sample ids: a join would send all of them, or all ids, through the driver as a broadcast."""
    odds = cohort.samples.select("sample_id", F.lit(1.0).alias("odds"))
    found = rs.adjusted_permutations(cohort, odds, 1, 3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.groupBy("perm_id").agg(F.countDistinct("sample_id").alias("n"), F.sum("y").alias("y")).select("n", "y").distinct().collect() == [cohort.sizes]


def test_effect_sizes_without_a_case_among_carriers(spark):
    """Permutations in which no carrier is a case count as zero; equal to sums over all labels."""
    samples = spark.createDataFrame([(k, int(k < 4), 0.0) for k in range(40)], "sample_id int, y int, trait double")
    variants = spark.createDataFrame([(0, "g", "t", 1.0), (1, "h", "t", 1.0)], "variant_id int, gene string, transcript string, weight double")
    calls = spark.createDataFrame([(1, 0, 1, False), (30, 0, 1, False), *((k, 1, 1, False) for k in range(2, 30))], "sample_id int, variant_id int, dosage int, missing boolean")
    c = Cohort(samples, variants, calls)
    labels = {(r.perm_id, r.sample_id): r.y for r in perm.uniform_permutations(c, 1, 20, 3).collect()}
    got = {r.gene: r for r in rs.effect_sizes(c, 20, 3).collect()}
    for gene, held, own in (("g", (1, 30), 1), ("h", range(2, 30), 2)):
        sums = sorted(sum(labels[k, s] for s in held) for k in range(1, 21))
        assert gene == "h" or sums[0] == 0
        assert math.isclose(got[gene].p_value, (sum(v >= own for v in sums) + 1) / 21)
        at = [fisher_odds_ratio(v, len(held) - v, 4 - v, 36 - len(held) + v) for v in (sums[0], sums[19])]
        assert np.allclose([got[gene].or_ci_low, got[gene].or_ci_high], at, equal_nan=True)
