"""Conversions, lookups, stops and sinks."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.plans import reports as rp
from cohortspark.plans import tools
from cohortspark.sources import files, sinks


def test_vcf_matrix(spark):
    calls = spark.createDataFrame([("chr1", 5, "A", "C", "a", 1), ("chr1", 5, "A", "C", "b", 2), ("chr1", 500_000, "AT", "A", "b", 5), ("chr2", 5, "A", "C", "a", 1)], "chrom string, pos long, ref string, alt string, sample_id string, code int")
    models = spark.createDataFrame([("G", "T1", "chr1", 1, 5), ("G", "T2", "chr1", 5, 600_000), ("H", "T3", "chr3", 1, 9)], "gene string, transcript string, chrom string, tx_start long, tx_end long")
    rows = tools.vcf_matrix(calls, models, ["a", "b", "c"])
    got = [r.value.split("\t") for r in tools.matrix_lines(rows).collect()]
    assert [(g[1], g[5], g[7], g[11]) for g in got] == [("5", "SNV", "T1", "120"), ("5", "SNV", "T2", "120"), ("500000", "deletion", "T2", "050")]
    assert tools.collapsed_rows(rows, rows.where("transcript = 'T1'").select("chrom", "start", "end", "ref", "alt", "transcript")).count() == 1


def test_interval_join(spark):
    """Spans from one base to a whole genome, a crowded place, empty spans and both ends, against a loop."""
    rng = np.random.default_rng(3)
    points = [("c1" if k % 5 else "c2", int(p)) for k, p in enumerate(np.concatenate((rng.integers(0, 3_000_000, 150), np.full(100, 77_777), [0, 1023, 1024, 1025])))]
    spans = [("c1", int(a), int(a + w), k) for k, (a, w) in enumerate(zip(rng.integers(0, 3_000_000, 60), 2 ** rng.integers(0, 22, 60), strict=True))]
    spans += [("c1", 0, 3 * 10**9, 100), ("c1", 77_777, 77_777, 101), ("c1", 1023, 1024, 102), ("c2", 5, 4, 103), *(("c1", 77_000 + k, 78_000, 200 + k) for k in range(40))]
    got = rp.interval_join(spark.createDataFrame(points, "chrom string, pos long"), spark.createDataFrame(spans, "chrom string, span_start long, span_end long, id int"))
    assert sorted((r.chrom, r.pos, r.id) for r in got.collect()) == sorted((c, p, i) for c, p in points for d, a, b, i in spans if c == d and a <= p <= b)
    none = spark.createDataFrame([], "chrom string, span_start long, span_end long, id int")
    assert rp.interval_join(spark.createDataFrame(points, "chrom string, pos long"), none).count() == 0


def test_locate(spark):
    f = spark.createDataFrame([("gene", "E1", None, "AB", "1", 5, 9), ("mRNA", "T1", "E1", None, "1", 6, 9), ("gene", "E2", None, None, "2", 7, 9)], "kind string, id string, parent string, name string, chrom string, start long, end long")
    r = spark.createDataFrame([("E2.4", 0.1), ("AB", 0.2), ("T1", 0.3), ("none", 0.4)], "gene string, p double")
    assert {x.gene: (x.chrom, x.start) for x in tools.locate(r, f).collect()} == {"E2.4": ("2", 7), "AB": ("1", 5), "T1": ("1", 5), "none": (None, None)}


def test_stops_and_values(spark):
    rows = [("g", "t", k, float(k), 3.0, int(k % 2), 0.5) for k in range(1, 41)] + [("h", "t", k, 0.0, 3.0, 0, 0.0) for k in range(1, 41)]
    marked = spark.createDataFrame(rows, "gene string, transcript string, perm_id int, stat double, observed double, hit int, mid double")
    stops = {r.gene: r.stop for r in tools.threshold_stop(marked, 0.05).collect()}
    assert stops["h"] == 40 and 10 < stops["g"] < 40
    assert tools.permuted_values(marked).where("gene = 'g'").first().stats == [float(k) for k in range(1, 41)]
    assert {r.gene: round(r.percentile, 6) for r in tools.percentile(marked).collect()} == {"g": round(39 / 41, 6), "h": round(1 / 41, 6)}
    assert tools.permuted_moments(marked).count() == 40
    assert tools.default_whitelist(spark, "SKAT").where("value = 'synonymous'").count() == 0


def test_simple_round_trip(spark, tmp_path):
    result = spark.createDataFrame([(2, "h", "t", 0.5, 0.1, 0.9, 3), (1, "g", "t", 0.25, 0.1, 0.4, 1)], "rank int, gene string, transcript string, empirical_p double, empirical_p_low double, empirical_p_high double, successes long")
    sinks.write_simple(result, str(tmp_path / "out.simple"), 2, 3, "scan")
    back = files.read_simple(spark, str(tmp_path / "out.simple"))
    assert [(r.Rank, r.Gene, r.Empirical_P_CI) for r in back.orderBy("Rank").collect()] == [("1", "g", "0.1,0.4"), ("2", "h", "0.1,0.9")]
    sinks.write_table(result, str(tmp_path / "table"), ["gene"])
    assert spark.read.text(str(tmp_path / "table")).count() == 3


def test_permutation_files(spark, tmp_path):
    p = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 1), (2, 2, 0)], "perm_id int, sample_id int, y int")
    files.write_permutations(p, str(tmp_path / "perms"))
    assert sorted(r.labels for r in files.read_permutations(spark, str(tmp_path / "perms")).collect()) == ["01", "10"]
    assert files.read_permutations(spark, str(tmp_path / "perms"), 2).first().labels == "10"


def test_glued_codes(spark):
    """Codes among runs of zeros, in a plan that doesn't grow with the samples; calls of unknown samples and nulls are zeros."""
    ids = [f"s{k}" for k in range(5000)]
    index = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "sample_id string, at long")
    rows = [("a", "s4999", 2), ("a", "s0", 1), ("a", "s1", 5), ("b", "gone", 1), ("c", "s7", None), ("c", "s9", 1)]
    calls = spark.createDataFrame(rows, "v string, sample_id string, code int")
    found = tools.glued(calls, index, len(ids), "v")
    want = {"a": "15" + "0" * 4997 + "2", "b": "0" * 5000, "c": "0" * 9 + "1" + "0" * 4990}
    assert {r.v: r.gt for r in found.collect()} == want
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 10_000
    with pytest.raises(Exception, match="two calls"):
        tools.glued(calls.unionByName(calls), index, len(ids), "v").collect()


def test_vcf_genotypes_do_not_travel(spark):
    """Genotypes are spelled out after the last exchange, or digested before the first one that they would pass."""
    calls = spark.createDataFrame([("chr1", 5, "A", "C", "a", 1), ("chr1", 5, "A", "C", "b", 2), ("chr1", 9, "AT", "A", "b", 5)], "chrom string, pos long, ref string, alt string, sample_id string, code int")
    models = spark.createDataFrame([("G", "T1", "chr1", 1, 5), ("G", "T2", "chr1", 5, 600)], "gene string, transcript string, chrom string, tx_start long, tx_end long")
    plain, short = (tools.vcf_matrix(calls, models, ["a", "b", "c"], digest) for digest in (None, F.md5))
    spelled = {(r.start, r.transcript): hashlib.md5(r.gt.encode()).hexdigest() for r in plain.collect()}
    assert len(spelled) == 3 and spelled == {(r.start, r.transcript): r.gt for r in short.collect()}
    for rows, mark in ((plain, "repeat("), (short, "md5(")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
        joins = [k for k, line in enumerate(plan) if "Join" in line]
        made = [k for k, line in enumerate(plan) if mark in line]
        assert len(made) == 1 and (made[0] < joins[0] if rows is plain else joins[0] < made[0] < [k for k, line in enumerate(plan) if "Aggregate" in line][0])
