"""The whole scan on the small tables, against plain loops."""

import math
from dataclasses import replace

import numpy as np
import plain_glm as glm
import pytest
from pyspark.sql import functions as F

from cohortspark.cohort import from_tables
from cohortspark.config import AssocConfig
from cohortspark.operators import filters as ops
from cohortspark.operators import grouped, products
from cohortspark.operators.dealing import CaseTree
from cohortspark.operators.products import SampleBlock
from cohortspark.plans import association as a
from cohortspark.plans import permutation as perm
from cohortspark.plans import reports as rp
from cohortspark.plans import resampling as rs
from cohortspark.plans import statistics as st
from cohortspark.sources import sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cohort(spark):
    c = from_tables(spark, SF)
    few = c.variants.where("gene in ('Brand#11', 'Brand#12', 'Brand#13')")
    out = type(c)(c.samples, few, c.calls.join(few.select("variant_id").distinct(), "variant_id", "left_semi"))
    out.__dict__["sizes"] = c.sizes
    return out


def counts_by_loop(cohort, labels):
    """Case alleles and case carriers of each variant, one label vector after the other."""
    calls = [(r.variant_id, r.sample_id, r.dosage) for r in cohort.calls.where("dosage > 0").collect()]
    out = []
    for y in labels:
        a, c = {}, {}
        for v, s, d in calls:
            if y[s]:
                a[v], c[v] = a.get(v, 0) + d, c.get(v, 0) + 1
        out.append((a, c))
    return out


def labels_of(plan, first, last):
    """The label vectors that the plan's blocks make, by sample."""
    spec, blocks = a.dealt_labels(plan, first, last, None)
    ids = {r.at: r.sample_id for r in plan.layout.index.select("at", "sample_id").collect()}
    out = [{} for _ in spec.perms]
    for row in range(blocks.count()):
        block = SampleBlock.of(blocks.toArrow(), row)
        for at, values in enumerate(block.labels(spec)):
            for k, y in enumerate(values):
                out[k][ids[block.number * products.BLOCK + at]] = float(y)
    return out


def test_hits_against_a_loop(cohort, monkeypatch):
    """WSS by blocks of 40 samples: labels, statistics and counts of successes against plain loops."""
    monkeypatch.setattr(products, "BLOCK", 40)
    config = AssocConfig(method="WSS", nperm=6, successes=100, seed=4)
    plan = a.make_plan(a.prepare(cohort, config), config, None, False)
    assert plan.layout.number == 4
    labels = labels_of(plan, 0, 6)
    n, cases = cohort.sizes
    assert {sum(y.values()) for y in labels} == {cases} and len({tuple(sorted(y.items())) for y in labels}) == 7
    assert labels[0] == {r.sample_id: r.y for r in cohort.samples.collect()}
    variants = [(r.gene, r.transcript, r.variant_id, r.ac) for r in ops.counted_variants(plan.cohort).collect()]
    want = {}
    for k, (alleles, _) in enumerate(counts_by_loop(plan.cohort, labels)):
        for g, t, v, ac in variants:
            f = (1 + ac) / (2 + 2 * n)
            want[g, t, k] = want.get((g, t, k), 0) + alleles.get(v, 0) / math.sqrt(f * (1 - f))
    got = {(r.gene, r.transcript, r.perm_id): r.stat for r in a.permuted_statistic(plan, 0, 6).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-6) for k in want)
    for r in a.scan(cohort, config).collect():
        group = [want[r.gene, r.transcript, k] for k in range(7)]
        assert r.successes == sum(x >= group[0] - 1e-9 for x in group[1:]) and r.permutations == 6


def test_covariates_against_a_loop(spark, cohort, monkeypatch):
    """SKAT with adjusted labels and refits against glm on the whole design."""
    monkeypatch.setattr(products, "BLOCK", 64)
    config = AssocConfig(method="SKAT", nperm=3, successes=100, seed=4, file_weights=True)
    null = grouped.null_model(grouped.design(cohort.samples, categorical=("cov_cat",)))
    ready = a.prepare(cohort, config)
    plan = a.make_plan(ready, config, null, True)
    labels = labels_of(plan, 0, 3)
    assert {sum(y.values()) for y in labels} == {cohort.sizes[1]}
    rows = null.samples.select("sample_id", "x").collect()
    x, ids = np.array([r.x for r in rows]), [r.sample_id for r in rows]
    calls = [(r.variant_id, r.sample_id, r.dosage) for r in ready.calls.collect()]
    got = {(r.gene, r.transcript, r.perm_id): r.stat for r in a.permuted_statistic(plan, 0, 3).collect()}
    for k, y in enumerate(labels):
        mu = glm.fit(x, np.array([y[i] for i in ids])).mu
        left = {i: y[i] - m for i, m in zip(ids, mu, strict=True)}
        z = {}
        for v, s, d in calls:
            z[v] = z.get(v, 0) + d * left[s]
        for (g, t), part in ready.variants.toPandas().groupby(["gene", "transcript"]):
            want = sum((w * z.get(v, 0)) ** 2 for v, w in zip(part["variant_id"], part["weight"], strict=True))
            assert math.isclose(got[g, t, k], want, rel_tol=1e-5, abs_tol=1e-9)
    regression = replace(config, method="RVT1")
    plan = a.make_plan(ready, regression, null, True)
    got = {(r.gene, r.transcript): r.stat for r in a.permuted_statistic(plan, 2, 2).collect()}
    y = labels_of(plan, 2, 2)[0]
    target = np.array([y[i] for i in ids])
    base = glm.fit(x, target).deviance
    for (g, t), part in ready.variants.toPandas().groupby(["gene", "transcript"]):
        own, share = set(part["variant_id"]), dict.fromkeys(ids, 0.0)
        for v, s, d in calls:
            if v in own and d:
                share[s] += 1 / len(part)
        want = base - glm.fit(np.column_stack((x, [share[i] for i in ids])), target).deviance
        assert math.isclose(got[g, t], want, rel_tol=1e-4, abs_tol=1e-6)


def test_quantitative(cohort):
    """Traits change places: permuted values are spread around the observed ones' law, and p is not constant."""
    config = AssocConfig(method="BURDEN", nperm=19, successes=100, seed=5, qtl=True, file_weights=True)
    plan = a.make_plan(a.prepare(cohort, config), config, None, False)
    traits = sorted(r.trait for r in cohort.samples.collect())
    assert all(np.allclose(sorted(y.values()), traits) for y in labels_of(plan, 0, 2))
    rows = a.scan(cohort, config).collect()
    closed = {(r.gene, r.transcript): r.burden for r in st.burden(plan.cohort, quantitative=True).collect()}
    assert all(math.isclose(r.stat, closed[r.gene, r.transcript], rel_tol=1e-6) for r in rows)
    assert len({r.empirical_p for r in rows}) > 1 and min(r.empirical_p for r in rows) < 0.9


def test_adjusted_quantitative_against_a_loop(cohort, monkeypatch):
    """Traits move inside bins of like odds only, across blocks; SKAT's hits equal those of plain fits."""
    monkeypatch.setattr(products, "BLOCK", 40)
    config = AssocConfig(method="SKAT", nperm=4, successes=100, seed=5, qtl=True, file_weights=True, bin_epsilon=0.02)
    null = grouped.null_model(grouped.design(cohort.samples, categorical=("cov_cat",)), True)
    ready = a.prepare(cohort, config)
    plan = a.make_plan(ready, config, null, True)
    labels = labels_of(plan, 0, 4)
    dealt, sizes, _ = rs.binned(rs.null_odds(null, True), config.bin_epsilon)
    bins = {r.sample_id: r.bin for r in dealt.collect()}
    assert 1 < len(sizes) < len(bins) and plan.layout.number == 4
    by_bin = lambda y: [sorted(round(t, 6) for i, t in y.items() if bins[i] == k) for k in range(len(sizes))]
    assert labels[0] == {r.sample_id: r.trait for r in cohort.samples.collect()}
    assert all(by_bin(y) == by_bin(labels[0]) and y != labels[0] for y in labels[1:])
    rows = null.samples.select("sample_id", "x").collect()
    x, ids = np.array([r.x for r in rows]), [r.sample_id for r in rows]
    calls = [(r.variant_id, r.sample_id, r.dosage) for r in ready.calls.collect()]
    got = {(r.gene, r.transcript, r.perm_id): r.stat for r in a.permuted_statistic(plan, 0, 4).collect()}
    for k, y in enumerate(labels):
        target = np.array([y[i] for i in ids])
        left = target - x @ np.linalg.lstsq(x, target, rcond=None)[0]
        s2, resid, z = (left @ left) / (len(ids) - np.linalg.matrix_rank(x)), dict(zip(ids, left, strict=True)), {}
        for v, s, d in calls:
            z[v] = z.get(v, 0) + d * resid[s]
        for (g, t), part in ready.variants.toPandas().groupby(["gene", "transcript"]):
            want = sum((w * z.get(v, 0)) ** 2 for v, w in zip(part["variant_id"], part["weight"], strict=True)) / s2
            assert math.isclose(got[g, t, k], want, rel_tol=1e-6, abs_tol=1e-9)
    for r in a.scan(cohort, config, categorical=("cov_cat",)).collect():
        group = [got[r.gene, r.transcript, k] for k in range(5)]
        assert r.successes == sum(v >= group[0] - 1e-9 for v in group[1:])


def test_biallelic_against_a_loop(cohort, monkeypatch):
    """Biallelic scores of permutations by the product, in blocks of 40 samples, against a loop over labels."""
    monkeypatch.setattr(products, "BLOCK", 40)
    config = AssocConfig(method="VAAST", nperm=11, successes=100, seed=3, biallelic=True, site_penalty=0.3, group_size=0, file_weights=True)
    ready = a.prepare(cohort, config)
    plan = a.make_plan(ready, config, None, False)
    labels, (n, cases) = labels_of(plan, 0, 11), cohort.sizes
    calls = ready.calls.where("dosage > 0").toPandas()
    got = {(r.gene, r.transcript, r.perm_id): r.stat for r in a.permuted_statistic(plan, 0, 11).collect()}

    def ratio(p, q, np_, nq):
        part = lambda alt, all_, f: sum(k * math.log(v) for k, v in ((alt, f), (all_ - alt, 1 - f)) if k)
        return 0.0 if p == 0 else part(q, nq, q / nq) + part(p, np_, p / np_) - part(p, np_, (p + q) / (np_ + nq)) - part(q, nq, (p + q) / (np_ + nq))

    doubles = 0
    for (g, t), part in ready.variants.toPandas().groupby(["gene", "transcript"]):
        weight = dict(zip(part["variant_id"], part["weight"], strict=True))
        mine = [(v, s, d) for v, s, d in zip(calls["variant_id"], calls["sample_id"], calls["dosage"], strict=True) if v in weight]
        for k, y in enumerate(labels):
            p, q, held = dict.fromkeys(weight, 0), dict.fromkeys(weight, 0), {}
            for v, s, d in mine:
                (p if y[s] else q)[v] += d
            score = {}
            for v, w in weight.items():
                raw = 2 * (ratio(p[v], q[v], 2 * cases, 2 * (n - cases)) + math.log(w)) if w > 0 and p[v] else 0.0
                score[v] = raw - 0.3 if raw > 0.3 else max(raw, 0.0)
            for v, s, d in mine:
                if score[v] > 0:
                    held[s] = held.get(s, 0) + d
            two = [s for s, d in held.items() if d > 1]
            doubles += len(two)
            in_cases = sum(y[s] for s in two)
            want = max(0.0, sum(score.values()) + ratio(in_cases, len(two) - in_cases, cases, n - cases))
            assert math.isclose(got[g, t, k], want, rel_tol=1e-6, abs_tol=1e-6), (g, t, k)
    assert doubles > 20
    seen = {(r.gene, r.transcript): r.stat for r in a.statistic(ready, config).collect()}
    assert all(math.isclose(got[g, t, 0], v, rel_tol=1e-6, abs_tol=1e-6) for (g, t), v in seen.items())


def test_tiles(cohort, monkeypatch):
    """SKATC permuted in tiles of one permutation equals that of whole blocks; a tile's cells stay within the bound."""
    config = AssocConfig(method="SKATC", nperm=3, seed=2, file_weights=True)
    null = grouped.null_model(grouped.design(cohort.samples, categorical=("cov_cat",)))
    plan = a.make_plan(a.prepare(cohort, config), config, null, True)
    whole = {(r.gene, r.transcript, r.perm_id): r.stat for r in a.permuted_statistic(plan, 0, 3).collect()}
    monkeypatch.setattr(a, "tile_size", lambda variants, perms: 1)
    tiles = {(r.gene, r.transcript, r.perm_id): r.stat for r in a.permuted_statistic(plan, 0, 3).collect()}
    assert whole.keys() == tiles.keys() and all(math.isclose(whole[k], tiles[k], rel_tol=1e-6, abs_tol=1e-9) for k in whole)
    monkeypatch.undo()
    for variants, perms in ((1, 10), (861, 256), (5_000, 256)):
        assert a.tile_size(variants, perms) == 1 or a.tile_size(variants, perms) * variants * (variants + 1) / 2 <= products.CELLS / 4


def test_external_file_ends_early(spark, cohort):
    """A file with fewer permutations than wanted ends the scan, without an error."""
    n, cases = cohort.sizes
    rows = [(k, "".join("1" if (i * 7 + k) % n < cases else "0" for i in range(n))) for k in range(1, 4)]
    labels = spark.createDataFrame(rows, "perm_id int, labels string")
    assert {r.permutations for r in a.scan(cohort, AssocConfig(method="WSS", nperm=50, successes=100), external=labels).collect()} == {3}


def test_bayesian_fallback(spark):
    """Labels that a covariate separates get a finite fit."""
    rows = [(k, k, int(k < 10), 0.0, [1.0, float(k < 10)]) for k in range(20)]
    samples = spark.createDataFrame(rows, "sample_id int, at long, y int, trait double, x array<double>")
    blocks = products.sample_blocks(samples)
    spec = products.Labels(1, 0, 0, CaseTree(np.array([20]), np.ones(1), np.array([0, 1]), 10), np.array([0, 20]))
    beta, info, loss = products.refit(blocks, spec, np.array([0.0, 0.0]))
    assert np.isfinite(beta).all() and np.isfinite(info).all() and 0 <= loss[0] < 2


def test_scan(cohort):
    rows = a.scan(cohort, AssocConfig(method="CALPHA", nperm=4, max_perms=8, successes=3, seed=2)).collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) > 2
    for r in rows:
        assert 0 < r.empirical_p <= 1 and r.empirical_p_low <= r.empirical_p_high and r.permutations <= 8 and 0 < r.mgit_p <= 1
    assert len({(r.gene, r.permutations) for r in rows}) == len({r.gene for r in rows})


@pytest.mark.parametrize("method", ["VT", "CMC", "CMC1df", "BURDEN", "SKAT", "RVT2", "VAAST"])
def test_methods(cohort, method):
    config = AssocConfig(method=method, nperm=0, site_penalty=0.2, file_weights=True)
    assert a.scan(cohort, config).count() == cohort.variants.select("gene", "transcript").distinct().count()


def test_options(cohort):
    config = AssocConfig(method="WSS", nperm=0, whole_gene=True, var_collapsing=3, ma_count=True, maf=0.4)
    rows = a.scan(cohort, config).collect()
    assert {r.transcript for r in rows} == {r.gene for r in rows}
    with pytest.raises(ValueError, match="unknown method"):
        AssocConfig(method="X")
    with pytest.raises(ValueError, match="quantitative"):
        AssocConfig(method="VAAST", qtl=True)
    assert AssocConfig(nperm=10, max_perms=4).block == 4


@pytest.mark.parametrize("option", [{"kernel": "x"}, {"hotellings": True}, {"biallelic": True}])
def test_options_that_a_method_cannot_follow(option):
    with pytest.raises(ValueError):
        a.scan(None, AssocConfig(method="SKAT", **option))


def test_thresholds_and_permuted_methods(cohort):
    rows = a.scan(cohort, AssocConfig(method="CMC", hotellings=True, nperm=30, pthresh=0.2, seed=6)).collect()
    assert all(r.permutations > 10 for r in rows)
    for method in ("SKATC", "VT"):
        assert all(0 < r.empirical_p <= 1 for r in a.scan(cohort, AssocConfig(method=method, nperm=4, seed=6)).collect())


def test_detail_after_collapsing(cohort):
    fewest = sorted(r.ac for r in ops.counted_variants(cohort).select("variant_id", "gene", "ac").distinct().collect())
    ready = a.prepare(cohort, AssocConfig(method="WSS", nperm=0, var_collapsing=fewest[len(fewest) // 2]))
    n, cases = cohort.sizes
    rows = [r for r in rp.detail(ready).collect() if r.variant.endswith("Collapsed")]
    assert rows
    for r in rows:
        carriers = [x for c in (r.case_list, r.control_list) if c != "-" for x in c.split(",")]
        assert r.case_alt + r.control_alt == len(carriers) and r.case_ref + r.case_alt == cases and r.control_ref + r.control_alt == n - cases


def test_outputs(spark, cohort, tmp_path):
    """Permuted statistics, the testability filter and the files."""
    config = AssocConfig(method="WSS", nperm=5, successes=100, seed=4, output_stats=True)
    result = a.scan(cohort, config)
    assert all(len(r.stats) == 5 and r.successes == sum(x >= round(r.stat, 9) for x in r.stats) for r in result.collect())
    reach = a.scan(cohort, replace(config, testable=0.9)).count()
    assert reach == result.count() and a.scan(cohort, replace(config, testable=0.0)).count() == 0
    sinks.write_stats(result, str(tmp_path / "stats"))
    assert spark.read.text(str(tmp_path / "stats")).count() == 1 + result.count()
    report = rp.ordered_report(rp.carrier_report(cohort), result)
    sinks.write_report(report, rp.sample_index(cohort), str(tmp_path / "report"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert lines.count("## Sample Index Map") == 1 and sum(x.startswith("#\t") for x in lines) == cohort.sizes[0]
    assert sum(not x.startswith("#") for x in lines) == report.count() > 0
    sinks.write_power(rs.power(cohort, 3, 20, 20), str(tmp_path / "power"))
    sinks.write_effects(rs.effect_sizes(cohort, 5), str(tmp_path / "effects"))
    assert spark.read.text(str(tmp_path / "effects")).where("value like 'Gene%OR%'").count() == 1


def test_shards():
    assert perm.shard_ranges(10, 7, 3) == [(1, 3, 2), (4, 6, 2), (7, 10, 3)] and perm.shard_ranges(2, 1, 5)[-1][1] == 2


def test_plot_tables(spark, cohort):
    p = spark.createDataFrame([("g", "t", 0.1), ("h", "t", 0.01)], "gene string, transcript string, p double")
    assert [(round(r.observed, 6), round(r.expected, 6)) for r in rp.quantiles(p).orderBy("gene").collect()] == [(1.0, round(-math.log10(0.75), 6)), (2.0, round(-math.log10(0.25), 6))]
    assert rp.power_curve(rs.power(cohort, 2, 20, 20)).where("samples = 40").count() > 0


@pytest.mark.parametrize("options", [{"method": "SKAT", "file_weights": True}, {"method": "CALPHA"}, {"method": "BURDEN", "file_weights": True}, {"method": "CMC1df"}, {"method": "VAAST"}, {"method": "VAAST", "biallelic": True}], ids=str)
def test_counts_in_tiles(cohort, monkeypatch, options):
    """The same values when a task holds only a few cells of a group's counts and adds only a few up."""
    config = AssocConfig(nperm=5, successes=100, seed=4, site_penalty=0.5, **options)

    def found():
        plan = a.make_plan(a.prepare(cohort, config), config, None, False)
        plan.__dict__["largest"] = 100_000_000  # does not cut the blocks of permutations
        size = a.block_size(plan)
        plan.__dict__["largest"] = 8
        return size, {(r.gene, r.transcript, r.perm_id): r.stat for r in a.permuted_statistic(plan, 0, 5).collect()}

    want = found()
    monkeypatch.setattr(products, "BLOCK", 40)
    monkeypatch.setattr(products, "ADDED", 32)
    monkeypatch.setattr(a, "TILE", 16)
    # Labels depend on the blocks of samples; the observed ones do not.
    got = found()
    assert want[0] == got[0] == 5 and got[1].keys() == want[1].keys()
    first = [k for k in want[1] if k[2] == 0]
    assert np.allclose([got[1][k] for k in first], [want[1][k] for k in first])
    monkeypatch.setattr(a, "TILE", 1 << 21)
    whole = found()[1]
    assert np.allclose([got[1][k] for k in sorted(got[1])], [whole[k] for k in sorted(got[1])])


def test_whole_numbers_travel_narrow():
    rows = np.array([[0.0, 3.0], [255.0, 1.0]])
    assert [len(x) for x in products.narrow(rows).to_pylist()] == [3, 3]
    assert [len(x) for x in products.narrow(rows + 0.5).to_pylist()] == [17, 17] and [len(x) for x in products.narrow(-rows).to_pylist()] == [17, 17]


def test_collapsed_calls_bear_numbers(spark, cohort):
    """The scan's collapsed calls hold numbers, not keys as text, and equal those of the keyed form, merged ones too."""
    variants, calls = ops.collapse_rare(cohort, 2)
    want = sorted((r.variant_key, r.sample_id, r.dosage, r.missing) for r in calls.collect())
    again = lambda df: df.unionByName(df.where("variant_id % 7 = 0").withColumn("variant_id", -F.col("variant_id")))
    for c in (cohort, type(cohort)(cohort.samples, again(cohort.variants), again(cohort.calls))):
        c.__dict__["sizes"] = cohort.sizes
        numbered, got = ops.collapse_rare(c, 2, numbers=True)
        assert dict(got.dtypes)["variant_id"] == "bigint" and numbered.count() == variants.count()
        assert want == sorted((r.variant_key, r.sample_id, r.dosage, r.missing) for r in got.join(numbered.select("variant_id", "variant_key"), "variant_id").collect())
    ready = a.prepare(cohort, AssocConfig(method="WSS", nperm=0, var_collapsing=2, ma_count=False))
    assert dict(ready.calls.dtypes)["variant_id"] == "bigint" and "l_orderkey" not in ready.calls._jdf.queryExecution().optimizedPlan().toString()


def test_regressions_pack_their_columns_once(spark, cohort, monkeypatch):
    """A regression packs no columns of variants or burdens, and its own once for all blocks of permutations."""
    made, pack = [], products.Layout.columns

    def counted(self, entries, keys):
        made.append(tuple(keys))
        return pack(self, entries, keys)

    monkeypatch.setattr(products.Layout, "columns", counted)
    monkeypatch.setattr(a, "block_size", lambda plan: 2)
    config = AssocConfig(method="RVT1", nperm=4, successes=5, seed=3)
    assert a.scan(cohort, config, categorical=("cov_cat",)).count() > 0
    assert made == [tuple(grouped.KEYS)]
