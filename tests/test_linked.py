"""Pairs of variants that share a sample, summed by blocks of samples, against matrices."""

import math

import numpy as np
import pytest

from cohortspark.cohort import from_tables
from cohortspark.functions import kernels, spectra
from cohortspark.operators import grouped, linked, products
from cohortspark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("at_a_time", [1, 7, 1 << 22])
def test_pairs_by_pieces(monkeypatch, at_a_time):
    """Pairs made a few at a time equal the whole product; a sample with many variants and variants without calls among them."""
    monkeypatch.setattr(linked, "PAIRS", at_a_time)
    rng = np.random.default_rng(4)
    g = (rng.random((40, 12)) < 0.2) * rng.integers(1, 3, (40, 12))
    g[7], g[:, 3] = 1, 0
    v = rng.random((40, 3))
    pos, column = np.nonzero(g)
    keys, cells = linked.linked(column, pos, g[pos, column].astype(float), 12, v)
    assert len(np.unique(keys)) == len(keys) and (keys // 12 <= keys % 12).all()
    for k in range(3):
        r = np.zeros((12, 12))
        r[keys // 12, keys % 12] = r[keys % 12, keys // 12] = cells[k]
        assert np.allclose(r, g.T @ (v[:, [k]] * g))


def test_blocks_add_up(spark, monkeypatch):
    """Sums of several blocks of samples and tiles of null models are those of one block."""
    c = from_tables(spark, SF)
    null = grouped.null_model(grouped.design(c.samples, categorical=("cov_cat",)))
    want = ("skat_p", "skato_p", "burden_p")
    one = {(r.gene, r.transcript): r for r in grouped.score_tests(c, null, want=want).collect()}
    monkeypatch.setattr(products, "BLOCK", 40)
    layout = products.lay_out(null.samples.select("sample_id", "y", "trait", "x", "u0", "v"), c.sizes[1], 1)
    assert layout.number == 4
    members, columns = grouped.gene_columns(c.variants.select("gene", "transcript", "variant_id", "weight"), c.calls, layout)
    both = lambda s: (np.column_stack([s.u0] * 3), np.column_stack((s.v, s.v * 2, s.v * 3)))
    sums = linked.gene_sums(columns, layout, both, 3, 2).toArrow()
    for gene, part in {(r.gene, r.transcript) for r in c.variants.select("gene", "transcript").collect()}:
        mine = [r for r in members.where(f"gene = '{gene}' and transcript = '{part}'").collect()]
        slots, weight = np.array([r.slot for r in mine]), np.array([r.weight for r in mine])
        for tile, models in ((0, (1, 2)), (1, (3,))):
            rows = sums.filter((np.array(sums.column("gene").to_pylist()) == gene) & (np.array(sums.column("tile").to_pylist()) == tile))
            if not rows.num_rows:
                assert (gene, part) not in one
                continue
            w, found, i, j, cross = linked.group_sums(rows, slots, weight, 1 + len(null.inverse))
            assert found.shape[0] == len(models)
            if not len(w):
                assert (gene, part) not in one
                continue
            for k, times in enumerate(models):
                assert np.allclose(cross[k], cross[0] / models[0] * times)
                r = grouped.paired(i, j, cross[k] / times, found[k, 1:].T / times, w, null.inverse)
                p = grouped.score_row(w * found[k, 0], r, want, False)
                assert all(math.isclose(x, one[gene, part][c], rel_tol=1e-6, abs_tol=1e-12) for x, c in zip(p, want, strict=True))


def test_a_large_group_has_no_matrix():
    """From some hundred variants on a null model's covariance is held as pairs, and its p is that of the matrix."""
    rng = np.random.default_rng(6)
    n = 600
    column = np.repeat(np.arange(n), 8)
    pos = rng.integers(0, 2_000, len(column))
    order = np.argsort(pos, kind="stable")
    keys, cells = linked.linked(column[order], pos[order], np.ones(len(pos)), n, np.full((2_000, 1), 0.24))
    xv, w = np.bincount(column, minlength=n)[:, None] * 0.24, rng.uniform(0.5, 1.5, n)
    inverse = np.array([[1 / (2_000 * 0.24)]])
    r = grouped.paired(keys // n, keys % n, cells[0], xv, w, inverse)
    assert isinstance(r, spectra.Spectra)
    plain = np.zeros((n, n))
    plain[keys // n, keys % n] = plain[keys % n, keys // n] = cells[0]
    plain = (plain - xv @ inverse @ xv.T) * np.outer(w, w)
    z = rng.normal(size=n) * np.sqrt(np.diag(plain)) * 1.05
    assert math.isclose(kernels.skato_p(z, r), kernels.skato_p(z, plain), rel_tol=2e-6)


def test_skato_is_permuted_as_often_as_other_scans(spark):
    """Every group meets as many permutations as in the other adjusted scans, and its p can be small."""
    rows = QUERIES["scan_skato_permuted"](spark, SF).collect()
    assert rows and max(r.permutations for r in rows) == 20
    assert all(r.permutations == 20 or r.mgit_successes >= 8 or r.successes >= 8 or any(o.gene == r.gene and o.successes >= 8 for o in rows) for r in rows)


def test_counts_by_gene(spark, monkeypatch):
    """Counts of blocks, pieces of genes and tiles of labels add up to those of all calls, in a byte or two a cell."""
    c = from_tables(spark, SF)
    monkeypatch.setattr(products, "BLOCK", 40)
    layout = products.lay_out(c.samples.select("sample_id", "y", "trait"), c.sizes[1], 1)
    spec = layout.base.part(0, 8)
    members, columns = grouped.gene_columns(c.variants.select("gene", "transcript", "variant_id", "weight"), c.calls, layout)

    def sums(s, table):
        return {"a": products.column_sums(table.column("pos"), table.column("value"), s.labels(spec), lambda v: v[None])[:, 0]}

    rows, tasks = linked.gene_counts(columns, layout, sums, ["a"], 9, 4, 2)
    rows = rows.toArrow()
    assert tasks >= layout.number and set(rows.column("tile").to_pylist()) == set(range(5))
    cells = sum(len(x) // 4 for x in rows.column("slot").to_pylist()) * 9 / 5
    assert sum(len(x) - 1 for x in rows.column("a").to_pylist()) < 2.1 * cells
    case_ac = {}
    for r in c.calls.join(c.samples.select("sample_id", "y"), "sample_id").where("dosage > 0").collect():
        case_ac[r.variant_id] = case_ac.get(r.variant_id, 0) + r.dosage * r.y
    slots = {(r.gene, r.slot): r.variant_id for r in members.collect()}
    seen = set()
    for gene in set(rows.column("gene").to_pylist()):
        mine = rows.filter((np.array(rows.column("gene").to_pylist()) == gene) & (np.array(rows.column("tile").to_pylist()) == 0))
        known, found = linked.counts_of(mine, ["a"])
        assert found["a"].dtype == np.uint32 and (np.diff(known) > 0).all()
        for slot, a in zip(known, found["a"][:, 0], strict=True):  # the labels as observed
            assert a == case_ac[slots[gene, slot]]
            seen.add(slots[gene, slot])
    assert seen == set(case_ac) & set(slots.values())
