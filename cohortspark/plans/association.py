"""The association scan: filters, a method, permutations in blocks, and the ranked result.

A block of permutations is one plan: label sums of all columns (`operators.products`), then one task for each group, which
works out the statistic for the whole block (`functions.batch`).  Permutation 0 holds the observed labels, so that observed
and permuted values come from the same arithmetic.  With covariates labels are dealt by each sample's odds, and score and
regression methods meet a null model fitted anew to every permutation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cohort import Cohort
from ..config import AssocConfig
from ..functions import batch
from ..functions.special import poisson_ci
from ..operators import filters as ops
from ..operators import grouped
from ..operators.products import CELLS, Labels, Layout, SampleBlock, both_counts, column_sums, lay_out, product, refit, refit_linear, routed_traits
from ..streaming.blocks import persist
from . import permutation as perm
from . import resampling as rs
from . import statistics as st
from . import tools
from .reports import ranked
from .statistics import GROUP

SCORED = frozenset({"BURDEN", "SKAT", "SKATO", "SKATC"})
REGRESSED = frozenset({"RVT1", "RVT2"})
CARRIED = frozenset({"CMC1df", "RVT2"})  # statistics of a group's carriers alone
WHOLE = CARRIED | {"BURDEN", "CMC"}  # statistics that take a group's carriers or burdens
TILE = 1 << 21  # cells of a group's counts that a task works on at once
HELD = 1 << 24  # cells of a gene's counts that a task holds, as they travel
PIECE = 1_024  # a gene's variants that travel in one row
USED = {"WSS": ("ac",), "SKAT": ("ac", "weight"), "CALPHA": ("carriers",), "VT": ("ac", "ac2"), "VAAST": ("ac", "weight")}  # of a variant


def check(config: AssocConfig) -> None:
    """An error for options that the method cannot honour."""
    if config.hotellings and config.method != "CMC":
        raise ValueError("hotellings is an option of CMC")
    if config.kernel not in ("Linear", "wLinear"):
        raise ValueError("kernel is 'Linear' or 'wLinear'")
    if config.biallelic and config.method != "VAAST":
        raise ValueError("biallelic is an option of VAAST")
    if config.qtl and config.method == "VT" and config.nperm:
        raise ValueError("VT is permuted for binary status only")
    if config.testable is not None and (config.method not in batch.COUNTED or not config.nperm or config.biallelic or config.hotellings or config.qtl):
        raise ValueError(f"testable needs permutations of {', '.join(batch.COUNTED)}")


def prepare(cohort: Cohort, config: AssocConfig, allowed: DataFrame | None = None, mask: DataFrame | None = None) -> Cohort:
    """The cohort after mask, whitelist, whole-gene union, imputation, minor-allele flip, collapsing, frequency filters, gate
    and weights.

    Calls are made once and kept: every step reads them twice, to count and to change them.
    """
    variants = cohort.variants
    if mask is not None:
        variants = ops.bed_mask(variants, mask)
    if allowed is not None:
        variants = ops.whitelist(variants, allowed, config.method)
    if config.whole_gene:
        variants = ops.whole_gene(variants).drop("variant_key")
    now = with_sizes(Cohort(cohort.samples, variants, persist(cohort.calls)), cohort)
    if config.impute is not None:
        now = with_sizes(Cohort(now.samples, now.variants, persist(ops.impute(now, config.impute))), cohort)
    if config.ma_count:
        flipped = ops.flip_calls(now)
        now = with_sizes(Cohort(flipped.samples, flipped.variants, persist(flipped.calls)), cohort)
    if config.var_collapsing is not None:
        merged, calls = ops.collapse_rare(now, config.var_collapsing, numbers=True)
        now = with_sizes(Cohort(now.samples, merged, persist(calls)), cohort)
    n, _ = cohort.sizes
    counted = ops.counted_variants(now)
    kept = ops.maf_filter(counted, n, config.mac, config.maf) if config.ma_count else ops.aaf_filter(counted, n, config.mac, config.maf)
    if config.no_weights:
        kept = kept.withColumn("weight", F.lit(1.0))
    elif config.method in SCORED and config.kernel == "wLinear" and not config.file_weights:
        kept = kept.withColumn("weight", ops.beta_weight(F.col("ac") / (2.0 * n), *config.beta_weights))
    gate = ops.polymorphic(kept, config.min_minor_allele_count, config.min_variant_count).where("kept").select(*GROUP)
    left = persist(kept.join(gate, list(GROUP), "left_semi").select(*now.variants.columns))
    calls = persist(now.calls.join(left.select("variant_id").distinct(), "variant_id", "left_semi"))
    return with_sizes(Cohort(now.samples, left, calls), cohort)


def with_sizes(cohort: Cohort, like: Cohort) -> Cohort:
    """cohort, known to have the samples of another one."""
    cohort.__dict__["sizes"] = like.sizes
    return cohort


def statistic(cohort: Cohort, config: AssocConfig) -> DataFrame:
    """(gene, transcript, stat[, p]) of the method without permutations and covariates."""
    named = lambda df, stat, p=None: df.select(*GROUP, F.col(stat).alias("stat"), *([F.col(p).alias("p")] if p else []))
    match config.method:
        case "CALPHA":
            return named(st.calpha(cohort), "calpha")
        case "WSS":
            return named(st.wss(cohort), "wss")
        case "VT":
            return named(st.variable_threshold(cohort), "vt")
        case "CMC" if config.hotellings:
            return named(grouped.hotelling(cohort, config.cmcmaf), "t2", "p")
        case "CMC":
            return named(st.cmc_chisq(cohort, config.cmcmaf), "cmc", "p")
        case "CMC1df":
            return named(st.odds_ratio(cohort), "odds_ratio").join(st.fisher_one_sided(cohort), list(GROUP))
        case "VAAST":
            if config.biallelic:
                return named(st.vaast_biallelic(cohort, config.site_penalty, config.soft_maf_filter), "vaast")
            if config.group_size:
                whole = grouped.vaast_grouped(cohort, config.group_size, config.soft_maf_filter, config.site_penalty, config.grouping == "by_type")
                return whole.groupBy(*GROUP).agg(F.first("vaast").alias("stat"))
            return named(st.vaast(cohort, config.site_penalty, config.soft_maf_filter), "vaast")
    return analytic(cohort, config, grouped.null_model(grouped.design(cohort.samples), config.qtl, config.optimizer))


def analytic(cohort: Cohort, config: AssocConfig, null: grouped.Null) -> DataFrame:
    """(gene, transcript, p) of a method beside a null model."""
    if config.method in REGRESSED:
        return grouped.regression_tests(cohort, null, config.qtl).select(*GROUP, F.col(config.method.lower() + "_p").alias("p"))
    column = {"BURDEN": "burden_p", "SKAT": "skat_p", "SKATO": "skato_p", "SKATC": "skatc_p"}[config.method]
    return grouped.score_tests(cohort, null, config.saddlepoint, (column,)).withColumnRenamed(column, "p")


def covariate_scan(cohort: Cohort, config: AssocConfig, numeric: tuple[str, ...] = (), categorical: tuple[str, ...] = ()) -> DataFrame:
    """Ranked analytic p-values of a method with covariates."""
    return scan(cohort, replace(config, nperm=0), numeric=numeric, categorical=categorical)


# Permutations in blocks.


@dataclass(frozen=True)
class Plan:
    """What all blocks of a scan share: the cohort, samples laid out, packed columns of variants and of groups (made for the
    methods that ask for them)."""

    cohort: Cohort
    config: AssocConfig
    layout: Layout
    shown: Cohort  # whose variants the method takes
    attributes: DataFrame
    null: grouped.Null | None
    largest: int

    @cached_property
    def variants(self) -> DataFrame:
        known = self.shown.variants.select("variant_id").distinct()
        held = self.shown.calls.where("dosage > 0").join(known, "variant_id", "left_semi")
        return self.layout.columns(held.select("variant_id", "sample_id", F.col("dosage").alias("value")), ["variant_id"])

    @cached_property
    def groups(self) -> DataFrame:
        burdens = st.carriers(self.cohort).select(*GROUP, "sample_id", F.col("burden").alias("value"))
        return self.layout.columns(burdens, list(GROUP))

    @cached_property
    def regressors(self) -> DataFrame:
        """Packed columns of the regression's variable, of all genes."""
        return self.layout.columns(grouped.regression_columns(self.cohort, (self.config.method.lower(),)), grouped.KEYS)

    @cached_property
    def slots(self) -> DataFrame:
        """(gene, transcript, variant_id, slot): variants with their number in the gene."""
        return persist(self.attributes.select(*GROUP, "variant_id").join(self.gene_slots, ["gene", "variant_id"]).select(*GROUP, "variant_id", "slot"))

    @cached_property
    def columns(self) -> DataFrame:
        """Packed columns (gene, slot, block, pos, value) of the variants of genes."""
        return self.variants.join(self.gene_slots, "variant_id").select("gene", "slot", "block", "pos", "value")

    @cached_property
    def genes(self) -> tuple[int, int]:
        """How many genes there are, and the variants of the largest."""
        row = self.gene_slots.agg(F.count_distinct("gene").alias("genes"), F.max("slot").alias("last")).first()
        return row.genes or 1, (row["last"] or 0) + 1

    @cached_property
    def gene_slots(self) -> DataFrame:
        """(gene, variant_id, slot): variants numbered in their gene."""
        return grouped.numbered_in_gene(self.attributes)

    @cached_property
    def doubles(self) -> DataFrame:
        """(gene, transcript, block, pos, ends, slot, dose): the samples with two alleles or more at a group's variants, by
        block; slot and dose list what they carry, ends where a sample's part ends."""
        size = self.layout.base.rows
        held = self.cohort.calls.where("dosage > 0").select("variant_id", "sample_id", F.col("dosage").cast("double").alias("dose"))
        each = held.join(self.slots, "variant_id").groupBy(*GROUP, "sample_id").agg(F.sum("dose").alias("all"), F.array_sort(F.collect_list(F.struct("slot", "dose"))).alias("c")).where("all > 1")
        placed = each.join(self.layout.index.select("sample_id", "at"), "sample_id").select(*GROUP, F.floor(F.col("at") / size).cast("int").alias("block"), F.struct(F.pmod("at", F.lit(size)).cast("int").alias("pos"), "c").alias("s"))
        rows = placed.groupBy(*GROUP, "block").agg(F.array_sort(F.collect_list("s")).alias("s"))
        cells, ends = F.flatten(F.transform("s", lambda s: s.c)), F.transform("s", lambda s: F.size(s.c))
        return persist(rows.select(*GROUP, "block", F.col("s.pos").alias("pos"), ends.alias("sizes"), F.transform(cells, lambda c: c.slot).alias("slot"), F.transform(cells, lambda c: c.dose).alias("dose")))

    @property
    def adjusted(self) -> bool:
        """Whether the method meets a null model that is fitted to every permutation."""
        return self.null is not None and self.config.method in SCORED | REGRESSED


def make_plan(ready: Cohort, config: AssocConfig, null: grouped.Null | None, adjust: bool) -> Plan:
    n, cases = ready.sizes
    samples, means = (null.samples if null is not None else ready.samples), None
    if null is not None and adjust:
        dealt, _, means = rs.binned(rs.null_odds(null, config.qtl), config.bin_epsilon)
        samples = samples.join(dealt, "sample_id")
    names = ["sample_id", "y", "trait", *(["x"] if null is not None else []), *(["bin"] if means is not None else [])]
    layout = lay_out(samples.select(*names), cases, config.seed, config.qtl, means)
    shown = grouped.hotelling_cohort(ready, config.cmcmaf) if config.hotellings else ready
    counted = ops.counted_variants(shown)
    key = ops.variant_key() if set(shown.variants.columns) >= set(ops.LOCUS) else F.col("variant_id").cast("string")
    sums = [F.col(c).cast("double").alias(c) for c in ("ac", "ac2", "carriers", "weight")]
    attributes = persist(counted.select(*GROUP, "variant_id", *sums, "type", key.alias("key")))
    largest = attributes.groupBy(*GROUP).count().agg(F.max("count")).first()[0] or 1
    return Plan(ready, config, layout, shown, attributes, null, largest)


def block_size(plan: Plan) -> int:
    """Permutations in a block: as wanted, as long as a block's labels stay below CELLS."""
    rows = max(min(plan.cohort.sizes[0], plan.layout.base.rows), 1)
    return max(1, min(plan.config.block, CELLS // (4 if plan.config.qtl else 1) // rows))  # routed traits are rows of Spark


def dealt_labels(plan: Plan, first: int, last: int, external: DataFrame | None) -> tuple[Labels, DataFrame]:
    """The labels of a block of permutations, and the blocks of samples (with the given labels, if they come from a file)."""
    spec, blocks = plan.layout.base.part(first, last), plan.layout.blocks
    start = max(1, first)
    if external is not None:
        cut = external.where(F.col("perm_id").between(start, last))
        pieces = cut.select("perm_id", F.explode(F.sequence(F.lit(0), F.lit(plan.layout.number - 1))).alias("block"), "labels")
        piece = F.substring("labels", F.col("block") * spec.rows + 1, F.lit(spec.rows))
        given = pieces.select("block", "perm_id", piece.alias("labels")).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("perm_id", "labels"))).alias("g"))
        blocks = persist(blocks.join(given.select("block", F.transform("g", lambda g: g.labels).alias("given")), "block"))
    elif plan.config.qtl and last >= start:
        blocks = routed_traits(blocks, spec)
    return spec, blocks


def permuted_statistic(plan: Plan, first: int, last: int, genes: DataFrame | None = None, external: DataFrame | None = None) -> DataFrame:
    """(gene, transcript, perm_id, stat) of permutations first to last; the more extreme, the larger stat is."""
    spec, blocks = dealt_labels(plan, first, last, external)
    only = lambda df: df.join(genes, "gene", "left_semi") if genes is not None else df
    if plan.config.method in REGRESSED and (plan.null is not None or plan.config.method == "RVT1" or plan.config.qtl):
        return regressed(plan, spec, blocks, only)
    if plan.config.method in ("SKATO", "SKATC"):
        return covariance_tests(plan, spec, blocks, only)
    if plan.config.biallelic:
        return biallelic(plan, spec, blocks, only)
    if plan.config.method in WHOLE:
        return counted(plan, spec, blocks, only)
    return gene_by_gene(plan, spec, blocks, only)


def null_of(plan: Plan, spec: Labels, blocks: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Coefficients, deviance and information of the null models of a block of permutations."""
    k = 1 if plan.null is None else len(plan.null.beta)
    if plan.config.qtl:
        beta, dev = refit_linear(blocks, spec, k)
        return beta, dev, None
    n, cases = plan.cohort.sizes
    start = plan.null.beta if plan.null is not None else np.array([math.log(cases / max(n - cases, 1e-9))])
    beta, info, dev = refit(blocks, spec, start)
    return beta, dev, info


def rank_of(plan: Plan) -> int:
    return plan.null.rank if plan.null is not None else 1


def fitted(s: SampleBlock, beta: np.ndarray, quantitative: bool) -> np.ndarray:
    eta = s.x @ beta.T
    return eta if quantitative else 1 / (1 + np.exp(-np.clip(eta, -30, 30)))


def counted(plan: Plan, spec: Labels, blocks: DataFrame, only) -> DataFrame:
    """Statistics of variants' case sums, or of their scores against a null model.

    A task holds a tile, some permutations of a group: the more variants the group has, the fewer permutations, so that a
    tile's counts stay below TILE.
    """
    config, (n, cases) = plan.config, plan.cohort.sizes
    names = ["a", "c"] if config.method == "CALPHA" else ["a"]
    scored = config.method in SCORED and (plan.null is not None or config.qtl)
    null = null_of(plan, spec, blocks) if scored else None
    quantitative = config.qtl
    used = only(plan.attributes).select("variant_id").distinct()

    def sums(s: SampleBlock, table: pa.Table) -> dict[str, np.ndarray]:
        y = s.labels(spec)
        if null is not None:
            y = y - fitted(s, null[0], quantitative)
        found = column_sums(table.column("pos"), table.column("value"), y, both_counts if "c" in names else lambda v: v[None])
        return {c: found[:, k] for k, c in enumerate(names)}

    def group_sums(s: SampleBlock, table: pa.Table) -> dict[str, np.ndarray]:
        """Case carriers; with a null model the parts of the variance of the burden's score."""
        y, pos, value = s.labels(spec), table.column("pos"), table.column("value")
        ones = lambda v: np.ones((1, len(v)))
        held = column_sums(pos, value, np.ones((len(y), 1)), lambda v: np.vstack((v > 0, v, v * v)))
        out = {"a": column_sums(pos, value, y, ones)[:, 0], "c": held[:, :, 0]}
        if null is not None:
            v = np.ones((len(y), y.shape[1])) if quantitative else np.maximum((mu := fitted(s, null[0], False)) * (1 - mu), 1e-10)
            parts = [column_sums(pos, value, v, lambda b: (b * b)[None])[:, 0]]
            parts += [column_sums(pos, value, v * s.x[:, [k]], lambda b: b[None])[:, 0] for k in range(s.x.shape[1])]
            out["a"] = np.concatenate(parts, axis=1)
        return out

    # A variant's sums meet its groups; a group's own sums come as one more row without a variant.
    perms, b = np.array(spec.perms), len(spec.perms)
    each = max(1, min(b, TILE // plan.largest))
    tiles = F.explode(F.sequence(F.lit(0), F.lit(-(-b // each) - 1))).alias("tile")
    cut = lambda c: F.substring(c, F.col("tile") * (8 * each) + 1, F.lit(8 * each)).alias(c)
    rows = None
    if config.method not in CARRIED:
        by_variant = product(plan.variants.join(used, "variant_id", "left_semi"), blocks, plan.layout.number, ["variant_id"], sums, names, b * len(names))
        rows = only(plan.attributes).join(by_variant, "variant_id").select("*", tiles)
        rows = rows.select(*plan.attributes.columns, "tile", *map(cut, names))
    if config.method in WHOLE:
        own = product(only(plan.groups), blocks, plan.layout.number, list(GROUP), group_sums, ["a", "c"]).select(*GROUP, "a", "c", tiles)
        own = own.select(*GROUP, "tile", F.col("a").alias("own"), F.col("c").alias("held"))
        rows = only(plan.attributes).limit(0).unionByName(own, allowMissingColumns=True) if rows is None else rows.unionByName(own, allowMissingColumns=True)
    whole = rows
    s2 = None
    inverse = None
    if null is not None:
        k = null[0].shape[1]
        s2 = null[1] / max(1.0, n - rank_of(plan)) if quantitative else np.ones(b)
        inverse = np.broadcast_to(plan.null.inverse if plan.null is not None else np.array([[1.0 / n]]), (b, k, k)) if quantitative else np.linalg.pinv(null[2], hermitian=True)
    scatter = grouped.variant_pairs(grouped.hotelling_cohort(plan.cohort, config.cmcmaf)) if config.hotellings else None

    def work(group: pa.Table, pairs: pa.Table | None = None) -> pa.Table:
        empty = pa.table({"gene": pa.array([], pa.string()), "transcript": pa.array([], pa.string()), "perm_id": pa.array([], pa.int32()), "stat": pa.array([], pa.float64())})
        if not group.num_rows:
            return empty
        single = group.filter(pc.is_valid(group.column("key")))
        if not single.num_rows and config.method not in CARRIED:
            return empty
        first = group.column("tile")[0].as_py() * each
        part = slice(first, min(first + each, b))
        own_rows = group.filter(pc.is_valid(group.column("own"))) if "own" in group.column_names else group.slice(0, 0)

        def read(c: str) -> np.ndarray:
            out = np.empty((single.num_rows if c in single.column_names else 0, part.stop - first))
            for k, x in enumerate(single.column(c) if len(out) else ()):
                out[k] = np.frombuffer(x.as_buffer(), np.float64)
            return out

        number = lambda c: single.column(c).to_numpy().astype(float)
        text = lambda c: single.column(c).to_pylist()
        g = batch.GroupCounts(n, cases, number("ac"), number("ac2"), number("carriers"), number("weight"), text("type"), text("key"), read("a"), read("c"))
        if own_rows.num_rows:
            mine, held = (np.frombuffer(own_rows.column(c)[0].as_py(), np.float64) for c in ("own", "held"))
            g.held, g.burden = held[0], (held[1], held[2])
            if null is None:
                g.h = mine[part]
            else:
                parts = mine.reshape(-1, b)[:, part]
                g.r1 = parts[0] - np.einsum("kb,bkj,jb->b", parts[1:], inverse[part], parts[1:])
        if null is not None:
            g.z = g.weight[:, None] * g.a / np.sqrt(s2[part])
        if pairs is not None:
            g.scatter = grouped.square(pairs, pd.Index(text("variant_id")))
        stat = np.round(batch.stat_of(g, config), 9)
        gene, transcript = (group.column(c)[0].as_py() for c in GROUP)
        return pa.table({"gene": [gene] * len(stat), "transcript": [transcript] * len(stat), "perm_id": perms[part].astype(np.int32), "stat": stat})

    schema = "gene string, transcript string, perm_id int, stat double"
    if scatter is not None:
        return whole.groupBy(*GROUP, "tile").cogroup(scatter.select("*", tiles).groupBy(*GROUP, "tile")).applyInArrow(work, schema)
    return whole.groupBy(*GROUP, "tile").applyInArrow(lambda group: work(group), schema)


def gene_by_gene(plan: Plan, spec: Labels, blocks: DataFrame, only) -> DataFrame:
    """Statistics that take variants' case sums, or scores against a null model, alone.

    A task holds a tile, some permutations of a gene, as it travels, and works on a few of them at a time.  What is known of
    the variants travels once for each tile, as arrays.
    """
    config, (n, cases), b = plan.config, plan.cohort.sizes, len(spec.perms)
    names = ["a", "c"] if config.method == "CALPHA" else ["a"]
    quantitative = config.qtl
    null = null_of(plan, spec, blocks) if config.method in SCORED and (plan.null is not None or quantitative) else None

    def sums(s: SampleBlock, table: pa.Table) -> dict[str, np.ndarray]:
        y = s.labels(spec)
        if null is not None:
            y = y - fitted(s, null[0], quantitative)
        found = column_sums(table.column("pos"), table.column("value"), y, both_counts if "c" in names else lambda v: v[None])
        return {c: found[:, k] for k, c in enumerate(names)}

    cores = blocks.sparkSession.sparkContext.defaultParallelism
    genes, widest = plan.genes
    tile = max(1, min(-(-b // max(1, 4 * cores // genes)), HELD // (widest * len(names))))
    found, tasks = grouped.gene_counts(only(plan.columns), replace(plan.layout, blocks=blocks), sums, names, b, PIECE, tile)
    merged = config.method == "VAAST" and config.group_size > 0
    used = [*USED[config.method], *(["type"] if merged and config.grouping == "by_type" else []), *(["rank"] if merged else [])]
    rows = only(plan.attributes).join(plan.slots, [*GROUP, "variant_id"])
    if merged:
        rows = rows.withColumn("rank", F.rank().over(Window.partitionBy(*GROUP).orderBy("key")).cast("int"))
    packed = persist(rows.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("slot", *used))).alias("m")).select(*GROUP, *(F.col("m").getField(c).alias(c) for c in ("slot", *used))))
    s2 = None if null is None else null[1] / max(1.0, n - rank_of(plan)) if quantitative else np.ones(b)
    perms, largest, group_tile = np.array(spec.perms, np.int32), plan.largest, TILE

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"gene": [], "transcript": [], "perm_id": [], "stat": []}
        if left.num_rows and right.num_rows:
            held, counts = grouped.counts_of(right, names)
            first = left.column("tile")[0].as_py() * tile
            width, each = counts["a"].shape[1], max(1, group_tile // largest)
            for row in range(left.num_rows):
                values = lambda c: left.column(c)[row].values  # noqa: B023, E731
                slot = values("slot").to_numpy()
                kept = np.flatnonzero(np.isin(slot, held))
                if not len(kept):
                    continue
                at = np.searchsorted(held, slot[kept])
                number = lambda c: values(c).to_numpy()[kept].astype(float) if c in used else np.zeros(len(kept))  # noqa: B023, E731
                text = lambda c: values(c).take(pa.array(kept)).to_pylist() if c in used else []  # noqa: B023, E731
                known = [number(c) for c in ("ac", "ac2", "carriers", "weight")], text("type") or [""] * len(kept), text("rank")
                for low in range(0, width, each):
                    part = slice(low, min(low + each, width))
                    a, c = (counts[k][at, part].astype(float) for k in ("a", names[-1]))
                    g = batch.GroupCounts(n, cases, *known[0], *known[1:], a, c)
                    if null is not None:
                        g.z = g.weight[:, None] * g.a / np.sqrt(s2[first + low : first + part.stop])
                    stat = np.round(batch.stat_of(g, config), 9)
                    out["stat"].append(stat)
                    out["perm_id"].append(perms[first + low : first + part.stop])
                    for c in GROUP:
                        out[c] += [left.column(c)[row].as_py()] * len(stat)
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        return pa.table({"gene": pa.array(out["gene"], pa.string()), "transcript": pa.array(out["transcript"], pa.string()), "perm_id": join(out["perm_id"], np.int32), "stat": join(out["stat"], float)})

    parts = max(grouped.SPREAD * cores, tasks // 4)
    left = packed.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(-(-b // tile) - 1)))).repartition(parts, "gene", "tile")
    return left.groupBy("gene", "tile").cogroup(found.repartition(parts, "gene", "tile").groupBy("gene", "tile")).applyInArrow(work, "gene string, transcript string, perm_id int, stat double")


def long_stats(found: DataFrame, spec: Labels, stats) -> DataFrame:
    """(gene, transcript, perm_id, stat) from rows with binary columns; stats makes the numbers of a row."""
    perms = np.array(spec.perms, np.int32)

    def run(batches):
        for rows in batches:
            for i in range(rows.num_rows):
                value = np.round(stats(rows, i), 9)
                names = [pa.array([rows.column(c)[i].as_py()] * len(perms)) for c in GROUP]
                yield pa.RecordBatch.from_arrays([*names, pa.array(perms), pa.array(value)], names=[*GROUP, "perm_id", "stat"])

    return found.mapInArrow(run, "gene string, transcript string, perm_id int, stat double")


def regressed(plan: Plan, spec: Labels, blocks: DataFrame, only) -> DataFrame:
    """Likelihood ratios of RVT1 or RVT2 beside null models fitted to every permutation."""
    beta, dev, _ = null_of(plan, spec, blocks)
    found = grouped.regression_lrt(only(plan.regressors), replace(plan.layout, blocks=blocks), spec, (beta, dev), plan.config.qtl)
    return long_stats(found, spec, lambda rows, i: np.frombuffer(rows.column("lrt")[i].as_py(), np.float64))


def tile_size(variants: int, perms: int) -> int:
    """Permutations whose covariances of a group of so many variants a task holds at once."""
    return max(1, min(perms, CELLS // 4 // max(1, variants * (variants + 1) // 2)))


def covariance_tests(plan: Plan, spec: Labels, blocks: DataFrame, only) -> DataFrame:
    """-log10 p of SKATO or SKATC: scores and covariances of every permutation's null model.

    A task holds a tile, some permutations of a group: the more variants the group has, the fewer permutations, down to one,
    of which it holds the pairs of variants that share a sample.
    """
    beta, dev, info = null_of(plan, spec, blocks)
    config, quantitative, b = plan.config, plan.config.qtl, len(spec.perms)
    n, k = plan.cohort.sizes[0], beta.shape[1]
    want = (config.method.lower() + "_p",)

    def sides(s: SampleBlock) -> tuple[np.ndarray, np.ndarray]:
        mu = fitted(s, beta, quantitative)
        return s.labels(spec) - mu, np.ones_like(mu) if quantitative else np.maximum(mu * (1 - mu), 1e-10)

    members = only(plan.attributes).select(*GROUP, "variant_id", "weight").join(plan.gene_slots, ["gene", "variant_id"])
    columns = only(plan.columns)
    each = tile_size(plan.largest, b)
    sums = grouped.gene_sums(columns, replace(plan.layout, blocks=blocks), sides, b, each)
    inverse = np.broadcast_to(plan.null.inverse if plan.null is not None else np.array([[1.0 / n]]), (b, k, k)) if quantitative else np.linalg.pinv(info, hermitian=True)
    s2 = dev / max(1.0, n - rank_of(plan)) if quantitative else np.ones(b)
    perms = np.array(spec.perms, np.int32)

    def work(group: dict, tile: int, w: np.ndarray, found: np.ndarray, i: np.ndarray, j: np.ndarray, cross: np.ndarray) -> pa.Table:
        if not len(w):
            return pa.table({"gene": pa.array([], pa.string()), "transcript": pa.array([], pa.string()), "perm_id": pa.array([], pa.int32()), "stat": pa.array([], pa.float64())})
        first, stat = tile * each, np.empty(len(found))
        for own, at in enumerate(range(first, first + len(stat))):
            r = grouped.paired(i, j, cross[own], found[own, 1:].T, w, inverse[at])
            p = grouped.score_row(w * found[own, 0] / math.sqrt(s2[at]), r, want, config.saddlepoint)[0]
            stat[own] = -math.log10(max(p, 1e-300))
        return pa.table({**{c: [group[c]] * len(stat) for c in GROUP}, "perm_id": perms[first : first + len(stat)], "stat": np.round(stat, 9)})

    return grouped.group_tests(members, sums, -(-b // each), work, k + 1, "gene string, transcript string, perm_id int, stat double", grouped.spread)


def biallelic(plan: Plan, spec: Labels, blocks: DataFrame, only) -> DataFrame:
    """VAAST's site scores and a term for samples with two alleles or more at scored sites.

    Which sites are scored differs by permutation: tasks mark them as bits, a run of a gene's slots each, and a second
    product counts, for each block of samples, the cases and others whose marked sites hold two alleles.
    """
    config, (n, cases), b = plan.config, plan.cohort.sizes, len(spec.perms)

    def sums(s: SampleBlock, table: pa.Table) -> dict[str, np.ndarray]:
        return {"a": column_sums(table.column("pos"), table.column("value"), s.labels(spec), lambda v: v[None])[:, 0]}

    run = max(1, min(plan.genes[1], TILE // b))  # slots that a task marks
    counts, _ = grouped.gene_counts(only(plan.columns), replace(plan.layout, blocks=blocks), sums, ["a"], b, run, b)
    rows = only(plan.attributes).join(plan.slots, [*GROUP, "variant_id"]).withColumn("piece", F.floor(F.col("slot") / run).cast("int"))
    packed = rows.groupBy(*GROUP, "piece").agg(F.array_sort(F.collect_list(F.struct("slot", "ac", "weight"))).alias("m")).select(*GROUP, "piece", *(F.col("m").getField(c).alias(c) for c in ("slot", "ac", "weight")))
    wide = -(-b // 8)  # bytes of a slot's marks

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            held, counts = grouped.counts_of(right, ["a"])
            for row in range(left.num_rows):
                slot, ac, weight = (left.column(c)[row].values.to_numpy() for c in ("slot", "ac", "weight"))
                kept = np.isin(slot, held)
                a = counts["a"][np.searchsorted(held, slot[kept])].astype(float)
                none = np.zeros(len(a))
                score = batch.site_scores(batch.GroupCounts(n, cases, ac[kept], none, none, weight[kept], [], [], a, a), config.soft_maf_filter)
                score = np.where(score > config.site_penalty, score - config.site_penalty, score)
                ever = (score > 0).any(axis=1)
                marks = [x.tobytes() for x in np.packbits(score[ever] > 0, axis=1)]
                out.append({**{c: left.column(c)[row].as_py() for c in GROUP}, "sites": score.sum(axis=0).tobytes(), "slots": slot[kept][ever].tolist(), "bits": marks})
        return pa.Table.from_pylist(out, pa.schema([("gene", pa.string()), ("transcript", pa.string()), ("sites", pa.binary()), ("slots", pa.list_(pa.int32())), ("bits", pa.list_(pa.binary()))]))

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in group.column("sites"))
        return pa.table({**{c: group.column(c).slice(0, 1) for c in GROUP}, "sites": [total.tobytes()]})

    left = packed.groupBy("gene", "piece")
    found = persist(left.cogroup(counts.groupBy("gene", "piece")).applyInArrow(mark, "gene string, transcript string, sites binary, slots array<int>, bits array<binary>"))
    sites = found.select(*GROUP, "sites").groupBy(*GROUP).applyInArrow(add, "gene string, transcript string, sites binary")
    # A block of samples gets the marks of the slots that its samples carry.
    marks = found.select(*GROUP, F.explode(F.arrays_zip("slots", "bits")).alias("m")).select(*GROUP, F.col("m.slots").alias("one"), F.col("m.bits").alias("bits"))
    doubles = only(plan.doubles)
    wanted = doubles.select(*GROUP, "block", F.explode(F.array_distinct("slot")).alias("one")).join(marks, [*GROUP, "one"])
    given = wanted.groupBy(*GROUP, "block").agg(F.array_sort(F.collect_list(F.struct("one", "bits"))).alias("m")).select(*GROUP, "block", F.col("m.one").alias("marked"), F.col("m.bits").alias("bits"))

    def count(s: SampleBlock, table: pa.Table) -> dict[str, np.ndarray]:
        y, out = s.labels(spec), np.zeros((table.num_rows, 2 * b))
        for row in range(table.num_rows):
            pos, sizes, slot, dose, marked = (table.column(c)[row].values.to_numpy() for c in ("pos", "sizes", "slot", "dose", "marked"))
            bits, dose = np.frombuffer(b"".join(table.column("bits")[row].as_py()), np.uint8).reshape(-1, wide), dose.astype(np.float32)
            at_bits = np.minimum(np.searchsorted(marked, slot), len(marked) - 1)
            dose = np.where(marked[at_bits] == slot, dose, 0)  # of slots that are never scored
            ends = np.cumsum(sizes)
            step = max(1, TILE // (b * int(sizes.max())))  # samples at a time
            for at in range(0, len(pos), step):
                lo, hi = (ends[at - 1] if at else 0), ends[min(at + step, len(pos)) - 1]
                held = np.add.reduceat(np.unpackbits(bits[at_bits[lo:hi]], axis=1, count=b) * dose[lo:hi, None], np.concatenate(([0], ends[at : at + step - 1][: len(pos) - at - 1] - lo)), axis=0)
                two = held > 1
                out[row, :b] += (two * y[pos[at : at + step]]).sum(axis=0)
                out[row, b:] += two.sum(axis=0)
        return {"d": out}

    held = product(doubles.join(given, [*GROUP, "block"]), blocks, plan.layout.number, list(GROUP), count, ["d"])
    none = np.zeros(2 * b)

    def stats(found: pa.RecordBatch, i: int) -> np.ndarray:
        d = found.column("d")[i].as_py()
        a, both = np.split(np.frombuffer(d, np.float64) if d is not None else none, 2)
        return np.maximum(np.frombuffer(found.column("sites")[i].as_py(), np.float64) + batch.allele_ratio(a, both - a, float(cases), float(n - cases), config.soft_maf_filter), 0.0)

    return long_stats(sites.join(held, list(GROUP), "left"), spec, stats)


def scan(
    cohort: Cohort,
    config: AssocConfig,
    allowed: DataFrame | None = None,
    mask: DataFrame | None = None,
    numeric: tuple[str, ...] = (),
    categorical: tuple[str, ...] = (),
    external: DataFrame | None = None,
    adjust: bool = True,
) -> DataFrame:
    """Filters, observed statistics, permutations in blocks with early stop, multi-transcript correction and ranks.

    Covariates are columns of the samples (numeric, categorical, and config.covariates among either), or a design x that
    the samples already have.  With covariates labels are permuted by odds unless adjust is false.  external(perm_id,
    labels): permutations from a file, labels as text in order of sample ids.
    """
    check(config)
    ready = prepare(cohort, config, allowed, mask)
    kinds = dict(ready.samples.dtypes)
    numeric = (*numeric, *(c for c in config.covariates if kinds[c] != "string"))
    categorical = (*categorical, *(c for c in config.covariates if kinds[c] == "string"))
    null = None
    if numeric or categorical or "x" in kinds:
        samples = ready.samples if "x" in kinds and not (numeric or categorical) else grouped.design(ready.samples, numeric, categorical, config.max_levels)
        null = grouped.null_model(samples, config.qtl, config.optimizer)
    if not config.nperm:
        found = analytic(ready, config, null) if null is not None and config.method in SCORED | REGRESSED else statistic(ready, config)
        found = persist(found)
        return ranked(found, "p") if "p" in found.columns else ranked(found, "stat", descending=True)
    return permuted_scan(ready, config, null, external, adjust)


def permuted_scan(ready: Cohort, config: AssocConfig, null: grouped.Null | None, external: DataFrame | None, adjust: bool) -> DataFrame:
    """The scan of a prepared cohort by permutations.

    Blocks are written side by side; counts of successes are kept up to date for the genes that go on.
    """
    plan = make_plan(ready, config, null, adjust)
    size = block_size(plan)
    wanted = config.max_perms or config.nperm
    if external is not None:  # a file may end early
        wanted = min(wanted, external.agg(F.max("perm_id")).first()[0] or 0)
    observed, parts, totals, genes, first = None, [], None, None, 0
    while first <= wanted:
        last = min(max(first, 1) + size - 1, wanted)
        block = persist(permuted_statistic(plan, first, last, genes, external))
        if first == 0:
            observed = block.where("perm_id = 0").select(*GROUP, "stat")
            block = block.where("perm_id > 0")
        parts.append(block)
        counts = perm.count_hits(perm.hits(observed, block))
        totals = persist(counts if totals is None else perm.combine_shards(totals.unionByName(counts)))
        genes = persist(unfinished(totals, config))
        first = last + 1
        if not genes.head(1):
            break
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    marked = perm.hits(observed, whole)
    stops = perm.adaptive_stop(marked, config.successes) if config.pthresh is None else tools.threshold_stop(marked, config.pthresh)
    kept = perm.stopped(marked, stops)
    result = perm.empirical(perm.count_hits(kept), wanted)
    corrected = perm.multi_transcript(observed, kept).select("gene", "mgit_p", "mgit_successes")
    found = observed.join(result, list(GROUP)).join(corrected, "gene")
    if config.testable is not None:
        reach = rs.testable_by(ready, config, whole, config.testable).where("testable").select(*GROUP)
        found = found.join(reach, list(GROUP), "left_semi")
    if config.output_stats:
        found = found.join(tools.permuted_values(kept), list(GROUP))
    return ranked(intervals(found), "empirical_p")


def unfinished(totals: DataFrame, config: AssocConfig) -> DataFrame:
    """Genes with a transcript short of successes; with a threshold, whose p does not surely exceed it."""
    if config.pthresh is None:
        return totals.groupBy("gene").agg(F.min("successes").alias("least")).where(F.col("least") < config.successes).select("gene")
    low = intervals(totals.select(*GROUP, "successes", "permutations"))
    return low.groupBy("gene").agg(F.min(F.when(F.col("permutations") > 10, F.col("empirical_p_low")).otherwise(0.0)).alias("low")).where(F.col("low") <= config.pthresh).select("gene")


def intervals(result: DataFrame) -> DataFrame:
    """With the 95 % interval of each empirical p."""

    @F.pandas_udf("struct<low double, high double>")
    def ci(s: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([poisson_ci(float(a), float(b)) for a, b in zip(s, n, strict=True)], columns=["low", "high"])

    both = result.withColumn("ci", ci("successes", "permutations"))
    return both.select(*result.columns, F.col("ci.low").alias("empirical_p_low"), F.col("ci.high").alias("empirical_p_high"))


def top_only(result: DataFrame, by: str = "empirical_p") -> DataFrame:
    """The best transcript of each gene."""
    order = Window.partitionBy("gene").orderBy(by, "transcript")
    return result.withColumn("r_", F.row_number().over(order)).where("r_ = 1").drop("r_")
