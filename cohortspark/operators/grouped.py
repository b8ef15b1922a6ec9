"""Statistics with covariates: sums over carriers are made in Spark, one group's numbers are worked out by a kernel.

Scores, weighted genotype products and products with the covariates all vanish at zero genotypes, so that they are sums
over calls; a kernel gets pairs of variants or a matrix of them, never samples.  The null model is fitted once over all samples by
distributed sums, and regressions beside it likewise, for all groups at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cohort import Cohort
from ..functions import batch, kernels, spectra
from ..functions.glm import EPS, distributed_fit
from ..functions.special import chi2_sf, f_sf
from ..plans.statistics import GROUP, carriers
from ..streaming.blocks import persist
from .filters import COLLAPSED, counted_variants, variant_key
from .linked import counts_of, gene_counts, gene_sums, group_tests, numbered_in_gene
from .products import Labels, Layout, SampleBlock, lay_out, product


@dataclass
class Null:
    """samples with u0 (residual), v (variance), x; the inverse information of the covariates; residual variance."""

    samples: DataFrame
    inverse: np.ndarray
    s2: float
    deviance: float
    beta: np.ndarray
    rank: int  # of the design


def design(samples: DataFrame, numeric: tuple[str, ...] = (), categorical: tuple[str, ...] = (), max_levels: int = 100) -> DataFrame:
    """samples with x: intercept, numbers, and indicators of all but the last level."""
    parts = [F.lit(1.0), *(F.col(c).cast("double") for c in numeric)]
    for c in categorical:
        levels = [r[0] for r in samples.select(F.col(c).cast("string")).distinct().orderBy(F.col(c).cast("string")).limit(max_levels + 2).collect()]
        if len(levels) - 1 > max_levels:
            raise ValueError(f"covariate {c} has over {max_levels} levels")
        parts += [(F.col(c).cast("string") == level).cast("double") for level in levels[:-1]]
    return samples.withColumn("x", F.array(*parts))


def null_model(samples: DataFrame, quantitative: bool = False, optimizer: str = "irls") -> Null:
    """Fit status (or trait) on x over all samples; dependent columns are left out, and residual degrees follow the rank."""
    y, kind = ("trait", "gaussian") if quantitative else ("y", "binomial")
    fit = distributed_fit(samples, y, "x", kind, optimizer)
    beta, deviance = fit.beta, fit.deviance
    eta = F.aggregate(F.zip_with("x", F.array(*map(F.lit, map(float, beta))), lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    mu = eta if quantitative else 1 / (1 + F.exp(-F.greatest(F.least(eta, F.lit(30.0)), F.lit(-30.0))))
    out = samples.withColumn("eta", eta).withColumn("mu", mu).withColumn("u0", F.col(y) - F.col("mu")).withColumn("v", F.lit(1.0) if quantitative else F.col("mu") * (1 - F.col("mu")))
    k = len(beta)
    cells = out.select(*(F.sum(F.col("x")[i] * F.col("x")[j] * F.col("v")).alias(f"c{i}_{j}") for i in range(k) for j in range(k)), F.count("*").alias("n")).first()
    info = np.array([[cells[f"c{i}_{j}"] for j in range(k)] for i in range(k)], float)
    s2 = deviance / max(1, cells["n"] - fit.rank) if quantitative else 1.0
    return Null(out, np.linalg.pinv(info), s2, deviance, beta, fit.rank)


def variant_pairs(cohort: Cohort, samples: DataFrame | None = None) -> DataFrame:
    """(gene, transcript, one, two, cross): sums over samples of both dosages (times v of samples), one <= two.

    Calls of a gene meet on the sample; sums are made by pair before transcripts multiply them.
    """
    genes = cohort.variants.select("variant_id", "gene").distinct()
    held = cohort.calls.where("dosage > 0").join(genes, "variant_id").select("gene", "sample_id", "variant_id", "dosage")
    other = held.select("gene", "sample_id", F.col("variant_id").alias("two"), F.col("dosage").alias("d2"))
    both = held.withColumnRenamed("variant_id", "one").join(other, ["gene", "sample_id"]).where("one <= two")
    weight = F.col("dosage") * F.col("d2")
    if samples is not None:
        both, weight = both.join(samples.select("sample_id", "v"), "sample_id"), weight * F.col("v")
    sums = both.groupBy("gene", "one", "two").agg(F.sum(weight).cast("double").alias("cross"))
    member = cohort.variants.select(*GROUP, "variant_id")
    first, second = (member.withColumnRenamed("variant_id", c) for c in ("one", "two"))
    return persist(sums.join(first, ["gene", "one"]).join(second, [*GROUP, "two"]).select(*GROUP, "one", "two", "cross"))


def square(pairs: pa.Table, ids: pd.Index) -> np.ndarray:
    """The symmetric matrix of pairs (one, two, cross) over the variants ids."""
    out = np.zeros((len(ids), len(ids)))
    i, j = (ids.get_indexer(pairs.column(c).to_pandas()) for c in ("one", "two"))
    out[i, j] = out[j, i] = pairs.column("cross").to_numpy()
    return out


SPREAD = 8  # partitions of groups for each core

SCORE_TESTS = ("burden", "burden_p", "skat_q", "skat_p", "skato_p", "skatc_p")
MORE_TESTS = ("skato_exact_p", "skato_error")  # p with exact quantiles; the error of the integral behind skato_p


def score_row(z: np.ndarray, r: np.ndarray | spectra.Spectra, want: tuple[str, ...], use_saddlepoint: bool) -> list[float]:
    """The wanted ones of SCORE_TESTS and MORE_TESTS from weighted scores and their covariance."""
    total, square_sum = float(r.sum()), float(z.sum() ** 2)
    burden_p = kernels.burden_p(square_sum, total)
    skat_p = kernels.skat_p(z, r, use_saddlepoint) if {"skat_p", "skatc_p"} & set(want) else math.nan
    found = {"burden": square_sum / total if total > 0 else 0.0, "burden_p": burden_p, "skat_q": float(z @ z), "skat_p": skat_p}
    if {"skato_p", "skato_error"} & set(want):
        found["skato_p"], found["skato_error"] = kernels.skato(z, r, use_saddlepoint)
    if "skato_exact_p" in want:
        found["skato_exact_p"] = kernels.skato_p(z, r, use_saddlepoint, True)
    if "skatc_p" in want:
        found["skatc_p"] = kernels.cauchy_p([skat_p, burden_p])
    return [found[c] for c in want]


PAIRED = 256  # variants up to which a group's covariance is a matrix


def covariance(scores: pa.Table, pairs: pa.Table, inverse: np.ndarray) -> np.ndarray | spectra.Spectra:
    """The covariance of a group's weighted scores from rows of variants and of pairs."""
    ids = pd.Index(scores.column("variant_id").to_pandas())
    i, j = (ids.get_indexer(pairs.column(c).to_pandas()) for c in ("one", "two"))
    return paired(i, j, pairs.column("cross").to_numpy(), np.array(scores.column("xv").to_pylist(), float), scores.column("weight").to_numpy(), inverse)


def paired(i: np.ndarray, j: np.ndarray, cross: np.ndarray, xv: np.ndarray, w: np.ndarray, inverse: np.ndarray) -> np.ndarray | spectra.Spectra:
    """The covariance of weighted scores; of a larger group its spectra, from pairs that share a sample alone."""
    if len(w) <= PAIRED:
        r = np.zeros((len(w), len(w)))
        r[i, j] = r[j, i] = cross
        return (r - xv @ inverse @ xv.T) * np.outer(w, w)
    return spectra.Spectra(spectra.Covariance(i, j, cross * w[i] * w[j], xv * w[:, None], inverse))


def score_tests(cohort: Cohort, null: Null, use_saddlepoint: bool = False, want: tuple[str, ...] = SCORE_TESTS) -> DataFrame:
    """The wanted score tests of each group.

    Scores and cross products come from blocks of samples as arrays; a group's task holds no samples, and of a larger group
    the pairs of variants alone that share a sample.  The burden test alone needs no pairs of variants.
    """
    if set(want) <= {"burden", "burden_p"}:
        return burden_tests(cohort, null, want)
    inverse, root = null.inverse, math.sqrt(null.s2)
    layout = lay_out(null.samples.select("sample_id", "y", "trait", "x", "u0", "v"), cohort.sizes[1], 1)
    members, columns = gene_columns(cohort.variants.select(*GROUP, "variant_id", "weight"), cohort.calls, layout)
    sums = gene_sums(columns, layout, lambda s: (s.u0[:, None], s.v[:, None]), 1, 1)

    def work(group: dict, tile: int, w: np.ndarray, found: np.ndarray, i: np.ndarray, j: np.ndarray, cross: np.ndarray) -> pa.Table:
        if not len(w):
            return pa.table({c: pa.array([], pa.string() if c in GROUP else pa.float64()) for c in (*GROUP, *want)})
        row = score_row(w * found[0, 0] / root, paired(i, j, cross[0], found[0, 1:].T, w, inverse), want, use_saddlepoint)
        return pa.table({**{c: [group[c]] for c in GROUP}, **{c: pa.array([float(v)]) for c, v in zip(want, row, strict=True)}})

    schema = "gene string, transcript string, " + ", ".join(f"{c} double" for c in want)
    return group_tests(members, sums, 1, work, 1 + len(inverse), schema, spread)


def gene_columns(members: DataFrame, calls: DataFrame, layout: Layout) -> tuple[DataFrame, DataFrame]:
    """members (gene, transcript, variant_id, weight) with their slot in the gene, and the packed columns of genes' slots."""
    slots = numbered_in_gene(members)
    packed = layout.columns(calls.where("dosage > 0").select("variant_id", "sample_id", F.col("dosage").alias("value")), ["variant_id"])
    return members.join(slots, ["gene", "variant_id"]), packed.join(slots, "variant_id").select("gene", "slot", "block", "pos", "value")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by group (or keys) in partitions that stay apart: a group's work grows faster than its bytes, by which Spark would
    merge them into few tasks."""
    return rows.repartition(SPREAD * rows.sparkSession.sparkContext.defaultParallelism, *(keys or GROUP))


def burden_tests(cohort: Cohort, null: Null, want: tuple[str, ...]) -> DataFrame:
    """The burden test of each group from sums over its carriers: the variance of the summed scores is that of the burdens,
    less what the covariates explain."""
    k, b, v = len(null.inverse), F.col("burden"), F.col("v")
    held = carriers(cohort).select(*GROUP, "sample_id", "burden").join(null.samples.select("sample_id", "u0", "v", "x"), "sample_id")
    sums = held.groupBy(*GROUP).agg(F.sum(b * F.col("u0")).alias("s"), F.sum(v * b * b).alias("bb"), *(F.sum(v * b * F.col("x")[i]).alias(f"t{i}") for i in range(k)))
    explained = sum((F.lit(float(null.inverse[i, j])) * F.col(f"t{i}") * F.col(f"t{j}") for i in range(k) for j in range(k)), F.lit(0.0))
    total, square_sum = F.col("bb") - explained, F.col("s") * F.col("s") / F.lit(float(null.s2))

    @F.pandas_udf("double")
    def p(square: pd.Series, whole: pd.Series) -> pd.Series:
        return pd.Series([kernels.burden_p(float(q), float(t)) for q, t in zip(square, whole, strict=True)], dtype=float)

    found = {"burden": F.when(F.col("total") > 0, F.col("square") / F.col("total")).otherwise(0.0), "burden_p": p("square", "total")}
    return sums.select(*GROUP, square_sum.alias("square"), total.alias("total")).select(*GROUP, *(found[c].alias(c) for c in want))


def regression_columns(cohort: Cohort, kinds: tuple[str, ...] = ("rvt1", "rvt2")) -> DataFrame:
    """(gene, transcript, kind, sample_id, value): the share of variants carried (rvt1) and whether any is (rvt2)."""
    totals = cohort.variants.groupBy(*GROUP).agg(F.count("*").alias("p"))
    carried = cohort.dealt(cohort.calls.where("dosage > 0"), "variant_id").join(cohort.variants.select("variant_id", *GROUP), "variant_id")
    share = cohort.dealt(carried, "sample_id").groupBy(*GROUP, "sample_id").agg(F.sum(F.ceil(F.col("dosage") / 2)).alias("sites")).join(totals, list(GROUP))
    value = {"rvt1": F.col("sites") / F.col("p"), "rvt2": F.lit(1.0)}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), value[k].alias("value")) for k in kinds)))
    return share.select(*GROUP, "sample_id", each.alias("e")).select(*GROUP, "e.kind", "sample_id", "e.value")


KEYS = [*GROUP, "kind"]


def regression_lrt(columns: DataFrame, layout: Layout, spec: Labels, base: tuple[np.ndarray, np.ndarray], quantitative: bool, rounds: int = 25, tol: float = 1e-8) -> DataFrame:
    """(gene, transcript, kind, lrt as binary): likelihood ratio of each column beside the covariates, for each permutation.

    base: coefficients and deviance of the null models.  Every round adds up the information and score of all columns and
    permutations over the blocks of samples; the coefficients stay in Spark.
    """
    beta0, dev0 = base
    b, k = beta0.shape
    w = k + 1

    if quantitative:
        total = layout.base.tree.sizes.sum()

        def linear(s: SampleBlock, table: pa.Table) -> dict[str, np.ndarray]:
            y, out = s.labels(spec), []
            cross, xy, yy = s.x.T @ s.x, s.x.T @ y, (y * y).sum(axis=0)
            for row in range(table.num_rows):
                at, r = (table.column(c)[row].values.to_numpy() for c in ("pos", "value"))
                out.append(np.concatenate((cross.ravel(), r @ s.x[at], [r @ r], xy.ravel(), r @ y[at], yy)))
            return {"cells": np.array(out)}

        def ratio(cells: np.ndarray) -> np.ndarray:
            info = np.zeros((w, w))
            info[:k, :k] = cells[: k * k].reshape(k, k)
            info[k, :k] = info[:k, k] = cells[k * k : k * k + k]
            info[k, k] = cells[k * k + k]
            rest = cells[k * k + k + 1 :]
            xy = np.vstack((rest[: k * b].reshape(k, b), rest[k * b : k * b + b]))
            dev = rest[k * b + b :] - np.einsum("ib,ij,jb->b", xy, np.linalg.pinv(info, hermitian=True), xy)
            return (dev0 - dev) / np.maximum(dev / max(1.0, total - w), 1e-300)

        return with_absent(columns, layout, KEYS, linear, ratio, rounds_of=None)

    def logistic(s: SampleBlock, table: pa.Table) -> dict[str, np.ndarray]:
        y, out = s.labels(spec), []
        cross = (s.x[:, :, None] * s.x[:, None, :]).reshape(len(s.x), -1)
        for row in range(table.num_rows):
            at, r = (table.column(c)[row].values.to_numpy() for c in ("pos", "value"))
            beta = np.frombuffer(table.column("beta")[row].as_py(), np.float64).reshape(b, w)
            eta = s.x @ beta[:, :k].T
            eta[at] += np.outer(r, beta[:, k])
            mu = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
            v, left = np.maximum(mu * (1 - mu), 1e-10), y - mu
            info = np.zeros((b, w, w))
            info[:, :k, :k] = (v.T @ cross).reshape(b, k, k)
            info[:, k, :k] = info[:, :k, k] = (v[at] * r[:, None]).T @ s.x[at]
            info[:, k, k] = (r * r) @ v[at]
            score = np.column_stack((left.T @ s.x, left[at].T @ r))
            loss = -2 * (y * np.log(np.maximum(mu, 1e-300)) + (1 - y) * np.log(np.maximum(1 - mu, 1e-300))).sum(axis=0)
            out.append(np.concatenate((info.ravel(), score.ravel(), loss)))
        return {"cells": np.array(out)}

    def step(beta: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        info, score, loss = cells[: b * w * w].reshape(b, w, w), cells[b * w * w : b * w * (w + 1)].reshape(b, w), cells[b * w * (w + 1) :]
        return beta + np.einsum("bij,bj->bi", np.linalg.pinv(info, hermitian=True), score), loss

    start = np.column_stack((beta0, np.zeros(b)))
    return with_absent(columns, layout, KEYS, logistic, lambda loss: dev0 - loss, rounds_of=(start, step, rounds, tol))


def with_absent(columns: DataFrame, layout: Layout, keys: list[str], work, finish, rounds_of) -> DataFrame:
    """(keys, lrt) from work's cells of every column in every block of samples, also where it has no carrier."""
    if layout.number > 1:
        every = columns.select(*keys).distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(layout.number - 1))))
        columns = every.join(columns, [*keys, "block"], "left").select(*keys, "block", *(F.coalesce(c, F.array().cast(columns.schema[c].dataType)).alias(c) for c in ("pos", "value")))
        columns = persist(columns)
    names = ", ".join(f"`{k}` {columns.schema[k].dataType.simpleString()}" for k in keys)

    def row_by_row(f, out: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [f(batch, i) for i in range(batch.num_rows)]
                arrays = [batch.column(k) for k in keys] + [pa.array([m[n] for m in made], pa.float64() if n == "moved" else pa.binary()) for n in out]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *out])

        return run

    numbers = lambda batch, c, i: np.frombuffer(batch.column(c)[i].as_py(), np.float64)
    if rounds_of is None:
        cells = product(columns, layout.blocks, layout.number, keys, work, ["cells"])
        return cells.mapInArrow(row_by_row(lambda batch, i: {"lrt": finish(numbers(batch, "cells", i)).tobytes()}, ["lrt"]), f"{names}, lrt binary")
    start, step, rounds, tol = rounds_of
    state = columns.select(*keys).distinct().select(*keys, F.lit(bytearray(start.tobytes())).alias("beta"), F.lit(None).cast("binary").alias("loss"))
    for _ in range(rounds):
        cells = product(columns.join(state.select(*keys, "beta"), keys), layout.blocks, layout.number, keys, work, ["cells"])

        def forward(batch: pa.RecordBatch, i: int) -> dict:
            beta, loss = step(numbers(batch, "beta", i).reshape(start.shape), numbers(batch, "cells", i))
            old = batch.column("loss")[i].as_py()
            before = np.full(len(loss), np.inf) if old is None else np.frombuffer(old, np.float64)
            gap = float((np.abs(loss - before) / (np.abs(loss) + 0.1)).max())
            return {"beta": beta.tobytes(), "loss": loss.tobytes(), "moved": gap}

        now = persist(cells.join(state, keys).mapInArrow(row_by_row(forward, ["beta", "loss", "moved"]), f"{names}, beta binary, loss binary, moved double"))
        state = now.select(*keys, "beta", "loss")
        if (now.agg(F.max("moved")).first()[0] or 0.0) < tol:
            break
    return state.mapInArrow(row_by_row(lambda batch, i: {"lrt": finish(numbers(batch, "loss", i)).tobytes()}, ["lrt"]), f"{names}, lrt binary")


def chi2_p(lrt: float) -> float:
    return chi2_sf(lrt, 1) if lrt >= 0 else chi2_sf(EPS, 1)


def regression_tests(cohort: Cohort, null: Null, quantitative: bool = False) -> DataFrame:
    """Likelihood-ratio p-values of the share of variants carried (rvt1) and of carrying any (rvt2), with covariates."""
    layout = lay_out(null.samples.select("sample_id", "y", "trait", "x"), cohort.sizes[1], 1, quantitative)
    columns = layout.columns(regression_columns(cohort), KEYS)
    base = null.beta[None, :], np.array([null.deviance])
    found = regression_lrt(columns, layout, layout.base.part(0, 0), base, quantitative)

    @F.pandas_udf("double")
    def p(lrt: pd.Series) -> pd.Series:
        return lrt.map(lambda x: chi2_p(float(np.frombuffer(x, np.float64)[0])))

    return found.withColumn("p", p("lrt")).groupBy(*GROUP).agg(*(F.max(F.when(F.col("kind") == k, F.col("p"))).alias(f"{k}_p") for k in ("rvt1", "rvt2")))


def hotelling_cohort(cohort: Cohort, rare: float = 0.005) -> Cohort:
    """The cohort whose variants are the columns of the test: rare ones of a transcript as one indicator, if there are two."""
    n, _ = cohort.sizes
    counted = counted_variants(cohort).select(*GROUP, "variant_id", "weight", (F.col("ac") / (2.0 * n) < rare).alias("few"))
    several = F.sum(F.col("few").cast("int")).over(Window.partitionBy(*GROUP)) > 1
    tagged = counted.withColumn("few", F.col("few") & several)
    name = F.when(F.col("few"), F.concat_ws(",", F.lit(COLLAPSED), *GROUP)).otherwise(F.concat_ws(",", F.col("variant_id").cast("string"), "transcript"))
    tagged = tagged.withColumn("column", name)
    held = cohort.calls.where("dosage > 0").join(tagged.select("variant_id", "column", "few"), "variant_id")
    calls = held.groupBy(F.col("column").alias("variant_id"), "sample_id").agg(F.max(F.when(F.col("few"), F.lit(1)).otherwise(F.col("dosage"))).alias("dosage"))
    variants = tagged.select(*GROUP, F.col("column").alias("variant_id")).distinct().withColumns({"weight": F.lit(1.0), "type": F.lit("SNV")})
    return Cohort(cohort.samples, variants, calls.withColumn("missing", F.lit(False)))


def hotelling(cohort: Cohort, rare: float = 0.005) -> DataFrame:
    """Two-sample T2 as an F statistic, with its p; a group's task holds a columns x columns matrix."""
    n, cases = cohort.sizes
    known = Cohort(cohort.samples, cohort.variants, persist(cohort.calls))  # made once: columns, their sums and their pairs read them
    known.__dict__["sizes"] = n, cases
    one = hotelling_cohort(known, rare)
    one = Cohort(one.samples, persist(one.variants), persist(one.calls))
    sums = one.calls.join(cohort.samples.select("sample_id", "y"), "sample_id").groupBy("variant_id").agg(F.sum("dosage").alias("ac"), F.sum(F.col("dosage") * F.col("y")).alias("a"))
    columns = one.variants.select(*GROUP, "variant_id").join(sums, "variant_id")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({c: pa.array([], pa.string() if c in GROUP else pa.float64()) for c in (*GROUP, "t2", "p")})
        ids = pd.Index(left.column("variant_id").to_pandas())
        ac, a = (left.column(c).to_numpy().astype(float) for c in ("ac", "a"))
        g = batch.GroupCounts(n, cases, ac, ac, ac, ac, [], [], a[:, None], a[:, None], scatter=square(right, ids))
        stat, p = float(batch.hotelling(g)[0]), len(ids)
        return pa.table({**{c: left.column(c).slice(0, 1) for c in GROUP}, "t2": [stat], "p": [f_sf(stat, p, n - 1 - p)]})

    return columns.groupBy(*GROUP).cogroup(variant_pairs(one).groupBy(*GROUP)).applyInArrow(work, "gene string, transcript string, t2 double, p double")


def vaast_grouped(cohort: Cohort, limit: float = 4, cap: float = 1.0, penalty: float = 2.0, by_type: bool = False) -> DataFrame:
    """Grouped scores and, for each variant, what it adds."""
    n, cases = cohort.sizes
    rows = counted_variants(cohort).select(*GROUP, variant_key().alias("key"), "type", "weight", "case_ac", "ac")

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key")
        a, c = frame["case_ac"].to_numpy(float), (frame["ac"] - frame["case_ac"]).to_numpy(float)
        counts = np.column_stack((a, 2 * cases - a, c, 2 * (n - cases) - c))
        args = (counts, frame["weight"].to_numpy(), frame["type"].tolist(), frame["key"].tolist())
        kw = {"limit": limit, "cap": cap, "penalty": penalty, "by_type": by_type}
        return pd.DataFrame({"gene": frame["gene"], "transcript": frame["transcript"], "key": frame["key"], "vaast": kernels.vaast_grouped(*args, **kw), "added": kernels.leave_one_out(*args, **kw)})

    return spread(rows).groupBy(*GROUP).applyInPandas(work, "gene string, transcript string, key string, vaast double, added double")
