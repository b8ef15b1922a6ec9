"""Covariate-adjusted permutations, power by bootstrap, effect sizes and testability."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cohort import Cohort
from ..config import AssocConfig
from ..functions import batch
from ..functions.batch import COUNTED, stat_of
from ..functions.special import chi2_sf_col, fisher_odds_ratio, wilson
from ..operators.dealing import CaseTree
from ..operators.filters import counted_variants
from ..operators.grouped import Null
from ..operators.products import SampleBlock, column_sums, lay_out, numbered, product, sample_blocks
from ..streaming.blocks import persist
from .permutation import uniform_permutations
from .statistics import GROUP, carriers, g_test


def odds_bins(odds: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each value, mean odds of each bin): from the left, a bin takes values below its first one plus epsilon."""
    order = np.argsort(odds, kind="stable")
    bins = np.empty(len(odds), int)
    left, k = None, -1
    for i in order:
        if left is None or odds[i] >= left + epsilon + 1e-10:
            left, k = odds[i], k + 1
        bins[i] = k
    return bins, np.bincount(bins, odds) / np.bincount(bins)


def chain_ends(values: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next, last, count) for a bin that starts at each of the sorted values: where the next one starts (the length: nowhere),
    where the last one of the chain does, and how many there are; by pointer doubling."""
    size = len(values)
    following = np.searchsorted(values, values + step, side="left")
    jump, last, count = following.copy(), np.arange(size), np.ones(size, np.int64)
    while (on := np.flatnonzero(jump < size)).size:
        to = jump[on]
        last[on], count[on], jump[on] = last[to], count[on] + count[to], jump[to]
    return following, last, count


def binned(odds: DataFrame, epsilon: float = 1e-4) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """((sample_id, bin), samples of each bin, mean odds of each bin) of odds(sample_id, odds), the bins of `odds_bins`.

    Distinct values are sorted in ranges.  A range's task finds, for each value that could be the first left edge inside it,
    the last one; the driver follows the edges from range to range, and the tasks name the bins.  The driver sees the values
    of one epsilon of each range, and the bins.
    """
    step = epsilon + 1e-10
    odds = odds.select("sample_id", F.col("odds").cast("double").alias("odds"))
    values = odds.groupBy("odds").agg(F.count("*").alias("n"))
    ranges = persist(values.repartitionByRange("odds").sortWithinPartitions("odds").withColumn("part", F.spark_partition_id()))

    def entries(group: pa.Table) -> pa.Table:
        v = np.sort(group.column("odds").to_numpy())
        _, last, count = chain_ends(v, step)
        first = int(np.searchsorted(v, v[0] + step, side="left")) + 1  # one beyond the first epsilon too
        table = {"part": group.column("part").slice(0, 1), "edges": [v[:first].tolist()], "lasts": [v[last[:first]].tolist()], "counts": [count[:first].tolist()]}
        return pa.table(table, schema=pa.schema([("part", pa.int32()), ("edges", pa.list_(pa.float64())), ("lasts", pa.list_(pa.float64())), ("counts", pa.list_(pa.int64()))]))

    known: dict[int, tuple[float, int]] = {}
    edge, bins = -math.inf, 0
    for r in ranges.groupBy("part").applyInArrow(entries, "part int, edges array<double>, lasts array<double>, counts array<bigint>").orderBy("part").collect():
        known[r.part] = edge, bins
        at = int(np.searchsorted(r.edges, edge + step, side="left"))
        if at < len(r.edges):
            edge, bins = r.lasts[at], bins + r.counts[at]

    def name(group: pa.Table) -> pa.Table:
        group = group.sort_by("odds")
        v = group.column("odds").to_numpy()
        before, bin_ = known[group.column("part")[0].as_py()]
        following, at, starts = chain_ends(v, step)[0], int(np.searchsorted(v, before + step, side="left")), []
        while at < len(v):
            starts.append(at)
            at = int(following[at])
        number = bin_ - 1 + np.searchsorted(starts, np.arange(len(v)), side="right")
        return pa.table({"odds": v, "n": group.column("n"), "bin": pa.array(number, pa.int32())})

    named = persist(ranges.groupBy("part").applyInArrow(name, "odds double, n long, bin int"))
    table = named.groupBy("bin").agg(F.sum("n").alias("n"), F.sum(F.col("odds") * F.col("n")).alias("sum")).orderBy("bin").toPandas()
    sizes = table["n"].to_numpy(np.int64)
    return odds.join(named.select("odds", "bin"), "odds").select("sample_id", "bin"), sizes, np.maximum(table["sum"].to_numpy(float) / np.maximum(sizes, 1), 1e-300)


def null_odds(null: Null, quantitative: bool = False) -> DataFrame:
    """(sample_id, odds) of a null model; of a quantitative trait the odds as if it were cut in two, without cutting it: the
    linear predictor on the logistic scale."""
    scale = math.pi / math.sqrt(3) / math.sqrt(max(null.deviance, 1e-300)) if quantitative else 1.0
    eta = F.greatest(F.least(F.col("eta") * scale, F.lit(30.0)), F.lit(-30.0))
    return null.samples.select("sample_id", F.exp(eta).alias("odds"))


def adjusted_permutations(cohort: Cohort, odds: DataFrame, first: int, last: int, epsilon: float = 1e-4, seed: int = 1) -> DataFrame:
    """(perm_id, sample_id, y): cases are dealt to bins of like odds(sample_id, odds), then by lot inside each bin.

    A task makes the labels of one block of samples, whose cases it finds by walking down the tree of cells.  A block brings
    its sample ids, so that labels are joined with nothing.
    """
    _, cases = cohort.sizes
    dealt, _, means = binned(odds, epsilon)
    layout = lay_out(cohort.samples.select("sample_id", "y", "trait").join(dealt, "sample_id"), cases, seed, odds=means)
    spec = layout.base.part(first, last)

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for row in range(table.num_rows):
                block = SampleBlock.of(table, row)
                ids, y = table.column("id")[row].values, block.labels(spec).astype(np.int32)
                for k, perm_id in enumerate(spec.perms):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), perm_id, np.int32)), ids, pa.array(np.ascontiguousarray(y[:, k]))], names=["perm_id", "sample_id", "y"])

    kind = layout.index.schema["sample_id"].dataType.simpleString()
    return sample_blocks(layout.index.withColumn("id", F.col("sample_id"))).mapInArrow(labels, f"perm_id int, sample_id {kind}, y int")


def bootstrap(cohort: Cohort, reps: int, n_cases: int, n_controls: int, seed: int = 1) -> DataFrame:
    """(rep, slot, sample_id, y): samples drawn with replacement among cases and controls by a hash of (seed, rep, slot)."""
    n, cases = cohort.sizes
    index = numbered(cohort.samples.select("y", "sample_id"), "y", "sample_id")
    ranked = index.select("sample_id", "y", (F.col("at") - F.when(F.col("y") == 1, n - cases).otherwise(0)).cast("int").alias("at"))
    spark = cohort.samples.sparkSession
    slots = spark.range(1, reps + 1).select(F.col("id").cast("int").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(n_cases + n_controls - 1))).alias("slot"))
    is_case = F.col("slot") < n_cases
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("slot").cast("string")))
    draw = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    drawn = slots.select("rep", "slot", is_case.cast("int").alias("y"), F.pmod(draw, F.when(is_case, cases).otherwise(n - cases)).cast("int").alias("at"))
    return drawn.join(ranked, ["y", "at"]).select("rep", "slot", "sample_id", "y")


def power(cohort: Cohort, reps: int, n_cases: int, n_controls: int, alphas: tuple[float, ...] = (0.05,), seed: int = 1) -> DataFrame:
    """Share of bootstrap replicates in which the carrier G test reaches each alpha, for each group."""
    drawn = bootstrap(cohort, reps, n_cases, n_controls, seed)
    carried = carriers(cohort).select(*GROUP, "sample_id").join(drawn, "sample_id")
    table = carried.groupBy(*GROUP, "rep").agg(F.sum("y").alias("a"), F.count("*").alias("m"))
    p = chi2_sf_col(g_test(F.col("a"), F.col("m"), n_cases, n_cases + n_controls), 1)
    return ratios(table.select(*GROUP, "rep", p.alias("p")), "RVT2", reps, n_cases, n_controls, alphas)


def ratios(tested: DataFrame, method: str, reps: int, n_cases: int, n_controls: int, alphas: tuple[float, ...]) -> DataFrame:
    """For each group and alpha how many replicates (gene, transcript, rep, p) reached it."""
    each = tested.select(*GROUP, "p", F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))
    won = each.groupBy(*GROUP, "alpha").agg(F.sum((F.col("p") <= F.col("alpha")).cast("long")).alias("successes"))
    return won.select(
        *GROUP, F.lit(method).alias("method"), F.lit(n_cases).alias("n_cases"), F.lit(n_controls).alias("n_controls"), "successes", F.lit(reps).alias("bootstraps"), (F.col("successes") / reps).alias("ratio"), "alpha"
    )


def permuted_power(cohort: Cohort, config: AssocConfig, reps: int, n_cases: int, n_controls: int, alphas: tuple[float, ...] = (0.05,), odds: DataFrame | None = None) -> DataFrame:
    """Power of a method without a p-value of its own: every replicate is permuted.

    With several alphas a replicate takes config.nperm permutations and p = (hits + 2) / (permutations + 4); with one alpha
    blocks of five until the Wilson interval leaves alpha out.  A task holds one replicate of one group: as many rows as
    the replicate has slots.  odds(sample_id, odds): labels are permuted by them, else uniformly.
    """
    if config.method not in COUNTED:
        raise ValueError(f"permuted_power works for {', '.join(COUNTED)}")
    total, seed, nperm = n_cases + n_controls, config.seed, config.nperm
    drawn = bootstrap(cohort, reps, n_cases, n_controls, seed)
    held = cohort.calls.where("dosage > 0").join(cohort.variants.select("variant_id", *GROUP, "weight", "type"), "variant_id")
    rows = held.join(drawn, "sample_id").select(*GROUP, "rep", "slot", F.col("variant_id").cast("string").alias("variant_id"), "weight", "type", F.col("dosage").cast("double").alias("dosage"))
    of_slot = drawn.select("rep", "slot", "sample_id") if odds is None else drawn.join(odds, "sample_id").select("rep", "slot", F.log("odds").alias("odds"))
    gathered = None if odds is None else of_slot.groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "odds"))), lambda s: s.odds).alias("odds"))
    if gathered is not None:
        rows = rows.join(gathered, "rep")

    def labels(rng: np.random.Generator, count: int, log_odds: np.ndarray | None) -> np.ndarray:
        out = np.zeros((total, count))
        if log_odds is None:
            for k in range(count):
                out[rng.permutation(total)[:n_cases], k] = 1
            return out
        bins, means = odds_bins(np.exp(log_odds), config.bin_epsilon)
        sizes = np.bincount(bins)
        tree = CaseTree(sizes, np.maximum(means, 1e-12), np.array([0, len(sizes)]), n_cases)
        for k in range(count):
            take = tree.dealt(int(rng.integers(1 << 62)), k, 0)
            order = np.lexsort((rng.random(total), bins))
            out[order[np.arange(total) - (np.cumsum(sizes) - sizes)[bins[order]] < take[bins[order]]], k] = 1
        return out

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        gene, transcript, rep = frame.iloc[0][[*GROUP, "rep"]]
        log_odds = np.array(frame["odds"].iloc[0]) if "odds" in frame else None
        variant, ids = pd.factorize(frame["variant_id"], sort=True)
        first = frame.assign(v=variant).drop_duplicates("v").sort_values("v")
        g = np.zeros((len(ids), total))
        g[variant, frame["slot"]] = frame["dosage"]
        any_carried, burden = g.max(axis=0) > 0, first["weight"].to_numpy() @ g

        def stats(y: np.ndarray) -> np.ndarray:
            counts = batch.GroupCounts(
                total, n_cases, g.sum(axis=1), (g * g).sum(axis=1), (g > 0).sum(axis=1).astype(float), first["weight"].to_numpy(float), first["type"].tolist(), list(ids), g @ y, (g > 0) @ y,
                float(any_carried.sum()), any_carried @ y, (float(burden.sum()), float(burden @ burden)),
            )
            return np.round(stat_of(counts, config), 9)

        seen = np.zeros((total, 1))
        seen[:n_cases] = 1
        own, rng = stats(seen)[0], np.random.default_rng([seed, int(rep), zlib.crc32(f"{gene}/{transcript}".encode())])
        if len(alphas) > 1:
            p = (float((stats(labels(rng, nperm, log_odds)) >= own).sum()) + 2) / (nperm + 4)
        else:
            won, done, low, high = 0, 0, 0.0, 1.0
            while done < nperm and (done < 10 or low <= alphas[0] <= high):
                count = min(5, nperm - done)
                won, done = won + int((stats(labels(rng, count, log_odds)) >= own).sum()), done + count
                low, high = wilson(float(won), done)
            p = (won + 2) / (done + 4)
        return pd.DataFrame([[gene, transcript, int(rep), p]], columns=[*GROUP, "rep", "p"])

    tested = rows.groupBy(*GROUP, "rep").applyInPandas(work, "gene string, transcript string, rep int, p double")
    return ratios(tested, config.method, reps, n_cases, n_controls, alphas)


def adjusted_carriers(cohort: Cohort, nperm: int, seed: int, odds: DataFrame, epsilon: float, held: DataFrame | None = None) -> DataFrame:
    """(gene, transcript, all): cases among a group's carriers in permutations by odds(sample_id, odds), in order of size;
    held: carriers, if they are known."""
    held = carriers(cohort) if held is None else held
    dealt, _, means = binned(odds, epsilon)
    layout = lay_out(cohort.samples.select("sample_id", "y", "trait").join(dealt, "sample_id"), cohort.sizes[1], seed, odds=means)
    columns = layout.columns(held.select(*GROUP, "sample_id", F.lit(1.0).alias("value")), list(GROUP))
    spec = layout.base.part(1, nperm)

    def sums(s: SampleBlock, table: pa.Table) -> dict[str, np.ndarray]:
        return {"a": column_sums(table.column("pos"), table.column("value"), s.labels(spec), lambda v: v[None])[:, 0]}

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            counts = [np.sort(np.frombuffer(x)).astype(np.int64) for x in rows.column("a").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in GROUP), pa.array(counts, pa.list_(pa.int64()))], names=[*GROUP, "all"])

    return product(columns, layout.blocks, layout.number, list(GROUP), sums, ["a"], nperm).mapInArrow(ordered, "gene string, transcript string, all array<bigint>")


def effect_sizes(cohort: Cohort, nperm: int, seed: int = 1, odds: DataFrame | None = None, epsilon: float = 1e-4) -> DataFrame:
    """Conditional odds ratio of carrying any variant, with its permutation percentiles and p-value; labels are permuted
    uniformly, or by odds(sample_id, odds).

    A sample brings the permutations in which it is a case to each group that it carries, as one list."""
    n, cases = cohort.sizes
    held = persist(carriers(cohort).select(*GROUP, "sample_id", "y"))
    seen = held.groupBy(*GROUP).agg(F.sum("y").alias("a"), F.count("*").alias("m"))

    @F.pandas_udf("double")
    def ratio(a: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([fisher_odds_ratio(int(x), int(k - x), int(cases - x), int(n - cases - k + x)) for x, k in zip(a, m, strict=True)])

    # Percentiles and p-value need the cases among carriers only: the odds ratio grows with them.
    own = seen.select(*GROUP, F.col("a").alias("own"), "m")
    if odds is None:
        labels = uniform_permutations(cohort, 1, nperm, seed)
        own_labels = cohort.dealt(labels.where("y = 1"), "sample_id").groupBy("sample_id").agg(F.collect_list("perm_id").alias("perms"))
        permuted = held.join(own_labels, "sample_id").select(*GROUP, F.explode("perms").alias("perm_id")).groupBy(*GROUP, "perm_id").agg(F.count("*").alias("a"))
        counts = permuted.groupBy(*GROUP).agg(F.array_sort(F.collect_list("a")).alias("some"))
        none = F.array_repeat(F.lit(0).cast("long"), F.lit(nperm) - F.size("some"))  # permutations without a case among carriers
        spread = seen.select(*GROUP).join(counts, list(GROUP), "left").select(*GROUP, F.coalesce(F.concat(none, "some"), F.array_repeat(F.lit(0).cast("long"), F.lit(nperm))).alias("all"))
    else:
        spread = adjusted_carriers(cohort, nperm, seed, odds, epsilon, held)
    at = lambda q: F.element_at("all", F.lit(int(q * nperm) + 1))
    joined = own.join(spread, list(GROUP)).select(*GROUP, "own", "m", at(0.025).alias("low"), at(0.975).alias("high"), F.size(F.filter("all", lambda x: x >= F.col("own"))).alias("hits"))
    return joined.select(
        *GROUP, ratio("own", "m").alias("or_estimate"), ratio("low", "m").alias("or_ci_low"), ratio("high", "m").alias("or_ci_high"), ((F.col("hits") + 1) / (nperm + 1.0)).alias("p_value"),
        F.col("own").alias("case_carrier"), (F.lit(cases) - F.col("own")).alias("case_non_carrier"), (F.col("m") - F.col("own")).alias("control_carrier"), (F.lit(n - cases) - F.col("m") + F.col("own")).alias("control_non_carrier"),
    )


def testable(cohort: Cohort, alpha: float = 0.05) -> DataFrame:
    """Whether a group could reach alpha at all: the carrier G test when carriers are cases first."""
    n, cases = cohort.sizes
    m = carriers(cohort).groupBy(*GROUP).agg(F.count("*").alias("m"))
    best = chi2_sf_col(g_test(F.least("m", F.lit(cases)), F.col("m"), cases, n), 1)
    return m.select(*GROUP, "m", best.alias("best_p")).withColumn("testable", F.col("best_p") <= alpha)


def extreme_statistic(cohort: Cohort, config: AssocConfig) -> DataFrame:
    """(gene, transcript, stat, scored): the method's statistic when a group's carriers are cases first, in order of sample
    id, and how many variants score above zero (VAAST and SKAT need eight to be testable).

    The labels differ by group, so that they are columns of carriers: a carrier is a case while its number in the group is
    within the number of cases; the others never enter a count.
    """
    n, cases = cohort.sizes
    held = carriers(cohort).select(*GROUP, "sample_id", "burden")
    few = held.groupBy(*GROUP).agg(F.count("*").alias("held"), F.sum("burden").alias("b"), F.sum(F.col("burden") * F.col("burden")).alias("bb"))
    order = Window.partitionBy(*GROUP).orderBy("sample_id")
    labelled = held.join(few.select(*GROUP, "held"), list(GROUP)).withColumn("y", F.when(F.col("held") <= cases, 1).otherwise((F.row_number().over(order) <= cases).cast("int")))
    member = cohort.variants.select(*GROUP, "variant_id")
    both = cohort.calls.where("dosage > 0").join(member, "variant_id").join(labelled.select(*GROUP, "sample_id", "y"), [*GROUP, "sample_id"])
    sums = both.groupBy(*GROUP, "variant_id").agg(F.sum(F.col("dosage") * F.col("y")).cast("double").alias("a"), F.sum("y").cast("double").alias("c"))
    name = "variant_key" if "variant_key" in cohort.variants.columns else "variant_id"  # collapsed variants are numbered
    counted = counted_variants(cohort).select(*GROUP, "variant_id", F.col(name).cast("string").alias("key"), "type", *(F.col(c).cast("double").alias(c) for c in ("weight", "ac", "ac2", "carriers")))
    rows = counted.join(sums, [*GROUP, "variant_id"]).drop("variant_id").join(few, list(GROUP))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        one = lambda c: frame[c].to_numpy(float)
        top = frame.iloc[0]
        h = np.array([float(min(top["held"], cases))])
        g = batch.GroupCounts(n, cases, one("ac"), one("ac2"), one("carriers"), one("weight"), frame["type"].tolist(), frame["key"].tolist(), one("a")[:, None], one("c")[:, None], float(top["held"]), h, (top["b"], top["bb"]))
        scores = batch.site_scores(g, config.soft_maf_filter) if config.method == "VAAST" else g.scores**2
        return pd.DataFrame([[top["gene"], top["transcript"], float(stat_of(g, config)[0]), int((scores > 0).sum())]], columns=[*GROUP, "stat", "scored"])

    return rows.groupBy(*GROUP).applyInPandas(work, "gene string, transcript string, stat double, scored int")


def testable_by(cohort: Cohort, config: AssocConfig, permuted: DataFrame, alpha: float) -> DataFrame:
    """(gene, transcript, testable): whether the extreme statistic's percentile among permuted(gene, transcript, stat) is below alpha."""
    best = extreme_statistic(cohort, config)
    share = permuted.join(best.select(*GROUP, F.round("stat", 9).alias("best"), "scored"), list(GROUP)).groupBy(*GROUP).agg(
        ((F.sum((F.col("best") <= F.col("stat")).cast("int")) + 1) / (F.count("*") + 1.0)).alias("p"), F.first("scored").alias("scored")
    )
    enough = F.col("scored") >= (8 if config.method in ("VAAST", "SKAT") else 0)
    return share.select(*GROUP, ((F.col("p") < alpha) & enough).alias("testable"))
