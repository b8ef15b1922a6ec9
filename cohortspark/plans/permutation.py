"""Permutation tests: deterministic label permutations, hits, early stop, multi-transcript correction.

A permutation is a pure function of (seed, perm_id, sample): the same on any partitioning.  Blocks of perm_ids bound
the size of the permuted table; counts of blocks add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cohort import Cohort, dealt
from .statistics import GROUP


def uniform_permutations(cohort: Cohort, first: int, last: int, seed: int = 1) -> DataFrame:
    """(perm_id, sample_id, y) for perm_ids first to last: the cases are the samples with the smallest hashes.

    Counts of hash prefixes tell in which bin of a permutation the last case lies; only that bin's samples are ranked, one
    in BINS of them all.
    """
    n, cases = cohort.sizes
    samples = dealt(cohort.samples.select("sample_id"), n * (last - first + 1), "sample_id")  # a file of samples may be one task
    each = samples.select("sample_id", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("perm_id"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("perm_id").cast("string"), F.col("sample_id").cast("string")))
    keyed = each.withColumn("key", key).withColumn("bin", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    upto = Window.partitionBy("perm_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows
    counts = keyed.groupBy("perm_id", "bin").agg(F.count("*").alias("size"))
    before = counts.select("perm_id", "bin", "size", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("before"))
    edge = before.where((F.col("before") < cases) & (F.col("before") + F.col("size") >= cases)).select("perm_id", F.col("bin").alias("edge"), (cases - F.col("before")).alias("left"))
    placed = keyed.join(edge, "perm_id", "left").withColumn("edge", F.coalesce("edge", F.lit(-1)))
    order = Window.partitionBy("perm_id").orderBy("key", "sample_id")
    inside = placed.where("bin = edge").select("perm_id", "sample_id", (F.row_number().over(order) <= F.col("left")).cast("int").alias("y"))
    return placed.where("bin <> edge").select("perm_id", "sample_id", (F.col("bin") < F.col("edge")).cast("int").alias("y")).unionByName(inside)


def permuted_calpha(cohort: Cohort, permutations: DataFrame) -> DataFrame:
    """(gene, transcript, perm_id, stat).

    A sample brings all its labels to each variant that it carries, as one list: rows by permutation exist in the task of
    their variant only.
    """
    n, cases = cohort.sizes
    p = cases / n
    variants = cohort.variants.select("variant_id", *GROUP)
    own = cohort.dealt(permutations, "sample_id").groupBy("sample_id").agg(F.collect_list(F.col("perm_id") * 2 + F.col("y")).alias("labels"))
    carried = cohort.calls.where("dosage > 0").select("sample_id", "variant_id").join(own, "sample_id").select("variant_id", "labels")
    each = cohort.dealt(carried.repartition("variant_id"), "variant_id").select("variant_id", F.explode("labels").alias("label"))
    each = each.select("variant_id", F.shiftright("label", 1).alias("perm_id"), F.col("label").bitwiseAND(1).alias("y"))
    # One row for each variant and permutation before transcripts multiply them.
    counts = each.groupBy("variant_id", "perm_id").agg(F.sum("y").alias("g"), F.count("*").alias("m"))
    term = F.pow(F.col("g") - F.col("m") * p, 2) - F.col("m") * p * (1 - p)
    return counts.join(variants, "variant_id").groupBy(*GROUP, "perm_id").agg(F.round(F.sum(term), 9).alias("stat"))


def hits(observed: DataFrame, permuted: DataFrame, small: bool = False) -> DataFrame:
    """Each permuted statistic against the observed one: hit (ties count) and mid hit (ties count a half)."""
    joined = permuted.join(observed.select(*GROUP, F.round("stat", 9).alias("observed")), list(GROUP))
    more = F.col("stat") < F.col("observed") if small else F.col("stat") > F.col("observed")
    tie = F.col("stat") == F.col("observed")
    return joined.select(*GROUP, "perm_id", "stat", "observed", (more | tie).cast("int").alias("hit"), F.when(tie, 0.5).otherwise(more.cast("double")).alias("mid"))


def empirical(counted: DataFrame, wanted: int) -> DataFrame:
    """p-values from (successes, mid_successes, permutations): geometric estimate if the group stopped early."""
    s, n = F.col("successes"), F.col("permutations")
    p = F.when((n < wanted) & (n > 1), (s - 1) / (n - 1)).otherwise((s + 1) / (n + 1.0))
    return counted.select("*", F.least(p, F.lit(1.0)).alias("empirical_p"), F.least((F.col("mid_successes") + 0.5) / (n + 1.0), F.lit(1.0)).alias("empirical_midp"))


def count_hits(marked: DataFrame) -> DataFrame:
    return marked.groupBy(*GROUP).agg(F.sum("hit").cast("long").alias("successes"), F.sum("mid").alias("mid_successes"), F.count("*").alias("permutations"))


def adaptive_stop(marked: DataFrame, wanted: int) -> DataFrame:
    """(gene, stop): the first permutation by which every transcript of the gene has enough hits, else the last one."""
    run = Window.partitionBy(*GROUP).orderBy("perm_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = marked.select(*GROUP, "perm_id", F.sum("hit").over(run).alias("so_far"))
    least = upto.groupBy("gene", "perm_id").agg(F.min("so_far").alias("least"))
    return least.groupBy("gene").agg(F.coalesce(F.min(F.when(F.col("least") >= wanted, F.col("perm_id"))), F.max("perm_id")).cast("int").alias("stop"))


def stopped(marked: DataFrame, stops: DataFrame) -> DataFrame:
    """The permutations that a gene's transcripts take in, all up to the same one."""
    return marked.join(stops, "gene").where("perm_id <= stop").drop("stop")


def tied_rank(value: Column, ties: str, *group: str) -> Column:
    """The rank of a value among its group's, the largest first; ties share the lowest, highest or mean of their places."""
    order, alike = Window.partitionBy(*group).orderBy(value.desc()), Window.partitionBy(*group, value)
    more = (F.count("*").over(alike) - 1) * {"min": 0.0, "max": 1.0, "average": 0.5}[ties]
    return F.rank().over(order) + more


def multi_transcript(observed: DataFrame, permuted: DataFrame) -> DataFrame:
    """Gene-level p: share of permutations whose best transcript rank is at least as good as the observed best one."""
    whole = observed.select(*GROUP, F.lit(0).alias("perm_id"), F.round("stat", 9).alias("stat")).unionByName(permuted.select(*GROUP, "perm_id", "stat"))
    rank = tied_rank(F.col("stat"), "average", *GROUP)
    best = whole.select(*GROUP, "perm_id", rank.alias("rank")).groupBy("gene", "perm_id").agg(F.min("rank").alias("best"))
    seen = best.where("perm_id = 0").select("gene", F.col("best").alias("own"))
    joined = best.where("perm_id > 0").join(seen, "gene")
    out = joined.groupBy("gene").agg(
        F.sum((F.col("best") <= F.col("own")).cast("int")).cast("long").alias("mgit_successes"), F.count("*").alias("permutations")
    )
    return out.withColumn("mgit_p", (F.col("mgit_successes") + 1) / (F.col("permutations") + 1.0))


def shard_ranges(nperm: int, successes: int, shards: int) -> list[tuple[int, int, int]]:
    """(first, last, successes) of each shard: disjoint permutations and equal shares of the successes, what is over goes to the last."""
    shards = max(1, min(shards, nperm))
    size, wanted = nperm // shards, successes // shards
    return [(k * size + 1, (k + 1) * size if k + 1 < shards else nperm, wanted if k + 1 < shards else successes - wanted * (shards - 1)) for k in range(shards)]


def combine_shards(shards: DataFrame) -> DataFrame:
    """Counts of permutation shards added up."""
    return shards.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in ("successes", "mid_successes", "permutations")))


def run_blocks(cohort: Cohort, observed: DataFrame, wanted: int, block: int, successes: int, seed: int = 1) -> DataFrame:
    """C-alpha permuted in blocks; only genes with a transcript short of successes go on to the next block."""
    from ..streaming.blocks import persist

    genes = observed.select("gene").distinct()
    total, first = None, 1
    while first <= wanted and genes.head(1):
        last = min(first + block - 1, wanted)
        part = Cohort(cohort.samples, cohort.variants.join(genes, "gene", "left_semi"), cohort.calls)
        part.__dict__["sizes"] = cohort.sizes
        counted = count_hits(hits(observed, permuted_calpha(part, uniform_permutations(cohort, first, last, seed))))
        total = persist(counted if total is None else combine_shards(total.unionByName(counted)))
        genes = persist(total.where(F.col("successes") < successes).select("gene").distinct())
        first = last + 1
    return empirical(total, wanted)
