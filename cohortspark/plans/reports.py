"""Result tables: ranked results, variant details, carrier reports, interval joins and exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cohort import Cohort
from ..operators.filters import COLLAPSED, LOCUS, counted_variants
from ..operators.products import numbered
from .statistics import GROUP

LEAST_SIZE = 10  # buckets hold 2^10 bases at least


def ranked(results: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Results with their global rank; ties by gene and transcript."""
    order = F.desc(by) if descending else F.asc(by)
    whole = Window.orderBy(order, "gene", "transcript")  # one row for each transcript
    return results.select(F.row_number().over(whole).alias("rank"), *results.columns)


def merge_results(parts: list[DataFrame], by: str) -> DataFrame:
    """Result files of shards under one ranking; columns meet by name, text that is no number sorts last."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    value = F.coalesce(F.expr(f"try_cast(`{by}` as double)"), F.lit(float("inf")))
    order = Window.orderBy("value_", "gene", "transcript")
    return whole.withColumn("value_", value).withColumn("rank", F.row_number().over(order)).drop("value_")


def detail(cohort: Cohort) -> DataFrame:
    """Per locus over its transcripts: names, frequency, allele counts by status and carriers.

    A collapsed row stands for itself in its transcript: it has carriers instead of alleles, one for each sample.
    """
    n, cases = cohort.sizes
    c = counted_variants(cohort)
    if not set(LOCUS) <= set(c.columns):
        raise ValueError("variants without a locus: collapse them by operators.filters.collapse_rare, which keeps it")
    c = c.withColumn("own_", F.when(F.col("type") == COLLAPSED, F.col("transcript")))
    key = [*LOCUS, "type", "gene", "own_"]
    own = c.groupBy(*key).agg(
        F.array_join(F.array_sort(F.collect_set("transcript")), ",").alias("transcripts"), F.min_by("weight", "transcript").alias("weight"), F.min_by("variant_id", "transcript").alias("variant_id"),
        F.min_by("ac", "transcript").alias("ac"), F.min_by("case_ac", "transcript").alias("case_alt"),
    )
    held = cohort.calls.where("dosage > 0").join(cohort.samples.select("sample_id", "y"), "sample_id")
    listed = held.groupBy("variant_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("y") == 1, F.col("sample_id")))), lambda x: x.cast("string")), ",").alias("case_list"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("y") == 0, F.col("sample_id")))), lambda x: x.cast("string")), ",").alias("control_list"),
    )
    joined = own.join(listed, "variant_id", "left")
    empty = lambda x: F.when(F.coalesce(F.col(x), F.lit("")) == "", "-").otherwise(F.col(x)).alias(x)
    scale = F.when(F.col("type") == COLLAPSED, 1).otherwise(2)
    return joined.select(
        "gene", "transcripts", F.concat_ws(",", *(F.col(x).cast("string") for x in LOCUS), "type").alias("variant"), "weight", (F.col("ac") / (scale * F.lit(float(n)))).alias("af"),
        (scale * cases - F.col("case_alt")).alias("case_ref"), "case_alt", (scale * (n - cases) - F.col("ac") + F.col("case_alt")).alias("control_ref"), (F.col("ac") - F.col("case_alt")).alias("control_alt"),
        empty("case_list"), empty("control_list"),
    )


def runs(frame: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Numbers of each group as text, neighbours joined: 1-3,7."""
    order = Window.partitionBy(*keys).orderBy(value)
    island = frame.select(*keys, value, (F.col(value) - F.row_number().over(order)).alias("island"))
    ranges = island.groupBy(*keys, "island").agg(F.min(value).alias("a"), F.max(value).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    parts = F.array_sort(F.collect_list(F.struct("a", text.alias("t"))))
    return ranges.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p.t), ",").alias(out))


def carrier_report(cohort: Cohort) -> DataFrame:
    """Lines of the carrier report: target or background side, unique or recurrent, genotype classes and carriers by index."""
    index = numbered(cohort.samples.select("sample_id", "y"), "sample_id")
    c = counted_variants(cohort).select("variant_id", *GROUP, "carriers", "case_carriers")
    held = cohort.calls.where("dosage > 0").join(index, "sample_id").select("variant_id", "y", "dosage", "at")
    listed = runs(cohort.dealt(held, "variant_id"), ["variant_id", "y", "dosage"], "at", "who")
    sides = listed.groupBy("variant_id", "y").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("dosage").cast("string"), F.lit(":"), F.col("who")))), ";").alias("who"))
    joined = sides.join(c, "variant_id")
    side = F.when(F.col("y") == 1, "T").otherwise("B")
    count = F.when(F.col("y") == 1, F.col("case_carriers")).otherwise(F.col("carriers") - F.col("case_carriers"))
    return joined.select(*GROUP, "variant_id", F.concat(side, F.when(count == 1, "U").otherwise("R")).alias("line"), "who")


def interval_join(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Points (chrom, pos) inside spans (chrom, span_start, span_end), both ends included: an equi-join on buckets.

    A span stands in the one or two buckets of its own size, a power of two, however long it is; a point looks at its bucket
    of every size that spans have (a few dozen at most).  Crowded buckets are split as skewed keys by adaptive execution.
    """
    size = F.greatest(F.ceil(F.log2(F.col("span_end") - F.col("span_start") + 1.0)), F.lit(LEAST_SIZE)).cast("int")
    bucket = lambda c, s: F.shiftright(c.cast("long"), s)
    sized = spans.where("span_end >= span_start").withColumn("size_", size)
    sizes = sorted(r.size_ for r in sized.select("size_").distinct().collect())
    ends = F.array_distinct(F.array(*(F.call_function("shiftright", F.col(c).cast("long"), F.col("size_")) for c in ("span_start", "span_end"))))
    cut = sized.withColumn("bucket_", F.explode(ends))
    at = F.explode(F.array(*(F.struct(F.lit(s).alias("size_"), bucket(F.col("pos"), s).alias("bucket_")) for s in sizes)) if sizes else F.array().cast("array<struct<size_:int,bucket_:bigint>>"))
    probed = points.withColumn("at_", at).select(*points.columns, "at_.size_", "at_.bucket_")
    return probed.join(cut, ["chrom", "size_", "bucket_"]).where("pos between span_start and span_end").drop("size_", "bucket_")


def variant_class(ref: Column, alt: Column) -> Column:
    """Class of a VCF row: several alternates or longer alternate insertion, longer reference deletion, single SNV, else MNP."""
    return (
        F.when(alt.contains(","), F.when(F.length(F.substring_index(alt, ",", 1)) > F.length(ref), "insertion").otherwise("MNP"))
        .when(F.length(ref) > F.length(alt), "deletion")
        .when(F.length(ref) < F.length(alt), "insertion")
        .when(F.length(ref) == 1, "SNV")
        .otherwise("MNP")
    )


def filled(template: str) -> Column:
    """Text of a template such as {chrom}_{start}_{ref}_{alt}: names of columns in braces; chrom without its chr."""
    parts = re.split(r"\{(\w+)\}", template)
    value = lambda c: F.regexp_replace("chrom", "^chr", "") if c == "chrom" else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(*(value(p) if k % 2 else F.lit(p) for k, p in enumerate(parts) if k % 2 or p))


def annotation_export(variants: DataFrame, variant: str = "{chrom}_{start}_{ref}_{alt}", group: str = "{gene}", split: str | None = None, default: str = "unknown") -> DataFrame:
    """(vid, set_id, category) of autosomal variants, names cleaned for white-space separated files.

    Ids follow templates.  With split a function of several values gives a row for each, without repeats.
    """
    values = F.split("function", f"[{re.escape(split)}]") if split else F.array("function")
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"\s+", "_"), ",", "_")
    named = F.transform(values, lambda x: F.when(F.coalesce(F.trim(x), F.lit("")) == "", F.lit(default)).otherwise(clean(x)))
    on = variants.withColumn("c", F.expr("try_cast(regexp_replace(chrom, '^chr', '') as int)")).where("c between 1 and 22")
    return on.select(filled(variant).alias("vid"), filled(group).alias("set_id"), F.explode(F.array_distinct(named)).alias("category"), F.col("c").alias("chrom"), "start").distinct()


def set_list_export(annotations: DataFrame) -> DataFrame:
    """One line for each set: first chromosome, first position and its variants in order of position."""
    order = F.array_sort(F.collect_set(F.struct("chrom", "start", "vid")))
    return annotations.groupBy("set_id").agg(order.alias("v")).select("set_id", F.col("v")[0].chrom.alias("chrom"), F.col("v")[0].start.alias("start"), F.array_join(F.transform("v", lambda x: x.vid), ",").alias("vids"))


def mask_export(annotations: DataFrame) -> DataFrame:
    return annotations.agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories")).select(F.lit("all").alias("mask"), "categories")


def chromosome_order(chrom: Column) -> Column:
    """1 to 22, X, Y, MT, others."""
    bare = F.regexp_replace(chrom, "^chr", "")
    number = F.when(bare.rlike(r"^\d+$"), bare.cast("int"))
    return F.coalesce(number, F.when(bare == "X", 23).when(bare == "Y", 24).when(bare.isin("M", "MT"), 25).otherwise(26))


def manhattan(results: DataFrame, genes: DataFrame, gap: int = 1_000_000) -> DataFrame:
    """Best row of each gene with its place on one axis and -log10 p; a zero p counts as a tenth of the least positive one."""
    best = results.groupBy("gene").agg(F.min("p").alias("p"))
    floor = best.where("p > 0").agg(F.min("p")).first()[0] or 1.0
    placed = best.join(genes, "gene")
    sizes = genes.groupBy("chrom").agg(F.max("start").alias("size")).withColumn("n", chromosome_order(F.col("chrom")))
    before = Window.orderBy("n", "chrom").rowsBetween(Window.unboundedPreceding, -1)  # one row for each chromosome
    offsets = sizes.select("chrom", F.coalesce(F.sum(F.col("size") + gap).over(before), F.lit(0)).alias("offset"), (F.row_number().over(Window.orderBy("n", "chrom")) % 2).alias("colour"))
    p = F.when(F.col("p") > 0, F.col("p")).otherwise(F.lit(floor / 10))
    return placed.join(offsets, "chrom").select("gene", "chrom", (F.col("start") + F.col("offset")).alias("place"), "colour", (-F.log10(p)).alias("score"))


def quantiles(results: DataFrame, by: str = "p") -> DataFrame:
    """Ready for a QQ plot: -log10 of each p beside that of its rank's expected value."""
    order = Window.orderBy(by, "gene", "transcript")  # one row for each transcript
    ranked_p = results.select("gene", "transcript", F.col(by).alias("p"), F.row_number().over(order).alias("rank"), F.count("*").over(Window.partitionBy()).alias("all"))
    return ranked_p.select("gene", "transcript", (-F.log10("p")).alias("observed"), (-F.log10((F.col("rank") - 0.5) / F.col("all"))).alias("expected"))


def power_curve(ratios: DataFrame) -> DataFrame:
    """Ready for a power plot: ratios of each group by method, alpha and sample size."""
    return ratios.select("gene", "transcript", "method", "alpha", (F.col("n_cases") + F.col("n_controls")).alias("samples"), "ratio")


def sample_index(cohort: Cohort) -> DataFrame:
    """(sample_id, at): the numbers by which carrier lists name samples, which end the carrier report."""
    return numbered(cohort.samples.select("sample_id"), "sample_id")


def ordered_report(report: DataFrame, results: DataFrame, by: str = "empirical_p") -> DataFrame:
    """The carrier report with each transcript's place, p and score: a gene's transcripts in order of p."""
    order = Window.partitionBy("gene").orderBy(by, "transcript")
    placed = results.select(*GROUP, "stat", by, F.row_number().over(order).alias("place"))
    return report.join(placed, list(GROUP))
