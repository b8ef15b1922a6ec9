"""Conversions and lookups around a scan: VCF to matrix rows, gene places, permuted statistics, threshold stops."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.special import poisson_ci
from ..operators.grouped import spread
from ..sources.files import MATRIX, SPARSE
from .reports import interval_join, variant_class
from .statistics import GROUP

# What the default whitelist allows for every method.
DEFAULT_TYPES = ("SNV", "insertion", "deletion", "SPDA", "complex_substitution")
DEFAULT_FUNCTIONS = (
    "nonsynonymous", "nonsynonymous SNV", "frameshift", "frameshift substitution", "nonframeshift", "nonframeshift substitution",
    "stopgain", "stoploss", "unknown", "-", "splicing",
)


def default_whitelist(spark: SparkSession, method: str) -> DataFrame:
    return spark.createDataFrame([(method, v) for v in (*DEFAULT_TYPES, *DEFAULT_FUNCTIONS)], "method string, value string")


def gathered(calls: DataFrame, index: DataFrame, *keys: str) -> DataFrame:
    """(keys, c): the calls (keys, sample_id, code) as an array of (at, code) in order of index (sample_id, at)."""
    cell = F.struct("at", F.coalesce(F.col("code").cast("string"), F.lit("0")).alias("code"))
    return calls.join(index.select("sample_id", "at"), "sample_id", "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), cell))).alias("c"))


def spelled(number: int) -> Column:
    """The codes of c, one for each of `number` samples; zero where there is no call: a run of zeros lies between two of them."""
    before = lambda i: F.coalesce(F.get(F.col("c"), i - 1).getField("at"), F.lit(-1))
    zeros = lambda count: F.repeat(F.lit("0"), count.cast("int"))
    run = lambda x, i: F.when(x.at > before(i), F.concat(zeros(x.at - before(i) - 1), x.code)).otherwise(F.raise_error(F.lit("a sample has two calls of a variant")))
    return F.concat(F.array_join(F.transform("c", run), ""), zeros(F.lit(number - 1) - before(F.size("c"))))


def glued(calls: DataFrame, index: DataFrame, number: int, *keys: str) -> DataFrame:
    """(keys, gt): the codes of calls (keys, sample_id, code) in order of index (sample_id, at), of `number` samples."""
    return gathered(calls, index, *keys).select(*keys, spelled(number).alias("gt"))


def listed(calls: DataFrame, index: DataFrame, *keys: str) -> DataFrame:
    """(keys, gt): the calls (keys, sample_id, code) as the sparse genotype field of a matrix file, by the places of index
    (sample_id, at)."""
    cell = F.struct(F.col("at").cast("int").alias("at"), F.col("code").cast("string").alias("code"))
    rows = calls.join(index.select("sample_id", "at"), "sample_id").groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    text = F.transform("c", lambda x: F.concat(x.at.cast("string"), F.lit(":"), x.code))
    return rows.select(*keys, F.concat(F.lit(SPARSE), F.array_join(text, ",")).alias("gt"))


def vcf_matrix(calls: DataFrame, models: DataFrame, ids: list[str] | DataFrame, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """Matrix rows of VCF calls (chrom, pos, ref, alt, sample_id, code) inside the transcripts of gene models.

    Places meet transcript spans by an interval join; genotypes are glued in the order of ids (a list, or a frame with
    sample_id and the place at), zero where there is no call.  Only calls travel: genotypes are spelled out after the join,
    or, if a digest of them is wanted in their place, once for each variant before it.
    """
    if isinstance(ids, DataFrame):
        index, number = ids, ids.count()
    else:
        index, number = calls.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], f"sample_id {calls.schema['sample_id'].dataType.simpleString()}, at long"), len(ids)
    spans = models.select("chrom", "gene", "transcript", F.col("tx_start").alias("span_start"), F.col("tx_end").alias("span_end"))
    at, keys = F.col("pos").cast("string"), ("chrom", "pos", "ref", "alt")
    # Work grows with the samples, not with the calls' bytes, by which Spark would merge rows into few tasks.
    held = spread(gathered(calls, index, *keys), *keys)
    if digest is not None:
        rows, gt = interval_join(held.select(*keys, digest(spelled(number)).alias("gt")), spans), F.col("gt")
    else:
        rows, gt = interval_join(held, spans), spelled(number)
    return rows.select(
        "chrom", at.alias("start"), at.alias("end"), "ref", "alt", variant_class(F.col("ref"), F.col("alt")).alias("type"), "gene", "transcript", F.lit(".").alias("region"), F.lit("unknown").alias("function"), F.lit(".").alias("annotation"), gt.alias("gt")
    )


def matrix_lines(rows: DataFrame) -> DataFrame:
    """Matrix rows as tab-separated lines, in order of gene, transcript and place."""
    value = F.concat_ws("\t", *MATRIX, "gt")
    return rows.orderBy("gene", "transcript", F.col("start").cast("long")).select(value.alias("value"))


def collapsed_rows(rows: DataFrame, collapsed: DataFrame) -> DataFrame:
    """The matrix rows of variants that were collapsed (chrom, start, end, ref, alt, transcript)."""
    return rows.join(collapsed, ["chrom", "start", "end", "ref", "alt", "transcript"], "left_semi")


def locate(results: DataFrame, features: DataFrame) -> DataFrame:
    """Results with chrom and start: by gene id, else by gene name, else by the parent of a transcript id; versions ignored."""
    bare = F.regexp_replace("gene", r"\.\d+$", "")
    genes = features.where(F.col("parent").isNull())
    place = lambda df, key, tag: df.groupBy(F.col(key).alias(f"{tag}_key")).agg(F.min_by(F.struct("chrom", "start"), "start").alias(tag))
    by_id, by_name = place(genes, "id", "by_id"), place(genes.where("name is not null"), "name", "by_name")
    parents = features.where(F.col("parent").isNotNull()).select(F.col("id").alias("child"), F.col("parent").alias("up"))
    child = place(parents.join(genes, parents.up == genes.id).select("child", "chrom", "start"), "child", "by_child")
    keyed = results.withColumn("bare_", bare)
    joined = keyed.join(by_id, F.col("bare_") == F.col("by_id_key"), "left").join(by_name, F.col("bare_") == F.col("by_name_key"), "left").join(child, F.col("bare_") == F.col("by_child_key"), "left")
    found = F.coalesce("by_id", "by_name", "by_child")
    return joined.select(*results.columns, found.chrom.alias("chrom"), found.start.alias("start"))


def permuted_values(marked: DataFrame) -> DataFrame:
    """Per group its permuted statistics in order of perm_id, for the output that lists them all."""
    return marked.groupBy(*GROUP).agg(F.transform(F.array_sort(F.collect_list(F.struct("perm_id", "stat"))), lambda x: x.stat).alias("stats"))


def permuted_moments(marked: DataFrame) -> DataFrame:
    """Mean over genes of the permuted statistic, and its variance around it, for each permutation."""
    return marked.groupBy("perm_id").agg(F.avg("stat").alias("mean"), F.var_pop("stat").alias("variance"))


def percentile(scores: DataFrame) -> DataFrame:
    """(#(score <= permuted) + 1) / (n + 1) from marked hits (stat, observed)."""
    return scores.groupBy(*GROUP).agg(((F.sum((F.col("observed") <= F.col("stat")).cast("int")) + 1) / (F.count("*") + 1.0)).alias("percentile"))


def threshold_stop(marked: DataFrame, threshold: float, least: int = 10) -> DataFrame:
    """(gene, stop): the first permutation after `least` at which every transcript's p surely exceeds the threshold.

    Surely: the lower end of the Poisson interval of its success rate is above it; else the last permutation.
    """

    @F.pandas_udf("double")
    def low(hits: pd.Series, n: pd.Series) -> pd.Series:
        known: dict[tuple[int, int], float] = {}
        return pd.Series([known.setdefault((h, k), poisson_ci(float(h), float(k))[0]) if (h, k) not in known else known[h, k] for h, k in zip(hits, n, strict=True)])

    run = Window.partitionBy(*GROUP).orderBy("perm_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = marked.select(*GROUP, "perm_id", F.sum("hit").over(run).alias("hits"), F.count("*").over(run).alias("n"))
    sure = upto.select("gene", "perm_id", ((F.col("n") > least) & (low("hits", "n") > threshold)).alias("sure"))
    whole = sure.groupBy("gene", "perm_id").agg(F.min("sure").alias("sure"))
    return whole.groupBy("gene").agg(F.coalesce(F.min(F.when(F.col("sure"), F.col("perm_id"))), F.max("perm_id")).cast("int").alias("stop"))
