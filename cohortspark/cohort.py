"""The data model: samples, variants (one row per variant and transcript) and sparse calls."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Variant types, and functions that the driver-table cohort deals out.
TYPES = ("SNV", "insertion", "deletion", "SPDA", "complex_substitution")
FUNCTIONS = ("synonymous", "nonsynonymous", "frameshift", "nonframeshift", "stopgain", "stoploss", "unknown", "splicing")


TASK_ROWS = 500_000  # rows of calls that a task takes


def task_count(rows: int, cores: int) -> int:
    """Tasks for so many rows; 0: cores are enough, and Spark may merge small partitions."""
    return -(-rows // TASK_ROWS) if rows > cores * TASK_ROWS else 0


@dataclass(frozen=True)
class Cohort:
    """samples(sample_id, y, trait, cov_num, cov_cat), variants(variant_id, ..., gene, transcript, type, function,
    weight) and calls(sample_id, variant_id, dosage, missing), which hold no zero dosages."""

    samples: DataFrame
    variants: DataFrame
    calls: DataFrame
    rows: int | None = None  # that calls are made from, if known

    def dealt(self, rows: DataFrame, *keys: str) -> DataFrame:
        """rows made from calls, dealt by keys to tasks of bounded size: Spark by itself merges partitions until there is one
        for each core, and its memory grows with the table."""
        return dealt(rows, self.rows or 0, *keys)

    @cached_property
    def sizes(self) -> tuple[int, int]:
        """Samples and cases: two numbers that every statistic needs."""
        row = self.samples.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("cases")).first()
        return int(row.n), int(row.cases)

    def register(self, prefix: str = "") -> None:
        """Temporary views, so that SQL can query the cohort."""
        for name in ("samples", "variants", "calls"):
            getattr(self, name).createOrReplaceTempView(prefix + name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, number: int, *keys: str) -> DataFrame:
    """rows, about so many, by keys in tasks of TASK_ROWS rows; few rows are left as they are."""
    tasks = task_count(number, rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys) if tasks else rows


def pick(values: tuple[str, ...], at: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)


def from_tables(spark: SparkSession, sf_dir: str) -> Cohort:
    """Customers as samples, parts as variants, purchases as genotype calls."""
    samples = read(spark, sf_dir, "customer").join(
        read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        F.col("c_custkey").alias("sample_id"),
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY").cast("int").alias("y"),
        F.col("c_acctbal").alias("trait"),
        (F.col("c_acctbal") / 1000).alias("cov_num"),
        F.col("n_regionkey").cast("int").alias("cov_cat"),
    )
    key = F.col("p_partkey")
    one = read(spark, sf_dir, "part").select(
        key.alias("variant_id"),
        F.concat(F.lit("chr"), (key % 22 + 1).cast("string")).alias("chrom"),
        (key * 10).alias("start"),
        (key * 10).alias("end"),
        pick(("A", "C", "G", "T"), key % 4).alias("ref"),
        pick(("C", "G", "T", "A"), key % 4).alias("alt"),
        pick(TYPES, key % 5).alias("type"),
        pick(FUNCTIONS, F.col("p_size") % 8).alias("function"),
        F.col("p_brand").alias("gene"),
        (F.col("p_retailprice") / 1000).alias("weight"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("ks"),
    )
    variants = one.select("*", F.explode("ks").alias("k")).select(
        *(c for c in one.columns if c != "ks"), F.concat_ws(".", "gene", F.col("k").cast("string")).alias("transcript")
    )
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    number = lines.count()  # known to the files
    lines, orders = dealt(lines.select("l_orderkey", "l_partkey"), number, "l_orderkey"), dealt(orders.select("o_orderkey", "o_custkey"), number, "o_orderkey")
    code = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("sample_id"), F.col("l_partkey").alias("variant_id"))
    calls = dealt(code, number, "sample_id").groupBy("sample_id", "variant_id").agg(F.count("*").alias("code"))
    calls = calls.select(
        "sample_id", "variant_id", F.when(F.col("code") > 2, 0).otherwise(F.col("code")).cast("int").alias("dosage"), (F.col("code") > 2).alias("missing")
    )
    return Cohort(samples, variants, calls, number)
