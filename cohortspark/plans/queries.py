"""Registered queries over the driver tables, and the SQL that an independent engine runs for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cohort import FUNCTIONS, TYPES, Cohort, from_tables, read
from ..config import OPTIMIZERS, AssocConfig
from ..functions.glm import distributed_fit
from ..operators import filters as ops
from ..operators.grouped import Null, design, hotelling, null_model, regression_tests, score_tests
from ..operators.grouped import vaast_grouped as grouped_vaast
from ..operators.products import numbered
from ..sources import sinks
from ..sources.files import MATRIX, SPARSE, from_files, read_permutations, read_simple, repeated_variants, write_permutations
from ..streaming.blocks import persist, shared_path
from . import association
from . import permutation as perm
from . import reports as rp
from . import resampling as rs
from . import statistics as st
from . import tools

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def case_list(at: str, values: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {at} = {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


# The cohort, and counts of its variants, as SQL.
BASE = f"""
WITH samples AS (
  SELECT c_custkey AS sample_id, CAST(c_mktsegment IN ('BUILDING', 'MACHINERY') AS INT) AS y, c_acctbal AS trait,
         c_acctbal / 1000 AS cov_num, n_regionkey AS cov_cat
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), sizes AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS cases, sum(y) / count(*) AS p0 FROM samples),
calls AS (
  SELECT o_custkey AS sample_id, l_partkey AS variant_id, CASE WHEN count(*) > 2 THEN 0 ELSE count(*) END AS dosage, count(*) > 2 AS missing
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
), variants AS (
  SELECT p_partkey AS variant_id, 'chr' || (p_partkey % 22 + 1) AS chrom, p_partkey * 10 AS start, p_partkey * 10 AS "end",
         {case_list("p_partkey % 4", ("A", "C", "G", "T"))} AS ref, {case_list("p_partkey % 4", ("C", "G", "T", "A"))} AS alt,
         {case_list("p_partkey % 5", TYPES)} AS type, {case_list("p_size % 8", FUNCTIONS)} AS function,
         p_brand AS gene, p_retailprice / 1000 AS weight, p_brand || '.' || k AS transcript
  FROM part, (VALUES (1), (2)) ks(k) WHERE k = 1 OR p_size % 2 = 0
), counts AS (
  SELECT variant_id, CAST(sum(dosage) AS BIGINT) AS ac, CAST(sum(dosage * dosage) AS BIGINT) AS ac2,
         CAST(sum(CAST(dosage > 0 AS INT)) AS BIGINT) AS carriers,
         CAST(sum(dosage * y) AS BIGINT) AS case_ac, CAST(sum(CAST(dosage > 0 AS INT) * y) AS BIGINT) AS case_carriers,
         CAST(sum(CAST(missing AS INT)) AS BIGINT) AS n_missing, CAST(sum(CAST(missing AS INT) * y) AS BIGINT) AS case_missing
  FROM calls JOIN samples USING (sample_id) GROUP BY 1
), cv AS (
  SELECT variants.*, coalesce(ac, 0) AS ac, coalesce(ac2, 0) AS ac2, coalesce(carriers, 0) AS carriers, coalesce(case_ac, 0) AS case_ac,
         coalesce(case_carriers, 0) AS case_carriers, coalesce(n_missing, 0) AS n_missing, coalesce(case_missing, 0) AS case_missing
  FROM variants LEFT JOIN counts USING (variant_id)
), carried AS (
  SELECT gene, transcript, sample_id, sum(weight * dosage) AS burden, sum(dosage) AS alleles, count(*) AS sites
  FROM calls JOIN variants USING (variant_id) WHERE dosage > 0 GROUP BY 1, 2, 3
), t22 AS (
  SELECT gene, transcript, CAST(sum(y) AS BIGINT) AS case_carrier, CAST(sum(1 - y) AS BIGINT) AS control_carrier,
         CAST(any_value(cases) - sum(y) AS BIGINT) AS case_other, CAST(any_value(n - cases) - sum(1 - y) AS BIGINT) AS control_other
  FROM carried JOIN samples USING (sample_id), sizes GROUP BY 1, 2
)
"""


def chi_tail(x: str, df: str = "1") -> str:
    """Upper chi-square tail: a series in the lower incomplete gamma function."""
    return (
        f"(CASE WHEN ({x}) <= 0 THEN 1.0 ELSE 1 - list_sum([exp((({df}) / 2.0 + i) * ln(({x}) / 2) - ({x}) / 2 - lgamma(({df}) / 2.0 + 1 + i)) "
        "FOR i IN range(0, 400)]) END)"
    )


def query(name: str, sql: str | None = None, base: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = (BASE if base else "") + sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


# Scans, joins and filters.


@query("scan_variants", "SELECT variant_id, concat_ws(',', chrom, start, \"end\", ref, alt, type, gene, transcript) AS variant_key, function, round(weight, 6) AS weight FROM variants")
def scan_variants(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(from_tables(spark, sf).variants.select("variant_id", ops.variant_key().alias("variant_key"), "function", "weight"), "weight")


@query("gene_list_scan", "SELECT variant_id, gene, transcript FROM variants WHERE gene IN ('Brand#11', 'Brand#23', 'Brand#55')")
def gene_list_scan(spark: SparkSession, sf: str) -> DataFrame:
    return from_tables(spark, sf).variants.where(F.col("gene").isin("Brand#11", "Brand#23", "Brand#55")).select("variant_id", "gene", "transcript")


@query(
    "gene_range_scan",
    "SELECT gene, CAST(ordinal AS INTEGER) AS ordinal, variants_in_gene FROM (SELECT gene, dense_rank() OVER (ORDER BY first_at, gene) AS ordinal, variants_in_gene FROM "
    "(SELECT gene, min(variant_id) AS first_at, count(*) AS variants_in_gene FROM variants GROUP BY 1)) WHERE ordinal BETWEEN 3 AND 8",
)
def gene_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    genes = from_tables(spark, sf).variants.groupBy("gene").agg(F.min("variant_id").alias("first_at"), F.count("*").alias("variants_in_gene"))
    order = Window.orderBy("first_at", "gene")  # one row for each gene
    return genes.select("gene", F.dense_rank().over(order).alias("ordinal"), "variants_in_gene").where("ordinal between 3 and 8")


@query("sample_calls", "SELECT sample_id, variant_id, CAST(dosage AS INTEGER) AS dosage, missing FROM calls")
def sample_calls(spark: SparkSession, sf: str) -> DataFrame:
    return from_tables(spark, sf).calls


@query(
    "multi_file_merge",
    ", f AS (SELECT *, 1 AS file FROM variants WHERE variant_id % 3 < 2 UNION ALL SELECT *, 2 AS file FROM variants WHERE variant_id % 3 > 0) "
    "SELECT chrom, start, transcript, count(*) AS copies, CAST(min(file) AS INTEGER) AS first_file, count(*) > 1 AS duplicate FROM f GROUP BY 1, 2, 3",
)
def multi_file_merge(spark: SparkSession, sf: str) -> DataFrame:
    v = from_tables(spark, sf).variants
    parts = [v.where("variant_id % 3 < 2"), v.where("variant_id % 3 > 0")]
    return repeated_variants(parts).select("chrom", "start", "transcript", "copies", "first_file", (F.col("copies") > 1).alias("duplicate"))


@query(
    "covariate_dummies",
    ", levels AS (SELECT cov_cat, row_number() OVER (ORDER BY CAST(cov_cat AS VARCHAR)) AS k, count(*) OVER () AS m FROM (SELECT DISTINCT cov_cat FROM samples)) "
    "SELECT sample_id, array_to_string([CASE WHEN k = i THEN 1 ELSE 0 END FOR i IN range(1, m)], ',') AS design FROM samples JOIN levels USING (cov_cat)",
)
def covariate_dummies(spark: SparkSession, sf: str) -> DataFrame:
    s = from_tables(spark, sf).samples
    order = Window.orderBy(F.col("cov_cat").cast("string"))
    levels = s.select("cov_cat").distinct().select("cov_cat", F.row_number().over(order).alias("k"))
    count = levels.count()
    if count - 1 > AssocConfig().max_levels:
        raise ValueError(f"a categorical covariate has {count} levels")
    m = F.lit(count)
    one_hot = F.transform(F.sequence(F.lit(1), m - 1), lambda i: (i == F.col("k")).cast("int").cast("string"))
    return s.join(F.broadcast(levels), "cov_cat").select("sample_id", F.array_join(F.when(m > 1, one_hot), ",").alias("design"))


BED = "variant_id % 7 = 0"


@query("bed_mask_anti", f"SELECT variant_id, transcript FROM variants v WHERE NOT EXISTS (SELECT 1 FROM variants b WHERE {BED.replace('variant_id', 'b.variant_id')} AND b.chrom = v.chrom AND b.start = v.start AND b.ref = v.ref AND b.alt = v.alt)")
def bed_mask_anti(spark: SparkSession, sf: str) -> DataFrame:
    v = from_tables(spark, sf).variants
    return ops.bed_mask(v, v.where(BED)).select("variant_id", "transcript")


@query("weight_left_join", "SELECT variant_id, transcript, CASE WHEN variant_id % 3 = 0 THEN round(weight, 6) ELSE 1.0 END AS weight FROM variants")
def weight_left_join(spark: SparkSession, sf: str) -> DataFrame:
    v = from_tables(spark, sf).variants
    return rounded(ops.attach_weights(v, v.where("variant_id % 3 = 0")).select("variant_id", "transcript", "weight"), "weight")


ALLOWED = [*TYPES, *(f for f in FUNCTIONS if f != "synonymous")]


@query("whitelist_semi", f"SELECT variant_id, transcript, type, function FROM variants WHERE type IN ({', '.join(repr(t) for t in ALLOWED)}) AND function IN ({', '.join(repr(t) for t in ALLOWED)})")
def whitelist_semi(spark: SparkSession, sf: str) -> DataFrame:
    allowed = spark.createDataFrame([("SKAT", v) for v in ALLOWED], "method string, value string")
    return ops.whitelist(from_tables(spark, sf).variants, allowed, "SKAT").select("variant_id", "transcript", "type", "function")


@query("sample_align_check", "SELECT coalesce(s.sample_id, o.o_custkey) AS sample_id, s.sample_id IS NULL AS only_in_calls, o.o_custkey IS NULL AS only_in_samples FROM samples s FULL JOIN (SELECT DISTINCT o_custkey FROM orders) o ON s.sample_id = o.o_custkey WHERE s.sample_id IS NULL OR o.o_custkey IS NULL")
def sample_align_check(spark: SparkSession, sf: str) -> DataFrame:
    ids = read(spark, sf, "orders").select(F.col("o_custkey").alias("other")).distinct()
    both = from_tables(spark, sf).samples.join(ids, F.col("sample_id") == F.col("other"), "full")
    return both.where("sample_id is null or other is null").select(
        F.coalesce("sample_id", "other").alias("sample_id"), F.col("sample_id").isNull().alias("only_in_calls"), F.col("other").isNull().alias("only_in_samples")
    )


# Aggregates and transforms.


@query("allele_counts", "SELECT variant_id, transcript, ac, carriers, n_missing, round(ac / (2 * n), 6) AS frequency FROM cv, sizes")
def allele_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = from_tables(spark, sf)
    return ops.counted_variants(c).select("variant_id", "transcript", "ac", "carriers", "n_missing", F.round(F.col("ac") / (2.0 * c.sizes[0]), 6).alias("frequency"))


@query("case_control_counts", "SELECT variant_id, case_ac AS case_alt, CAST(2 * cases - case_ac AS BIGINT) AS case_ref, ac - case_ac AS control_alt, CAST(2 * (n - cases) - ac + case_ac AS BIGINT) AS control_ref FROM counts, sizes")
def case_control_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = from_tables(spark, sf)
    n, cases = c.sizes
    return ops.counts(c).select(
        "variant_id", F.col("case_ac").alias("case_alt"), (2 * cases - F.col("case_ac")).alias("case_ref"), (F.col("ac") - F.col("case_ac")).alias("control_alt"),
        (2 * (n - cases) - F.col("ac") + F.col("case_ac")).alias("control_ref"),
    )


@query("transcript_counts", "SELECT gene, transcript, CAST(sum(case_ac) AS BIGINT) AS case_alt, CAST(sum(ac - case_ac) AS BIGINT) AS control_alt, count(*) AS variants FROM cv GROUP BY 1, 2")
def transcript_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ops.counted_variants(from_tables(spark, sf)).groupBy("gene", "transcript").agg(
        F.sum("case_ac").alias("case_alt"), F.sum(F.col("ac") - F.col("case_ac")).alias("control_alt"), F.count("*").alias("variants")
    )


@query("sample_burden", "SELECT gene, transcript, sample_id, round(burden, 6) AS burden, CAST(alleles AS BIGINT) AS alleles, sites FROM carried")
def sample_burden(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.carriers(from_tables(spark, sf)).select("gene", "transcript", "sample_id", "burden", "alleles", "sites"), "burden")


@query("aaf_filter", "SELECT variant_id, transcript, ac FROM cv, sizes WHERE ac <= 40 AND ac / (2 * n) < 0.0105")
def aaf_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = from_tables(spark, sf)
    return ops.aaf_filter(ops.counted_variants(c), c.sizes[0], 40, 0.0105).select("variant_id", "transcript", "ac")


@query("maf_flip_filter", ", m AS (SELECT variant_id, transcript, ac / (2 * n) > 0.5 AS flip, CASE WHEN ac / (2 * n) > 0.5 THEN CAST(2 * (n - n_missing) - ac AS BIGINT) ELSE ac END AS minor_ac, n FROM cv, sizes) SELECT variant_id, transcript, flip, minor_ac FROM m WHERE minor_ac <= 35 AND minor_ac / (2 * n) <= 0.01")
def maf_flip_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = from_tables(spark, sf)
    return ops.maf_filter(ops.counted_variants(c), c.sizes[0], 35, 0.01).select("variant_id", "transcript", "flip", "minor_ac")


@query("polymorphic_gate", ", g AS (SELECT gene, transcript, count(*) AS variants, CAST(sum(ac) AS BIGINT) AS alleles FROM cv GROUP BY 1, 2), k AS (SELECT *, alleles >= 1200 AND variants >= 35 AS kept FROM g) SELECT gene, transcript, variants, alleles, kept, max(kept) OVER (PARTITION BY gene) AS gene_kept FROM k")
def polymorphic_gate(spark: SparkSession, sf: str) -> DataFrame:
    return ops.polymorphic(ops.counted_variants(from_tables(spark, sf)), 1200, 35)


@query(
    "impute_af",
    ", g AS (SELECT variant_id, y, sum(dosage) AS a, sum(CAST(missing AS INT)) AS gone FROM calls JOIN samples USING (sample_id) GROUP BY 1, 2) "
    "SELECT sample_id, variant_id, round(CASE WHEN missing THEN a / (2 * ((CASE WHEN y = 1 THEN cases ELSE n - cases END) - gone)) ELSE dosage END, 9) AS dosage, missing "
    "FROM calls JOIN samples USING (sample_id) JOIN g USING (variant_id, y), sizes",
)
def impute_af(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ops.impute(from_tables(spark, sf)), "dosage", digits=9)


@query("beta_weights", "SELECT variant_id, transcript, round(pow(1 - ac / (2 * n), 24) * 25, 6) AS weight FROM cv, sizes")
def beta_weights(spark: SparkSession, sf: str) -> DataFrame:
    c = from_tables(spark, sf)
    return ops.counted_variants(c).select("variant_id", "transcript", F.round(ops.beta_weight(F.col("ac") / (2.0 * c.sizes[0])), 6).alias("weight"))


@query("whole_gene_union", "SELECT gene AS transcript, concat_ws(',', chrom, start, \"end\", ref, alt, type, gene, transcript) AS variant_key FROM variants")
def whole_gene_union(spark: SparkSession, sf: str) -> DataFrame:
    return ops.whole_gene(from_tables(spark, sf).variants).select("transcript", "variant_key")


@query("whole_gene_physical", "SELECT gene, count(*) AS loci FROM (SELECT DISTINCT gene, chrom, start, ref, alt FROM variants) GROUP BY 1")
def whole_gene_physical(spark: SparkSession, sf: str) -> DataFrame:
    return ops.whole_gene(from_tables(spark, sf).variants, "physical").groupBy("gene").agg(F.count("*").alias("loci"))


COLLAPSE_SQL = """, k AS (SELECT *, ac <= 25 AS rare FROM cv), r AS (
  SELECT gene, transcript, sample_id, max(CAST(dosage > 0 AS INT)) AS d FROM calls JOIN k USING (variant_id) WHERE rare GROUP BY 1, 2, 3
)
SELECT gene, transcript, count(*) AS members, round(avg(weight), 6) AS weight,
       coalesce((SELECT CAST(sum(d) AS BIGINT) FROM r WHERE r.gene = k.gene AND r.transcript = k.transcript), 0) AS carriers
FROM k WHERE rare GROUP BY 1, 2"""


@query("variant_collapse", COLLAPSE_SQL)
def variant_collapse(spark: SparkSession, sf: str) -> DataFrame:
    variants, calls = ops.collapse_rare(from_tables(spark, sf), 25)
    sums = calls.groupBy("variant_key").agg(F.sum("dosage").alias("carriers"))
    return rounded(
        variants.where("type = 'Collapsed'").join(sums, "variant_key", "left").select("gene", "transcript", "members", "weight", F.coalesce("carriers", F.lit(0)).alias("carriers")), "weight"
    )


@query("collapse_audit", ", k AS (SELECT *, ac > 0 AND ac <= 25 AS rare FROM cv) SELECT gene, transcript, count(*) AS variants, CAST(sum(CAST(rare AS INT)) AS BIGINT) AS collapsed, CAST(sum(CAST(ac = 0 AS INT)) AS BIGINT) AS empty, CAST(sum(CASE WHEN rare THEN ac ELSE 0 END) AS BIGINT) AS collapsed_alleles, round(avg(carriers), 6) AS mean_carriers, round(var_samp(carriers), 6) AS var_carriers FROM k GROUP BY 1, 2")
def collapse_audit(spark: SparkSession, sf: str) -> DataFrame:
    rare = (F.col("ac") > 0) & (F.col("ac") <= 25)
    return ops.counted_variants(from_tables(spark, sf)).groupBy("gene", "transcript").agg(
        F.count("*").alias("variants"), F.sum(rare.cast("long")).alias("collapsed"), F.sum((F.col("ac") == 0).cast("long")).alias("empty"),
        F.sum(F.when(rare, F.col("ac")).otherwise(0)).alias("collapsed_alleles"), F.round(F.avg("carriers"), 6).alias("mean_carriers"), F.round(F.var_samp("carriers"), 6).alias("var_carriers"),
    )


# Statistics.


@query("calpha", "SELECT gene, transcript, round(sum(pow(case_carriers - carriers * p0, 2) - carriers * p0 * (1 - p0)), 6) AS calpha FROM cv, sizes GROUP BY 1, 2")
def calpha(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.calpha(from_tables(spark, sf)), "calpha")


@query("calpha_ranked", ", s AS (SELECT gene, transcript, round(sum(pow(case_carriers - carriers * p0, 2) - carriers * p0 * (1 - p0)), 6) AS calpha FROM cv, sizes GROUP BY 1, 2) SELECT CAST(row_number() OVER (ORDER BY calpha DESC, gene, transcript) AS INTEGER) AS rank, gene, transcript, calpha FROM s")
def calpha_ranked(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.orderBy(F.desc("calpha"), "gene", "transcript")  # one row for each transcript
    return calpha(spark, sf).select(F.row_number().over(order).alias("rank"), "gene", "transcript", "calpha")


@query("top_transcript", ", s AS (SELECT gene, transcript, round(sum(pow(case_carriers - carriers * p0, 2) - carriers * p0 * (1 - p0)), 6) AS calpha FROM cv, sizes GROUP BY 1, 2) SELECT gene, transcript, calpha FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY calpha DESC, transcript) AS r FROM s) WHERE r = 1")
def top_transcript(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("gene").orderBy(F.desc("calpha"), "transcript")
    return calpha(spark, sf).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


@query("wss", "SELECT gene, transcript, round(sum(case_ac / sqrt((1 + ac) / (2 + 2 * n) * (1 - (1 + ac) / (2 + 2 * n)))), 6) AS wss FROM cv, sizes GROUP BY 1, 2")
def wss(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.wss(from_tables(spark, sf)), "wss")


@query(
    "vt",
    ", g AS (SELECT gene, transcript, ac, sum(case_ac) AS a, sum(ac) AS b, sum(ac2) AS c FROM cv GROUP BY 1, 2, 3), "
    "u AS (SELECT gene, transcript, sum(a) OVER w AS a, sum(b) OVER w AS b, sum(c) OVER w AS c FROM g WINDOW w AS (PARTITION BY gene, transcript ORDER BY ac)) "
    "SELECT gene, transcript, round(max(CASE WHEN c > 0 THEN (a - p0 * b) / sqrt(c) END), 6) AS vt FROM u, sizes GROUP BY 1, 2",
)
def vt(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.variable_threshold(from_tables(spark, sf)), "vt")


CMC_SQL = f""", col AS (
  SELECT gene, transcript, CASE WHEN ac / (2 * n) < 0.005 THEN -1 ELSE variant_id END AS c, sum(case_ac) AS a, sum(ac) AS t FROM cv, sizes GROUP BY 1, 2, 3 HAVING sum(ac) > 0
), tot AS (SELECT gene, transcript, sum(a) / sum(t) AS q, count(*) AS columns FROM col GROUP BY 1, 2
), chi AS (
  SELECT gene, transcript, any_value(columns) AS columns, sum(pow(a - q * t, 2) / (q * t) + pow(t - a - (1 - q) * t, 2) / ((1 - q) * t)) AS cmc
  FROM col JOIN tot USING (gene, transcript) GROUP BY 1, 2
), lone AS (
  SELECT gene, transcript, pow(case_carrier - cases * f, 2) * (1 / (cases * f) + 1 / (cases * (1 - f)) + 1 / ((n - cases) * f) + 1 / ((n - cases) * (1 - f))) AS s
  FROM (SELECT *, (case_carrier + control_carrier) / n AS f FROM t22, sizes)
), stat AS (SELECT gene, transcript, columns, CASE WHEN columns > 1 THEN cmc ELSE s END AS cmc FROM chi JOIN lone USING (gene, transcript))
SELECT gene, transcript, columns, round(cmc, 6) AS cmc, round({chi_tail("cmc", "greatest(columns - 1, 1)")}, 6) AS p FROM stat"""


@query("cmc_chisq", CMC_SQL)
def cmc_chisq(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.cmc_chisq(from_tables(spark, sf)), "cmc", "p")


@query("cmc1df_or", ", h AS (SELECT *, CASE WHEN least(case_carrier, control_carrier, case_other, control_other) = 0 THEN 0.5 ELSE 0.0 END AS e FROM t22) SELECT gene, transcript, case_carrier, control_carrier, case_other, control_other, round((case_carrier + e) * (control_other + e) / ((control_carrier + e) * (case_other + e)), 6) AS odds_ratio FROM h")
def cmc1df_or(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.odds_ratio(from_tables(spark, sf)), "odds_ratio")


@query(
    "fisher_one_sided",
    ", m AS (SELECT gene, transcript, case_carrier AS a, case_carrier + control_carrier AS m FROM t22) SELECT gene, transcript, round(list_sum(["
    "exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + lgamma(n - m + 1) - lgamma(cases - k + 1) - lgamma(n - m - cases + k + 1) - lgamma(n + 1) + lgamma(cases + 1) + lgamma(n - cases + 1)) "
    "FOR k IN range(a, CAST(least(m, cases) AS BIGINT) + 1)]), 6) AS p FROM m, sizes",
)
def fisher_one_sided(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.fisher_one_sided(from_tables(spark, sf)), "p")


BURDEN_SQL = f""", b AS (
  SELECT gene, transcript, pow(sum(burden * (y - p0)), 2) / (any_value(p0 * (1 - p0)) * (sum(burden * burden) - pow(sum(burden), 2) / any_value(n))) AS s
  FROM carried JOIN samples USING (sample_id), sizes GROUP BY 1, 2
)
SELECT gene, transcript, round(s, 6) AS burden, round({chi_tail("s")}, 6) AS p FROM b"""


@query("burden", BURDEN_SQL)
def burden(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.burden(from_tables(spark, sf)), "burden", "p")


QTL_SQL = f""", t AS (SELECT avg(trait) AS mean, var_samp(trait) AS v FROM samples), b AS (
  SELECT gene, transcript, pow(sum(burden * (trait - mean)), 2) / (any_value(v) * (sum(burden * burden) - pow(sum(burden), 2) / any_value(n))) AS s
  FROM carried JOIN samples USING (sample_id), sizes, t GROUP BY 1, 2
)
SELECT gene, transcript, round(s, 6) AS burden, round({chi_tail("s")}, 6) AS p FROM b"""


@query("burden_qtl", QTL_SQL)
def burden_qtl(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.burden(from_tables(spark, sf), quantitative=True), "burden", "p")


@query("skat_q", "SELECT gene, transcript, round(sum(pow(weight * (case_ac - p0 * ac), 2)), 6) AS skat_q FROM cv, sizes GROUP BY 1, 2")
def skat_q(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.skat_q(from_tables(spark, sf)), "skat_q")


RVT2_SQL = f""", e AS (SELECT *, case_carrier + control_carrier AS m FROM t22), g AS (
  SELECT gene, transcript, 2 * (case_carrier * ln(greatest(case_carrier, 1) / (m * cases / n)) + control_carrier * ln(greatest(control_carrier, 1) / (m * (n - cases) / n))
    + case_other * ln(greatest(case_other, 1) / ((n - m) * cases / n)) + control_other * ln(greatest(control_other, 1) / ((n - m) * (n - cases) / n))) AS s FROM e, sizes
)
SELECT gene, transcript, round(s, 6) AS lrt, round({chi_tail("s")}, 6) AS p FROM g"""


@query("rvt2_lrt", RVT2_SQL)
def rvt2_lrt(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.rvt2(from_tables(spark, sf)), "lrt", "p")


def ll(f: str, ref: str, alt: str) -> str:
    return f"(CASE WHEN {alt} = 0 THEN 0 ELSE {alt} * ln({f}) END + CASE WHEN {ref} = 0 THEN 0 ELSE {ref} * ln(1 - {f}) END)"


def lrt(a: str, b: str, na: str, nb: str, cap: str) -> str:
    f0 = f"(({a} + {b}) / ({na} + {nb}))"
    return (
        f"(CASE WHEN {a} = 0 THEN 0 ELSE {ll(f'least({b} / {nb}, {cap})', f'({nb} - {b})', b)} + {ll(f'({a} / {na})', f'({na} - {a})', a)}"
        f" - {ll(f0, f'({na} - {a})', a)} - {ll(f0, f'({nb} - {b})', b)} END)"
    )


VAAST_BASE = f""", raw AS (
  SELECT gene, transcript, variant_id, case_ac, weight, 2 * ({lrt("case_ac", "(ac - case_ac)", "(2 * cases)", "(2 * (n - cases))", "0.02")} + ln(weight)) AS s FROM cv, sizes
), fl AS (SELECT *, CASE WHEN s < 0 OR case_ac = 0 THEN 0 ELSE s END AS f FROM raw), site AS (
  SELECT gene, transcript, variant_id, CASE WHEN f > 0.5 THEN f - 0.5 ELSE f END AS score, f > 0.5 AS included FROM fl
)"""


@query("vaast_site_scores", VAAST_BASE + " SELECT gene, transcript, variant_id, round(score, 6) AS score, included FROM site")
def vaast_site_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.vaast_sites(from_tables(spark, sf), 0.5, 0.02), "score")


@query("vaast", VAAST_BASE + " SELECT gene, transcript, round(sum(CASE WHEN included THEN score ELSE 0 END), 6) AS vaast FROM site GROUP BY 1, 2")
def vaast(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.vaast(from_tables(spark, sf), 0.5, 0.02), "vaast")


@query(
    "vaast_biallelic",
    VAAST_BASE
    + f""", dd AS (SELECT gene, transcript, sample_id FROM calls JOIN site USING (variant_id) WHERE score > 0 GROUP BY 1, 2, 3 HAVING sum(dosage) > 1),
two AS (SELECT gene, transcript, CAST(sum(y) AS DOUBLE) AS a, CAST(sum(1 - y) AS DOUBLE) AS b FROM dd JOIN samples USING (sample_id) GROUP BY 1, 2),
term AS (SELECT gene, transcript, {lrt("a", "b", "cases", "(n - cases)", "0.02")} AS t FROM two, sizes),
tot AS (SELECT gene, transcript, sum(score) AS s FROM site GROUP BY 1, 2)
SELECT gene, transcript, round(greatest(s + coalesce(t, 0), 0), 6) AS vaast FROM tot LEFT JOIN term USING (gene, transcript)""",
)
def vaast_biallelic(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.vaast_biallelic(from_tables(spark, sf), 0.5, 0.02), "vaast")


# Permutation.

NPERM, SEED = 12, 7
PERM_BASE = f""", pk AS (
  SELECT sample_id, perm_id, md5('{SEED}:' || perm_id || ':' || sample_id) AS k FROM samples, range(1, {NPERM + 1}) r(perm_id)
), perms AS (
  SELECT perm_id, sample_id, CAST(row_number() OVER (PARTITION BY perm_id ORDER BY k, sample_id) <= cases AS INT) AS py FROM pk, sizes
), pc AS (
  SELECT variant_id, perm_id, sum(py) AS g, count(*) AS m FROM calls JOIN perms USING (sample_id) WHERE dosage > 0 GROUP BY 1, 2
), ps AS (
  SELECT gene, transcript, perm_id, round(sum(pow(g - m * p0, 2) - m * p0 * (1 - p0)), 9) AS stat FROM pc JOIN variants USING (variant_id), sizes GROUP BY 1, 2, 3
), obs AS (
  SELECT gene, transcript, round(sum(pow(case_carriers - carriers * p0, 2) - carriers * p0 * (1 - p0)), 9) AS observed FROM cv, sizes GROUP BY 1, 2
), hit AS (
  SELECT *, CAST(round(stat, 6) >= round(observed, 6) AS INT) AS hit, CASE WHEN round(stat, 6) = round(observed, 6) THEN 0.5 WHEN stat > observed THEN 1.0 ELSE 0.0 END AS mid FROM ps JOIN obs USING (gene, transcript)
)"""


def calpha_permuted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = from_tables(spark, sf)
    return st.calpha(c).withColumnRenamed("calpha", "stat"), perm.permuted_calpha(c, perm.uniform_permutations(c, 1, NPERM, SEED))


@query("uniform_permutations", PERM_BASE.split(", pc AS")[0] + " SELECT perm_id, sample_id, py AS y FROM perms")
def uniform_permutations(spark: SparkSession, sf: str) -> DataFrame:
    return perm.uniform_permutations(from_tables(spark, sf), 1, NPERM, SEED).select(F.col("perm_id").cast("long").alias("perm_id"), "sample_id", "y")


@query("permuted_calpha", PERM_BASE + " SELECT gene, transcript, perm_id, round(stat, 6) AS stat FROM ps")
def permuted_calpha(spark: SparkSession, sf: str) -> DataFrame:
    return calpha_permuted(spark, sf)[1].select("gene", "transcript", F.col("perm_id").cast("long").alias("perm_id"), F.round("stat", 6).alias("stat"))


@query("permuted_moments", PERM_BASE + " SELECT perm_id, round(avg(stat), 5) AS mean, round(var_pop(stat), 3) AS variance FROM ps GROUP BY 1")
def permuted_moments(spark: SparkSession, sf: str) -> DataFrame:
    found = tools.permuted_moments(calpha_permuted(spark, sf)[1])
    return found.select(F.col("perm_id").cast("long").alias("perm_id"), F.round("mean", 5).alias("mean"), F.round("variance", 3).alias("variance"))


@query("observed_percentile", PERM_BASE + " SELECT gene, transcript, round((sum(CAST(round(observed, 6) <= round(stat, 6) AS INT)) + 1) / (count(*) + 1.0), 6) AS percentile FROM hit GROUP BY 1, 2")
def observed_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tools.percentile(perm.hits(*calpha_permuted(spark, sf))), "percentile")


@query(
    "tied_ranks",
    """, s AS (SELECT gene, transcript, variant_id, carriers FROM cv), r AS (
  SELECT *, rank() OVER (PARTITION BY gene, transcript ORDER BY carriers DESC) AS low, count(*) OVER (PARTITION BY gene, transcript, carriers) - 1 AS more FROM s
) SELECT gene, transcript, variant_id, CAST(low AS DOUBLE) AS min_rank, CAST(low + more AS DOUBLE) AS max_rank, low + more / 2.0 AS mean_rank FROM r""",
)
def tied_ranks(spark: SparkSession, sf: str) -> DataFrame:
    counted = ops.counted_variants(from_tables(spark, sf))
    names = {"min_rank": "min", "max_rank": "max", "mean_rank": "average"}
    return counted.select(*st.GROUP, "variant_id", *(perm.tied_rank(F.col("carriers"), ties, *st.GROUP).cast("double").alias(c) for c, ties in names.items()))


@query(
    "vcf_matrix",
    """, g AS (
  SELECT variant_id, md5(string_agg(CAST(coalesce(CASE WHEN missing THEN NULL ELSE dosage END, 0) AS VARCHAR), '' ORDER BY sample_id)) AS gt_md5, sum(dosage) AS held
  FROM (SELECT DISTINCT variant_id FROM variants) CROSS JOIN samples LEFT JOIN calls USING (variant_id, sample_id) GROUP BY 1
) SELECT chrom, CAST(start AS VARCHAR) AS start, ref, alt, CASE WHEN length(ref) > length(alt) THEN 'deletion' WHEN length(ref) < length(alt) THEN 'insertion' ELSE 'SNV' END AS type, gene, transcript, gt_md5
FROM variants JOIN g USING (variant_id) WHERE held > 0""",
)
def vcf_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Calls as of a VCF file meet the transcripts that they lie in, and become matrix rows."""
    c = from_tables(spark, sf)
    calls = c.calls.where("dosage > 0").join(c.variants.select("variant_id", "chrom", F.col("start").alias("pos"), "ref", "alt").distinct(), "variant_id")
    models = c.variants.select("chrom", "gene", "transcript", (F.col("start") - 4).alias("tx_start"), (F.col("end") + 4).alias("tx_end"))
    index = numbered(c.samples.select("sample_id"), "sample_id")
    rows = tools.vcf_matrix(calls.select("chrom", "pos", "ref", "alt", "sample_id", F.col("dosage").alias("code")), models, index, digest=F.md5)
    return rows.select("chrom", "start", "ref", "alt", "type", "gene", "transcript", F.col("gt").alias("gt_md5"))


EMPIRICAL_SQL = """, c AS (SELECT gene, transcript, CAST(sum(hit) AS BIGINT) AS successes, CAST(sum(mid) AS DOUBLE) AS mid_successes, count(*) AS permutations FROM {hits} GROUP BY 1, 2)
SELECT gene, transcript, successes, mid_successes, permutations,
       round(least(CASE WHEN permutations < {n} AND permutations > 1 THEN (successes - 1) / (permutations - 1) ELSE (successes + 1) / (permutations + 1.0) END, 1.0), 6) AS empirical_p,
       round(least((mid_successes + 0.5) / (permutations + 1.0), 1.0), 6) AS empirical_midp FROM c"""


@query("empirical_p", PERM_BASE + EMPIRICAL_SQL.format(hits="hit", n=NPERM))
def empirical_p(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(perm.empirical(perm.count_hits(perm.hits(*calpha_permuted(spark, sf))), NPERM), "empirical_p", "empirical_midp")


STOP_SQL = """, run AS (SELECT gene, transcript, perm_id, sum(hit) OVER (PARTITION BY gene, transcript ORDER BY perm_id) AS h FROM hit),
low AS (SELECT gene, perm_id, min(h) AS h FROM run GROUP BY 1, 2),
stops AS (SELECT gene, CAST(coalesce(min(CASE WHEN h >= 3 THEN perm_id END), max(perm_id)) AS INTEGER) AS stop FROM low GROUP BY 1)"""


@query("adaptive_stop", PERM_BASE + STOP_SQL + " SELECT gene, stop FROM stops")
def adaptive_stop(spark: SparkSession, sf: str) -> DataFrame:
    return perm.adaptive_stop(perm.hits(*calpha_permuted(spark, sf)), 3)


@query("stopped_p", PERM_BASE + STOP_SQL + ", kept AS (SELECT hit.* FROM hit JOIN stops USING (gene) WHERE perm_id <= stop)" + EMPIRICAL_SQL.format(hits="kept", n=NPERM))
def stopped_p(spark: SparkSession, sf: str) -> DataFrame:
    marked = perm.hits(*calpha_permuted(spark, sf))
    return rounded(perm.empirical(perm.count_hits(perm.stopped(marked, perm.adaptive_stop(marked, 3))), NPERM), "empirical_p", "empirical_midp")


@query(
    "multi_transcript_p",
    PERM_BASE
    + """, w AS (SELECT gene, transcript, 0 AS perm_id, round(observed, 6) AS stat FROM obs UNION ALL SELECT gene, transcript, perm_id, round(stat, 6) FROM ps),
rk AS (SELECT gene, perm_id, rank() OVER (PARTITION BY gene, transcript ORDER BY stat DESC) + (count(*) OVER (PARTITION BY gene, transcript, stat) - 1) / 2.0 AS r FROM w),
b AS (SELECT gene, perm_id, min(r) AS r FROM rk GROUP BY 1, 2), o AS (SELECT gene, r AS own FROM b WHERE perm_id = 0)
SELECT gene, CAST(sum(CAST(r <= own AS INT)) AS BIGINT) AS mgit_successes, count(*) AS permutations, round((sum(CAST(r <= own AS INT)) + 1) / (count(*) + 1.0), 6) AS mgit_p
FROM b JOIN o USING (gene) WHERE perm_id > 0 GROUP BY 1""",
)
def multi_transcript_p(spark: SparkSession, sf: str) -> DataFrame:
    observed, permuted = calpha_permuted(spark, sf)
    six = lambda df: df.withColumn("stat", F.round("stat", 6))
    return rounded(perm.multi_transcript(six(observed), six(permuted)), "mgit_p")


@query("shard_combine", PERM_BASE + " SELECT gene, transcript, CAST(sum(hit) AS BIGINT) AS successes, CAST(sum(mid) AS DOUBLE) AS mid_successes, count(*) AS permutations FROM hit GROUP BY 1, 2")
def shard_combine(spark: SparkSession, sf: str) -> DataFrame:
    c = from_tables(spark, sf)
    observed = st.calpha(c).withColumnRenamed("calpha", "stat")
    shards = [perm.count_hits(perm.hits(observed, perm.permuted_calpha(c, perm.uniform_permutations(c, a, b, SEED)))) for a, b, _ in perm.shard_ranges(NPERM, 4, 2)]
    return perm.combine_shards(shards[0].unionByName(shards[1]))


@query("unfinished_genes", PERM_BASE + " SELECT gene FROM (SELECT gene, transcript, sum(hit) AS s FROM hit GROUP BY 1, 2) GROUP BY 1 HAVING min(s) < 4")
def unfinished_genes(spark: SparkSession, sf: str) -> DataFrame:
    counted = perm.count_hits(perm.hits(*calpha_permuted(spark, sf)))
    return counted.groupBy("gene").agg(F.min("successes").alias("least")).where("least < 4").select("gene")


# Reports and exports.


@query(
    "variant_detail",
    ", d AS (SELECT variant_id, y, sample_id FROM calls JOIN samples USING (sample_id) WHERE dosage > 0), "
    "l AS (SELECT variant_id, string_agg(CASE WHEN y = 1 THEN CAST(sample_id AS VARCHAR) END, ',' ORDER BY sample_id) AS cl, string_agg(CASE WHEN y = 0 THEN CAST(sample_id AS VARCHAR) END, ',' ORDER BY sample_id) AS ol FROM d GROUP BY 1), "
    "g AS (SELECT variant_id, gene, chrom, start, \"end\", ref, alt, type, any_value(weight) AS weight, any_value(ac) AS ac, any_value(case_ac) AS case_ac, string_agg(transcript, ',' ORDER BY transcript) AS transcripts FROM cv GROUP BY ALL) "
    "SELECT gene, transcripts, concat_ws(',', chrom, start, \"end\", ref, alt, type) AS variant, round(weight, 6) AS weight, round(ac / (2 * n), 9) AS af, CAST(2 * cases - case_ac AS BIGINT) AS case_ref, case_ac AS case_alt, "
    "CAST(2 * (n - cases) - ac + case_ac AS BIGINT) AS control_ref, ac - case_ac AS control_alt, coalesce(cl, '-') AS case_list, coalesce(ol, '-') AS control_list FROM g LEFT JOIN l USING (variant_id), sizes",
)
def variant_detail(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(rp.detail(from_tables(spark, sf)), "weight"), "af", digits=9)


@query(
    "carrier_runs",
    ", i AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS idx FROM samples), h AS (SELECT variant_id, idx, idx - row_number() OVER (PARTITION BY variant_id ORDER BY idx) AS g FROM calls JOIN i USING (sample_id) WHERE dosage > 0), "
    "r AS (SELECT variant_id, g, min(idx) AS a, max(idx) AS b FROM h GROUP BY 1, 2) SELECT variant_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS carriers FROM r GROUP BY 1",
)
def carrier_runs(spark: SparkSession, sf: str) -> DataFrame:
    c = from_tables(spark, sf)
    index = numbered(c.samples.select("sample_id"), "sample_id")
    return rp.runs(c.dealt(c.calls.where("dosage > 0").join(index, "sample_id"), "variant_id"), ["variant_id"], "at", "carriers")


@query(
    "carrier_report",
    ", i AS (SELECT sample_id, y, row_number() OVER (ORDER BY sample_id) - 1 AS idx FROM samples), h AS (SELECT variant_id, y, dosage, idx, idx - row_number() OVER (PARTITION BY variant_id, y, dosage ORDER BY idx) AS g FROM calls JOIN i USING (sample_id) WHERE dosage > 0), "
    "r AS (SELECT variant_id, y, dosage, g, min(idx) AS a, max(idx) AS b FROM h GROUP BY 1, 2, 3, 4), s AS (SELECT variant_id, y, dosage, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS w FROM r GROUP BY 1, 2, 3), "
    "t AS (SELECT variant_id, y, string_agg(dosage || ':' || w, ';' ORDER BY dosage) AS who FROM s GROUP BY 1, 2) "
    "SELECT gene, transcript, variant_id, (CASE WHEN y = 1 THEN 'T' ELSE 'B' END) || (CASE WHEN (CASE WHEN y = 1 THEN case_carriers ELSE carriers - case_carriers END) = 1 THEN 'U' ELSE 'R' END) AS line, who FROM t JOIN cv USING (variant_id)",
)
def carrier_report(spark: SparkSession, sf: str) -> DataFrame:
    return rp.carrier_report(from_tables(spark, sf))


SPANS = "SELECT gene, chrom, min(start) AS a, max(start) AS b FROM variants GROUP BY 1, 2"


@query("interval_join", f", s AS ({SPANS}), pts AS (SELECT l_partkey % 22 + 1 AS c, l_suppkey * 150 AS pos, count(*) AS hits FROM lineitem GROUP BY 1, 2) SELECT gene, s.chrom, pos, hits FROM pts JOIN s ON s.chrom = 'chr' || c AND pos BETWEEN a AND b")
def interval_join(spark: SparkSession, sf: str) -> DataFrame:
    v = from_tables(spark, sf).variants
    spans = v.groupBy("gene", "chrom").agg(F.min("start").alias("span_start"), F.max("start").alias("span_end"))
    points = read(spark, sf, "lineitem").groupBy(F.concat(F.lit("chr"), (F.col("l_partkey") % 22 + 1).cast("string")).alias("chrom"), (F.col("l_suppkey") * 150).alias("pos")).agg(F.count("*").alias("hits"))
    return rp.interval_join(points, spans).select("gene", "chrom", "pos", "hits")


@query("variant_classes", ", v AS (SELECT p_partkey AS variant_id, repeat('A', CAST(p_size % 3 + 1 AS INT)) AS ref, CASE WHEN p_partkey % 7 = 0 THEN 'CC,T' ELSE repeat('C', CAST(p_partkey % 3 + 1 AS INT)) END AS alt FROM part) SELECT variant_id, CASE WHEN alt LIKE '%,%' THEN CASE WHEN length(split_part(alt, ',', 1)) > length(ref) THEN 'insertion' ELSE 'MNP' END WHEN length(ref) > length(alt) THEN 'deletion' WHEN length(ref) < length(alt) THEN 'insertion' WHEN length(ref) = 1 THEN 'SNV' ELSE 'MNP' END AS class FROM v")
def variant_classes(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    ref = F.repeat(F.lit("A"), (F.col("p_size") % 3 + 1).cast("int"))
    alt = F.when(F.col("p_partkey") % 7 == 0, "CC,T").otherwise(F.repeat(F.lit("C"), (F.col("p_partkey") % 3 + 1).cast("int")))
    return p.select(F.col("p_partkey").alias("variant_id"), rp.variant_class(ref, alt).alias("class"))


ANNOTATION = ", an AS (SELECT DISTINCT regexp_replace(chrom, '^chr', '') || '_' || start || '_' || ref || '_' || alt AS vid, gene AS set_id, function AS category, CAST(regexp_replace(chrom, '^chr', '') AS INT) AS chrom, start FROM variants)"


@query("annotation_export", ANNOTATION + " SELECT vid, set_id, category FROM an")
def annotation_export(spark: SparkSession, sf: str) -> DataFrame:
    return rp.annotation_export(from_tables(spark, sf).variants).select("vid", "set_id", "category")


@query("annotation_templates", ", an AS (SELECT DISTINCT start || ':' || ref || '>' || alt AS vid, 'set-' || gene AS set_id, unnest(list_distinct([function, type])) AS category, CAST(regexp_replace(chrom, '^chr', '') AS INT) AS chrom, start FROM variants) SELECT DISTINCT vid, set_id, category FROM an")
def annotation_templates(spark: SparkSession, sf: str) -> DataFrame:
    v = from_tables(spark, sf).variants.withColumn("function", F.concat_ws(";", "function", "type", "function"))
    return rp.annotation_export(v, "{start}:{ref}>{alt}", "set-{gene}", ";").select("vid", "set_id", "category")


@query("sample_index", " SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS at FROM samples")
def sample_index(spark: SparkSession, sf: str) -> DataFrame:
    return rp.sample_index(from_tables(spark, sf))


@query(
    "qq_table",
    RVT2_SQL.split("SELECT gene, transcript, round")[0]
    + f", p AS (SELECT gene, transcript, {chi_tail('s')} AS p FROM g) SELECT gene, transcript, round(-log10(p), 5) AS observed, "
    "round(-log10((row_number() OVER (ORDER BY p, gene, transcript) - 0.5) / count(*) OVER ()), 5) AS expected FROM p",
)
def qq_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rp.quantiles(st.rvt2(from_tables(spark, sf))), "observed", "expected", digits=5)


@query("set_list_export", ANNOTATION + " SELECT set_id, min(chrom) AS chrom, min_by(start, chrom * 1e12 + start) AS start, string_agg(vid, ',' ORDER BY chrom, start, vid) AS vids FROM an GROUP BY 1")
def set_list_export(spark: SparkSession, sf: str) -> DataFrame:
    return rp.set_list_export(rp.annotation_export(from_tables(spark, sf).variants))


@query("mask_export", ANNOTATION + " SELECT 'all' AS mask, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM an")
def mask_export(spark: SparkSession, sf: str) -> DataFrame:
    return rp.mask_export(rp.annotation_export(from_tables(spark, sf).variants))


@query(
    "manhattan",
    f""", e AS (SELECT *, case_carrier + control_carrier AS m FROM t22), g AS (
  SELECT gene, transcript, 2 * (case_carrier * ln(greatest(case_carrier, 1) / (m * cases / n)) + control_carrier * ln(greatest(control_carrier, 1) / (m * (n - cases) / n))
    + case_other * ln(greatest(case_other, 1) / ((n - m) * cases / n)) + control_other * ln(greatest(control_other, 1) / ((n - m) * (n - cases) / n))) AS s FROM e, sizes
), pv AS (SELECT gene, min({chi_tail("s")}) AS p FROM g GROUP BY 1), loc AS (SELECT gene, min(chrom) AS chrom, min(start) AS start FROM variants GROUP BY 1),
sz AS (SELECT chrom, max(start) AS size, CAST(replace(chrom, 'chr', '') AS INT) AS k FROM loc GROUP BY 1),
o AS (SELECT chrom, coalesce(sum(size + 1000000) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, row_number() OVER (ORDER BY k) % 2 AS colour FROM sz)
SELECT gene, chrom, CAST(start + off AS BIGINT) AS place, CAST(colour AS INTEGER) AS colour, round(-log10(p), 5) AS score FROM pv JOIN loc USING (gene) JOIN o USING (chrom)""",
)
def manhattan(spark: SparkSession, sf: str) -> DataFrame:
    c = from_tables(spark, sf)
    genes = c.variants.groupBy("gene").agg(F.min("chrom").alias("chrom"), F.min("start").alias("start"))
    return rounded(rp.manhattan(st.rvt2(c), genes), "score", digits=5)


@query("merge_results", ", s AS (SELECT gene, transcript, round(sum(pow(weight * (case_ac - p0 * ac), 2)), 6) AS skat_q FROM cv, sizes GROUP BY 1, 2) SELECT gene, transcript, CASE WHEN gene LIKE '%1%' THEN 'NA' ELSE CAST(skat_q AS VARCHAR) END IS NULL OR gene LIKE '%1%' AS unknown, CAST(row_number() OVER (ORDER BY CASE WHEN gene LIKE '%1%' THEN 1e300 ELSE skat_q END, gene, transcript) AS INTEGER) AS rank FROM s")
def merge_results(spark: SparkSession, sf: str) -> DataFrame:
    s = skat_q(spark, sf)
    one = s.where("gene like '%1%'").select("gene", "transcript", F.lit("NA").alias("skat_q"))
    two = s.where("gene not like '%1%'").select("gene", "transcript", F.col("skat_q").cast("string").alias("skat_q"), F.lit(1).alias("extra"))
    return rp.merge_results([one, two], "skat_q").select("gene", "transcript", (F.col("skat_q") == "NA").alias("unknown"), "rank")


@query(
    "bootstrap_samples",
    """, rk AS (SELECT sample_id, y, row_number() OVER (PARTITION BY y ORDER BY sample_id) - 1 AS at FROM samples),
sl AS (SELECT rep, slot, CAST(slot < 40 AS INT) AS y, CAST('0x' || substr(md5('5:' || rep || ':' || slot), 1, 12) AS BIGINT) AS d FROM range(1, 4) a(rep), range(0, 100) b(slot))
SELECT CAST(rep AS INTEGER) AS rep, CAST(slot AS INTEGER) AS slot, sample_id, sl.y FROM sl, sizes JOIN rk ON rk.y = sl.y AND rk.at = d % CAST(CASE WHEN sl.y = 1 THEN cases ELSE n - cases END AS BIGINT)""",
)
def bootstrap_samples(spark: SparkSession, sf: str) -> DataFrame:
    return rs.bootstrap(from_tables(spark, sf), 3, 40, 60, seed=5)


# Whole scans.  Labels of these permutations come as in a file, from hashes that SQL can work out too.


def external_labels(c: Cohort) -> DataFrame:
    order = F.transform(F.array_sort(F.collect_list(F.struct("sample_id", "y"))), lambda s: s.y.cast("string"))
    return perm.uniform_permutations(c, 1, NPERM, SEED).groupBy("perm_id").agg(F.array_join(order, "").alias("labels"))


SCANNED = ("gene", "transcript", "rank", "stat", "successes", "mid_successes", "permutations", "empirical_p", "empirical_midp", "mgit_p")


def scan_sql(observed: str, permuted: str, successes: int) -> str:
    """SQL of a scan by statistic: observed and permuted are selects of (gene, transcript, observed) and (.., perm_id, stat)."""
    return (
        PERM_BASE.split(", pc AS")[0]
        + f""", obs AS ({observed}), pv AS (
  SELECT variant_id, perm_id, sum(py * dosage) AS g, sum(py) AS m FROM calls JOIN perms USING (sample_id) WHERE dosage > 0 GROUP BY 1, 2
), pg AS (
  SELECT gene, transcript, perm_id, sum(py) AS a, sum(burden * py) AS sb FROM carried JOIN perms USING (sample_id) GROUP BY 1, 2, 3
), ps AS ({permuted}), hit AS (
  SELECT *, CAST(round(stat, 6) >= round(observed, 6) AS INT) AS hit,
         CASE WHEN round(stat, 6) = round(observed, 6) THEN 0.5 WHEN stat > observed THEN 1.0 ELSE 0.0 END AS mid
  FROM ps JOIN obs USING (gene, transcript)
)"""
        + STOP_SQL.replace("h >= 3", f"h >= {successes}")
        + f""", kept AS (SELECT hit.* FROM hit JOIN stops USING (gene) WHERE perm_id <= stop), c AS (
  SELECT gene, transcript, CAST(sum(hit) AS BIGINT) AS successes, CAST(sum(mid) AS DOUBLE) AS mid_successes, count(*) AS permutations FROM kept GROUP BY 1, 2
), e AS (
  SELECT *, least(CASE WHEN permutations < {NPERM} AND permutations > 1 THEN (successes - 1) / (permutations - 1) ELSE (successes + 1) / (permutations + 1.0) END, 1.0) AS empirical_p,
         least((mid_successes + 0.5) / (permutations + 1.0), 1.0) AS empirical_midp FROM c
), w AS (
  SELECT gene, transcript, 0 AS perm_id, round(observed, 6) AS stat FROM obs UNION ALL SELECT gene, transcript, perm_id, round(stat, 6) FROM kept
), rk AS (
  SELECT gene, perm_id, rank() OVER (PARTITION BY gene, transcript ORDER BY stat DESC) + (count(*) OVER (PARTITION BY gene, transcript, stat) - 1) / 2.0 AS r FROM w
), b AS (SELECT gene, perm_id, min(r) AS r FROM rk GROUP BY 1, 2), o AS (SELECT gene, r AS own FROM b WHERE perm_id = 0), mg AS (
  SELECT gene, (sum(CAST(r <= own AS INT)) + 1) / (count(*) + 1.0) AS mgit_p FROM b JOIN o USING (gene) WHERE perm_id > 0 GROUP BY 1
)
SELECT gene, transcript, CAST(row_number() OVER (ORDER BY round(empirical_p, 6), gene, transcript) AS INTEGER) AS rank, round(observed, 6) AS stat, successes, mid_successes, permutations,
       round(empirical_p, 6) AS empirical_p, round(empirical_midp, 6) AS empirical_midp, round(mgit_p, 6) AS mgit_p
FROM e JOIN obs USING (gene, transcript) JOIN mg USING (gene)"""
    )


def labelled_scan(spark: SparkSession, sf: str, config: AssocConfig) -> DataFrame:
    c = from_tables(spark, sf)
    found = association.scan(c, config, external=external_labels(c))
    return rounded(found.select(*SCANNED), "stat", "empirical_p", "empirical_midp", "mgit_p")


WEIGHT = "sqrt((1 + ac) / (2 + 2 * n) * (1 - (1 + ac) / (2 + 2 * n)))"


@query(
    "scan_wss",
    scan_sql(
        f"SELECT gene, transcript, sum(case_ac / {WEIGHT}) AS observed FROM cv, sizes GROUP BY 1, 2",
        f"SELECT gene, transcript, perm_id, sum(g / {WEIGHT}) AS stat FROM pv JOIN cv USING (variant_id), sizes GROUP BY 1, 2, 3",
        4,
    ),
)
def scan_wss(spark: SparkSession, sf: str) -> DataFrame:
    return labelled_scan(spark, sf, AssocConfig(method="WSS", nperm=NPERM, successes=4))


@query(
    "scan_skat",
    scan_sql(
        "SELECT gene, transcript, sum(pow(weight * (case_ac - p0 * ac), 2)) AS observed FROM cv, sizes GROUP BY 1, 2",
        "SELECT gene, transcript, perm_id, sum(pow(weight * (g - p0 * ac), 2)) AS stat FROM pv JOIN cv USING (variant_id), sizes GROUP BY 1, 2, 3",
        4,
    ),
)
def scan_skat(spark: SparkSession, sf: str) -> DataFrame:
    return labelled_scan(spark, sf, AssocConfig(method="SKAT", nperm=NPERM, successes=4, file_weights=True))


@query(
    "scan_burden",
    scan_sql(
        BURDEN_SQL.split("SELECT gene, transcript, round")[0].split("b AS (", 1)[1].strip().removesuffix(")").replace(" AS s\n", " AS observed\n"),
        "SELECT gene, transcript, perm_id, pow(any_value(pg.sb) - p0 * sum(burden), 2) / (any_value(p0 * (1 - p0)) * (sum(burden * burden) - pow(sum(burden), 2) / any_value(n))) AS stat "
        "FROM pg JOIN carried USING (gene, transcript), sizes GROUP BY gene, transcript, perm_id, p0",
        4,
    ),
)
def scan_burden(spark: SparkSession, sf: str) -> DataFrame:
    return labelled_scan(spark, sf, AssocConfig(method="BURDEN", nperm=NPERM, successes=4, file_weights=True))


@query(
    "scan_cmc1df",
    scan_sql(
        "SELECT gene, transcript, (case_carrier + e) * (control_other + e) / ((control_carrier + e) * (case_other + e)) AS observed "
        "FROM (SELECT *, CASE WHEN least(case_carrier, control_carrier, case_other, control_other) = 0 THEN 0.5 ELSE 0.0 END AS e FROM t22)",
        "SELECT gene, transcript, perm_id, (a + e) * (n - cases - m + a + e) / ((m - a + e) * (cases - a + e)) AS stat FROM ("
        "SELECT *, CASE WHEN least(a, m - a, cases - a, n - cases - m + a) = 0 THEN 0.5 ELSE 0.0 END AS e "
        "FROM pg JOIN (SELECT gene, transcript, case_carrier + control_carrier AS m FROM t22) USING (gene, transcript), sizes)",
        4,
    ),
)
def scan_cmc1df(spark: SparkSession, sf: str) -> DataFrame:
    return labelled_scan(spark, sf, AssocConfig(method="CMC1df", nperm=NPERM, successes=4))


@query("scan_cmc1df_analytic", SQL["fisher_one_sided"].removeprefix(BASE))
def scan_cmc1df_analytic(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(association.scan(from_tables(spark, sf), AssocConfig(method="CMC1df", nperm=0)).select("gene", "transcript", "p"), "p")


@query("scan_burden_qtl_analytic", QTL_SQL.replace("round(s, 6) AS burden, ", ""))
def scan_burden_qtl_analytic(spark: SparkSession, sf: str) -> DataFrame:
    config = AssocConfig(method="BURDEN", nperm=0, qtl=True, file_weights=True)
    return rounded(association.scan(from_tables(spark, sf), config).select("gene", "transcript", "p"), "p")


COLLAPSED_SQL = """, k AS (SELECT *, ac <= 25 AS rare FROM cv), one AS (
  SELECT gene, transcript, CASE WHEN rare THEN NULL ELSE variant_id END AS id, sample_id, max(CASE WHEN rare THEN CAST(dosage > 0 AS INT) ELSE dosage END) AS d
  FROM calls JOIN k USING (variant_id) WHERE dosage > 0 GROUP BY ALL
), col AS (
  SELECT gene, transcript, id, sum(d * y) AS a, sum(d) AS t FROM one JOIN samples USING (sample_id) GROUP BY ALL
)
SELECT gene, transcript, round(sum(a / sqrt((1 + t) / (2 + 2 * n) * (1 - (1 + t) / (2 + 2 * n)))), 6) AS stat FROM col, sizes GROUP BY 1, 2"""


@query("scan_wss_collapsed", COLLAPSED_SQL)
def scan_wss_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    config = AssocConfig(method="WSS", nperm=0, var_collapsing=25, ma_count=False)
    return rounded(association.scan(from_tables(spark, sf), config).select("gene", "transcript", "stat"), "stat")


@query("impute_skat", """, g AS (SELECT variant_id, y, sum(dosage) AS a, sum(CAST(missing AS INT)) AS gone FROM calls JOIN samples USING (sample_id) GROUP BY 1, 2), i AS (
  SELECT variant_id, y, CASE WHEN missing THEN a / (2 * ((CASE WHEN y = 1 THEN cases ELSE n - cases END) - gone)) ELSE dosage END AS d
  FROM calls JOIN samples USING (sample_id) JOIN g USING (variant_id, y), sizes
), v AS (SELECT variant_id, sum(d * y) AS ca, sum(d) AS t FROM i GROUP BY 1)
SELECT gene, transcript, round(sum(pow(v_w.weight * (ca - p0 * t), 2)), 6) AS skat_q FROM variants v_w JOIN v USING (variant_id), sizes GROUP BY 1, 2""")
def impute_skat(spark: SparkSession, sf: str) -> DataFrame:
    c = association.prepare(from_tables(spark, sf), AssocConfig(method="SKAT", nperm=0, impute="af", file_weights=True))
    return rounded(st.skat_q(c), "skat_q")


@query("beta_weighted_skat", "SELECT gene, transcript, round(sum(pow(pow(1 - ac / (2 * n), 24) * 25 * (case_ac - p0 * ac), 2)), 5) AS skat_q FROM cv, sizes GROUP BY 1, 2")
def beta_weighted_skat(spark: SparkSession, sf: str) -> DataFrame:
    c = association.prepare(from_tables(spark, sf), AssocConfig(method="SKAT", nperm=0))
    return rounded(st.skat_q(c), "skat_q", digits=5)


def biallelic_sql(labels: str) -> str:
    """Biallelic scores (gene, transcript, perm_id, stat) of labels (sample_id, perm_id, py)."""
    return f"""WITH lb AS ({labels}), gc AS (
  SELECT variant_id, perm_id, CAST(sum(py * dosage) AS DOUBLE) AS g FROM calls JOIN lb USING (sample_id) WHERE dosage > 0 GROUP BY 1, 2
), sc AS (
  SELECT gene, transcript, variant_id, perm_id, g, 2 * ({lrt("g", "(ac - g)", "(2 * cases)", "(2 * (n - cases))", "0.02")} + ln(weight)) AS s FROM cv JOIN gc USING (variant_id), sizes
), site AS (
  SELECT *, CASE WHEN s < 0 OR g = 0 THEN 0 WHEN s > 0.5 THEN s - 0.5 ELSE s END AS score FROM sc
), dd AS (
  SELECT gene, transcript, perm_id, sample_id FROM calls JOIN site USING (variant_id) WHERE score > 0 GROUP BY 1, 2, 3, 4 HAVING sum(dosage) > 1
), two AS (
  SELECT gene, transcript, perm_id, CAST(sum(py) AS DOUBLE) AS a, CAST(sum(1 - py) AS DOUBLE) AS b FROM dd JOIN lb USING (sample_id, perm_id) GROUP BY 1, 2, 3
), term AS (SELECT gene, transcript, perm_id, {lrt("a", "b", "cases", "(n - cases)", "0.02")} AS t FROM two, sizes),
tot AS (SELECT gene, transcript, perm_id, sum(score) AS s FROM site GROUP BY 1, 2, 3)
SELECT gene, transcript, perm_id, greatest(s + coalesce(t, 0), 0) AS stat FROM tot LEFT JOIN term USING (gene, transcript, perm_id)"""


@query(
    "scan_vaast_biallelic",
    scan_sql(
        f"SELECT gene, transcript, stat AS observed FROM ({biallelic_sql('SELECT sample_id, 0 AS perm_id, y AS py FROM samples')})",
        biallelic_sql("SELECT sample_id, perm_id, py FROM perms"),
        4,
    ),
)
def scan_vaast_biallelic(spark: SparkSession, sf: str) -> DataFrame:
    config = AssocConfig(method="VAAST", nperm=NPERM, successes=4, biallelic=True, site_penalty=0.5, soft_maf_filter=0.02, group_size=0)
    return labelled_scan(spark, sf, config)


@query(
    "null_model_fits",
    """SELECT optimizer, 2 AS rank, round(regr_intercept(trait, cov_num), 5) AS intercept, round(regr_slope(trait, cov_num), 5) AS slope, 0.0 AS again, true AS settled
FROM (SELECT sample_id, cov_cat * trait + cov_cat AS trait, cov_num FROM samples), (VALUES ('irls'), ('irls_svdnewton'), ('irls_qr'), ('irls_qr_R'), ('gradient_descent')) o(optimizer) GROUP BY optimizer""",
)
def null_model_fits(spark: SparkSession, sf: str) -> DataFrame:
    """Every optimizer on a trait and a covariate that comes twice: the second one is left out."""
    samples = from_tables(spark, sf).samples.withColumn("again", 3 - 2 * F.col("cov_num")).withColumn("trait", F.col("cov_cat") * F.col("trait") + F.col("cov_cat"))
    rows = []
    for optimizer in OPTIMIZERS:
        fit = distributed_fit(design(samples, ("cov_num", "again")), "trait", "x", "gaussian", optimizer)
        rows.append((optimizer, fit.rank, *(float(round(b, 5)) for b in fit.beta), fit.settled))
    return spark.createDataFrame(rows, "optimizer string, rank int, intercept double, slope double, again double, settled boolean")


# Through files: the tables written as the files of a study and read again.


def write_text(rows: DataFrame, path: str, *columns: F.Column | str) -> str:
    rows.select(F.concat_ws("\t", *columns).alias("value")).write.text(path)
    return path


def cohort_by_files(spark: SparkSession, sf: str) -> Cohort:
    """The cohort as matrix, pedigree (six samples in seven), covariates, weights (a third) and mask (one variant in 50)."""
    c, path = from_tables(spark, sf), shared_path(spark, "files")
    index = persist(numbered(c.samples.select("sample_id"), "sample_id"))
    code = F.when(F.col("missing"), 5).otherwise(F.col("dosage")).alias("code")
    codes = tools.listed(c.calls.select("variant_id", "sample_id", code), index, "variant_id")
    names = F.array_sort(F.collect_list(F.struct("at", F.col("sample_id").cast("string").alias("id"))))
    start = F.lit("\t".join(["Chr", *MATRIX[1:]]))
    head = index.agg(names.alias("s")).select(F.concat_ws("\t", start, F.array_join(F.transform("s", lambda x: x.id), "\t")).alias("value"))  # a line by its format
    texts = [F.col(k).cast("string") for k in ("chrom", "start", "end", "ref", "alt", "type", "gene", "transcript")]
    genotypes = F.coalesce("gt", F.lit(SPARSE))
    body = c.variants.join(codes, "variant_id", "left").select(F.concat_ws("\t", *texts, F.lit("exonic"), "function", F.lit("."), genotypes).alias("value"))
    body.unionByName(head).write.text(f"{path}/matrix")
    status = F.when(F.col("y") == 1, "2").otherwise("1")
    zero = F.lit("0")
    write_text(c.samples.where("sample_id % 7 <> 0"), f"{path}/ped", zero, F.col("sample_id").cast("string"), zero, zero, zero, status)
    write_text(c.samples, f"{path}/cov", F.col("sample_id").cast("string"), F.col("cov_num").cast("string"), F.concat(F.lit("L"), F.col("cov_cat").cast("string")))
    old = [F.when(F.col("type") == "SNV", "SNP").otherwise(F.col("type")) if k == 5 else t for k, t in enumerate(texts)]
    write_text(c.variants.where("variant_id % 3 = 0"), f"{path}/weights", *old, F.col("weight").cast("string"))
    write_text(c.variants.where("variant_id % 50 = 0"), f"{path}/mask", *texts[:5])
    return from_files(spark, [f"{path}/matrix"], f"{path}/ped", f"{path}/weights", f"{path}/mask", covariates=f"{path}/cov")


@query(
    "file_variants",
    """, k AS (
  SELECT variant_id, sum(dosage) AS ac, sum(CAST(dosage > 0 AS INT)) AS carriers, sum(dosage * y) AS case_ac FROM calls JOIN samples USING (sample_id) WHERE sample_id % 7 <> 0 GROUP BY 1
) SELECT chrom, CAST(start AS VARCHAR) AS start, transcript, CASE WHEN variant_id % 3 = 0 THEN round(weight, 6) ELSE 1.0 END AS weight,
         CAST(coalesce(ac, 0) AS BIGINT) AS ac, CAST(coalesce(carriers, 0) AS BIGINT) AS carriers, CAST(coalesce(case_ac, 0) AS BIGINT) AS case_ac
FROM variants LEFT JOIN k USING (variant_id) WHERE variant_id % 50 <> 0""",
)
def file_variants(spark: SparkSession, sf: str) -> DataFrame:
    counted = ops.counted_variants(cohort_by_files(spark, sf))
    return rounded(counted.select("chrom", "start", "transcript", "weight", *(F.col(k).cast("long").alias(k) for k in ("ac", "carriers", "case_ac"))), "weight")


@query(
    "file_samples",
    """, top AS (SELECT max(cov_cat) AS last FROM samples)
SELECT CAST(sample_id AS VARCHAR) AS sample_id, y, round(cov_num, 6) AS cov_num, CAST(1 + (SELECT count(DISTINCT cov_cat) FROM samples) AS INT) AS columns,
       CASE WHEN cov_cat = last THEN 0.0 ELSE 1.0 END AS levels FROM samples, top WHERE sample_id % 7 <> 0""",
)
def file_samples(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("x")
    level = F.aggregate(F.slice(x, 3, F.greatest(F.size(x) - 2, F.lit(0))), F.lit(0.0), lambda a, b: a + b)
    return cohort_by_files(spark, sf).samples.select("sample_id", "y", F.round(x[1], 6).alias("cov_num"), F.size(x).alias("columns"), level.alias("levels"))


@query("file_results", SQL["calpha_ranked"].removeprefix(BASE))
def file_results(spark: SparkSession, sf: str) -> DataFrame:
    """The ranked result, written as a result file and read again."""
    c, path = from_tables(spark, sf), shared_path(spark, "results")
    n, cases = c.sizes
    sinks.write_simple(calpha_ranked(spark, sf).withColumnRenamed("calpha", "stat"), path, cases, n - cases)
    found = read_simple(spark, path)
    return found.select(F.col("Rank").cast("int").alias("rank"), F.col("Gene").alias("gene"), F.col("Transcript").alias("transcript"), F.col("Test_Statistic").cast("double").alias("calpha"))


@query("file_permutations", PERM_BASE.split(", pc AS")[0] + " SELECT perm_id, string_agg(CAST(py AS VARCHAR), '' ORDER BY sample_id) AS labels FROM perms WHERE perm_id BETWEEN 3 AND 9 GROUP BY 1")
def file_permutations(spark: SparkSession, sf: str) -> DataFrame:
    """Permutations written as a file, of which a block is read."""
    path = shared_path(spark, "permutations")
    write_permutations(perm.uniform_permutations(from_tables(spark, sf), 1, NPERM, SEED), path)
    return read_permutations(spark, path, 3, 9)


# Resampling by hashes, which SQL can follow.

POWER_SQL = f""", rk AS (SELECT sample_id, y, row_number() OVER (PARTITION BY y ORDER BY sample_id) - 1 AS at FROM samples),
sl AS (SELECT rep, slot, CAST(slot < 200 AS INT) AS y, CAST('0x' || substr(md5('1:' || rep || ':' || slot), 1, 12) AS BIGINT) AS d FROM range(1, 21) a(rep), range(0, 400) b(slot)),
dr AS (SELECT rep, sample_id, sl.y FROM sl, sizes JOIN rk ON rk.y = sl.y AND rk.at = d % CAST(CASE WHEN sl.y = 1 THEN cases ELSE n - cases END AS BIGINT)),
tb AS (SELECT gene, transcript, rep, sum(dr.y) AS a, count(*) AS m FROM carried JOIN dr USING (sample_id) GROUP BY 1, 2, 3),
g AS (SELECT gene, transcript, rep, 2 * (a * ln(greatest(a, 1) / (m * 0.5)) + (m - a) * ln(greatest(m - a, 1) / (m * 0.5))
  + (200 - a) * ln(greatest(200 - a, 1) / ((400 - m) * 0.5)) + (200 - m + a) * ln(greatest(200 - m + a, 1) / ((400 - m) * 0.5))) AS s FROM tb),
al AS (SELECT unnest([0.05, 0.2])::DOUBLE AS alpha)
SELECT gene, transcript, 'RVT2' AS method, 200 AS n_cases, 200 AS n_controls, CAST(sum(CAST({chi_tail("s")} <= alpha AS INT)) AS BIGINT) AS successes, 20 AS bootstraps,
       round(sum(CAST({chi_tail("s")} <= alpha AS INT)) / 20.0, 6) AS ratio, alpha FROM g, al GROUP BY gene, transcript, alpha"""


@query("power_ratio", POWER_SQL)
def power_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rs.power(from_tables(spark, sf), 20, 200, 200, (0.05, 0.2)), "ratio")


@query(
    "testable_groups",
    f""", e AS (SELECT gene, transcript, case_carrier + control_carrier AS m, least(case_carrier + control_carrier, cases) AS a, cases, n FROM t22, sizes), g AS (
  SELECT gene, transcript, m, 2 * (a * ln(a / (m * cases / n)) + (m - a) * ln(greatest(m - a, 1) / (m * (n - cases) / n))
    + (cases - a) * ln(greatest(cases - a, 1) / ((n - m) * cases / n)) + (n - cases - m + a) * ln(greatest(n - cases - m + a, 1) / ((n - m) * (n - cases) / n))) AS s FROM e
), p AS (SELECT *, CASE WHEN s > 300 THEN 0.0 ELSE {chi_tail("s")} END AS p FROM g) SELECT gene, transcript, m, round(p, 6) + 0.0 AS best_p, p <= 0.05 AS testable FROM p""",
)
def testable_groups(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rs.testable(from_tables(spark, sf)), "best_p")


@query(
    "effect_size_p",
    PERM_BASE.split(", pc AS")[0]
    + f""", pa AS (SELECT gene, transcript, perm_id, sum(py) AS a FROM carried JOIN perms USING (sample_id) GROUP BY 1, 2, 3)
SELECT gene, transcript, case_carrier, case_other AS case_non_carrier, control_carrier, control_other AS control_non_carrier,
       round((sum(CAST(a >= case_carrier AS INT)) + 1) / {NPERM + 1}.0, 6) AS p_value FROM pa JOIN t22 USING (gene, transcript) GROUP BY ALL""",
)
def effect_size_p(spark: SparkSession, sf: str) -> DataFrame:
    cells = [F.col(c).cast("long").alias(c) for c in ("case_carrier", "case_non_carrier", "control_carrier", "control_non_carrier")]
    return rounded(rs.effect_sizes(from_tables(spark, sf), NPERM, SEED).select("gene", "transcript", *cells, "p_value"), "p_value")


# Numeric statistics with covariates and resampling: SQL cannot express them; tests hold them against other solvers.


def binary_null(c: Cohort) -> Null:
    return null_model(design(c.samples, categorical=("cov_cat",)))


@query("skato_p")
def skato_p(spark: SparkSession, sf: str) -> DataFrame:
    c = from_tables(spark, sf)
    return score_tests(c, binary_null(c), want=("skato_p",))


@query("skat_p")
def skat_p(spark: SparkSession, sf: str) -> DataFrame:
    c = from_tables(spark, sf)
    return score_tests(c, binary_null(c), want=("skat_q", "skat_p", "burden", "burden_p", "skatc_p"))


@query("skat_qtl_p")
def skat_qtl_p(spark: SparkSession, sf: str) -> DataFrame:
    c = from_tables(spark, sf)
    null = null_model(design(c.samples, categorical=("cov_cat",)), quantitative=True)
    return score_tests(c, null, want=("skat_p", "skato_p", "burden_p"))


@query("rvt1_p")
def rvt1_p(spark: SparkSession, sf: str) -> DataFrame:
    c = from_tables(spark, sf)
    return regression_tests(c, binary_null(c))


@query("rvt_qtl_p")
def rvt_qtl_p(spark: SparkSession, sf: str) -> DataFrame:
    c = from_tables(spark, sf)
    return regression_tests(c, null_model(design(c.samples, ("cov_num",)), quantitative=True), quantitative=True)


@query("cmc_hotelling")
def cmc_hotelling(spark: SparkSession, sf: str) -> DataFrame:
    return hotelling(from_tables(spark, sf))


@query("vaast_grouped")
def vaast_grouped(spark: SparkSession, sf: str) -> DataFrame:
    return grouped_vaast(from_tables(spark, sf), penalty=0.5)


@query("vaast_grouped_by_type")
def vaast_grouped_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return grouped_vaast(from_tables(spark, sf), penalty=0.5, by_type=True)


@query("adjusted_permutations")
def adjusted_permutations(spark: SparkSession, sf: str) -> DataFrame:
    c = from_tables(spark, sf)
    return rs.adjusted_permutations(c, rs.null_odds(binary_null(c)), 1, 10)


@query("permuted_power_wss")
def permuted_power_wss(spark: SparkSession, sf: str) -> DataFrame:
    return rs.permuted_power(from_tables(spark, sf), AssocConfig(method="WSS", nperm=40), 4, 200, 200, (0.05, 0.2))


@query("effect_size_or")
def effect_size_or(spark: SparkSession, sf: str) -> DataFrame:
    return rs.effect_sizes(from_tables(spark, sf), 40)


@query("effect_size_adjusted")
def effect_size_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    c = from_tables(spark, sf)
    return rs.effect_sizes(c, 40, odds=rs.null_odds(binary_null(c)), epsilon=0.01)


@query("scan_vaast_collapsed")
def scan_vaast_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return association.scan(from_tables(spark, sf), AssocConfig(method="VAAST", nperm=0, var_collapsing=20, site_penalty=0.5))


@query("covariate_scan_skato")
def covariate_scan_skato(spark: SparkSession, sf: str) -> DataFrame:
    return association.covariate_scan(from_tables(spark, sf), AssocConfig(method="SKATO", file_weights=True), categorical=("cov_cat",))


@query("scan_skat_adjusted")
def scan_skat_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    config = AssocConfig(method="SKAT", nperm=20, successes=8, seed=3, file_weights=True)
    return association.scan(from_tables(spark, sf), config, categorical=("cov_cat",))


@query("scan_burden_qtl")
def scan_burden_qtl(spark: SparkSession, sf: str) -> DataFrame:
    return association.scan(from_tables(spark, sf), AssocConfig(method="BURDEN", nperm=20, successes=8, seed=3, qtl=True, file_weights=True))


@query("scan_skat_qtl_adjusted")
def scan_skat_qtl_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    """Traits change places among samples of like odds; the linear null model is fitted to every permutation."""
    config = AssocConfig(method="SKAT", nperm=20, successes=8, seed=3, qtl=True, file_weights=True, bin_epsilon=0.01)
    return association.scan(from_tables(spark, sf), config, categorical=("cov_cat",))


@query("scan_skato_permuted")
def scan_skato_permuted(spark: SparkSession, sf: str) -> DataFrame:
    config = AssocConfig(method="SKATO", nperm=20, successes=8, seed=3, file_weights=True)
    return association.scan(from_tables(spark, sf), config, categorical=("cov_cat",))


@query("scan_rvt1_permuted")
def scan_rvt1_permuted(spark: SparkSession, sf: str) -> DataFrame:
    return association.scan(from_tables(spark, sf), AssocConfig(method="RVT1", nperm=10, successes=5, seed=3), categorical=("cov_cat",))


def thousand(method: str, **options: object) -> Query:
    """1,000 permutations, none spared by an early stop."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return association.scan(from_tables(spark, sf), AssocConfig(method=method, nperm=1000, successes=10_000, seed=5, **options))

    return run


query("wss_1000")(thousand("WSS"))
query("skat_1000")(thousand("SKAT", file_weights=True))
query("vaast_1000")(thousand("VAAST", site_penalty=0.5))
query("vaast_biallelic_1000")(thousand("VAAST", site_penalty=0.5, biallelic=True))
