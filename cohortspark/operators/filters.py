"""Variant filters and transforms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cohort import Cohort
from ..streaming.blocks import persist
from .products import numbered

LOCUS = ("chrom", "start", "end", "ref", "alt")
COLLAPSED = "Collapsed"


def variant_key() -> F.Column:
    """The id of a variant in a transcript."""
    return F.concat_ws(",", *(F.col(c).cast("string") for c in (*LOCUS, "type", "gene", "transcript")))


def bed_mask(variants: DataFrame, bed: DataFrame) -> DataFrame:
    """Variants whose locus and alleles are not listed."""
    return variants.join(bed.select(*LOCUS).distinct(), list(LOCUS), "left_anti")


def whitelist(variants: DataFrame, allowed: DataFrame, method: str) -> DataFrame:
    """Variants whose type and function both are in the method's pooled set; allowed(method, value)."""
    values = allowed.where(F.col("method") == method).select("value").distinct()
    kept = variants.join(values, variants.type == values.value, "left_semi")
    return kept.join(values, kept.function == values.value, "left_semi")


def attach_weights(variants: DataFrame, weights: DataFrame | None) -> DataFrame:
    """File weights by the full variant key; 1 where there is none."""
    if weights is None:
        return variants.withColumn("weight", F.lit(1.0))
    keys = [*LOCUS, "type", "gene", "transcript"]
    known = weights.select(*keys, F.col("weight").alias("file_weight"))
    return variants.drop("weight").join(known, keys, "left").withColumn("weight", F.coalesce("file_weight", F.lit(1.0))).drop("file_weight")


def counts(cohort: Cohort) -> DataFrame:
    """Per variant: allele count, carriers, squares and missing calls, in all and in cases."""
    both = cohort.calls.join(cohort.samples.select("sample_id", "y"), "sample_id")
    d, case = F.col("dosage"), F.col("y") == 1
    whole = dict(cohort.calls.dtypes)["dosage"] not in ("double", "float")  # imputed dosages have fractions
    long = lambda c: c.cast("long") if whole else c.cast("double")
    return both.groupBy("variant_id").agg(
        long(F.sum(d)).alias("ac"),
        long(F.sum(d * d)).alias("ac2"),
        long(F.sum((d > 0).cast("int"))).alias("carriers"),
        long(F.sum(F.when(case, d).otherwise(0))).alias("case_ac"),
        long(F.sum(F.when(case & (d > 0), 1).otherwise(0))).alias("case_carriers"),
        long(F.sum(F.col("missing").cast("int"))).alias("n_missing"),
        long(F.sum(F.when(case & F.col("missing"), 1).otherwise(0))).alias("case_missing"),
    )


def counted_variants(cohort: Cohort) -> DataFrame:
    """Variants with their counts; variants without calls count zero."""
    c = counts(cohort)
    names = [x for x in c.columns if x != "variant_id"]
    return cohort.variants.join(c, "variant_id", "left").fillna(0, names)


def aaf_filter(counted: DataFrame, n: int, mac: float, maf: float) -> DataFrame:
    """Alternate allele filter: the frequency must be below maf (not for collapsed variants), the count at most mac."""
    frequency = F.col("ac") / (2.0 * n)
    return counted.where((F.col("ac") <= mac) & ((F.col("type") == COLLAPSED) | (frequency < maf)))


def flipped(counted: DataFrame, n: int) -> DataFrame:
    """Counts of the minor allele: if the alternate allele is the major one, 0 and 2 change places; missing stay 0."""
    flip = (F.col("ac") / (2.0 * n) > 0.5) & (F.col("type") != COLLAPSED)
    minor = F.when(flip, 2 * (n - F.col("n_missing")) - F.col("ac")).otherwise(F.col("ac"))
    return counted.select("*", flip.alias("flip"), minor.cast("long").alias("minor_ac"))


def flip_calls(cohort: Cohort) -> Cohort:
    """The cohort with minor alleles counted: of a variant whose alternate allele is the major one 0 and 2 change places.

    Only such variants get rows for the samples without a call: their ids meet the samples by an anti join on both.
    """
    n, _ = cohort.sizes
    turned = flipped(counted_variants(cohort), n).where("flip").select("variant_id").distinct()
    marked = cohort.calls.join(turned.withColumn("flip", F.lit(True)), "variant_id", "left")
    dosage = F.when(F.col("flip") & ~F.col("missing"), 2 - F.col("dosage")).otherwise(F.col("dosage"))
    called = marked.select("sample_id", "variant_id", dosage.cast(cohort.calls.schema["dosage"].dataType).alias("dosage"), "missing")
    # Calls of all samples for the flipped variants alone: what has no call has two minor alleles.
    spread = turned.join(cohort.samples.select("sample_id"), F.lit(True)).join(cohort.calls.select("sample_id", "variant_id"), ["sample_id", "variant_id"], "left_anti")
    absent = spread.select("sample_id", "variant_id", F.lit(2).cast(cohort.calls.schema["dosage"].dataType).alias("dosage"), F.lit(False).alias("missing"))
    out = Cohort(cohort.samples, cohort.variants, called.where("dosage > 0 or missing").unionByName(absent))
    out.__dict__["sizes"] = cohort.sizes
    return out


def maf_filter(counted: DataFrame, n: int, mac: float, maf: float) -> DataFrame:
    """Minor allele filter: frequency at most maf, count at most mac."""
    flip = flipped(counted, n)
    return flip.where((F.col("minor_ac") <= mac) & ((F.col("type") == COLLAPSED) | (F.col("minor_ac") / (2.0 * n) <= maf)))


def polymorphic(counted: DataFrame, least_alleles: int, least_variants: int) -> DataFrame:
    """(gene, transcript, variants, alleles, kept, gene_kept): a transcript needs enough of both, a gene one transcript."""
    groups = counted.groupBy("gene", "transcript").agg(F.count("*").alias("variants"), F.sum("ac").cast("long").alias("alleles"))
    kept = (F.col("alleles") >= least_alleles) & (F.col("variants") >= least_variants)
    return groups.withColumn("kept", kept).withColumn("gene_kept", F.max("kept").over(Window.partitionBy("gene")))


def impute(cohort: Cohort, mode: str = "af") -> DataFrame:
    """calls with missing dosages replaced by the allele frequency (or, mode dosage, twice it) of the sample's own group."""
    n, cases = cohort.sizes
    both = cohort.calls.join(cohort.samples.select("sample_id", "y"), "sample_id")
    groups = both.groupBy("variant_id", "y").agg(F.sum("dosage").alias("ac"), F.sum(F.col("missing").cast("int")).alias("gone"))
    size = F.when(F.col("y") == 1, cases).otherwise(n - cases)
    factor = 1.0 if mode == "dosage" else 2.0
    seen = size - F.col("gone")
    mean = groups.select("variant_id", "y", F.when(seen > 0, F.col("ac") / (factor * seen)).otherwise(0.0).alias("mean"))
    value = F.when(F.col("missing") & (F.col("dosage") == 0), F.col("mean")).otherwise(F.col("dosage").cast("double"))
    return both.join(mean, ["variant_id", "y"]).select("sample_id", "variant_id", value.alias("dosage"), "missing")


def beta_weight(frequency: F.Column, a: float = 1.0, b: float = 25.0) -> F.Column:
    """Beta density at an allele frequency."""
    constant = math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
    return F.pow(frequency, a - 1) * F.pow(1 - frequency, b - 1) / constant


def whole_gene(variants: DataFrame, dedupe: str = "id") -> DataFrame:
    """All transcripts of a gene as one: full ids are distinct; dedupe="physical" keeps one row for each locus."""
    keyed = variants.withColumn("variant_key", variant_key()).withColumn("transcript", F.col("gene"))
    return keyed.dropDuplicates(["gene", *LOCUS] if dedupe == "physical" else ["variant_key"])


def collapse_rare(cohort: Cohort, k: int, numbers: bool = False) -> tuple[DataFrame, DataFrame]:
    """Variants with at most k minor alleles become one variant of each transcript: whether a sample carries any.

    Returns variants (variant_key, locus, gene, transcript, type, function, weight, members) and calls (variant_key,
    sample_id, dosage, missing).  A collapsed variant spans its members and has no alleles of its own; variants without any
    allele are collapsed too; the weight is the mean.

    numbers: variants get a number besides (variant_id), in order of their keys, which calls bear instead of the key; only
    calls of merged variants are shuffled.
    """
    n, _ = cohort.sizes
    keyed = flipped(counted_variants(cohort), n).withColumn("rare", F.col("minor_ac") <= k)
    for c in (*LOCUS, "function"):
        if c not in keyed.columns:
            keyed = keyed.withColumn(c, F.lit(None).cast("string"))
    own = variant_key() if set(LOCUS) <= set(cohort.variants.columns) else F.concat_ws(",", F.col("variant_id").cast("string"), "transcript")
    name = F.when(F.col("rare"), F.concat_ws(",", F.lit(COLLAPSED), "gene", "transcript")).otherwise(own)
    keyed = keyed.withColumn("variant_key", name)
    keyed = persist(keyed) if numbers else keyed
    either = lambda c, merged: F.first(F.when(F.col("rare"), F.lit(merged)).otherwise(F.col(c))).alias(c)
    variants = keyed.groupBy("variant_key", "gene", "transcript").agg(
        F.min("chrom").alias("chrom"), F.min("start").alias("start"), F.max("end").alias("end"), either("ref", "-"), either("alt", "-"), either("type", COLLAPSED), either("function", COLLAPSED),
        F.avg("weight").alias("weight"), F.count("*").alias("members"),
    )
    if numbers:
        variants = persist(numbered(variants, "variant_key", name="variant_id"))
        known = variants.select("variant_key", F.col("variant_id").alias("number"), (F.col("members") > 1).alias("several"))
        member = persist(keyed.select("variant_id", "variant_key", "rare").join(known, "variant_key").drop("variant_key"))
        dose = F.when(F.col("rare"), (F.col("dosage") > 0).cast("int")).otherwise(F.col("dosage")).alias("dosage")
        held = lambda which: cohort.calls.join(member.where(which), "variant_id").select(F.col("number").alias("variant_id"), "sample_id", dose, "missing")
        merged = held("several").groupBy("variant_id", "sample_id").agg(F.max("dosage").alias("dosage"), F.max("missing").alias("missing"))
        return variants, held("not several").unionByName(merged)
    joined = cohort.calls.join(keyed.select("variant_id", "variant_key", "rare"), "variant_id")
    calls = joined.groupBy("variant_key", "sample_id").agg(
        F.max(F.when(F.col("rare"), (F.col("dosage") > 0).cast("int")).otherwise(F.col("dosage"))).alias("dosage"), F.max("missing").alias("missing")
    )
    return variants, calls
