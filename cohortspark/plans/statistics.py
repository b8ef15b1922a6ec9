"""Gene-level statistics as DataFrame plans: closed forms without covariates.

Every plan aggregates sparse calls; zero genotypes never appear.  Groups are (gene, transcript).
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cohort import Cohort
from ..functions.special import chi2_sf_col, log_gamma_col
from ..operators.filters import counted_variants

GROUP = ("gene", "transcript")


def calpha(cohort: Cohort) -> DataFrame:
    """Sum over variants of (case carriers - expected)^2 - variance."""
    n, cases = cohort.sizes
    p = cases / n
    term = F.pow(F.col("case_carriers") - F.col("carriers") * p, 2) - F.col("carriers") * p * (1 - p)
    return counted_variants(cohort).groupBy(*GROUP).agg(F.sum(term).alias("calpha"))


def wss(cohort: Cohort) -> DataFrame:
    """Weighted sum of case alleles; weights from the frequency over all samples with one pseudo-count."""
    n, _ = cohort.sizes
    f = (1 + F.col("ac")) / (2.0 + 2 * n)
    return counted_variants(cohort).groupBy(*GROUP).agg(F.sum(F.col("case_ac") / F.sqrt(f * (1 - f))).alias("wss"))


def variable_threshold(cohort: Cohort) -> DataFrame:
    """Largest z over allele-count thresholds."""
    n, cases = cohort.sizes
    by_count = counted_variants(cohort).groupBy(*GROUP, "ac").agg(*(F.sum(c).alias(c + "_sum") for c in ("case_ac", "ac", "ac2")))
    upto = Window.partitionBy(*GROUP).orderBy("ac").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = {c: F.sum(c + "_sum").over(upto) for c in ("case_ac", "ac", "ac2")}
    z = F.when(total["ac2"] > 0, (total["case_ac"] - cases / n * total["ac"]) / F.sqrt(total["ac2"]))
    return by_count.select(*GROUP, z.alias("z")).groupBy(*GROUP).agg(F.max("z").alias("vt"))


def carriers(cohort: Cohort, *carry: str) -> DataFrame:
    """Per (gene, transcript, sample): weighted burden, alleles and variants carried, for samples with any call."""
    variants = cohort.variants.select("variant_id", *GROUP, "weight")
    held = cohort.dealt(cohort.calls.where("dosage > 0"), "variant_id").join(variants, "variant_id")
    return (
        cohort.dealt(held, "sample_id")
        .groupBy(*GROUP, "sample_id")
        .agg(F.sum(F.col("weight") * F.col("dosage")).alias("burden"), F.sum("dosage").cast("long").alias("alleles"), F.count("*").alias("sites"))
        .join(cohort.samples.select("sample_id", "y", "trait", *carry), "sample_id")
    )


def carrier_table(cohort: Cohort) -> DataFrame:
    """2x2 counts per group: case and control carriers and the others."""
    n, cases = cohort.sizes
    table = carriers(cohort).groupBy(*GROUP).agg(F.sum("y").cast("long").alias("case_carrier"), F.sum(1 - F.col("y")).cast("long").alias("control_carrier"))
    return table.select(
        "*", (F.lit(cases) - F.col("case_carrier")).cast("long").alias("case_other"), (F.lit(n - cases) - F.col("control_carrier")).cast("long").alias("control_other")
    )


def cmc_chisq(cohort: Cohort, rare: float = 0.005) -> DataFrame:
    """Chi-square of allele sums by status: rare variants as one column; a lone column is tested by carriers."""
    n, cases = cohort.sizes
    counted = counted_variants(cohort)
    column = F.when(F.col("ac") / (2.0 * n) < rare, F.lit(-1)).otherwise(F.col("variant_id"))
    columns = counted.groupBy(*GROUP, column.alias("col")).agg(F.sum("case_ac").alias("a"), F.sum("ac").alias("t")).where("t > 0")
    both = Window.partitionBy(*GROUP)
    share = F.sum("a").over(both) / F.sum("t").over(both)
    cells = columns.select(*GROUP, "a", "t", share.alias("q"))
    chi = F.pow(F.col("a") - F.col("q") * F.col("t"), 2) * (1 / (F.col("q") * F.col("t")) + 1 / ((1 - F.col("q")) * F.col("t")))
    table = cells.groupBy(*GROUP).agg(F.sum(chi).alias("chi"), F.count("*").alias("columns"))
    c = carrier_table(cohort)
    expected = (F.col("case_carrier") + F.col("control_carrier")) / n
    lone = F.pow(F.col("case_carrier") - cases * expected, 2) * (1 / (cases * expected) + 1 / (cases * (1 - expected)) + 1 / ((n - cases) * expected) + 1 / ((n - cases) * (1 - expected)))
    joined = table.join(c.select(*GROUP, lone.alias("lone")), list(GROUP))
    stat = F.when(F.col("columns") > 1, F.col("chi")).otherwise(F.col("lone"))
    df = F.greatest(F.col("columns") - 1, F.lit(1))
    return joined.select(*GROUP, "columns", stat.alias("cmc"), chi2_sf_col(stat, df).alias("p"))


def odds_ratio(cohort: Cohort) -> DataFrame:
    """Carrier odds ratio, with a half added to each cell if any is empty."""
    t = carrier_table(cohort)
    cells = ("case_carrier", "control_carrier", "case_other", "control_other")
    add = F.when(F.least(*cells) == 0, 0.5).otherwise(0.0)
    a, b, c, d = (F.col(x) + add for x in cells)
    return t.select(*GROUP, *cells, (a * d / (b * c)).alias("odds_ratio"))


def fisher_one_sided(cohort: Cohort) -> DataFrame:
    """P(at least as many case carriers), with margins fixed: hypergeometric terms by log-gamma, added up in the JVM."""
    n, cases = cohort.sizes
    t = carrier_table(cohort)
    m = F.col("case_carrier") + F.col("control_carrier")
    lg = lambda x: log_gamma_col(x + 1.0)
    margins = lg(m) + lg(F.lit(n) - m) + lg(F.lit(cases)) + lg(F.lit(n - cases)) - lg(F.lit(n))
    top = F.least(m, F.lit(cases).cast("long"))
    keyed = t.select(*GROUP, "case_carrier", m.alias("m"), margins.alias("margins"), top.alias("top"))
    k = F.col("k")
    term = F.exp(F.col("margins") - lg(k) - lg(F.col("m") - k) - lg(F.lit(cases) - k) - lg(F.lit(n - cases) - F.col("m") + k))
    terms = keyed.withColumn("k", F.explode(F.sequence(F.greatest("case_carrier", F.col("m") - (n - cases)), "top")))
    return terms.select(*GROUP, term.alias("term")).groupBy(*GROUP).agg(F.least(F.sum("term"), F.lit(1.0)).alias("p"))


def burden(cohort: Cohort, quantitative: bool = False) -> DataFrame:
    """Score test of the weighted burden, no covariates; binary status or the trait."""
    n, cases = cohort.sizes
    if quantitative:
        mean, var = cohort.samples.agg(F.avg("trait"), F.var_samp("trait")).first()
        u, scale = F.col("trait") - mean, var
    else:
        p = cases / n
        u, scale = F.col("y") - p, p * (1 - p)
    s = carriers(cohort).groupBy(*GROUP).agg(F.sum(F.col("burden") * u).alias("s"), F.sum("burden").alias("b"), F.sum(F.col("burden") * F.col("burden")).alias("bb"))
    stat = F.pow("s", 2) / (scale * (F.col("bb") - F.col("b") * F.col("b") / n))
    return s.select(*GROUP, stat.alias("burden"), chi2_sf_col(stat, 1).alias("p"))


def skat_q(cohort: Cohort) -> DataFrame:
    """Sum of squared weighted scores, no covariates."""
    n, cases = cohort.sizes
    z = F.col("weight") * (F.col("case_ac") - cases / n * F.col("ac"))
    return counted_variants(cohort).groupBy(*GROUP).agg(F.sum(z * z).alias("skat_q"))


def g_test(a: F.Column, m: F.Column, cases: int, n: int) -> F.Column:
    """Likelihood ratio of a 2x2 table: a cases among m carriers, of so many cases among n."""
    cell = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    controls = n - cases
    return 2 * (cell(a, m * cases / n) + cell(m - a, m * controls / n) + cell(cases - a, (n - m) * cases / n) + cell(controls - m + a, (n - m) * controls / n))


def rvt2(cohort: Cohort) -> DataFrame:
    """Likelihood-ratio test of the carrier indicator without covariates: a 2x2 G test."""
    n, cases = cohort.sizes
    t = carrier_table(cohort)
    g = g_test(F.col("case_carrier"), F.col("case_carrier") + F.col("control_carrier"), cases, n)
    return t.select(*GROUP, g.alias("lrt"), chi2_sf_col(g, 1).alias("p"))


def log_likelihood(freq: F.Column, ref: F.Column, alt: F.Column) -> F.Column:
    part = lambda k, f: F.when(k == 0, 0.0).otherwise(k * F.log(f))
    return part(alt, freq) + part(ref, 1 - freq)


def allele_lrt(case_alt: F.Column, control_alt: F.Column, case_all: F.Column | float, control_all: F.Column | float, cap: float) -> F.Column:
    """Log likelihood ratio of separate allele frequencies, the controls' capped, against a common one."""
    case_ref, control_ref = case_all - case_alt, control_all - control_alt
    common = (case_alt + control_alt) / (F.lit(1.0) * case_all + control_all)
    separate = log_likelihood(F.least(control_alt / control_all, F.lit(cap)), control_ref, control_alt) + log_likelihood(case_alt / case_all, case_ref, case_alt)
    joint = log_likelihood(common, case_ref, case_alt) + log_likelihood(common, control_ref, control_alt)
    return F.when(case_alt == 0, 0.0).otherwise(separate - joint)


def vaast_sites(cohort: Cohort, penalty: float = 2.0, cap: float = 1.0) -> DataFrame:
    """Per variant its site score after weight, floor and penalty, and whether it passed the penalty."""
    n, cases = cohort.sizes
    c = counted_variants(cohort)
    control = F.col("ac") - F.col("case_ac")
    raw = 2 * (allele_lrt(F.col("case_ac"), control, F.lit(2.0 * cases), F.lit(2.0 * (n - cases)), cap) + F.log("weight"))
    floored = F.when((F.col("weight") <= 0) | (raw < 0) | (F.col("case_ac") == 0), 0.0).otherwise(raw)
    return c.select(*GROUP, "variant_id", F.when(floored > penalty, floored - penalty).otherwise(floored).alias("score"), (floored > penalty).alias("included"))


def vaast(cohort: Cohort, penalty: float = 2.0, cap: float = 1.0) -> DataFrame:
    """Sum of the site scores beyond the penalty."""
    sites = vaast_sites(cohort, penalty, cap)
    return sites.groupBy(*GROUP).agg(F.sum(F.when(F.col("included"), F.col("score")).otherwise(0.0)).alias("vaast"))


def vaast_biallelic(cohort: Cohort, penalty: float = 2.0, cap: float = 1.0) -> DataFrame:
    """Site scores plus a term for samples with two or more alleles at positively scored sites."""
    n, cases = cohort.sizes
    sites = vaast_sites(cohort, penalty, cap)
    scored = sites.groupBy(*GROUP).agg(F.sum("score").alias("sites"))
    positive = sites.where("score > 0").select(*GROUP, "variant_id")
    per_sample = cohort.calls.join(positive, "variant_id").groupBy(*GROUP, "sample_id").agg(F.sum("dosage").alias("d")).where("d > 1")
    double = per_sample.join(cohort.samples, "sample_id").groupBy(*GROUP).agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    term = allele_lrt(F.col("a"), F.col("b"), F.lit(float(cases)), F.lit(float(n - cases)), cap)
    joined = scored.join(double.select(*GROUP, term.alias("term")), list(GROUP), "left")
    return joined.select(*GROUP, F.greatest(F.col("sites") + F.coalesce("term", F.lit(0.0)), F.lit(0.0)).alias("vaast"))


def acat(values: list[F.Column]) -> F.Column:
    """Combination of p-values by the mean-free Cauchy sum."""
    total = sum((F.tan((0.5 - p) * F.lit(3.141592653589793)) for p in values[1:]), F.tan((0.5 - values[0]) * F.lit(3.141592653589793)))
    return 0.5 - F.atan(total / len(values)) / F.lit(3.141592653589793)
