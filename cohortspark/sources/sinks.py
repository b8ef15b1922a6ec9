"""Writers of result files."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column names of the ranked result file.
SIMPLE = {
    "rank": "Rank", "gene": "Gene", "transcript": "Transcript", "stat": "Test_Statistic", "empirical_p": "Empirical_P", "ci": "Empirical_P_CI", "empirical_midp": "Empirical_MidP",
    "mgit_p": "MGIT_P", "successes": "Successes", "mgit_successes": "MGIT_Successes", "permutations": "Permutations",
}


def write_lines(df: DataFrame, path: str, columns: dict[str, str], order: list[str], comments: tuple[str, ...] = ()) -> None:
    """Tab-separated text in a stated order, after comment lines and a header."""
    spark = df.sparkSession
    text = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns))
    body = df.select(F.lit(1).alias("part"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(order)), text.alias("value"))
    head = [*(f"# {c}" for c in comments), "\t".join(columns.values())]
    top = spark.createDataFrame([(0, k, v) for k, v in enumerate(head)], "part int, at int, value string")
    whole = body.withColumn("at", F.lit(0)).unionByName(top, allowMissingColumns=True)
    whole.orderBy("part", "at", *(f"k{i}" for i in range(len(order)))).select("value").write.mode("overwrite").text(path)


def write_simple(result: DataFrame, path: str, cases: int, controls: int, command: str = "") -> None:
    """The ranked result with its interval as lo,hi."""
    low, high = (F.col(c).cast("string") for c in ("empirical_p_low", "empirical_p_high"))
    shown = result.withColumn("ci", F.concat_ws(",", low, high)) if "empirical_p_low" in result.columns else result
    columns = {c: n for c, n in SIMPLE.items() if c in shown.columns}
    write_lines(shown, path, columns, ["rank"], (f"command: {command}", f"cases: {cases}", f"controls: {controls}"))


def write_table(df: DataFrame, path: str, order: list[str]) -> None:
    """Any result table with its own column names: details, power, effect sizes, exports."""
    write_lines(df, path, {c: c for c in df.columns}, order)


# Column names of the power and effect size files.
POWER = {"gene": "Gene", "transcript": "Transcript", "method": "Method", "n_cases": "Ncases", "n_controls": "Ncontrols", "successes": "Successes", "bootstraps": "Bootstraps", "ratio": "Ratio", "alpha": "Alpha"}
EFFECT = {
    "gene": "Gene", "transcript": "Transcript", "or_estimate": "OR", "or_ci_low": "OR_CI_Low", "or_ci_high": "OR_CI_High", "p_value": "P", "case_carrier": "Case_Carrier",
    "case_non_carrier": "Case_Non_Carrier", "control_carrier": "Control_Carrier", "control_non_carrier": "Control_Non_Carrier",
}


def write_power(ratios: DataFrame, path: str) -> None:
    """Power by gene, transcript, sample sizes and alpha."""
    write_lines(ratios, path, POWER, ["gene", "transcript", "n_cases", "n_controls", "alpha"])


def write_effects(effects: DataFrame, path: str) -> None:
    """Effect sizes with intervals, by gene and transcript."""
    write_lines(effects, path, EFFECT, ["gene", "transcript"])


def write_stats(result: DataFrame, path: str) -> None:
    """The permuted statistics of each group (column stats), in order of the permutations."""
    write_lines(result.withColumn("stats", F.concat_ws(",", F.transform("stats", lambda x: x.cast("string")))), path, {"gene": "Gene", "transcript": "Transcript", "stats": "Permuted"}, ["gene", "transcript"])


def write_report(report: DataFrame, index: DataFrame, path: str) -> None:
    """The carrier report, a gene's transcripts in order of p (reports.ordered_report), then the sample numbers."""
    body = report.select(F.col("gene").alias("a"), F.col("place").alias("b"), F.concat_ws("\t", "gene", "transcript", F.col("stat").cast("string"), F.col("empirical_p").cast("string"), "line", "variant_id", "who").alias("value"))
    spark = report.sparkSession
    head = spark.createDataFrame([("## Sample Index Map",)], "value string")
    trailer = index.select(F.lit(None).cast("string").alias("a"), F.col("at").alias("b"), F.concat_ws("\t", F.lit("#"), F.col("sample_id").cast("string"), F.col("at").cast("string")).alias("value"))
    whole = body.withColumn("part", F.lit(0)).unionByName(head.withColumn("part", F.lit(1)), allowMissingColumns=True).unionByName(trailer.withColumn("part", F.lit(2)))
    whole.orderBy("part", "a", "b", "value").select("value").write.mode("overwrite").text(path)
