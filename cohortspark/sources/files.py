"""Readers of the file kinds of an association study.

Text goes through Spark's own readers, which take plain and gzip files by their ending; `with_codec` copies files whose
ending hides their format to a name that tells it.  Lines are checked as columns: a bad line raises with its file and number of fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cohort import TYPES, Cohort
from ..streaming.blocks import persist, shared_path

MATRIX = ("chrom", "start", "end", "ref", "alt", "type", "gene", "transcript", "region", "function", "annotation")
# The first bytes of compressed files and the endings that Spark knows them by.
MAGIC = {b"\x1f\x8b": ".gz", b"\x28\xb5\x2f\xfd": ".zst", b"BZh": ".bz2"}


def with_codec(spark: SparkSession, path: str) -> str:
    """A path whose ending tells Spark the codec: path itself, or a copy in shared storage, by the file's first bytes.

    Files are opened by Spark's own file systems, so that remote paths work too.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    source = hadoop.Path(path)
    system = source.getFileSystem(conf)
    stream = system.open(source)
    try:
        head = bytes(b for b in (stream.read() for _ in range(4)) if b >= 0)
    finally:
        stream.close()
    ending = next((e for magic, e in MAGIC.items() if head.startswith(magic)), "")
    if not ending or path.endswith(ending):
        return path
    target = hadoop.Path(f"{shared_path(spark, 'codec')}/{source.getName()}{ending}")
    hadoop.FileUtil.copy(system, source, target.getFileSystem(conf), target, False, conf)
    return target.toString()


def require(ok: Column, value: Column, message: str) -> Column:
    """value, or an error that shows the line."""
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.substring(F.coalesce("value", F.lit("")), 1, 80))))


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).where(F.trim("value") != "")


def fields(line: str, pattern: str = "\t", limit: int = -1) -> Column:
    return F.split(F.col(line), pattern, limit)


IS_HEAD = ("chr\t", "#chr")  # what a header line begins with, in lower case
SPARSE = "*"  # begins a genotype field that lists calls only


def matrix_head(spark: SparkSession, path: str) -> tuple[Column, int]:
    """Whether a line is the header of a matrix file, the line that starts with Chr, and how many samples it names."""
    begins = F.lower(F.substring("value", 1, 4)).isin(*IS_HEAD)
    head = lines(spark, path).where(begins).select(F.size(fields("value")).alias("size"), F.sha2("value", 256).alias("digest")).head()
    if head is None:
        raise ValueError(f"{path} has no header line")
    return begins & (F.sha2("value", 256) == head.digest), max(0, head["size"] - len(MATRIX))


def matrix_index(spark: SparkSession, path: str) -> DataFrame:
    """(at, sample_id): the header's samples and their places; ids stay in Spark."""
    is_head, _ = matrix_head(spark, path)
    found = lines(spark, path).where(is_head).limit(1).select(F.posexplode(fields("value")).alias("at", "sample_id"))
    return persist(found.where(F.col("at") >= len(MATRIX)).select((F.col("at") - len(MATRIX)).alias("at"), "sample_id"))


def sparse_cells(gt: Column) -> Column:
    """The calls of a sparse genotype field: (at, code as text)."""
    cells = F.split(F.expr("substring(gt, 2)"), ",")
    return F.transform(F.filter(cells, lambda x: x != ""), lambda x: F.struct(F.substring_index(x, ":", 1).try_cast("int").alias("at"), F.substring_index(x, ":", -1).alias("d")))


def well_formed(gt: Column, samples: int) -> Column:
    """Whether a genotype field is a digit for each sample, or lists calls in order of their places."""
    cells = sparse_cells(gt)
    places = F.transform(cells, lambda x: x.at)
    entries = F.split(F.expr("substring(gt, 2)"), ",")
    each = (gt == SPARSE) | F.forall(entries, lambda x: x.rlike("^[0-9]{1,9}:[0-9]$"))
    ascending = (places == F.array_sort(F.array_distinct(places))) & (F.coalesce(F.array_max(places), F.lit(-1)) < samples)
    return F.when(gt.startswith(SPARSE), each & ascending).otherwise((F.length(gt) == samples) & gt.rlike("^[0-9]*$"))


def matrix_rows(spark: SparkSession, path: str, genes: list[str] | None = None) -> DataFrame:
    """One row for each variant and transcript: its eleven columns and its genotypes.

    Genotypes are a digit for each sample, glued, or, behind a star, the calls alone as place:digit in order, joined by commas.
    A list of genes is a filter on the split line before any genotype is looked at.
    """
    is_head, samples = matrix_head(spark, path)
    body = lines(spark, path).where(~is_head).withColumn("f", fields("value", "\t", 12))
    if genes is not None:
        body = body.where(F.get("f", F.lit(6)).isin(genes))
    body = body.withColumn("gt", F.get("f", F.lit(11)))
    ok = (F.size("f") == 12) & F.get("f", F.lit(5)).isin(*TYPES) & F.coalesce(well_formed(F.col("gt"), samples), F.lit(False))
    return body.select(*(F.get("f", F.lit(k)).alias(c) for k, c in enumerate(MATRIX)), require(ok, F.col("gt"), "bad matrix line").alias("gt"))


def read_matrix(spark: SparkSession, path: str, genes: list[str] | None = None) -> DataFrame:
    """matrix_rows, with the sample ids of the header in every row: for files of few samples."""
    is_head, _ = matrix_head(spark, path)
    ids = lines(spark, path).where(is_head).head().value.split("\t")[len(MATRIX) :]
    return matrix_rows(spark, path, genes).withColumn("ids", F.split(F.lit("\t".join(ids)), "\t"))


def check_sorted(spark: SparkSession, path: str) -> list[str]:
    """Genes that come back after another gene began; empty for a file sorted by gene.  A check for small files."""
    numbered = lines(spark, path).withColumn("at", F.monotonically_increasing_id()).withColumn("gene", fields("value", "\t", 8)[6]).where("gene <> 'Genes'")
    order = Window.orderBy("at")
    starts = numbered.withColumn("before", F.lag("gene").over(order)).where("before is null or before <> gene")
    return [r.gene for r in starts.groupBy("gene").count().where("count > 1").collect()]


def matrix_cells(matrix: DataFrame, *keep: Column | str) -> DataFrame:
    """What is kept of each row, and its calls (at, dosage, missing): digits above 2 are missing, zeros are left out.

    Zeros leave inside the array, before anything is exploded.
    """
    glued = F.transform(F.split("gt", ""), lambda d, i: F.struct(i.alias("at"), d.alias("d")))
    cells = F.filter(F.when(F.col("gt").startswith(SPARSE), sparse_cells(F.col("gt"))).otherwise(glued), lambda c: c.d != "0")
    code = F.col("x.d").cast("int")
    long = matrix.select(*keep, F.explode(cells).alias("x"))
    return long.select(*long.columns[:-1], F.col("x.at").alias("at"), F.when(code > 2, 0).otherwise(code).alias("dosage"), (code > 2).alias("missing"))


def matrix_calls(matrix: DataFrame) -> DataFrame:
    """Sparse calls (variant columns, sample_id, dosage, missing) of rows that have the sample ids."""
    return matrix_cells(matrix, *MATRIX, "ids").select(*MATRIX, F.get("ids", F.col("at")).alias("sample_id"), "dosage", "missing")


VARIANT = ("chrom", "start", "end", "ref", "alt", "transcript")


def repeated_variants(parts: list[DataFrame]) -> DataFrame:
    """For each variant of several files how many rows have it (copies), and the first file."""
    keyed = [p.select(*VARIANT, F.lit(k + 1).alias("file")) for k, p in enumerate(parts)]
    whole = keyed[0]
    for other in keyed[1:]:
        whole = whole.unionByName(other)
    return whole.groupBy(*VARIANT).agg(F.count("*").alias("copies"), F.min("file").alias("first_file"))


def refuse_repeated(parts: list[DataFrame]) -> None:
    twice = repeated_variants(parts).where("copies > 1").head()
    if twice is not None:
        raise ValueError(f"variant in more than one file: {twice}")


def merge_matrices(matrices: list[DataFrame]) -> DataFrame:
    """Calls of several files; samples meet by id, so that column order does not matter; repeated variants raise."""
    refuse_repeated(matrices)
    headers = {tuple(sorted(m.head().ids)) for m in matrices if m.head() is not None}
    if len(headers) > 1:
        raise ValueError("the files have different samples")
    calls = [matrix_calls(m) for m in matrices]
    whole = calls[0]
    for other in calls[1:]:
        whole = whole.unionByName(other)
    return whole


def read_ped(spark: SparkSession, path: str, quantitative: bool = False) -> DataFrame:
    """(sample_id, y, trait): 1 and 2 are control and case; quantitative phenotypes are numbers."""
    body = lines(spark, path).where(~F.col("value").startswith("#")).withColumn("f", fields("value", r"\s+"))
    pheno = F.expr("try_cast(get(f, 5) as double)")
    ok = (F.size("f") >= 6) & pheno.isNotNull() & (F.lit(quantitative) | pheno.isin(1.0, 2.0))
    value = require(ok, pheno, "bad pedigree line")
    return body.select(F.get("f", F.lit(1)).alias("sample_id"), value.alias("trait")).select("sample_id", (F.col("trait") == 2).cast("int").alias("y"), "trait")


def read_covariates(spark: SparkSession, path: str, max_levels: int = 100) -> DataFrame:
    """(sample_id, x): an intercept, numbers as they are, other columns as indicators of all levels but the last.

    A column with any value that is no number is categorical as a whole; NA raises; a header line is dropped by the join
    with the samples.
    """
    body = lines(spark, path).withColumn("f", fields("value", r"\s+"))
    width = F.lit(len(body.head().f))
    ok = (F.size("f") == width) & ~F.array_contains("f", "NA")
    body = body.select(require(ok, F.col("f"), "bad covariate line").alias("f"))
    count = len(body.head().f)
    columns = [F.lit(1.0)]
    for k in range(1, count):
        value = F.expr(f"try_cast(get(f, {k}) as double)")
        numeric = body.agg(F.sum(F.when(value.isNull(), 1).otherwise(0))).first()[0] == 0
        if numeric:
            columns.append(value)
            continue
        levels = [r[0] for r in body.select(F.get("f", F.lit(k))).distinct().orderBy(F.get("f", F.lit(k))).limit(max_levels + 2).collect()]
        if len(levels) - 1 > max_levels:
            raise ValueError(f"covariate {k} has over {max_levels} levels")
        columns += [(F.get("f", F.lit(k)) == level).cast("double") for level in levels[:-1]]
    return body.select(F.get("f", F.lit(0)).alias("sample_id"), F.array(*columns).alias("x"))


def read_bed(spark: SparkSession, paths: str) -> DataFrame:
    """Loci and alleles to leave out, from a comma-separated list of files."""
    body = lines(spark, paths.split(",")).withColumn("f", fields("value"))
    names = MATRIX[:5]
    return body.select(*(require(F.size("f") >= 5, F.get("f", F.lit(k)), "bad mask line").alias(c) for k, c in enumerate(names))).distinct()


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """Weights by the full variant key; the type SNP is an SNV."""
    body = lines(spark, path).withColumn("f", fields("value"))
    kind = F.when(F.get("f", F.lit(5)) == "SNP", "SNV").otherwise(F.get("f", F.lit(5)))
    number = F.expr("try_cast(get(f, 8) as double)")
    ok = (F.size("f") == 9) & kind.isin(*TYPES) & number.isNotNull()
    names = MATRIX[:8]
    return body.select(*((kind if c == "type" else F.get("f", F.lit(k))).alias(c) for k, c in enumerate(names)), require(ok, number, "bad weight line").alias("weight"))


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """(method, value) of allowed types and functions, pooled."""
    wide = spark.read.csv(path, header=True)
    methods = [c for c in wide.columns if c != "Variant"]
    long = wide.unpivot(["Variant"], methods, "method", "allowed").where(F.trim("allowed") == "1")
    return long.select("method", F.regexp_replace("Variant", "^(TYPE|FUNCTION):", "").alias("value")).distinct()


def read_permutations(spark: SparkSession, path: str, first: int = 1, last: int | None = None) -> DataFrame:
    """(perm_id, labels) of a file with one line of 0 and 1 for each permutation; a block is a range of perm_ids.

    Lines are numbered in order of files and partitions, blanks left out; a line that is already numbered (perm_id and a tab)
    keeps its number.
    """
    body = lines(spark, path)
    labels = F.regexp_extract("value", r"^\s*(?:(\d+)\t)?([01\s]+)$", 2)
    own = F.expr(r"try_cast(regexp_extract(value, '^\\s*(\\d+)\\t', 1) as long)")
    rows = body.select(own.alias("own"), F.regexp_replace(labels, r"\s", "").alias("labels"))
    if rows.where("own is null").head(1):
        from ..operators.products import numbered

        rows = numbered(rows.withColumn("line", F.monotonically_increasing_id()), "line").select((F.col("at") + 1).alias("perm_id"), "labels")
    else:
        rows = rows.select(F.col("own").alias("perm_id"), "labels")
    return rows.where((F.col("perm_id") >= first) & (F.lit(last is None) | (F.col("perm_id") <= (last or 0))))


def write_permutations(permutations: DataFrame, path: str) -> None:
    """One line for each permutation: its number, a tab, and 0 or 1 for each sample in id order."""
    order = F.array_sort(F.collect_list(F.struct("sample_id", "y")))
    text = permutations.groupBy("perm_id").agg(order.alias("s")).select("perm_id", F.array_join(F.transform("s", lambda s: s.y.cast("string")), "").alias("labels"))
    text.orderBy("perm_id").select(F.concat_ws("\t", F.col("perm_id").cast("string"), "labels").alias("value")).write.text(path)


def read_refflat(spark: SparkSession, path: str) -> DataFrame:
    """Gene models with nested exon spans."""
    f = F.col("f")
    numbers = lambda k: F.transform(F.filter(F.split(f[k], ","), lambda x: x != ""), lambda x: x.cast("long"))
    body = lines(spark, path).withColumn("f", fields("value")).where(F.size("f") >= 11)
    return body.select(
        f[0].alias("gene"), f[1].alias("transcript"), f[2].alias("chrom"), f[3].alias("strand"), f[4].cast("long").alias("tx_start"), f[5].cast("long").alias("tx_end"),
        f[6].cast("long").alias("cds_start"), f[7].cast("long").alias("cds_end"),
        F.zip_with(numbers(9), numbers(10), lambda a, b: F.struct(a.alias("start"), b.alias("end"))).alias("exons"),
    )


def genotype_code(gt: Column) -> Column:
    """Alternate alleles of a GT entry; 5 (missing) if it is short or has a dot."""
    alleles = F.split(F.split(gt, ":")[0], r"[/|]")
    alt = lambda k: F.when(alleles[k] != "0", 1).otherwise(0)
    return F.when((F.size(alleles) < 2) | F.split(gt, ":")[0].contains("."), 5).otherwise(alt(0) + alt(1))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, ref, alt, sample_id, code) of all samples; zero codes leave inside the array."""
    raw = lines(spark, path).where(~F.col("value").startswith("##"))
    head = raw.where(F.col("value").startswith("#C")).head()
    ids = F.split(F.lit("\t".join(head.value.split("\t")[9:])), "\t")
    f = fields("value")
    cell = F.transform(F.slice(f, F.lit(10), F.greatest(F.size(f) - 9, F.lit(0))), lambda g, i: F.struct(i.alias("at"), genotype_code(g).alias("code")))
    body = raw.where(~F.col("value").startswith("#")).select(
        f[0].alias("chrom"), f[1].cast("long").alias("pos"), f[3].alias("ref"), f[4].alias("alt"), F.explode(F.filter(cell, lambda c: c.code != 0)).alias("x")
    )
    return body.select("chrom", "pos", "ref", "alt", F.get(ids, F.col("x.at")).alias("sample_id"), F.col("x.code").alias("code"))


def read_simple(spark: SparkSession, path: str) -> DataFrame:
    """A ranked result file: comment lines dropped, columns named by its header line."""
    body = lines(spark, path).where(~F.col("value").startswith("#"))
    names = body.where(F.col("value").startswith("Rank")).head().value.split()
    f = F.split(F.trim("value"), r"\s+")
    return body.where(~F.col("value").startswith("Rank")).select(*(f[k].alias(c) for k, c in enumerate(names)))


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """(kind, id, parent, chrom, start, end) of genes and transcripts; ids without prefix and version."""
    f = fields("value")
    body = lines(spark, path).where(~F.col("value").startswith("#")).select(f[0].alias("chrom"), f[2].alias("kind"), f[3].cast("long").alias("start"), f[4].cast("long").alias("end"), F.str_to_map(f[8], F.lit(";"), F.lit("=")).alias("a"))
    bare = lambda key: F.regexp_replace(F.regexp_replace(F.col("a")[key], "^(gene|transcript):", ""), r"\.\d+$", "")
    return body.select("kind", bare("ID").alias("id"), bare("Parent").alias("parent"), F.col("a")["Name"].alias("name"), "chrom", "start", "end").where("id is not null")


def from_files(
    spark: SparkSession,
    matrices: list[str],
    ped: str,
    weights: str | None = None,
    mask: str | None = None,
    quantitative: bool = False,
    covariates: str | None = None,
    genes: list[str] | None = None,
    max_levels: int = 100,
) -> Cohort:
    """The cohort of matrix and pedigree files; samples that the pedigree lacks are left out, those that only it has raise.

    With covariates the samples have a design x, which a scan takes as it is; samples without a covariate line raise.
    A whitelist and permutations from files go to the scan itself (read_whitelist, read_permutations).
    """
    from ..operators.filters import attach_weights, bed_mask, variant_key

    read = [matrix_rows(spark, m, genes) for m in matrices]
    indexes = [matrix_index(spark, m) for m in matrices]
    samples = read_ped(spark, ped, quantitative)
    refuse_repeated(read)
    used = [i for i, r in zip(indexes, read, strict=True) if len(read) == 1 or r.head(1)] or indexes
    for other in used[1:]:
        if used[0].join(other, "sample_id", "full").where(used[0].at.isNull() | other.at.isNull()).head(1):
            raise ValueError("the files have different samples")
    if missing := [r.sample_id for r in samples.join(used[0], "sample_id", "left_anti").select("sample_id").limit(20).collect()]:
        raise ValueError(f"samples without genotypes: {missing}")
    known = [index.join(samples.select("sample_id"), "sample_id", "left_semi") for index in indexes]
    parts = [matrix_cells(r, variant_key().alias("variant_id")).join(k, "at").select("variant_id", "sample_id", "dosage", "missing") for r, k in zip(read, known, strict=True)]
    calls = parts[0]
    for other in parts[1:]:
        calls = calls.unionByName(other)
    if covariates:
        design = read_covariates(spark, covariates, max_levels)
        if missing := [r.sample_id for r in samples.join(design, "sample_id", "left_anti").select("sample_id").limit(20).collect()]:
            raise ValueError(f"samples without covariates: {missing}")
        samples = samples.join(design, "sample_id")
    variants = read[0].select(*MATRIX)
    for other in read[1:]:
        variants = variants.unionByName(other.select(*MATRIX))
    variants = attach_weights(variants, read_weights(spark, weights) if weights else None)
    if mask:
        variants = bed_mask(variants, read_bed(spark, mask))
    key = variant_key()
    return Cohort(samples, variants.withColumn("variant_id", key), calls)
