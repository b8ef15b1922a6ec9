"""Content-addressed WARC archive.

Two tables make the archive.  `payloads` holds the bytes of each distinct payload once, under its SHA-256; `headers`
holds the exact header bytes of each record and the digest of its payload.  Records are rebuilt by joining the two;
the reader recomputes both digests from the bytes it got, and fails on a mismatch.

Of records with equal payloads of at least `least` bytes the one with the largest page_id is a response, the others
are revisits that refer to it; shorter payloads are all responses.  Ties: of rows that repeat the largest page_id the
smallest url is the response (of equal rows any one, as nothing tells them apart), the rest are revisits of that id.  A null
html is an empty payload; a null page_id sorts below all others, a null url gives an empty target.  Record ids are unique:
the page_id, and the row's number where page_ids repeat.  Payload bytes cross the network once, when headers meet
payloads; the records of a payload that many share are dealt to several tasks, which get its bytes once each.  Deciding
what is a revisit moves digests only.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import few, placed, save, spread_join

DATE = "1970-01-01T00:00:00Z"  # of records whose pages bring no date of their own

# The alphabets of conv() in base 32 and of RFC 4648 base32.
CONV_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE_32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: twenty bits, five hexadecimal digits, are four letters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), CONV_32, BASE_32)


def records(pages: DataFrame) -> DataFrame:
    """Per page its payload and digests, and where it is stored."""
    payload = F.coalesce(F.col("row.html"), F.lit("")).cast("binary")
    return placed(pages).select("file", "at", F.col("row.page_id").alias("page_id"), F.coalesce("row.url", F.lit("")).alias("url"), payload.alias("payload")).select(
        "file",
        "at",
        "page_id",
        "url",
        "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
    )


def record_id(page_id: str, copy: str) -> Column:
    """A urn of the page_id; rows that repeat one have a number behind it."""
    number = F.when(F.col(copy) > 0, F.concat(F.lit(":"), F.col(copy).cast("string"))).otherwise(F.lit(""))
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), number, F.lit(">"))


def header_text(kind: str, date: str = DATE) -> Column:
    """The exact header of a record, up to and including the blank line."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        F.concat(F.lit("WARC-Record-ID: "), record_id("page_id", "copy")),
        f"WARC-Date: {date}",
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
    ]
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(F.concat(F.lit("WARC-Refers-To: "), record_id("refers_to", "refers_copy")))
        lines.append("Content-Length: 0")
    else:
        lines.append("Content-Type: text/html")
        lines.append(F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string")))
    return F.concat(*(F.concat(x if isinstance(x, Column) else F.lit(x), F.lit("\r\n")) for x in lines), F.lit("\r\n"))


def write_archive(pages: DataFrame, path: str, least: int = 0, date: str = DATE) -> None:
    """Write path/headers and path/payloads."""
    facts = records(pages)
    # From here on digests and ids only.
    digests = save(facts.select("file", "at", "page_id", "url", "payload_sha256", "payload_bytes", "payload_digest", F.monotonically_increasing_id().alias("row")))
    again = few(digests.groupBy("page_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("page_id").alias("twice"), F.lit(True).alias("repeated")))
    told = save(digests.join(again, F.col("page_id").eqNullSafe(F.col("twice")), "left").withColumn("copy", F.when(F.col("repeated"), F.col("row") + 1).otherwise(0)).drop("twice", "repeated"))
    # The largest page_id first, then the smallest url; ~x falls as x grows, without overflow.
    rank = F.struct(F.bitwise_not(F.coalesce(F.col("page_id").cast("long"), F.lit(-(2**63)))).alias("id"), "url", "row")
    chosen = told.groupBy("payload_sha256").agg(F.min_by(F.struct("row", "page_id", "copy", "file", "at"), rank).alias("top"))
    chosen = save(chosen.select("payload_sha256", "top.*").toDF("payload_sha256", "top_row", "refers_to", "refers_copy", "file", "at"))
    revisit = (F.col("payload_bytes") >= least) & (F.col("row") != F.col("top_row"))
    headers = spread_join(told, chosen.drop("file", "at"), "payload_sha256").select(
        "page_id", F.when(revisit, header_text("revisit", date)).otherwise(header_text("response", date)).cast("binary").alias("header"), "payload_sha256"
    )
    headers.write.parquet(f"{path}/headers")
    kept = facts.select("file", "at", "payload_sha256", "payload").join(chosen.select("file", "at"), ["file", "at"], "left_semi")
    kept.select("payload_sha256", "payload").write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record with its header and payload bytes as written; digests are verified on the way."""
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    verified = payloads.select(
        "payload_sha256", "payload", F.when(F.sha2("payload", 256) != F.col("payload_sha256"), F.raise_error(F.lit("a payload fails its digest"))).alias("fault")
    ).where("fault is null")
    return spread_join(headers, verified.drop("fault"), "payload_sha256", "left").select("page_id", "header", "payload", "payload_sha256")


def record_bytes(archive: DataFrame) -> DataFrame:
    """(page_id, record): each record as it stands in a WARC file: header, payload (none in a revisit) and two line ends."""
    body = F.when(field("WARC-Type") == "revisit", F.lit(bytearray())).otherwise(F.col("payload"))
    return archive.select("page_id", F.concat("header", body, F.lit(bytearray(b"\r\n\r\n"))).alias("record"))


def field(name: str) -> Column:
    """A header field of a record that was read back (null if it isn't there)."""
    found = F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r]*)", 1)
    return F.when(found != "", found)


def parse_records(archive: DataFrame) -> DataFrame:
    """Per record, from its own bytes: lengths, digest, type and reference; url as far as the header has it."""
    digest = base32_sha1(F.col("payload"))
    bad = F.coalesce(field("WARC-Payload-Digest") != F.concat(F.lit("sha1:"), digest), F.lit(True))
    return archive.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(bad, F.raise_error(F.lit("a record fails its digest"))).otherwise(digest).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        F.regexp_extract(F.coalesce(field("WARC-Refers-To"), F.lit("")), r"<urn:page:(-?\d+)(?::\d+)?>", 1).alias("refers"),
        field("WARC-Target-URI").alias("url"),
    ).select("page_id", "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(refers as bigint)").alias("refers_to"), "url")


def round_trip(pages: DataFrame, path: str, least: int = 0) -> DataFrame:
    write_archive(pages, path, least)
    return parse_records(read_archive(pages.sparkSession, path))
