"""Shared plumbing of the training-data operators: tables, shared storage, byte-level words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Lower-cases A-Z and turns every ASCII byte that is not a letter or digit into a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below the folder that driver and executors share (spark.checkpoint.dir); only a local master gets one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="cohortspark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/cohortspark-{uuid.uuid4().hex}"


def save(df: DataFrame) -> DataFrame:
    """Cut lineage: write df once to shared storage and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame) -> DataFrame:
    """(row, file, at): each of rows as a struct, with where it is stored: a digest of its file's name, and its number there.

    Places are the same in every job, however files are cut into tasks.  What isn't a plain scan of files is saved first.
    All columns stand in the struct, so that none can clash with a helper's name.
    """
    try:
        rows.select(rows.metadataColumn("_metadata")["row_index"]).schema  # noqa: B018
    except AnalysisException:
        rows = save(rows)
    known = rows.metadataColumn("_metadata")
    return rows.select(F.struct(*(rows[f"`{c}`"] for c in rows.columns)).alias("row"), F.xxhash64(known["file_path"]).alias("file"), known["row_index"].alias("at"))


HOT_ROWS = 256  # rows that a key may have at least before they are dealt to several tasks


def spread_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """many joined with one on a column of both; the rows of a key with a great share of many's rows go to several tasks.

    many is read three times: it should be saved.  Such keys are at most twice as many as shuffle partitions, whatever the
    size of many; they go through the driver.
    """
    spark = many.sparkSession
    rows = many.count()
    most = max(HOT_ROWS, rows // (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if rows <= most:
        return many.join(one, key, how)
    sizes = many.groupBy(F.col(key).alias("hot_")).agg(F.count("*").alias("size_")).where(F.col("size_") > most)
    hot = [(r.hot_, -(-r.size_ // most)) for r in sizes.where("hot_ is not null").collect()]
    if not hot:
        return many.join(one, key, how)
    listed = F.broadcast(spark.createDataFrame(hot, StructType([StructField("hot_", many.schema[key].dataType), StructField("lots_", IntegerType())])))
    lots = F.coalesce("lots_", F.lit(1))
    dealt = many.join(listed, F.col(key) == F.col("hot_"), "left").select(*many.columns, F.pmod(F.xxhash64(*many.columns), lots).cast("int").alias("lot_"))
    copied = one.join(listed, F.col(key) == F.col("hot_"), "left").select(*one.columns, F.explode(F.sequence(F.lit(0), lots - 1)).alias("lot_"))
    return dealt.join(copied, [key, "lot_"], how).drop("lot_")


BROADCAST_ROWS = 1_000_000


def few(rows: DataFrame) -> DataFrame:
    """rows, marked for a broadcast if they are fewer than BROADCAST_ROWS."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS).count() < BROADCAST_ROWS else rows


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; -1 for a null id (never a held-out fold)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)), F.lit(-1))


def give_back() -> None:
    """Memory that a fit on the driver or a task has freed goes back to the machine: their processes stay for what comes next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


SLICE_ROWS = 1_000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of SLICE_ROWS rows, which bound what a task's Python objects take; memory goes back at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
    give_back()  # the worker stays for stages that need none of it


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty, without decoding."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def alnum_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z."""
    return text.translate(WORD_BYTES).split()


def space_words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z (bytes.lower and bytes.split are ASCII-only)."""
    return text.lower().split()
