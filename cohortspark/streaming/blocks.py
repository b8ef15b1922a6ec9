"""State between blocks of permutations, and a stream of shard results.

`merge_stream` follows a folder into which shards write their counts, and keeps running totals: the incremental form of
combining finished shards.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD = "gene string, transcript string, successes long, mid_successes double, permutations long"


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path below spark.checkpoint.dir, which driver and executors share; only a local master gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="cohortspark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{kind}-{uuid.uuid4().hex}"


def persist(df: DataFrame) -> DataFrame:
    """Write df to the folder that driver and executors share, and read it back: a block's state survives executors."""
    path = shared_path(df.sparkSession, "blocks")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merge_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming frame of totals over the shard files of a folder (complete or update mode)."""
    shards = spark.readStream.schema(SHARD).parquet(folder)
    return shards.groupBy("gene", "transcript").agg(*(F.sum(c).alias(c) for c in ("successes", "mid_successes", "permutations")))
