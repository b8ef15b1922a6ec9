"""Bounded labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import crc_mod, save


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows: int) -> DataFrame:
    """(text, label) of at most `rows` labelled documents outside the held-out fold, the same for any partitioning.

    Ids are taken in the order of a hash; of an id's repeated labels the largest counts, of its repeated texts the
    smallest.  Only the chosen ids (a bounded number) are broadcast, so that documents are read once and not moved.
    """
    ids = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("double").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & (crc_mod(F.col("id"), modulus) != held))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    source = docs.select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    found = source.join(F.broadcast(ids), source.doc == ids.id)
    return save(found.groupBy("doc").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label"))
