"""Labelled rows that a model may learn from, and hash remainders of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def is_held_out(doc_id: Column, by: int, held: int) -> Column:
    return F.coalesce(remainder(doc_id, by) == held, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, by: int, held: int, most: int) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled ids outside the held-out remainder: those of least hash, so that it is
    the same sample on each run. Of an id's labels the largest counts, of its rows the one with the least text; null ids
    and null labels teach nothing. `most` bounds what the driver and the broadcast hold."""
    ids = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), by) != held))
    ids = ids.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = F.broadcast(ids.select(F.col("doc_id").alias("_id"), "y"))
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id"))
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
