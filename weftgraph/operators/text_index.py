"""Substring search by a kept trigram index of blocks.

A block is about a megabyte of texts. The index is three tables in a folder: `texts` by a hash of the id, with their blocks,
`postings` (gram, place, block) by a hash of the gram and sorted by gram, and `grams` with the number of blocks of each. A search
reads the numbers of its own trigrams, then the postings of its rarest ones (partitions by their hash, row groups by the gram),
intersects these, and checks the texts of the blocks that are left, of whose table only their partitions are read. A block has
each trigram once, so that postings don't grow with the length of texts. Those of a frequent gram are spread over several files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialise, shared_base

GRAM = 3
#: Trigrams of a search whose postings are intersected.
RAREST = 3
#: Files that the postings of a bucket are spread over.
SPREAD = 4
#: Characters of the texts in a block, and in a partition of texts.
BLOCK = 1_000_000
AT_ONE = 64_000_000


def hashed(value: Column, buckets: int) -> Column:
    return (F.crc32(value.cast("string").cast("binary")) % buckets).cast("int")


def trigrams(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the different trigrams of a text in lower case, in time of its length."""
    at = lambda i: F.get("_c", i)
    chars = df.withColumn("_c", F.filter(F.split(F.lower(text), ""), lambda x: x != ""))
    last = F.size("_c") - GRAM
    grams = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat(at(i), at(i + 1), at(i + 2)))
    return chars.withColumn(name, F.when(last >= 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))).drop("_c")


def _blocks(size: int):
    """(id, text, place) with the numbers of blocks, which texts fill in the order of a task."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = 0
        for batch in batches:
            lengths = pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
            begins = begun + np.cumsum(lengths) - lengths
            begun += int(lengths.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(begins // size)], names=[*batch.schema.names, "block"])

    return numbered


def _grams_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, place, block) -> (gram, place, block): the different trigrams of each block, as far as a task sees it. A task reads
    blocks one after the other, so that it holds the trigrams of one."""
    at, seen = None, set()

    def told() -> pa.RecordBatch:
        n = len(seen)
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([at[0]] * n, pa.int32()), pa.array([at[1]] * n, pa.int64())], names=["gram", "place", "block"])

    for batch in batches:
        for text, *own in zip(*(batch.column(c).to_pylist() for c in ("text", "place", "block"))):
            if own != at:
                if seen:
                    yield told()
                at, seen = own, set()
            seen.update(map("".join, zip(text, text[1:], text[2:])))
    if seen:
        yield told()


@dataclass(frozen=True)
class Index:
    texts: DataFrame
    postings: DataFrame
    grams: DataFrame
    buckets: int


def read(spark, folder: str, id_type: str, buckets: int) -> Index:
    """The index that build() has written to a folder."""
    kinds = {"texts": f"id {id_type}, text string, block long, place int", "postings": "gram string, place int, block long, bucket int", "grams": "gram string, n long, bucket int"}
    return Index(*(spark.read.schema(kind).parquet(f"{folder}/{table}") for table, kind in kinds.items()), buckets)


def build(texts: DataFrame, folder: str | None = None, buckets: int | None = None) -> Index:
    """Writes the index of texts(id, text). Null ids and texts aren't in it; an id may have several texts. The number of
    buckets follows the length of the texts."""
    spark = texts.sparkSession
    folder = folder or f"{shared_base(spark)}/weft-index-{uuid.uuid4().hex[:12]}"
    rows = materialise(texts.select("id", "text").filter("id IS NOT NULL AND text IS NOT NULL"))
    kind = rows.schema["id"].dataType.simpleString()
    n = buckets or min(4096, max(16, (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // AT_ONE))
    placed = rows.withColumn("place", hashed(F.col("id"), n)).repartition(n, "place")
    numbered = placed.mapInArrow(_blocks(BLOCK), f"id {kind}, text string, place int, block long")
    numbered.sortWithinPartitions("place", "block").write.partitionBy("place").parquet(f"{folder}/texts")
    kept = spark.read.schema(f"id {kind}, text string, block long, place int").parquet(f"{folder}/texts")
    # a file that two tasks read tells the trigrams of the block between them twice
    pairs = kept.select(F.lower("text").alias("text"), "place", "block").mapInArrow(_grams_of_blocks, "gram string, place int, block long").distinct()
    spread = pairs.withColumn("bucket", hashed(F.col("gram"), n)).repartition(n * SPREAD, "bucket", F.pmod("block", F.lit(SPREAD)))
    spread.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{folder}/postings")
    postings = spark.read.schema("gram string, place int, block long, bucket int").parquet(f"{folder}/postings")
    postings.groupBy("bucket", "gram").agg(F.count("*").alias("n")).repartition(n, "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{folder}/grams")
    return read(spark, folder, kind, n)


def _at(table: DataFrame, grams: list[str], buckets: int) -> DataFrame:
    """The rows of some grams: partitions by literals, which a scan prunes."""
    return table.filter(F.col("bucket").isin(*sorted({crc32(g.encode()) % buckets for g in grams})) & F.col("gram").isin(*grams))


def candidates(index: Index, query: str) -> DataFrame | None:
    """(place, block) of the blocks with the query's rarest trigrams; None if the query is too short for one."""
    grams = sorted({query[i : i + GRAM] for i in range(len(query) - GRAM + 1)})
    if not grams:
        return None
    known = {r["gram"]: r["n"] for r in _at(index.grams, grams, index.buckets).collect()}  # no more than the query's trigrams
    some = sorted(grams, key=lambda g: (known.get(g, 0), g))[:RAREST]
    rows = _at(index.postings, some, index.buckets)
    return rows.groupBy("place", "block").agg(F.count_distinct("gram").alias("k")).filter(F.col("k") == len(some)).select("place", "block")


def containing(index: Index, query: str) -> DataFrame:
    """(id, text) of the texts that hold the query, in lower case. One of less than three characters is looked for in all."""
    query = query.lower()
    found = candidates(index, query)
    texts = index.texts if found is None else index.texts.join(found, ["place", "block"], "left_semi")
    return texts.filter(F.contains(F.lower("text"), F.lit(query))).select("id", "text")
