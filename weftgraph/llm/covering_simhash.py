"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has the majority bits of the XXH64 of a text's 3-word shingles. Fingerprints link at RADIUS or fewer
differing bits. Covering: each bit position gets a vector of RADIUS + 1 bits; for every non-zero vector v of that length
one table keeps the positions whose vector has an odd product with v. The vectors of at most RADIUS positions don't span
the space, so some v is orthogonal to all of them: every pair within the radius collides in that table, without
exception.

Within a bucket no pairs are formed. A fingerprint that shares a bucket with a different one emits itself and its
one-bit changes in the positions that the tables of such buckets leave out; two fingerprints within two bits that meet in
a table share one of these (for radius 2 the value half-way), and two that share one are within two bits. A value is
shared by at most 65 fingerprints, so these groups are small however large a bucket is, and the fingerprints of a group
are linked to its least.

Defined results: a null or empty text has fingerprint zero and links like any other; texts of one or two words have one
shingle, the whole sequence; repeated rows each get a row; a null doc_id counts as the largest, and is the component_id
only where no member has an id. Only doc_id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialise, ship
from .components import components

RADIUS = 2
SEED = 42
#: Shingles whose bits are summed at once.
BLOCK = 1 << 15


def covering_masks(radius: int = RADIUS) -> list[int]:
    """2 ** (radius + 1) - 1 masks of 64 bits. Position i has the vector i mod (2 ** (radius + 1) - 1) + 1, so that each
    vector stands at about as many positions."""
    top = 1 << (radius + 1)
    return [sum(1 << i for i in range(64) if ((i % (top - 1) + 1) & v).bit_count() % 2) for v in range(1, top)]


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text, unsigned."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII white space characters
    if not words:
        return 0
    if len(words) < 3:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(words, words[1:], words[2:])))
    digest, n = xxhash.xxh64_intdigest, len(shingles)
    h = np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for a in range(0, n, BLOCK):
        counts += _bit_counts(h[a : a + BLOCK])
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of h have each bit, least first."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprints(df: DataFrame, *also: str) -> DataFrame:
    """(doc_id, *also, fp): fp is the fingerprint as a signed long."""
    import pyarrow as pa

    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            texts, made = batch.column(1), np.zeros(batch.num_rows, dtype=np.uint64)
            for i in range(batch.num_rows):
                made[i] = fingerprint(texts[i].as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(made.view(np.int64))], names=["doc_id", *also, "fp"])

    df = df.select("doc_id", "text", *also)
    kept = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in ("doc_id", *also))
    return df.mapInArrow(run, f"{kept}fp bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(distinct: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (u, v) whose components are those of all links."""
    masks = [_signed(m) for m in covering_masks()]
    rows = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    # buckets with two fingerprints or more: their least and greatest differ
    shared = rows.groupBy("t", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b").select("t", "key")
    left_out: Column = F.element_at(F.array(*[F.lit(~m) for m in masks]), F.col("t") + 1)
    near = rows.join(shared, ["t", "key"]).select("fp", left_out.alias("free")).groupBy("fp").agg(F.bit_or("free").alias("free"))
    flips = F.filter(F.array(*[F.lit(_signed(1 << i)) for i in range(64)]), lambda b: F.col("free").bitwiseAND(b) != 0)
    around = near.select("fp", F.explode(F.concat(F.array(F.col("fp")), F.transform(flips, lambda b: F.col("fp").bitwiseXOR(b)))).alias("z"))
    # distinct fingerprints at most one bit from z: 65 at most
    groups = around.groupBy("z").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    edges = groups.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).filter("u <> v").distinct()
    return edges


def _classes(marked: DataFrame) -> DataFrame:
    """marked(doc_id, fp, ...) -> (_fp, c, component_id): of each fingerprint, its component and the least id there."""
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-fp")
    found = components(links(distinct.select("fp")), "simhash-cc")
    joined = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    least = joined.groupBy("c").agg(F.min("first").alias("component_id"))
    return joined.join(least, "c").select(F.col("fp").alias("_fp"), "c", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, kept (the first of its component)."""
    marked = materialise(fingerprints(docs), "simhash")
    out = marked.join(_classes(marked), F.col("fp") == F.col("_fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Exactly one row of docs per component, whatever the ids: that of least doc_id, nulls last, and of least row key.

    The row key is two 64-bit hashes of all columns, so texts travel once, and rows without an id are told apart.
    """
    keys, columns = ["row_a", "row_b"], [f"c{i}" for i in range(len(docs.columns))]
    keyed = docs.toDF(*columns).select("*", F.xxhash64(F.lit(1), *columns).alias(keys[0]), F.xxhash64(F.lit(2), *columns).alias(keys[1]))
    own = {c.lower(): f"c{i}" for i, c in enumerate(docs.columns)}
    marked = materialise(fingerprints(keyed.select(F.col(own["doc_id"]).alias("doc_id"), F.col(own["text"]).alias("text"), *keys), *keys), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *keys)).alias("x")
    chosen = marked.join(_classes(marked), F.col("fp") == F.col("_fp")).groupBy("c").agg(first).select(*[F.col(f"x.{k}").alias(k) for k in keys])
    return keyed.join(chosen, keys, "left_semi").dropDuplicates(keys).select(*columns).toDF(*docs.columns)
