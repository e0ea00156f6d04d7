"""Mixing sources to target weights by hash-threshold histograms.

Each source takes floor(target / size) whole passes of its documents and, for the rest, the documents whose hash lies
below a threshold. The threshold is found on histograms: token sums by source and hash bucket locate the bucket in which
the budget ends, and only the documents of that boundary bucket are summed again by the next digits of the hash, until it
holds one hash. No rows are sorted; a histogram has at most 2 ** DIGIT buckets a source, whatever the input.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, ordered last;
documents with equal doc_id (null ones too) and equal text share a hash and are taken together, so that a source comes
within one such group of its target; a source without words has target 0; an empty table gives an empty result. A very long
text is counted and hashed as a whole. Of the input only doc_id, text and source are read; other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._shared import WORD_CLASS, materialise

#: Weights by position of the source in code point order, the share of all words to take, the most passes of a document.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Hash digits: 60 bits, refined 12 at a time.
BITS, DIGIT = 60, 12
#: Sources whose thresholds are broadcast at most.
MOST_SENT = 10_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of the id as text and the text's MD5; nulls hash as the empty text."""
    both = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) -> with target. Filling by weight up to the cap of MOST times the size has a closed form: in
    order of cap / weight, the sources up to some place are full and the rest share what is left by weight. The windows
    range over one row per source, which is what they are for; documents are never in them."""
    n = len(WEIGHTS)
    placed = sources.withColumn("_k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("_k") % n + 1)
    placed = placed.withColumn("_w", weight.cast("long")).withColumn("_cap", F.col("source_size") * MOST)
    by_fill = W.orderBy((F.col("_cap").cast("double") / F.col("_w")).asc(), "_k")
    before, whole = by_fill.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = (
        placed.withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_free_w", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .withColumn("_left", F.lit(SHARE) * F.sum("source_size").over(whole) - F.col("_full"))
        .withColumn("_stays", F.col("_left") * F.col("_w") < F.col("_cap").cast("double") * F.col("_free_w"))
    )
    # the first source that isn't filled settles the level for all from there on
    level = F.min(F.when(F.col("_stays"), F.struct("_fill_at", "_left", "_free_w"))).over(whole)
    filled = filled.withColumn("_fill_at", F.row_number().over(by_fill)).withColumn("_level", level)
    target = F.when(F.col("_level").isNull() | (F.col("_fill_at") < F.col("_level._fill_at")), F.col("_cap").cast("double")).otherwise(F.col("_w") * F.col("_level._left") / F.col("_level._free_w"))
    return filled.select("source", "source_size", target.alias("target"))


def _boundary(histogram: DataFrame) -> DataFrame:
    """(source, prefix, rest, bucket, n) -> per source the bucket in which the cumulated sum reaches the rest of the budget."""
    upto = F.sum("n").over(W.partitionBy("source", "prefix", "rest").orderBy("bucket"))
    return histogram.withColumn("_upto", upto).filter((F.col("_upto") > F.col("rest")) & (F.col("_upto") - F.col("n") <= F.col("rest"))).select("source", F.col("bucket").alias("prefix"), (F.col("rest") - (F.col("_upto") - F.col("n"))).alias("rest"), F.col("n").alias("within"))


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with size and hash, sources with their thresholds)."""
    sized = materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("h")), "mix")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = materialise(sources.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix-sources")
    at = sources.select("source", F.lit(0).cast("long").alias("prefix"), "rest", F.lit(None).cast("long").alias("within"))
    for done in range(0, BITS, DIGIT):
        left = BITS - done
        bucket = F.shiftrightunsigned(F.col("h"), left - DIGIT)
        place = F.col("h") if done == 0 else F.shiftrightunsigned(F.col("h"), left)
        inner = sized.select("source", "size", bucket.alias("bucket"), (F.lit(0).cast("long") if done == 0 else place).alias("_p"))
        inner = inner.groupBy("source", "_p", "bucket").agg(F.sum("size").alias("n"))
        found = _boundary(at.drop("within").withColumnRenamed("source", "_s").join(inner, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_p") == F.col("prefix"))).drop("_s"))
        at = materialise(found, "mix-bound")
        if at.isEmpty():
            break
    # `prefix` is now the one hash at which the budget ends: it is taken if that comes nearer to the target
    limit = at.select(F.col("source").alias("_s"), (F.col("prefix") + F.when(F.col("rest") * 2 > F.col("within"), 1).otherwise(0)).alias("_limit"))
    sources = sources.join(limit, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return sized, materialise(sources.withColumn("limit", F.coalesce("_limit", F.lit(0).cast("long"))).drop("_limit"), "mix-limits")


def _few(sources: DataFrame) -> DataFrame:
    """The materialised row per source, broadcast if there are at most MOST_SENT; else Spark chooses how to join them."""
    return F.broadcast(sources) if sources.count() <= MOST_SENT else sources


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, passes (how often the mix takes it)."""
    sized, sources = plan(docs)
    joined = sized.join(_few(sources.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")))
    passes = F.col("passes") + F.when((F.col("passes") < MOST) & (F.col("h") < F.col("limit")), 1).otherwise(0)
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * passes).cast("long").alias("taken"), passes.cast("long").alias("passes"))


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs. A document without words is
    taken as its source's passes and its hash say, as any other."""
    thresholds = plan(docs)[1].select(F.col("source").alias("s"), "passes", "limit")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # columns of docs may have any names
    place = {c.lower(): plain[f"c{i}"] for i, c in enumerate(docs.columns)}
    passes = F.col("passes") + F.when((F.col("passes") < MOST) & (hash_of(place["doc_id"], place["text"]) < F.col("limit")), 1).otherwise(0)
    joined = plain.join(_few(thresholds), place["source"].cast("string").eqNullSafe(F.col("s")))
    return joined.withColumn("i", F.explode(F.array_repeat(F.lit(0), passes.cast("int")))).select(*plain.columns).toDF(*docs.columns)


ORACLE = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, {BITS // 4}) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INT)] AS w FROM s),
f AS (SELECT *, row_number() OVER o AS pos, {SHARE} * sum(source_size) OVER () - coalesce(sum({MOST} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
             sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free_w
      FROM p WINDOW o AS (ORDER BY {MOST} * source_size / CAST(w AS DOUBLE), source NULLS LAST)),
l AS (SELECT pos, lft, free_w FROM f WHERE lft * w < CAST({MOST} * source_size AS DOUBLE) * free_w ORDER BY pos LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN l.pos IS NULL OR f.pos < l.pos THEN CAST({MOST} * source_size AS DOUBLE)
                                       ELSE CAST(w AS DOUBLE) * CAST(l.lft AS DOUBLE) / CAST(l.free_w AS DOUBLE) END AS target FROM f LEFT JOIN l ON TRUE),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
u AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS rest,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h) AS BIGINT) AS upto, CAST(sum(size) OVER (PARTITION BY d.source, h) AS BIGINT) AS here
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
v AS (SELECT *, whole + CASE WHEN whole < {MOST} AND (upto <= rest OR (upto - here <= rest AND (rest - (upto - here)) * 2 > here)) THEN 1 ELSE 0 END AS passes FROM u)
SELECT doc_id, size, source_size, target, CAST(size * passes AS BIGINT) AS taken, CAST(passes AS BIGINT) AS passes FROM v
"""
