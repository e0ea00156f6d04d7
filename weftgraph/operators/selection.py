"""Exact order statistics by histogram refinement: no group's values meet in one task.

Each round counts a group's values in BUCKETS intervals between its least and greatest, with the least and greatest of each, as
partial sums; a group's rank lies in one of them, whose values alone go into the next round. A round divides the range by
BUCKETS, and ends for a group when the values left are equal: eight rounds at most for any doubles, two or three for most. So a round's state is a row per group and interval, and
what is read again shrinks with it. Infinite values and NaN (which is greatest, as in ordering) have intervals of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .tables import materialise

BUCKETS = 1024
#: A range over more binades than this is cut by magnitude.
BINADES = 8


def _by_magnitude(v: Column) -> Column:
    """The binade of v with its sign, as a number that grows with v."""
    size = F.log2(F.abs(v)) + 1075
    return F.when(v > 0, size).when(v < 0, -size).otherwise(0.0)


def _interval(v: Column, low: Column, high: Column) -> Column:
    """The interval of v: 0 for -inf, 1 to BUCKETS, and two more. A range over more than a few binades is cut by magnitude, so
    that very unequal values part as fast as equal ones; a few rounds reach any double. Halves keep the difference from
    overflowing; each step is monotone in v, so that intervals are in order."""
    a, b = _by_magnitude(low), _by_magnitude(high)
    share = F.when(b - a > BINADES, (_by_magnitude(v) - a) / (b - a)).otherwise((v / 2 - low / 2) / (high / 2 - low / 2))
    inside = F.when(high > low, F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))).otherwise(F.lit(0))
    return F.when(F.isnan(v), BUCKETS + 2).when(v == float("inf"), BUCKETS + 1).when(v == float("-inf"), 0).otherwise(inside + 1).cast("int")


def _finite(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def histogram(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, interval, n, low, high) of rows(keys, v) in the ranges of state(keys, low, high)."""
    j = rows.join(state.select(*keys, "low", "high"), keys)
    return j.withColumn("interval", _interval(F.col("v"), F.col("low"), F.col("high"))).groupBy(*keys, "interval").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


def neighbours(values: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(keys, n, part, lower, upper): the values at the ranks around share * (n - 1), and how far it is on the way from the one
    to the other. Null values don't count; groups without values are left out; null keys are keys."""
    if not 0 <= share <= 1:
        raise ValueError("a share between 0 and 1")
    names = [f"k{i}" for i in range(len(keys))]
    v = F.col(value).cast("double")
    # a null key joins nothing: its place is taken by a flag beside it
    flat = [c for i, k in enumerate(keys) for c in (F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"k{i}"), F.col(k).isNull().alias(f"z{i}"))]
    on = [c for i in range(len(keys)) for c in (f"k{i}", f"z{i}")]
    rows = values.filter(v.isNotNull()).select(*flat, (v + 0.0).alias("v"))
    kinds = [values.schema[k].dataType for k in keys]
    first = rows.groupBy(*on).agg(F.count("*").alias("n"), F.min(_finite(F.col("v"))).alias("low"), F.max(_finite(F.col("v"))).alias("high"))
    at = F.lit(share) * (F.col("n") - 1)
    state = materialise(first.select(*on, "n", F.floor(at).alias("rank"), (at - F.floor(at)).alias("part"), F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(0.0)).alias("high"), F.lit(None).cast("double").alias("next")))
    done = None
    while not state.isEmpty():
        w = W.partitionBy(*on).orderBy("interval")
        h = histogram(rows, state, on).withColumnsRenamed({"n": "m", "low": "a", "high": "b"})
        h = h.withColumn("upto", F.sum("m").over(w)).withColumn("after", F.lead("a").over(w)).join(state, on)
        hit = h.filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("m")))
        hit = hit.withColumn("rank", F.col("rank") - (F.col("upto") - F.col("m"))).withColumn("next", F.coalesce("after", "next"))
        now = materialise(hit.select(*on, "n", "rank", "part", "next", "m", "interval", "a", "b", F.col("low").alias("low0"), F.col("high").alias("high0")))
        settled = now.filter("a = b").select(*on, "n", "part", F.col("a").alias("lower"), F.when(F.col("rank") + 1 < F.col("m"), F.col("a")).otherwise(F.coalesce("next", "a")).alias("upper"))
        done = settled if done is None else done.union(settled)
        going = now.filter("NOT a = b")
        kept = rows.join(going.select(*on, F.col("interval").alias("_i"), "low0", "high0"), on).filter(_interval(F.col("v"), F.col("low0"), F.col("high0")) == F.col("_i"))
        state = going.select(*on, "n", "rank", "part", F.col("a").alias("low"), F.col("b").alias("high"), "next")
        if not state.isEmpty():
            rows, state = materialise(kept.select(*on, "v")), materialise(state)
    if done is None:
        done = state.select(*on, "n", "part", F.col("low").alias("lower"), F.col("high").alias("upper"))
    own = [F.when(~F.col(f"z{i}"), F.col(f"k{i}")).cast(t).alias(k) for i, (k, t) in enumerate(zip(keys, kinds))]
    return done.select(*own, "n", "part", "lower", "upper") if names else done


def quantile(values: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """(keys, name): the quantile between the values around its rank; the median for a share of a half."""
    x = neighbours(values, keys, value, share)
    between = F.when(F.col("part") == 0, F.col("lower")).otherwise((1 - F.col("part")) * F.col("lower") + F.col("part") * F.col("upper"))
    return x.select(*keys, between.alias(name))


def quantiles(values: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a column for each named share)."""
    found = None
    for name, share in shares.items():
        q = quantile(values, keys, value, share, name)
        found = q if found is None else found.join(q, keys)
    return found
