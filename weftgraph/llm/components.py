"""Connected components of an edge table by alternating large-star and small-star steps.

Each step replaces edges by edges to smaller ids and is one aggregation and one join; the steps end when a round changes
nothing, after about log(n) rounds. Every round is written to the shared folder, which cuts the lineage and survives lost
executors. Minima are aggregated before the shuffle, so a node with very many edges costs one row per task.

Defined results: self-loops, repeated edges and edges with a null end are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every greater neighbour is linked to the node's minimum. Small: every smaller one and the node itself are."""
    if large:
        sides = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = sides.join(least, "u")
    if large:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """edges(u, v) -> (node, component): the smallest id reachable, for every node with an edge to another."""
    now = materialise(edges.select("u", "v").filter("u <> v").distinct(), tag)
    sign = None
    while True:
        now = materialise(_star(_star(now, True), False), tag)
        # count and sums of the edge hashes tell whether the round changed anything
        h = F.xxhash64("u", "v")
        after = now.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 24))).first()
        if after == sign:
            break
        sign = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
