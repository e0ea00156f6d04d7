"""Forests by Euler tour: entry and exit numbers of all nodes in about log(depth) rounds, so that descendants are an interval.

An edge runs from a child to its parent. A child's two arcs, down to it and up from it, form with those of its siblings and
children one list per tree; ranks in the list come from pointer jumping, in which every arc doubles how far it sees. Each
round is one join on the arcs' keys, written out; n nodes give 2 n rows in each, whatever the depth or a node's children.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .tables import materialise


def _moved(df: DataFrame) -> DataFrame:
    """df, which has about a row per node, for a join that moves both sides by their keys and brings neither to the driver: files
    of ids are small where ids are alike, so that they would be broadcast in each round."""
    return df.hint("merge")


def _jumped(arcs: DataFrame) -> DataFrame:
    """arcs(arc, next, weight) -> (arc, ahead): the sum of weights from an arc to the end of its list, itself included.

    An arc whose next is null is a list's end. After round i an arc holds the sum of 2^i arcs and points beyond them. Ended ones
    are no longer joined."""
    now = materialise(arcs.select("arc", "next", F.col("weight").alias("ahead")))
    while not now.filter("next IS NOT NULL").isEmpty():
        far = now.select(F.col("arc").alias("next"), F.col("next").alias("beyond"), F.col("ahead").alias("more"))
        going = now.filter("next IS NOT NULL").join(_moved(far), "next").select("arc", F.col("beyond").alias("next"), (F.col("ahead") + F.col("more")).alias("ahead"))
        now = materialise(now.filter("next IS NULL").select("arc", "next", "ahead").union(going))
    return now.select("arc", "ahead")


def _next_sibling(children: DataFrame) -> DataFrame:
    """children(node_id, parent) with `after`, the next child of a parent by id, null for the last. Children are ranked by ranges
    of ids: within a range of ids by a window, and from range to range by the ranges' first ones, so that no window holds all
    children of a node that has many."""
    part = F.pmod(F.shiftright(F.xxhash64("node_id"), 40), F.lit(1024))
    c = children.withColumn("_r", part)
    within = c.withColumn("after", F.lead("node_id").over(W.partitionBy("parent", "_r").orderBy("node_id")))
    first = c.groupBy("parent", "_r").agg(F.min("node_id").alias("first"))
    beyond = first.withColumn("then", F.lead("first").over(W.partitionBy("parent").orderBy("_r"))).select("parent", "_r", "then")  # at most 1024 rows a parent
    return within.join(_moved(beyond), ["parent", "_r"]).select("node_id", "parent", F.coalesce("after", "then").alias("after"))


def tour(parents: DataFrame) -> DataFrame:
    """parents(node_id, parent): a row per node, parent null for roots -> (node_id, root, depth, entry, exit, size).

    entry and exit number the nodes of a tree from 0 in the order in which a walk enters them; exit is the greatest entry below
    a node, and size = exit - entry + 1 counts it and its descendants: x is below y iff they have one root and
    y.entry <= x.entry <= y.exit. Children follow in a fixed order of hashed ranges and ids. A parent that isn't a node is a
    ValueError, as are two parents of a node and a cycle."""
    p = materialise(parents.select("node_id", "parent").filter("node_id IS NOT NULL").distinct())
    if not p.groupBy("node_id").count().filter("count > 1").isEmpty():
        raise ValueError("a node has more than one parent")
    children = p.filter("parent IS NOT NULL")
    if not children.join(_moved(p.select(F.col("node_id").alias("parent"))), "parent", "left_anti").isEmpty():
        raise ValueError("a parent isn't a node")
    roots = roots_of(p)
    sibling = materialise(_next_sibling(children))
    leads = sibling.join(_moved(sibling.select(F.col("after").alias("node_id")).distinct().withColumn("_later", F.lit(True))), "node_id", "left")
    first = leads.filter("_later IS NULL").select(F.col("parent").alias("node_id"), F.col("node_id").alias("first"))
    down, up = (lambda c: F.struct(F.col(c).alias("id"), F.lit(0).alias("way"))), (lambda c: F.struct(F.col(c).alias("id"), F.lit(1).alias("way")))
    # down to a node: on to its first child, else back up from it; up from it: on to the next sibling, else up from the parent
    entering = children.join(_moved(first), "node_id", "left").select(down("node_id").alias("arc"), F.when(F.col("first").isNotNull(), down("first")).otherwise(up("node_id")).alias("next"), F.lit(1).alias("weight"), F.lit(1).alias("step"))
    top = p.filter("parent IS NULL").select(F.col("node_id").alias("parent"), F.lit(True).alias("_top"))
    leaving = sibling.join(top, "parent", "left").select(
        up("node_id").alias("arc"), F.when(F.col("after").isNotNull(), down("after")).when(F.col("_top").isNull(), up("parent")).alias("next"), F.lit(0).alias("weight"), F.lit(-1).alias("step")
    )
    arcs = materialise(entering.union(leaving))
    ahead = _jumped(arcs.select("arc", "next", F.struct(F.col("weight").cast("long").alias("n"), F.col("step").cast("long").alias("d")).alias("w")).select("arc", "next", F.col("w.n").alias("weight")))
    climb = _jumped(arcs.select("arc", "next", F.col("step").cast("long").alias("weight")))
    seen = ahead.withColumnRenamed("ahead", "n").join(_moved(climb.withColumnRenamed("ahead", "d")), "arc")
    into = seen.filter("arc.way = 0").select(F.col("arc.id").alias("node_id"), F.col("n").alias("n_in"), F.col("d").alias("d_in"))
    out = seen.filter("arc.way = 1").select(F.col("arc.id").alias("node_id"), F.col("n").alias("n_out"))
    size = roots.groupBy("root").agg(F.count("*").alias("total"))
    j = roots.join(size, "root").join(_moved(into), "node_id", "left").join(_moved(out), "node_id", "left")
    # of the nodes entered from here on, `n` are counted: the first of a tree of t nodes has t - 1 of them, without the root
    entry = F.coalesce(F.col("total") - F.col("n_in"), F.lit(0))
    last = F.coalesce(F.col("total") - F.col("n_out") - 1, F.col("total") - 1)
    depth = F.coalesce(1 - F.col("d_in"), F.lit(0))
    return j.select("node_id", "root", depth.alias("depth"), entry.alias("entry"), last.alias("exit"), (last - entry + 1).alias("size"))


def roots_of(parents: DataFrame) -> DataFrame:
    """(node_id, root) by pointer jumping: in each round a node points to what its pointer pointed to. A node that points to
    itself after as many rounds as the number of nodes has bits is on a cycle or leads to one, which is a ValueError."""
    now = materialise(parents.select("node_id", F.coalesce("parent", "node_id").alias("root")))
    top = parents.filter("parent IS NULL").select(F.col("node_id").alias("root"))
    n, reach = now.count(), 1
    while True:
        going = now.join(top, "root", "left_anti")
        if going.isEmpty():
            return now
        if reach > n:
            raise ValueError("the parents have a cycle")
        done = now.join(top, "root", "left_semi").select("node_id", "root")
        far = now.select(F.col("node_id").alias("root"), F.col("root").alias("far"))
        now = materialise(done.union(going.join(_moved(far), "root").select("node_id", F.col("far").alias("root"))))
        reach *= 2


def descendants(toured: DataFrame, some: DataFrame) -> DataFrame:
    """(node_id, below) of some(node_id): the nodes in its interval. A join of equal roots with a range: as many rows as the
    result has, plus those of the trees concerned."""
    a = toured.join(some.select("node_id").distinct(), "node_id", "left_semi").select("node_id", "root", F.col("entry").alias("a"), F.col("exit").alias("b"))
    x = toured.select(F.col("node_id").alias("below"), "root", "entry")
    return x.join(a, "root").filter("entry BETWEEN a AND b").select("node_id", "below")


def is_below(toured: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(x, y) with `below`: whether x is y or a descendant of it; null if either isn't a node."""
    k = lambda c: toured.select(F.col("node_id").alias(c), F.col("root").alias(f"r_{c}"), F.col("entry").alias(f"e_{c}"), F.col("exit").alias(f"l_{c}"))
    j = pairs.join(k("x"), "x", "left").join(k("y"), "y", "left")
    return j.select("x", "y", ((F.col("r_x") == F.col("r_y")) & F.col("e_x").between(F.col("e_y"), F.col("l_y"))).alias("below"))
