"""Views over the graph: sorting, grouping, sampling of values, overlaps, method paths, measurement ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import ranks

from ..functions.columns import hierarchy_kind, naming_score
from .ontology import property_classes


def naming(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """The naming score of each property of a type."""
    total = nodes.groupBy("type").agg(F.count("*").alias("total"))
    lengths = props.groupBy("type", "prop").agg(F.avg(F.length("s_val")).alias("length"))
    c = property_classes(nodes, props).join(lengths, ["type", "prop"]).join(F.broadcast(total), "type")
    return c.select("type", "prop", F.round(naming_score(F.col("uniqueness"), F.col("present"), F.col("total"), F.col("length")), 4).alias("score"))


def hierarchy_buckets(edges: DataFrame) -> DataFrame:
    return edges.groupBy(hierarchy_kind(F.col("edge_type")).alias("kind"), "edge_type").agg(F.count("*").alias("n"))


def categories(nodes: DataFrame, props: DataFrame, edges: DataFrame) -> DataFrame:
    """Per type: relationships it takes part in, share of numeric properties, a score of 2 for more than two relationships
    and 1 for a numeric share above .3."""
    ends = edges.select("src_type", "edge_type", "dst_type").distinct()
    n = ends.select(F.explode(F.array_distinct(F.array("src_type", "dst_type"))).alias("type"), "src_type", "edge_type", "dst_type").groupBy("type").agg(F.count("*").alias("relationships"))
    kinds = props.groupBy("type", "prop").agg(F.bool_or(F.col("d_val").isNotNull()).alias("numeric")).groupBy("type").agg(F.round(F.count_if("numeric") / F.count("*"), 6).alias("numeric_share"))
    j = nodes.select("type").distinct().join(n, "type", "left").join(kinds, "type", "left").na.fill(0)
    return j.withColumn("score", F.when(F.col("relationships") > 2, 2).otherwise(0) + F.when(F.col("numeric_share") > 0.3, 1).otherwise(0))


def ranges(props: DataFrame, parts: int = 4) -> DataFrame:
    """Equal ranges of each numeric property: low, high and how many values lie in each."""
    b = props.filter("d_val IS NOT NULL").groupBy("type", "prop").agg(F.min("d_val").alias("a"), F.max("d_val").alias("b"))
    x = props.filter("d_val IS NOT NULL").join(F.broadcast(b), ["type", "prop"])
    k = F.when(F.col("a") == F.col("b"), 0).otherwise(F.least(F.lit(parts - 1), F.floor((F.col("d_val") - F.col("a")) * parts / (F.col("b") - F.col("a"))))).cast("int")
    return x.withColumn("part", k).groupBy("type", "prop", "part").agg(F.count("*").alias("n"))


def parents(edges: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """(node_id, parent, level): up through edges of the given types, one level for each."""
    now, found = None, None
    for level, kind in enumerate(rules, 1):
        step = edges.filter(F.col("edge_type") == kind).select(F.col("src").alias("s"), F.col("dst").alias("parent"))
        now = step.select(F.col("s").alias("node_id"), "parent") if now is None else now.withColumnRenamed("parent", "s").join(step, "s").select("node_id", "parent")
        found = now.withColumn("level", F.lit(level)) if found is None else found.union(now.withColumn("level", F.lit(level)))
    return found


def sorted_by(nodes: DataFrame, edges: DataFrame, props: DataFrame, how: str, prop: str | None = None, reverse: bool = False, most: int | None = None) -> DataFrame:
    """(type, node_id, place): nodes of each type in order of a numeric property, of their first parent's type and value, of
    their number of children, or of their value without case; those without what is asked for last, ties by id. With `most`,
    only the first so many of each type: then Spark ranks no more than these."""
    rows = nodes.select("node_id", "type", "value")
    turn = lambda c: c.desc_nulls_last() if reverse else c.asc_nulls_last()
    if how == "property":
        rows = rows.join(props.filter(F.col("prop") == prop).groupBy("node_id").agg(F.min("d_val").alias("k")), "node_id", "left")
        order = [turn(F.col("k"))]
    elif how == "parent":
        up = parents_of(edges, nodes).groupBy("node_id").agg(F.min(F.struct("parent", "parent_type", "parent_value")).alias("p"))
        rows = rows.join(up, "node_id", "left")
        order = [turn(F.col("p.parent_type")), turn(F.col("p.parent_value"))]
    elif how == "children":
        rows = rows.join(edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("k")), "node_id", "left")
        order = [turn(F.coalesce("k", F.lit(0)))]
    elif how == "name":
        order = [turn(F.lower("value"))]
    else:
        raise ValueError(f"{how!r} is none of property, parent, children, name")
    if most is None:
        return ranks.placed(rows, "type", [*order, F.col("node_id").asc()]).select("type", "node_id", "place")
    first = rows.withColumn("place", F.row_number().over(W.partitionBy("type").orderBy(*order, "node_id")))
    return first.filter(F.col("place") <= most).select("type", "node_id", "place")


def sort_strategy(nodes: DataFrame, edges: DataFrame, props: DataFrame) -> DataFrame:
    """(type, strategy, prop): the first numeric property by name that .7 of a type's nodes have with more than .3 of its values
    different; else the parents, if they are of several types; else the name."""
    total = F.broadcast(nodes.groupBy("type").agg(F.count("*").alias("total")))
    p = props.groupBy("type", "prop").agg(F.count("*").alias("n"), F.count("d_val").alias("numbers"), F.count_distinct("d_val").alias("values"))
    best = p.join(total, "type").filter((F.col("n") >= 0.7 * F.col("total")) & (F.col("n") == F.col("numbers")) & (F.col("values") > 0.3 * F.col("n"))).groupBy("type").agg(F.min("prop").alias("prop"))
    kinds = parents_of(edges, nodes).groupBy("type").agg(F.count_distinct("parent_type").alias("kinds"))
    j = nodes.select("type").distinct().join(best, "type", "left").join(kinds, "type", "left")
    return j.select("type", F.when(F.col("prop").isNotNull(), "property").when(F.col("kinds") > 1, "parent").otherwise("name").alias("strategy"), "prop")


def parents_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, type, edge_type, parent, parent_type, parent_value): what edges lead to from each node, as the star's edges
    run from the part to the whole; other graphs turn theirs round first."""
    v = nodes.select(F.col("node_id").alias("parent"), F.col("value").alias("parent_value"))
    return edges.select(F.col("src").alias("node_id"), F.col("src_type").alias("type"), "edge_type", F.col("dst").alias("parent"), F.col("dst_type").alias("parent_type")).join(v, "parent").select("node_id", "type", "edge_type", "parent", "parent_type", "parent_value")


def children_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, type, edge_type, child, child_type, child_value)."""
    v = nodes.select(F.col("node_id").alias("child"), F.col("value").alias("child_value"))
    return edges.select(F.col("dst").alias("node_id"), F.col("dst_type").alias("type"), "edge_type", F.col("src").alias("child"), F.col("src_type").alias("child_type")).join(v, "child").select("node_id", "type", "edge_type", "child", "child_type", "child_value")


def grouped(nodes: DataFrame, edges: DataFrame, props: DataFrame, how: str, prop: str | None = None) -> DataFrame:
    """(key, n): nodes by the value of a property, by the type of their first parent, or by their own type; `Other` without."""
    if how == "property":
        rows = nodes.select("node_id").join(props.filter(F.col("prop") == prop).groupBy("node_id").agg(F.min("s_val").alias("key")), "node_id", "left")
    elif how == "parent":
        rows = nodes.select("node_id").join(edges.groupBy(F.col("src").alias("node_id")).agg(F.min_by("dst_type", "dst").alias("key")), "node_id", "left")
    elif how == "type":
        rows = nodes.select("node_id", F.col("type").alias("key"))
    else:
        raise ValueError(f"{how!r} is none of property, parent, type")
    return rows.groupBy(F.coalesce("key", F.lit("Other")).alias("key")).agg(F.count("*").alias("n"))


#: Names of properties that say how a graph is built and not what was measured.
STRUCTURAL = ("id", "type", "hierarchy", "index", "count", "level", "depth", "position")


def measurement_properties(props: DataFrame) -> DataFrame:
    """(type, prop, n): numeric properties whose names aren't structural."""
    part = F.split(F.lower("prop"), "_")
    return props.filter("d_val IS NOT NULL").filter(~F.arrays_overlap(part, F.array(*[F.lit(x) for x in STRUCTURAL]))).groupBy("type", "prop").agg(F.count("*").alias("n"))


def options(nodes: DataFrame, edges: DataFrame, props: DataFrame) -> DataFrame:
    """(type, option, name): what a type's nodes can be sorted and coloured by."""
    number = props.filter("d_val IS NOT NULL").select("type", F.lit("sort").alias("option"), F.col("prop").alias("name")).distinct()
    small = props.filter("d_val IS NULL").groupBy("type", "prop").agg(F.count_distinct("s_val").alias("v")).filter("v <= 20").select("type", F.lit("colour"), "prop")
    up = edges.select(F.col("src_type").alias("type"), F.lit("parent"), F.col("dst_type")).distinct()
    return number.union(small).union(up)


def chosen(items: DataFrame, categories: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """items(name, category, ...) of the given categories and names; None keeps all, an empty list none."""
    for column, wanted in (("category", categories), ("name", names)):
        if wanted is not None:
            items = items.filter(F.col(column).isin(*wanted) if wanted else F.lit(False))
    return items


def method_paths(steps: DataFrame, depth: int = 6) -> DataFrame:
    """steps(src, dst, method) between classes -> simple paths of up to `depth` methods, all prefixes among them. Classes of
    an ontology are few."""
    now = steps.select(F.array("src", "dst").alias("nodes"), F.array("method").alias("methods"))
    found = now
    for _ in range(depth - 1):
        now = now.join(F.broadcast(steps), F.element_at("nodes", -1) == F.col("src")).filter(~F.array_contains("nodes", F.col("dst"))).select(F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("methods", F.array("method")).alias("methods"))
        found = found.union(now)
    return found.select(F.array_join("nodes", ">").alias("path"), F.array_join("methods", ">").alias("methods"))
