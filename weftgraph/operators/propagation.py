"""Propagation of numeric properties over a graph as Gaussian mixtures.

Sources are nodes with a value. A signal walks the edges, hop by hop, weakening by `decay`; a node's mixture has a
component per source that reaches it. Hops are joins of the frontier with the edges, so each hop is one plan whatever the
graph's size; mixtures are folded per node with bounded lists.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

PAD = 0.1
LOW, HIGH = 0.001, 0.999
CUT = 0.01
KEEP = 0.05
METHODS = ("matrix", "belief", "spectral", "heat")
#: Nodes that all others are compared with at most.
MOST_QUERIES = 2_000
#: Intervals of the values that a mixture is carried in from hop to hop.
BINS = 32
#: Order of the polynomials that stand for spectral filters; bumps of .15 of the spectrum are then met to about 1e-5.
ORDER = 16
#: Terms that are kept before they are added up.
FOLD = 4


def sources(props: DataFrame, types: list[str], prop: str) -> DataFrame:
    """(node_id, value, x): x is the value between 0 and 1 over the range padded by a tenth on each side; .5 if there is
    one value only."""
    s = props.filter(F.col("type").isin(*types) & (F.col("prop") == prop) & F.col("d_val").isNotNull()).select("node_id", F.col("d_val").alias("value"))
    r = s.agg(F.min("value").alias("a"), F.max("value").alias("b"))
    span = (F.col("b") - F.col("a")) * (1 + 2 * PAD)
    x = F.when(F.col("b") == F.col("a"), 0.5).otherwise(F.greatest(F.lit(LOW), F.least(F.lit(HIGH), (F.col("value") - F.col("a") + PAD * (F.col("b") - F.col("a"))) / span)))
    return s.join(F.broadcast(r)).select("node_id", "value", F.round(x, 9).alias("x"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) in both directions; the weight is 1 where there is none."""
    e = weighted(edges)
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).distinct()


def weighted(edges: DataFrame) -> DataFrame:
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    return edges.select("src", "dst", weight.alias("weight"))


def hops(src: DataFrame, edges: DataFrame, depth: int, decay: float, cut: float = CUT) -> DataFrame:
    """(source, node_id, distance, influence): along the edges, not through other sources. Influence of parallel ways of one
    length adds up; what is below `cut` goes on and isn't returned. There is a row for each source and node that it reaches:
    where many sources reach the same nodes, `signals` has one for each value."""
    now = src.select(F.col("node_id").alias("source"), "node_id", F.lit(1.0).alias("influence"))
    return _walked(now, ["source"], src, edges, depth, decay, cut)


def signals(src: DataFrame, edges: DataFrame, depth: int, decay: float, digits: int = 3) -> DataFrame:
    """(x, node_id, distance, influence) of all sources of one value together, values rounded to `digits` digits: at most
    10 ** digits rows for each node and distance, however many sources there are. Nothing is cut."""
    now = src.groupBy(F.round("x", digits).alias("x"), "node_id").agg(F.lit(1.0).alias("influence"))
    return _walked(now, ["x"], src, edges, depth, decay, 0.0)


def moments(src: DataFrame, edges: DataFrame, depth: int, decay: float, bins: int = BINS) -> DataFrame:
    """(bin, node_id, distance, w, wx, wxx): the mixture that reaches each node, as sums that add up: the influence of sources
    whose x lies in one of `bins` equal intervals, and the sums of it with x and its square. A hop is one join with the edges and
    one sum, made in part before the shuffle, with at most `bins` rows a node however many sources there are. Nothing is cut."""
    own = F.least(F.floor(F.col("x") * bins), F.lit(bins - 1)).cast("int")
    sums = ["w", "wx", "wxx"]
    now = src.groupBy(own.alias("bin"), "node_id").agg(F.count("*").cast("double").alias("w"), F.sum("x").alias("wx"), F.sum(F.col("x") * F.col("x")).alias("wxx"))
    e, stop, found = weighted(edges), src.select(F.col("node_id").alias("_s")).distinct(), None
    for d in range(1, depth + 1):
        sent = now.join(e, F.col("node_id") == F.col("src"))
        step = sent.groupBy("bin", F.col("dst").alias("node_id")).agg(*[(F.sum(F.col(c) * F.col("weight")) * decay).alias(c) for c in sums])
        now = step.join(stop, F.col("node_id") == F.col("_s"), "left_anti")
        kept = now.select("bin", "node_id", F.lit(d).alias("distance"), *sums)
        found = kept if found is None else found.union(kept)
    return found


def merged_mixtures(reached: DataFrame, most: int = 5, near: float = 0.05) -> DataFrame:
    """moments() -> (node_id, c), components folded in order of mean and distance. Weights, and the mean of a node's whole
    mixture, are those of mixtures() of all pairs (with nothing cut); a component stands for values of one interval, so that its
    mean is within 1 / bins of each of theirs, and their spread is in its deviation."""
    m = F.col("wx") / F.col("w")
    spread = F.greatest(F.col("wxx") / F.col("w") - m * m, F.lit(0.0))
    s = F.sqrt(F.pow(0.025 + 0.015 * F.col("distance"), 2) + spread)
    r = F.array_sort(F.collect_list(F.struct(F.round(m, 12).alias("m"), F.col("distance").alias("d"), F.col("w").alias("w"), s.alias("s"))))
    listed = reached.filter("w > 0").groupBy("node_id").agg(r.alias("r"))  # at most bins times depth
    return listed.select("node_id", normalised(folded(F.col("r"), most, near, True)).alias("c"))


def _walked(now: DataFrame, key: list[str], src: DataFrame, edges: DataFrame, depth: int, decay: float, cut: float) -> DataFrame:
    e, stop, found = weighted(edges), src.select(F.col("node_id").alias("_s")).distinct(), None
    for d in range(1, depth + 1):
        step = now.join(e, F.col("node_id") == F.col("src")).groupBy(*key, F.col("dst").alias("node_id")).agg((F.sum(F.col("influence") * F.col("weight")) * decay).alias("influence"))
        now = step.join(stop, F.col("node_id") == F.col("_s"), "left_anti")
        kept = now.filter(F.col("influence") > cut).select(*key, "node_id", F.lit(d).alias("distance"), "influence")
        found = kept if found is None else found.union(kept)
    return found


def means(reached: DataFrame, src: DataFrame) -> DataFrame:
    """hops() -> per node the weighted mean of the source values, the number of contributions and their whole influence."""
    x = reached.join(src.select(F.col("node_id").alias("source"), "value"), "source")
    g = x.groupBy("node_id").agg(F.sum("influence").alias("w"), F.sum(F.col("influence") * F.col("value")).alias("wv"), F.count("*").alias("n"))
    return g.select("node_id", "n", F.round("w", 6).alias("evidence"), F.round(F.col("wv") / F.col("w"), 4).alias("mean"))


KIND = "array<struct<m:double,w:double,s:double>>"


def folded(records: Column, most: int, near: Column | float, shift: bool) -> Column:
    """The components of records (array of structs m, w, s and, for `near` by distance, d), taken in order: each joins the
    first component whose mean is nearer than `near`, else is one more; beyond `most` it replaces the lightest if it is
    heavier. With shift, joining counts the distance of the means into the variance."""

    def add(acc: Column, r: Column) -> Column:
        limit = near(r) if callable(near) else F.lit(near)
        at = F.array_position(F.transform(acc, lambda c: F.abs(c["m"] - r["m"]) < limit), F.lit(True))

        def joined(c: Column) -> Column:
            w = c["w"] + r["w"]
            m = (c["w"] * c["m"] + r["w"] * r["m"]) / w
            var = (c["w"] * (F.pow(c["s"], 2) + (F.pow(c["m"] - m, 2) if shift else 0)) + r["w"] * (F.pow(r["s"], 2) + (F.pow(r["m"] - m, 2) if shift else 0))) / w
            return F.struct(m.alias("m"), w.alias("w"), F.sqrt(var).alias("s"))

        new = F.struct(r["m"].alias("m"), r["w"].alias("w"), r["s"].alias("s"))
        least = F.array_min(F.transform(acc, lambda c: c["w"]))
        lightest = F.array_position(F.transform(acc, lambda c: c["w"]), least)
        merged = F.transform(acc, lambda c, i: F.when(i + 1 == at, joined(c)).otherwise(c))
        replaced = F.transform(acc, lambda c, i: F.when(i + 1 == lightest, new).otherwise(c))
        return F.when(at > 0, merged).when(F.size(acc) < most, F.concat(acc, F.array(new))).when(least < r["w"], replaced).otherwise(acc).cast(KIND)

    return F.aggregate(records, F.array().cast(KIND), add)


def normalised(components: Column) -> Column:
    """Components with weights that add up to one."""
    total = F.aggregate(components, F.lit(0.0), lambda s, c: s + c["w"])
    return F.transform(components, lambda c: F.struct(c["m"].alias("m"), (c["w"] / total).alias("w"), c["s"].alias("s")))


def mixtures(reached: DataFrame, src: DataFrame, most: int = 5, near: float = 0.05, digits: int = 4) -> DataFrame:
    """hops() -> (node_id, c): the components (m, w, s) of each node that a signal reaches, folded in order of mean and
    distance, weights adding up to one. Contributions of one distance whose means are equal in `digits` digits are one, which
    bounds a node's list by the values' resolution and not by the sources."""
    x = reached.join(src.select(F.col("node_id").alias("source"), "x"), "source")
    one = x.groupBy("node_id", F.round("x", digits).alias("m"), "distance").agg(F.sum("influence").alias("w"))
    listed = one.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("m", F.col("distance").alias("d"), "w", (0.025 + 0.015 * F.col("distance")).alias("s")))).alias("r"))
    return listed.select("node_id", normalised(folded(F.col("r"), most, near, True)).alias("c"))


def assembled(nodes: DataFrame, src: DataFrame, inferred: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(node_id, kind, x, evidence, c) for every node: a source has its own value, an inferred one its mixture and the mean of
    that, an isolated one nothing. evidence(node_id, evidence) is that of inferred nodes, 1 by default."""
    own = src.select("node_id", F.lit("source").alias("kind"), F.lit(1.0).alias("evidence"), F.array(F.struct(F.col("x").alias("m"), F.lit(1.0).alias("w"), F.lit(0.02).alias("s"))).cast(KIND).alias("c"))
    e = inferred.join(evidence, "node_id", "left") if evidence is not None else inferred.withColumn("evidence", F.lit(1.0))
    found = own.union(e.select("node_id", F.lit("inferred"), "evidence", F.col("c").cast(KIND)))
    j = nodes.select("node_id").join(found, "node_id", "left")
    x = F.aggregate("c", F.lit(0.0), lambda s, c: s + c["w"] * c["m"])
    return j.select("node_id", F.coalesce("kind", F.lit("isolated")).alias("kind"), x.alias("x"), F.coalesce("evidence", F.lit(0.0)).alias("evidence"), F.coalesce("c", F.array().cast(KIND)).alias("c"))


def value_range(src: DataFrame) -> DataFrame:
    """One row (low, high): the sources' range, padded by a tenth on each side."""
    g = src.agg(F.min("value").alias("a"), F.max("value").alias("b"))
    return g.select((F.col("a") - PAD * (F.col("b") - F.col("a"))).alias("low"), (F.col("b") + PAD * (F.col("b") - F.col("a"))).alias("high"))


def values_of(mixed: DataFrame, src: DataFrame) -> DataFrame:
    """assembled() -> (node_id, kind, value) in the property's own unit; null where nothing reaches."""
    r = F.broadcast(value_range(src))  # one row
    return mixed.crossJoin(r).select("node_id", "kind", (F.col("x") * (F.col("high") - F.col("low")) + F.col("low")).alias("value"))


def components_of(mixed: DataFrame) -> DataFrame:
    """assembled() -> a row per component."""
    return mixed.select("node_id", "kind", F.posexplode("c").alias("place", "x")).select("node_id", "kind", "place", F.round("x.w", 9).alias("weight"), F.round("x.m", 9).alias("mean"), F.round("x.s", 9).alias("std"))


def in_range(mixed: DataFrame, src: DataFrame, low: float, high: float) -> DataFrame:
    """assembled() -> nodes whose value can lie in the range: a source's value does, or some component of an inferred one
    within two deviations. The range is in the property's unit."""
    r = F.broadcast(value_range(src))
    x = mixed.crossJoin(r).join(src.select(F.col("node_id").alias("_id"), F.col("value").alias("_v")), F.col("node_id") == F.col("_id"), "left")
    unit = lambda v: v * (F.col("high") - F.col("low")) + F.col("low")
    met = F.exists("c", lambda c: (unit(c["m"] + 2 * c["s"]) >= low) & (unit(c["m"] - 2 * c["s"]) <= high))
    keep = F.when(F.col("kind") == "source", F.col("_v").between(low, high)).when(F.col("kind") == "inferred", met).otherwise(False)
    return x.filter(keep).select("node_id", "kind")


def probability(mixed: DataFrame, src: DataFrame, value: float) -> DataFrame:
    """assembled() -> how well the value goes with each node: 1 less ten times its distance from a source's; the density of an
    inferred node's mixture against that at its means; .05 for an isolated one."""
    r = F.broadcast(value_range(src))
    v = F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.when(F.col("high") == F.col("low"), 0.5).otherwise((F.lit(value) - F.col("low")) / (F.col("high") - F.col("low")))))
    x = mixed.crossJoin(r).withColumn("v", v)
    peak = lambda c: c["w"] / (c["s"] * math.sqrt(2 * math.pi))
    density = F.aggregate("c", F.lit(0.0), lambda s, c: s + peak(c) * F.exp(-0.5 * F.pow((F.col("v") - c["m"]) / c["s"], 2)))
    most = F.aggregate("c", F.lit(0.0), lambda s, c: s + peak(c))
    p = F.when(F.col("kind") == "source", F.greatest(F.lit(0.0), 1 - 10 * F.abs(F.col("v") - F.element_at("c", 1)["m"]))).when(F.col("kind") == "inferred", F.least(F.lit(1.0), density / most)).otherwise(0.05)
    return x.select("node_id", "kind", p.alias("probability"))


def similarity(a: Column, b: Column, kind_a: Column, kind_b: Column) -> Column:
    """Of two mixtures: of two sources by their values; else the greatest overlap of two components, weighted by both."""
    x, y = F.element_at(a, 1), F.element_at(b, 1)

    def overlap(p: Column, q: Column) -> Column:
        return F.greatest(F.lit(0.0), 1 - F.abs(p["m"] - q["m"]) / (p["s"] + q["s"])) * p["w"] * q["w"]

    best = F.array_max(F.transform(a, lambda p: F.array_max(F.transform(b, lambda q: overlap(p, q)))))
    either = (kind_a == "isolated") | (kind_b == "isolated")
    return F.when(either, 0.0).when((kind_a == "source") & (kind_b == "source"), F.greatest(F.lit(0.0), 1 - 2 * F.abs(x["m"] - y["m"]))).otherwise(best)


def similarities(mixed: DataFrame, some: DataFrame) -> DataFrame:
    """(a, b, similarity) of every node with each of some(node_id), a stated set of queries: at most MOST_QUERIES, which is
    checked, as they are broadcast."""
    n = some.count()
    if n > MOST_QUERIES:
        raise ValueError(f"{n} nodes to compare all others with, of {MOST_QUERIES} at most")
    b = F.broadcast(mixed.join(some.select("node_id"), "node_id", "left_semi").select(F.col("node_id").alias("b"), F.col("kind").alias("kb"), F.col("c").alias("cb")))
    a = mixed.select(F.col("node_id").alias("a"), F.col("kind").alias("ka"), F.col("c").alias("ca"))
    return a.crossJoin(b).select("a", "b", similarity(F.col("ca"), F.col("cb"), F.col("ka"), F.col("kb")).alias("similarity"))


def influence_score(mixed: DataFrame) -> DataFrame:
    """assembled() -> 10 a component, 5 of evidence, 20 of the spread of means, 15 for being inferred."""
    spread = F.when(F.size("c") > 1, F.array_max(F.transform("c", lambda c: c["m"])) - F.array_min(F.transform("c", lambda c: c["m"]))).otherwise(0.0)
    return mixed.select("node_id", "kind", (10 * F.size("c") + 5 * F.col("evidence") + 20 * spread + F.when(F.col("kind") == "inferred", 15).otherwise(0)).alias("score"))


def polar_layout(compared: DataFrame, values: DataFrame, base: float = 100.0) -> DataFrame:
    """similarities() and values_of() -> (node_id, x, y, radius, angle, centrality): the farther out the less similar a node is
    to the others on average, at the angle of its value among all; nodes without a value by a hash of their id."""
    centre = compared.groupBy(F.col("a").alias("node_id")).agg(F.avg("similarity").alias("centrality"))
    r = F.broadcast(values.agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    at = F.when(F.col("hi") == F.col("lo"), 0.5).otherwise((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    loose = (F.crc32(F.col("node_id").cast("binary")) % 3600) / 3600.0
    x = centre.join(values, "node_id").crossJoin(r).withColumn("radius", base * (1 - F.col("centrality")) * 2).withColumn("angle", F.coalesce(at, loose) * 2 * math.pi)
    return x.select("node_id", (F.col("radius") * F.cos("angle")).alias("x"), (F.col("radius") * F.sin("angle")).alias("y"), "radius", "angle", "centrality")


def grid_layout(nodes: DataFrame, spacing: float = 50.0) -> DataFrame:
    """(node_id, row, column, x, y): nodes in order of id on a square grid. For what is shown at once: the window is over all."""
    n = F.broadcast(nodes.agg(F.ceil(F.sqrt(F.count("*"))).cast("long").alias("side")))
    k = nodes.select("node_id").withColumn("k", F.row_number().over(W.orderBy("node_id")) - 1).crossJoin(n)
    row, column = F.floor(F.col("k") / F.col("side")), F.col("k") % F.col("side")
    return k.select("node_id", row.alias("row"), column.alias("column"), (column * spacing).alias("x"), (row * spacing).alias("y"))


def page(mixed: DataFrame, number: int, size: int = 1000) -> DataFrame:
    """The results number * size to (number + 1) * size in order of id."""
    return mixed.orderBy("node_id").offset(number * size).limit(size)


def density_curve(mixed: DataFrame, node_id: str, src: DataFrame, steps: int = 300) -> DataFrame:
    """(x, component, density) of one node's mixture over the padded range in the property's unit; component -1 is the sum."""
    r = F.broadcast(value_range(src))
    one = mixed.filter(F.col("node_id") == node_id).crossJoin(r).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    span = F.col("high") - F.col("low")
    x = F.col("low") + span * F.col("i") / (steps - 1)
    each = one.select(x.alias("x"), span.alias("span"), F.col("low").alias("low"), F.posexplode("c").alias("component", "p"))
    mean, sd = F.col("p.m") * F.col("span") + F.col("low"), F.col("p.s") * F.col("span")
    d = F.col("p.w") * F.exp(-0.5 * F.pow((F.col("x") - mean) / sd, 2)) / (sd * math.sqrt(2 * math.pi))
    parts = each.select("x", "component", d.alias("density"))
    return parts.union(parts.groupBy("x").agg(F.lit(-1).alias("component"), F.sum("density").alias("density")).select("x", "component", "density"))


def top_values(values: DataFrame, k: int = 20) -> DataFrame:
    """The k greatest values that were inferred, ties by id."""
    return values.filter("kind = 'inferred'").orderBy(F.desc("value"), "node_id").limit(k)


def tuned(n: int, edges: int, clustering: float, components: int, largest: int) -> dict[str, float]:
    """What the shape of a graph says for the parameters: density in three bands gives an estimated diameter and path length,
    and these the rounds, damping, decay, depth, components, merging, boost, least weight and eigenvectors."""
    density = edges / (n * (n - 1)) if n > 1 else 0.0
    within = lambda x, a, b: min(max(x, a), b)
    if density > 0.1:
        diameter, share = max(2, int(math.log2(largest))), 0.6
    elif density > 0.01:
        diameter, share = max(3, int(math.log(largest))), 0.7
    else:
        diameter, share = max(4, int(math.sqrt(largest))), 0.8
    path, connected = diameter * share, largest / n
    band = 0 if density < 0.01 else 1 if density < 0.05 else 2
    rounds = int(within(int(path * 1.5) * (1.4, 1.2, max(0.6, 1 - density))[band], 3, 10))
    most = int(within((4 if band < 2 else 3) + 3 * ((1 - clustering) * density + components / n), 2, 6))
    near = within((0.06, 0.08 + clustering * connected * 0.03, 0.10 + clustering * connected * 0.04)[band], 0.05, 0.15)
    least = 0.005 if band == 0 else 0.01 * min(1.0, 100.0 / n) * max(0.5, density)
    eigen = int(within(int(n * 0.5) if n < 50 else max(8, int(path * 2)) if n < 200 else max(6, int(diameter * 1.2)), 5, 20))
    if n > 2000:
        rounds, most, eigen = int(rounds * 0.8), int(most * 0.8), min(eigen, 10)
    if connected < 0.8:
        most, near = min(most + 1, 6), max(near * 0.9, 0.05)
    return {
        "density": density, "rounds": rounds, "damping": within((0.2, max(0.3, clustering * density), max(0.4, clustering * density))[band], 0.1, 0.8),
        "decay": within((0.6 if band < 2 else 0.5) ** (1 / path), 0.7, 0.95), "depth": int(within(min(diameter + 1, int(path * 1.5)), 2, 5)), "components": most, "merge": near,
        "boost": within((2.0, 1.5 + (1 - density * 10), 1.2 + (1 - density) * 0.5)[band], 1.1, 2.5), "least_weight": within(least, 0.002, 0.05), "eigenvectors": eigen,
    }


def shape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (n, edges, clustering, components, largest): clustering is the mean over all nodes of the share of pairs of
    neighbours that are neighbours; triangles run from the end of lower degree."""
    from .graph import triangles, weak_labels

    e = edges.select("src", "dst").filter("src <> dst")
    near = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    degree = near.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("k"))
    at = triangles(e).select(F.explode(F.array("a", "b", "c")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("t"))
    local = degree.join(at, "node_id").select((2 * F.col("t") / (F.col("k") * (F.col("k") - 1))).alias("c"))
    sizes = nodes.select("node_id").join(weak_labels(edges), "node_id", "left").groupBy(F.coalesce("component", "node_id").alias("component")).agg(F.count("*").alias("size"))
    g = sizes.agg(F.sum("size").alias("n"), F.count("*").alias("components"), F.max("size").alias("largest"))
    one = g.crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(local.agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("c")))  # one row each
    return one.select("n", "edges", (F.col("c") / F.col("n")).alias("clustering"), "components", "largest")


def tuning(nodes: DataFrame, edges: DataFrame) -> dict[str, float]:
    r = shape(nodes, edges).first()
    return tuned(r["n"], r["edges"], r["clustering"], r["components"], r["largest"])


def propagate(nodes: DataFrame, edges: DataFrame, props: DataFrame, types: list[str], prop: str, method: str = "matrix", undirected: bool = True, **given) -> DataFrame:
    """assembled() of a property by one of METHODS. Parameters that aren't given come from the graph's shape."""
    src = sources(props, types, prop)
    e = both_ways(edges) if undirected else weighted(edges)
    p = tuning(nodes, edges) | given
    if method == "matrix":
        return assembled(nodes, src, mixtures(hops(src, e, p["depth"], p["decay"]), src, p["components"]))
    if method == "belief":
        return believed(nodes, src, belief_influences(src, e, p["damping"], rounds=p["rounds"]), p["components"])
    if method not in METHODS:
        raise ValueError(f"{method!r} is none of {', '.join(METHODS)}")
    reached = spectral_influences(nodes, edges, src, p["depth"], p["decay"], p["least_weight"], p["boost"], heat=method == "heat")
    return assembled(nodes, src, spectral_mixtures(reached, p["components"]))


def belief(src: DataFrame, edges: DataFrame, damping: float = 0.1, gain: float = 0.85, rounds: int = 15, least: float = 1e-3) -> tuple[DataFrame, bool]:
    """((source, node_id, influence), settled): each source's x <- damping * x + (1 - damping) * gain * (sum over incoming edges), its own
    node held at 1 and those of other sources at 0, until no value moves by `least` or the rounds are over, which settled
    tells apart. Each round is written out. There is a row for each source and node that it reaches: `moments` has bounded ones."""
    from .tables import materialise

    e = materialise(weighted(edges))
    ends = src.select("node_id").distinct()
    now = materialise(ends.select(F.col("node_id").alias("source"), "node_id", F.lit(1.0).alias("influence")))
    for _ in range(rounds):
        into = now.join(e, F.col("node_id") == F.col("src")).groupBy("source", F.col("dst").alias("node_id")).agg((F.sum(F.col("influence") * F.col("weight")) * (1 - damping) * gain).alias("i"))
        x = now.withColumnRenamed("influence", "old").join(into, ["source", "node_id"], "full")
        x = x.join(ends.withColumn("held", F.lit(True)), "node_id", "left")
        value = F.when(F.col("source") == F.col("node_id"), 1.0).when(F.col("held"), 0.0).otherwise(damping * F.coalesce("old", F.lit(0.0)) + F.coalesce("i", F.lit(0.0)))
        step = materialise(x.select("source", "node_id", value.alias("influence"), F.coalesce("old", F.lit(0.0)).alias("old")))
        moved = step.agg(F.max(F.abs(F.col("influence") - F.col("old")))).first()[0]
        now = step.filter("influence > 0").select("source", "node_id", "influence")
        if moved is None or moved < least:
            return now, True
    return now, False


def belief_influences(src: DataFrame, edges: DataFrame, damping: float = 0.1, **given) -> DataFrame:
    """The influences of belief(), settled or not."""
    return belief(src, edges, damping, **given)[0]


def believed(nodes: DataFrame, src: DataFrame, reached: DataFrame, most: int = 20, near: float = 0.08, cut: float = KEEP, digits: int = 4) -> DataFrame:
    """assembled() of belief_influences(): components of influences above `cut`, wider the weaker they are, merged in order of
    mean without counting the distance of means, the `most` heaviest. Equal means (in `digits` digits) and influences (in 2)
    are one before they are folded, which bounds a node's list."""
    x = reached.filter(F.col("influence") > cut).join(src.select(F.col("node_id").alias("source"), "x"), "source").join(src.select("node_id"), "node_id", "left_anti")
    one = x.groupBy("node_id", F.round("x", digits).alias("m"), F.round("influence", 2).alias("i")).agg(F.sum("influence").alias("w"))
    listed = one.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("m", "i", "w", (0.03 + 0.05 * (1 - F.col("i"))).alias("s")))).alias("r"), F.sum("w").alias("evidence"))
    c = folded(F.col("r"), 1 << 30, near, False)
    heavy = F.slice(F.reverse(F.array_sort(F.transform(c, lambda p: F.struct(p["w"].alias("w"), p["m"].alias("m"), p["s"].alias("s"))))), 1, most)
    inferred = listed.select("node_id", normalised(heavy).alias("c"), "evidence")
    return assembled(nodes, src, inferred.select("node_id", "c"), inferred.select("node_id", "evidence"))


def filters(top: float, depth: int, heat: bool, alpha: float = 0.08) -> list:
    """For each distance, what an eigenvalue lets through: a bump that moves up with the distance over a floor of .2, or, with
    heat, a heat kernel of a short time under a bell."""
    if heat:
        return [lambda v, d=d: np.exp(-v * d * alpha * 0.01) * np.exp(-0.5 * (v / top) ** 2) for d in range(1, depth + 1)]
    return [lambda v, d=d: 0.8 * np.exp(-0.5 * ((v - top * 0.05 * d) / (top * 0.15)) ** 2) + 0.2 for d in range(1, depth + 1)]


def chebyshev(f, top: float, order: int) -> list[float]:
    """The coefficients c of f on [0, top]: f(v) is about the sum of c[k] T_k(2 v / top - 1)."""
    n = 8 * (order + 1)
    angle = (np.arange(n) + 0.5) * np.pi / n
    y = f(top * (np.cos(angle) + 1) / 2)
    c = [2 / n * float(np.sum(y * np.cos(k * angle))) for k in range(order + 1)]
    return [c[0] / 2, *c[1:]]


def undirected_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, edge_type, src_type, dst_type, weight), one edge per pair of different nodes; of several the greatest weight."""
    w = weighted(edges).filter("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))
    return w.select("src", "dst", F.lit("pair").alias("edge_type"), F.lit("").alias("src_type"), F.lit("").alias("dst_type"), "weight")


def _next_term(kept, degree: DataFrame, found: list[DataFrame], signals: list[str], top: float) -> DataFrame:
    """T_k = 2 L T_(k-1) - T_(k-2) of the Laplacian moved to [-1, 1], without the 2 for the first: what a node keeps, what its
    neighbours send and the term before the last, added up by node."""
    last, scale = found[-1], 2.0 if len(found) > 1 else 1.0
    own = last.join(degree, "node_id", "left").select("node_id", *[(scale * (2 / top * F.coalesce("d", F.lit(0.0)) - 1) * F.col(v)).alias(v) for v in signals])
    sent = kept.ends.select(*kept.keys, "other", "weight").join(kept.asked(last), kept.keys)
    rows = own.union(sent.select(F.col("other").alias("node_id"), *[(-scale * 2 / top * F.col("weight") * F.col(v)).alias(v) for v in signals]))
    if len(found) > 1:
        rows = rows.union(found[-2].select("node_id", *[(-F.col(v)).alias(v) for v in signals]))
    return rows.groupBy("node_id").agg(*[F.sum(v).alias(v) for v in signals])


def _sums(kept, degree: DataFrame, start: DataFrame, signals: list[str], top: float, terms: list[list[float]], fold: int = FOLD) -> DataFrame:
    """(node_id, y0_0, ...): for each distance k and signal i the sum of the terms by the coefficients terms[k]. After `fold` terms
    at most they are added to the sums and dropped but for the last two, so that few tables of a number per node and signal
    are there at once."""
    from .tables import drop, materialise, scratch

    spark, order = start.sparkSession, len(terms[0]) - 1
    names = [f"y{k}_{i}" for k in range(len(terms)) for i in range(len(signals))]
    found, summed, old, waiting = [], None, None, []
    for k in range(order + 1):
        found.append(scratch(_next_term(kept, degree, [t for t, _ in found], signals, top) if found else start))
        waiting.append(found[-1][0].select("node_id", *[(F.lit(c[k]) * F.col(v)).alias(f"y{d}_{i}") for d, c in enumerate(terms) for i, v in enumerate(signals)]))
        if len(waiting) == fold or k == order:
            sums = reduce(DataFrame.union, waiting if summed is None else [summed, *waiting]).groupBy("node_id").agg(*[F.sum(y).alias(y) for y in names])
            last = k == order
            summed, name = (materialise(sums), None) if last else scratch(sums)  # it is read for the lengths and for the rows
            drop(spark, [n for _, n in (found if last else found[:-2])] + ([old] if old else []))
            found, old, waiting = found[-2:], name, []
    return summed


def spectral_influences(nodes: DataFrame, edges: DataFrame, src: DataFrame, depth: int = 3, decay: float = 0.95, least_weight: float = 0.01, boost: float = 1.3, heat: bool = False, order: int = ORDER, digits: int = 1) -> DataFrame:
    """(x, node_id, distance, influence): sources by filters of the Laplacian of the undirected graph, in its whole spectrum.

    Sources of equal x in `digits` digits (one or two) are one signal, so that a node has 10 or 100 numbers at most. Filters
    are Chebyshev polynomials of the sparse Laplacian, all distances share the terms: products of `blocks` in files, or, where the
    shared folder has no path that tasks can open, joins of tables with the kept adjacency. The greatest sum of two neighbours'
    degrees bounds the spectrum. Each signal is scaled to length one and weakened by decay ** distance; sources themselves get nothing."""
    from .tables import local_path, shared_base

    if digits not in (1, 2):
        raise ValueError("one or two digits")
    spark = nodes.sparkSession
    xs = sorted(r["x"] for r in src.select(F.round("x", digits).alias("x")).distinct().collect())  # 101 at most
    if not xs:
        return spark.createDataFrame([], "x double, node_id string, distance int, influence double")
    n = nodes.count()
    low, high = (0.01, 0.02) if heat else (0.001, 0.015)
    way = _by_blocks if local_path(shared_base(spark)) else _by_tables
    found = way(nodes, edges, src.select("node_id", F.round("x", digits).alias("x")), xs, lambda top: [chebyshev(f, top, order) for f in filters(top, depth, heat)], decay, heat, low if n < 500 else high)
    w = F.col("z") * (0.5 if heat else 1.0)
    return found.select("x", "node_id", "distance", F.when(w < least_weight * 1.2, w * boost).otherwise(w).alias("influence"))


def _by_blocks(nodes: DataFrame, edges: DataFrame, src: DataFrame, xs: list[float], terms: Callable, decay: float, heat: bool, cut: float) -> DataFrame:
    """(x, node_id, distance, z) above `cut`, by files of blocks."""
    from .blocks import Blocks

    spark = nodes.sparkSession
    kept = Blocks(nodes, edges)
    signal = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "signal int, x double")
    top = kept.top or 1.0
    rows = kept.filtered(src.join(F.broadcast(signal), "x").select("node_id", "signal"), len(xs), terms(top), top)  # 101 rows at most
    scale = decay ** np.arange(1, len(kept.lengths) + 1)[:, None] / np.where(kept.lengths > 1e-8, kept.lengths, 1.0)
    found = rows(lambda y, d, i: np.abs(y * scale[d, i]) if heat else y * scale[d, i], cut)
    kept.remove()
    return found.join(F.broadcast(signal), "signal").select("x", "node_id", (F.col("sum") + 1).alias("distance"), "z")


def _by_tables(nodes: DataFrame, edges: DataFrame, src: DataFrame, xs: list[float], terms: Callable, decay: float, heat: bool, cut: float) -> DataFrame:
    """_by_blocks() by joins with the kept adjacency. A term is one join of the nodes' numbers with it, which stays where it is,
    and one aggregate by node. Nodes that nothing has reached have no row."""
    from . import adjacency
    from .tables import few_shuffle_files, materialise

    held = src.join(nodes.select("node_id"), "node_id", "left_semi")
    kept = adjacency.keep(undirected_weights(edges).join(nodes.select(F.col("node_id").alias("src")), "src", "left_semi").join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi"))
    degree = materialise(kept.ends.groupBy("node_id").agg(F.sum("weight").alias("d")))
    far = kept.ends.join(degree, "node_id").join(degree.select(F.col("node_id").alias("other"), F.col("d").alias("e")), "other")
    top = far.agg(F.max(F.col("d") + F.col("e"))).first()[0] or 1.0
    signals = [f"v{i}" for i in range(len(xs))]
    start = held.groupBy("node_id").agg(*[F.sum(F.when(F.col("x") == x, 1.0).otherwise(0.0)).alias(v) for x, v in zip(xs, signals)])
    sums = terms(top)
    with few_shuffle_files(nodes.sparkSession):
        summed = _sums(kept, degree, start, signals, top, sums)
    each = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(k + 1).alias("distance"), F.col(f"y{k}_{i}").alias("y")) for i, x in enumerate(xs) for k in range(len(sums))])
    rows = summed.select("node_id", F.explode(each).alias("r")).select("node_id", "r.*")
    length = rows.groupBy("x", "distance").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("length"))
    unit = rows.join(F.broadcast(length), ["x", "distance"]).join(held.select("node_id").distinct(), "node_id", "left_anti")  # 101 rows for each distance
    z = F.when(F.col("length") > 1e-8, F.col("y") / F.col("length")).otherwise(F.col("y")) * F.pow(F.lit(decay), F.col("distance"))
    return unit.select("x", "node_id", "distance", (F.abs(z) if heat else z).alias("z")).filter(F.col("z") > cut)


def spectral_mixtures(reached: DataFrame, most: int = 20) -> DataFrame:
    """spectral_influences() -> (node_id, c), folded in order of mean and distance; farther ones merge more easily."""
    listed = reached.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct(F.col("x").alias("m"), F.col("distance").alias("d"), F.col("influence").alias("w"), (0.025 + 0.015 * F.col("distance")).alias("s")))).alias("r"))
    return listed.select("node_id", normalised(folded(F.col("r"), most, lambda r: 0.05 + 0.01 * r["d"], False)).alias("c"))
