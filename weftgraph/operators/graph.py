"""Graph queries and rewrites over nodes(node_id, type, value, ...) and edges(src, dst, edge_type, src_type, dst_type)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# --- lookups


def where_all(df: DataFrame, wanted: dict) -> DataFrame:
    """Rows that equal all wanted values; one filter, which a scan can take over. Nothing wanted keeps all."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in wanted.items()], F.lit(True)))


def page(df: DataFrame, order: list, limit: int | None = None, offset: int = 0) -> DataFrame:
    found = df.orderBy(*order).offset(offset)
    return found if limit is None else found.limit(limit)


def both_ways(edges: DataFrame) -> DataFrame:
    """(node_id, other, way) for each end of each edge, from one pass over the edges."""
    ends = F.array(F.struct(F.col("src").alias("node_id"), F.col("dst").alias("other"), F.lit("out").alias("way")), F.struct(F.col("dst").alias("node_id"), F.col("src").alias("other"), F.lit("in").alias("way")))
    return edges.select(F.explode(ends).alias("x")).select("x.*")


def degrees(edges: DataFrame) -> DataFrame:
    """out_degree, in_degree and total_degree, which is the number of different neighbours."""
    return both_ways(edges).groupBy("node_id").agg(F.count_if(F.col("way") == "out").alias("out_degree"), F.count_if(F.col("way") == "in").alias("in_degree"), F.count_distinct("other").alias("total_degree"))


def neighbors(edges: DataFrame, node: str) -> DataFrame:
    mine = edges.filter((F.col("src") == node) | (F.col("dst") == node))
    return both_ways(mine).filter(F.col("node_id") == node).groupBy("other").agg(F.bool_or(F.col("way") == "out").alias("outgoing"), F.bool_or(F.col("way") == "in").alias("incoming"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ids(node_id)."""
    keep = ids.select("node_id").distinct()
    return edges.join(keep, edges["src"] == keep["node_id"], "left_semi").join(keep, F.col("dst") == keep["node_id"], "left_semi")


def neighborhood(edges: DataFrame, node: str) -> DataFrame:
    """Edges at the node, and those among its neighbours."""
    near = neighbors(edges, node).select(F.col("other").alias("node_id"))
    at = edges.filter((F.col("src") == node) | (F.col("dst") == node))
    return at.union(induced(edges, near)).distinct()


def one_hop(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """ids and all their neighbours."""
    keep = ids.select("node_id").distinct()
    return keep.union(both_ways(edges).join(keep, "node_id", "left_semi").select(F.col("other").alias("node_id"))).distinct()


def capped_neighbors(edges: DataFrame, scored: DataFrame, strong: float = 0.9, many: int = 5, few: int = 2) -> DataFrame:
    """scored(node_id, similarity) -> (node_id, other): at most `many` neighbours of strong matches and `few` of others, by id."""
    near = both_ways(edges).select("node_id", "other").join(scored.select("node_id").distinct(), "node_id", "left_semi")  # other ends aren't shuffled
    rows = near.distinct().join(scored, "node_id")
    rank = F.row_number().over(W.partitionBy("node_id").orderBy("other"))
    return rows.withColumn("k", rank).filter(F.col("k") <= F.when(F.col("similarity") >= strong, many).otherwise(few)).select("node_id", "other")


def allowed_edges(edges: DataFrame, without_types: list[str] = (), without_edges: list[str] = (), only: list[str] | None = None) -> DataFrame:
    keep = ~F.col("src_type").isin(*without_types) & ~F.col("dst_type").isin(*without_types) if without_types else F.lit(True)
    if without_edges:
        keep = keep & ~F.col("edge_type").isin(*without_edges)
    return edges.filter(keep if only is None else keep & F.col("edge_type").isin(*only))


def type_counts(nodes: DataFrame, part: str = "") -> DataFrame:
    """Nodes per type whose name contains `part`."""
    return nodes.filter(F.contains(F.lower("type"), F.lit(part.lower()))).groupBy("type").agg(F.count("*").alias("n"))


def attribute_index(props: DataFrame, most: int = 100) -> DataFrame:
    """(prop, s_val) -> the ids that have it, the first `most` by id; values of one node are left out. Ranks come from a
    window over one value's rows only after values of a single node are gone."""
    n = props.groupBy("prop", "s_val").agg(F.count("*").alias("n")).filter("n > 1")
    ranked = props.join(n, ["prop", "s_val"]).withColumn("k", F.row_number().over(W.partitionBy("prop", "s_val").orderBy("node_id")))
    return ranked.filter(F.col("k") <= most).select("prop", "s_val", "node_id", "n")


# --- structure


def summary(nodes: DataFrame, edges: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """One row: counts, density E / (N (N - 1)), greatest and mean degree; `counted` gives the degrees if they are known."""
    d = (degrees(edges) if counted is None else counted).agg(F.max("total_degree").alias("max_degree"), F.sum(F.col("in_degree") + F.col("out_degree")).alias("ends"))
    n = nodes.agg(F.count("*").alias("n_nodes"), F.count_distinct("type").alias("n_types"))
    e = edges.agg(F.count("*").alias("n_edges"), F.count_distinct("edge_type").alias("n_edge_types"))
    return n.crossJoin(e).crossJoin(d).select("n_nodes", "n_types", "n_edges", "n_edge_types", F.round(F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)), 9).alias("density"), "max_degree", F.round(F.col("ends") / F.col("n_nodes"), 6).alias("avg_degree"))


def type_census(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src_type", "edge_type", "dst_type").agg(F.count("*").alias("n"))


def attributes_summary(nodes: DataFrame, edges: DataFrame, props: DataFrame, most: int = 100) -> DataFrame:
    """(what, name, n): nodes by type and by hierarchy, edges by type, properties by name, components, the largest of them, and
    the diameter of a connected graph of `most` nodes at most, null otherwise."""
    of = lambda df, what, c: df.groupBy(F.col(c).cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "name", "n")
    found = of(nodes, "type", "type").union(of(nodes, "hierarchy", "hierarchy")).union(of(edges, "edge_type", "edge_type")).union(of(props, "property", "prop"))
    sizes = nodes.select("node_id").join(weak_labels(edges), "node_id", "left").groupBy(F.coalesce("component", "node_id").alias("c")).agg(F.count("*").alias("n"))
    one = sizes.agg(F.count("*").alias("components"), F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    whole = diameter(edges) if one["components"] == 1 and one["total"] <= most else None
    more = [("structure", "components", one["components"]), ("structure", "largest_component", one["largest"]), ("structure", "diameter", whole)]
    return found.union(nodes.sparkSession.createDataFrame(more, "what string, name string, n long"))


def diameter(edges: DataFrame) -> int:
    """The longest of the shortest paths of a small connected undirected graph, whose edges are brought to the driver."""
    near: dict[str, set] = {}
    for r in edges.select("src", "dst").distinct().collect():
        near.setdefault(r["src"], set()).add(r["dst"])
        near.setdefault(r["dst"], set()).add(r["src"])
    longest = 0
    for start in near:
        seen, front, steps = {start}, {start}, 0
        while front := {y for x in front for y in near[x]} - seen:
            seen |= front
            steps += 1
        longest = max(longest, steps)
    return longest


def two_hop_census(edges: DataFrame) -> DataFrame:
    """How many two-edge paths (a, e1, b, e2, c) there are of each kind, if more than one. Paths aren't made: through each
    middle node go the product of its incoming and outgoing counts, so the join has a row per node and kind."""
    into = edges.groupBy(F.col("dst").alias("mid"), F.col("src_type").alias("a"), F.col("edge_type").alias("e1"), F.col("dst_type").alias("b")).agg(F.count("*").alias("i"))
    out = edges.groupBy(F.col("src").alias("mid"), F.col("edge_type").alias("e2"), F.col("dst_type").alias("c")).agg(F.count("*").alias("o"))
    return into.join(out, "mid").groupBy("a", "e1", "b", "e2", "c").agg(F.sum(F.col("i") * F.col("o")).cast("long").alias("n")).filter("n > 1")


def chains(edges: DataFrame, steps: list[tuple[str, str, str]]) -> DataFrame:
    """Paths along (type, edge type, type) steps without a repeated node: columns n0, n1, ..."""
    found = None
    for i, (a, kind, b) in enumerate(steps):
        step = edges.filter((F.col("src_type") == a) & (F.col("edge_type") == kind) & (F.col("dst_type") == b)).select(F.col("src").alias(f"n{i}"), F.col("dst").alias(f"n{i + 1}"))
        found = step if found is None else found.join(step, f"n{i}").filter(reduce(lambda x, y: x & y, [F.col(f"n{i + 1}") != F.col(f"n{k}") for k in range(i + 1)]))
    return found.select(*[f"n{i}" for i in range(len(steps) + 1)])


def stars(edges: DataFrame, center: str, kind: str, least: int = 2) -> DataFrame:
    """Centres of a type with at least `least` edges of a kind."""
    return edges.filter((F.col("src_type") == center) & (F.col("edge_type") == kind)).groupBy(F.col("src").alias("center")).agg(F.count("*").alias("leaves")).filter(F.col("leaves") >= least)


def cycles(edges: DataFrame, steps: list[tuple[str, str, str]]) -> DataFrame:
    """Cycles along (type, edge type, type) steps of three or more, the last of which leads back to the first node; columns n0,
    n1, ... A cycle whose steps repeat is found from each of its nodes that can begin it."""
    if len(steps) < 3 or steps[-1][2] != steps[0][0]:
        raise ValueError("a cycle has three steps or more and ends where it begins")
    path = chains(edges, steps[:-1])
    a, kind, b = steps[-1]
    last = len(steps) - 1
    back = edges.filter((F.col("src_type") == a) & (F.col("edge_type") == kind) & (F.col("dst_type") == b)).select(F.col("src").alias(f"n{last}"), F.col("dst").alias("n0"))
    return path.join(back, ["n0", f"n{last}"], "left_semi").select(*[f"n{i}" for i in range(last + 1)])


def motif(edges: DataFrame, node_types: list[str], edge_types: list[str], pattern: str = "chain") -> DataFrame:
    """Chains, stars or cycles by the types of their nodes and edges."""
    if pattern == "star":
        return stars(edges.filter(F.col("dst_type") == node_types[1]), node_types[0], edge_types[0])
    ring = pattern == "cycle"
    steps = list(zip(node_types, edge_types, [*node_types[1:], *node_types[:1]] if ring else node_types[1:]))
    return cycles(edges, steps) if ring else chains(edges, steps)


def triangles(edges: DataFrame) -> DataFrame:
    """Undirected triangles a < b < c. Each edge runs from its end of lower degree, so that a hub isn't paired with itself."""
    both = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()
    d = both_ways(both.select(F.col("a").alias("src"), F.col("b").alias("dst"))).groupBy("node_id").agg(F.count("*").alias("d"))
    da, db = (d.select(F.col("node_id").alias(k), F.col("d").alias(f"d{k}")) for k in "ab")
    way = both.join(da, "a").join(db, "b")
    low = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    arcs = way.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedges = arcs.alias("p").join(arcs.alias("q"), F.expr("p.x = q.x AND p.y < q.y")).select(F.col("p.x").alias("x"), F.col("p.y").alias("a"), F.col("q.y").alias("b"))
    closed = wedges.join(both, ["a", "b"])
    s = F.array_sort(F.array("x", "a", "b"))
    return closed.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every greater neighbour is linked to the node's least one. Small: every smaller one and the node itself are."""
    if large:
        sides = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = sides.join(least, "u")
    if large:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def weak_labels(edges: DataFrame) -> DataFrame:
    """(node_id, component): the least id reachable, by large-star and small-star steps until a round changes nothing, which
    takes about log(n) rounds on a path too."""
    from .tables import materialise

    ends = materialise(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).dropna().distinct())
    now = materialise(ends.filter("u <> v"))
    while True:
        before, now = now, materialise(_star(_star(now, True), False))
        if now.count() == before.count() and now.join(before, ["u", "v"], "left_anti").isEmpty():
            break
    every = ends.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    return every.join(now.select(F.col("u").alias("node_id"), F.col("v").alias("component")), "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def is_tree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: whether the graph is connected and has one edge less than nodes."""
    apart = nodes.select("node_id").join(weak_labels(edges), "node_id", "left").select(F.coalesce("component", "node_id").alias("c")).distinct().agg(F.count("*").alias("components"))
    counts = nodes.agg(F.count("*").alias("n")).crossJoin(edges.agg(F.count("*").alias("e"))).crossJoin(apart)
    return counts.select("n", "e", "components", ((F.col("components") == 1) & (F.col("e") == F.col("n") - 1)).alias("is_tree"))


def has_cycle(edges: DataFrame) -> bool:
    """Whether the directed graph has a cycle: nodes without incoming edges are peeled off until none is left or none goes.
    Between two peels, some nodes with one incoming edge are merged into its source, which neither makes nor breaks a cycle
    (one of the two alone becomes a loop), so that a chain takes about log(n) rounds."""
    from .tables import materialise

    now = materialise(edges.select("src", "dst").dropna().distinct())
    left, i = now.count(), 0
    while left:
        heads = now.select(F.col("dst").alias("src")).distinct()
        peeled = materialise(now.join(heads, "src", "left_semi"))
        size = peeled.count()
        if size in (0, left):
            return size > 0
        if not peeled.filter("src = dst").isEmpty():
            return True
        coin = lambda c: F.xxhash64(F.lit(i), c).bitwiseAND(F.lit(1))
        single = peeled.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("up")).filter("n = 1")
        merged = single.filter((coin(F.col("dst")) == 1) & (coin(F.col("up")) == 0)).select(F.col("dst").alias("gone"), "up")
        rest = peeled.join(merged.select(F.col("gone").alias("dst")), "dst", "left_anti").join(merged, F.col("src") == F.col("gone"), "left")
        now = materialise(rest.select(F.coalesce("up", "src").alias("src"), "dst").distinct())
        left, i = now.count(), i + 1
    return False


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node_id, distance) within `depth` directed steps of start(node_id), the least distance of each."""
    found = start.select("node_id", F.lit(0).alias("distance"))
    now = found
    for d in range(1, depth + 1):
        step = now.join(edges, F.col("node_id") == F.col("src")).select(F.col("dst").alias("node_id")).distinct().withColumn("distance", F.lit(d))
        now = step.join(found.select("node_id"), "node_id", "left_anti")
        found = found.union(now)
    return found.groupBy("node_id").agg(F.min("distance").alias("distance"))


def display_sample(nodes: DataFrame, rare: int = 50, few: int = 3, more: int = 5) -> DataFrame:
    """A sample for display: `few` nodes of each type, `more` of rare types, by id. The feature is the limit."""
    n = nodes.groupBy("type").agg(F.count("*").alias("_n"))
    k = F.row_number().over(W.partitionBy("type").orderBy("node_id"))
    return nodes.join(F.broadcast(n), "type").withColumn("_k", k).filter(F.col("_k") <= F.when(F.col("_n") < rare, more).otherwise(few)).select("node_id", "type")


# --- rewrites


def upsert(df: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of changes replace rows of equal key and add the others; of several changes to a key the last by `seq` counts."""
    last = changes.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("seq")))).filter("_k = 1").drop("_k", "seq")
    return df.join(last, key, "left_anti").unionByName(last)


def add_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with the new ones, refused(src, dst, edge_type, reason)): an edge is refused if an end isn't a node or the edge is
    there already; of repeated new ones one is added."""
    key = ["src", "dst", "edge_type"]
    ids = nodes.select(F.col("node_id").alias("id"))
    no_src = new.join(ids, F.col("src") == F.col("id"), "left_anti").select(*key, F.lit("no source").alias("reason"))
    no_dst = new.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_anti").select(*key, F.lit("no target"))
    whole = new.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")
    there = whole.join(edges.select(*key), key, "left_semi").select(*key, F.lit("already there"))
    good = whole.join(edges.select(*key), key, "left_anti").dropDuplicates(key)
    return edges.unionByName(good.select(*edges.columns)), no_src.union(no_dst).union(there).distinct()


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the edges of gone(src, dst, edge_type)."""
    return edges.join(gone.select("src", "dst", "edge_type").distinct(), ["src", "dst", "edge_type"], "left_anti")


def update_attributes(props: DataFrame, changes: DataFrame) -> DataFrame:
    """props with the values of changes(node_id, type, prop, s_val, d_val, seq): new properties are added, those that are there
    replaced, of several changes the last counts."""
    return upsert(props, changes, ["node_id", "prop"])


def simple(edges: DataFrame) -> DataFrame:
    """One edge for each ordered pair of nodes, the first by edge type."""
    return edges.groupBy("src", "dst").agg(F.min("edge_type").alias("edge_type"))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, edge_type) with a <= b, each once."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "edge_type").distinct()


def connected(edges: DataFrame, ids: DataFrame, edge_type: str | None = None, way: str = "both") -> DataFrame:
    """(node_id, other) for ids(node_id): what edges of a type lead to (out), come from (in), or both."""
    e = edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type)
    out = e.select(F.col("src").alias("node_id"), F.col("dst").alias("other"))
    into = e.select(F.col("dst").alias("node_id"), F.col("src").alias("other"))
    rows = out if way == "out" else into if way == "in" else out.union(into)
    return rows.join(ids.select("node_id").distinct(), "node_id", "left_semi").distinct()


def edge_attribute_index(edges: DataFrame, attribute: str, most: int = 100) -> DataFrame:
    """(value, src, dst, n): the first `most` edges of each value of an attribute that several edges have."""
    n = edges.groupBy(F.col(attribute).alias("value")).agg(F.count("*").alias("n")).filter("n > 1")
    ranked = edges.select(F.col(attribute).alias("value"), "src", "dst").withColumn("k", F.row_number().over(W.partitionBy("value").orderBy("src", "dst"))).filter(F.col("k") <= most)
    return ranked.join(n, "value").select("value", "src", "dst", "n")


def tree_reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(start, reached, is_tree) for start(node_id): how many nodes directed steps reach, and whether none is reached twice, that
    is, the edges among them are one less than they are. Steps go on until nothing new is found; each is written out."""
    from .tables import materialise

    e = materialise(edges.select("src", "dst").distinct())
    seen = materialise(start.select(F.col("node_id").alias("start"), "node_id").distinct())
    front = seen
    while not front.isEmpty():
        step = front.join(e, F.col("node_id") == F.col("src")).select("start", F.col("dst").alias("node_id")).distinct()
        front = materialise(step.join(seen, ["start", "node_id"], "left_anti"))
        seen = materialise(seen.union(front))
    inside = seen.join(e, F.col("node_id") == F.col("src")).groupBy("start").agg(F.count("*").alias("edges"))
    n = seen.groupBy("start").agg(F.count("*").alias("reached")).join(inside, "start", "left")
    return n.select("start", "reached", (F.coalesce("edges", F.lit(0)) == F.col("reached") - 1).alias("is_tree"))


def sampled(nodes: DataFrame, edges: DataFrame, most: int = 1000, rare: int = 50) -> DataFrame:
    """(node_id, type) to show: all of a graph of up to `most` nodes; else min(100, most // 3) of them, first up to three of each
    type (five of rare ones), then the ends of three edges of each edge type, then those of most neighbours; ties by id."""
    if nodes.count() <= most:
        return nodes.select("node_id", "type")
    few = min(100, most // 3)
    share = nodes.groupBy("type").agg(F.count("*").alias("n"))  # a row a type
    ranked = firsts(nodes.select("node_id", "type"), "type", ["node_id"], 5).join(F.broadcast(share), "type")
    first = ranked.filter(F.col("k") <= F.when(F.col("n") < rare, 5).otherwise(3)).select("node_id", F.lit(0).alias("tier"), F.lit(0).cast("long").alias("weight"))
    three = firsts(edges.select("edge_type", "src", "dst"), "edge_type", ["src", "dst"], 3)
    ends = three.select(F.explode(F.array("src", "dst")).alias("node_id"), F.lit(1).alias("tier"), F.lit(0).cast("long").alias("weight"))
    top = degrees(edges).orderBy(F.desc("total_degree"), "node_id").limit(few).select("node_id", F.lit(2).alias("tier"), F.col("total_degree").alias("weight"))
    best = first.union(ends).union(top).groupBy("node_id").agg(F.min(F.struct("tier", (-F.col("weight")).alias("w"))).alias("x"))
    return nodes.select("node_id", "type").join(F.broadcast(best.orderBy("x", "node_id").limit(few).select("node_id")), "node_id", "left_semi")


def firsts(df: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """df with k, the place from 1 in its group: the first `most` of each group. The window has nothing beside the place, so that
    Spark cuts each partition to its own first ones before any are brought together: no task has a group whole."""
    return df.withColumn("k", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("k") <= most)


def collapse_stats(nodes: DataFrame, edges: DataFrame, kinds: list[str], drop_orphans: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, stats) after collapse(): the edges are gone, with drop_orphans also nodes that only they led to."""
    gone = edges.filter(F.col("edge_type").isin(*kinds))
    rest = edges.filter(~F.col("edge_type").isin(*kinds))
    targets = gone.select(F.col("dst").alias("node_id")).distinct()
    used = both_ways(rest).select("node_id").union(gone.select("src")).distinct()
    orphans = targets.join(used, "node_id", "left_anti")
    kept = nodes.join(orphans, "node_id", "left_anti") if drop_orphans else nodes
    stats = gone.agg(F.count("*").alias("edges_collapsed"), F.count_distinct("src").alias("nodes_changed")).crossJoin(orphans.agg(F.count("*").alias("orphans")))  # one row each
    return kept, rest, stats


def merged_attributes(props: DataFrame, members: DataFrame) -> DataFrame:
    """(prop, values) of the nodes of members(node_id): the different values of each property, in order, as a node that takes
    them in would have."""
    return props.join(members.select("node_id"), "node_id", "left_semi").groupBy("prop").agg(F.array_join(F.array_sort(F.collect_set("s_val")), "|").alias("values"))


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of gone(node_id) and the edges at them."""
    g = gone.select("node_id").distinct()
    return nodes.join(g, "node_id", "left_anti"), edges.join(g, F.col("src") == g["node_id"], "left_anti").join(g, F.col("dst") == g["node_id"], "left_anti")


def collapse(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Edges of the given types as attributes: (node_id, attr, values, ids) per source and edge type, sorted lists."""
    far = nodes.select(F.col("node_id").alias("dst"), F.col("value").alias("v"))
    rows = edges.filter(F.col("edge_type").isin(*kinds)).join(far, "dst")
    pairs = F.array_sort(F.collect_list(F.struct(F.col("dst").alias("i"), F.col("v"))))
    found = rows.groupBy(F.col("src").alias("node_id"), F.col("edge_type").alias("attr")).agg(pairs.alias("x"))
    return found.select("node_id", "attr", F.array_join("x.v", "|").alias("values"), F.array_join("x.i", "|").alias("ids"))


def expand(props: DataFrame, prefix: str = "", suffix: str = "") -> tuple[DataFrame, DataFrame]:
    """Attributes whose name has the prefix and suffix become nodes per value, and edges to them."""
    rows = props.filter(F.col("prop").startswith(prefix) & F.col("prop").endswith(suffix))
    own = F.concat_ws(":", "prop", "s_val")
    return rows.select(own.alias("node_id"), F.col("prop").alias("type"), F.col("s_val").alias("value")).distinct(), rows.select(F.col("node_id").alias("src"), own.alias("dst"), F.concat(F.lit("has_"), F.col("prop")).alias("edge_type")).distinct()


def subsume(nodes: DataFrame, edges: DataFrame, members: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """Nodes for which members holds become one node; edges inside go, those across its boundary move to it."""
    inside = nodes.filter(members).select(F.col("node_id").alias("_m"))
    kinds = nodes.filter(members).agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias("type"), F.count("*").alias("members"))
    one = kinds.select(F.lit(name).alias("node_id"), "type", F.col("members").cast("string").alias("value"))
    rest = nodes.filter(~F.coalesce(members, F.lit(False))).select("node_id", "type", "value")
    a = edges.join(inside, F.col("src") == F.col("_m"), "left").withColumn("s", F.when(F.col("_m").isNotNull(), F.lit(name)).otherwise(F.col("src"))).drop("_m")
    b = a.join(inside, F.col("dst") == F.col("_m"), "left").withColumn("d", F.when(F.col("_m").isNotNull(), F.lit(name)).otherwise(F.col("dst")))
    moved = b.filter(~((F.col("s") == name) & (F.col("d") == name))).select(F.col("s").alias("src"), F.col("d").alias("dst"), "edge_type").distinct()
    return rest.union(one), moved
