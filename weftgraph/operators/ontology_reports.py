"""Ontologies as a whole: extraction, summary, suggestions, comparison, merge, change log.

An ontology is a dictionary of small frames: types(type, n), type_props(type, prop), edge_types(edge_type, n),
relationships(src_type, edge_type, dst_type, n), profile (rules.profile) and choices(type, prop, choices). Their rows grow
with the types and not with the graph; reports are joins and aggregates of these.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import ontology, rules, selection
from .tables import in_pieces, materialise

#: Ends that are made distinct in one task, which holds them.
AT_ONCE = 500_000

#: Terms of hierarchies in edge names.
HIERARCHY = ("parent", "child", "contains", "part_of", "belongs_to", "member_of")
KEY = ["src_type", "edge_type", "dst_type"]


def extract(nodes: DataFrame, edges: DataFrame, props: DataFrame) -> dict[str, DataFrame]:
    """The ontology of a graph. Its frames are written once, as every report reads them several times."""
    profiled, related = materialise(rules.profile(props)), materialise(ontology.relationships(edges))
    return {
        "types": materialise(nodes.groupBy(F.coalesce("type", F.lit("Unknown")).alias("type")).agg(F.count("*").alias("n"))),
        "type_props": profiled.select("type", "prop"),
        "edge_types": materialise(related.groupBy("edge_type").agg(F.sum("n").alias("n"))),
        "relationships": related,
        "profile": profiled,
        "choices": materialise(rules.choices(props, profiled)),
    }


def type_analysis(nodes: DataFrame, edges: DataFrame, props: DataFrame) -> DataFrame:
    """(type, section, name, value, share): all that is told of a type, as one table. Sections: nodes (how many there are, their
    share of all); hierarchy (how many at each level, their share of the type); property (how many have it, their share);
    outgoing and incoming (edges by relationship, their share of the type's edges that way); degree (least, greatest, mean and
    median number of edge ends of a node, those without edges among them)."""
    n = nodes.groupBy("type").agg(F.count("*").alias("n"))
    total = F.broadcast(n)  # a row per type
    every = n.agg(F.sum("n").alias("every"))
    row = lambda df, section, name, value, share: df.select("type", F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("double").alias("value"), share.cast("double").alias("share"))
    share = F.col("k") / F.col("n")
    found = [row(n.crossJoin(every), "nodes", F.lit("count"), F.col("n"), F.col("n") / F.col("every"))]
    level = nodes.groupBy("type", "hierarchy").agg(F.count("*").alias("k")).join(total, "type")
    found.append(row(level, "hierarchy", F.coalesce(F.col("hierarchy").cast("string"), F.lit("none")), F.col("k"), share))
    have = props.select("type", "prop", "node_id").distinct().groupBy("type", "prop").agg(F.count("*").alias("k")).join(total, "type")
    found.append(row(have, "property", F.col("prop"), F.col("k"), share))
    r = materialise(ontology.relationships(edges))
    for section, mine, other in (("outgoing", "src_type", "dst_type"), ("incoming", "dst_type", "src_type")):
        mine_all = F.sum("n").over(W.partitionBy(mine))  # a row per relationship
        x = r.withColumn("m", mine_all).withColumnRenamed(mine, "type")
        found.append(row(x, section, F.concat_ws(" ", "edge_type", other), F.col("n"), F.col("n") / F.col("m")))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("d"))
    d = materialise(nodes.select("node_id", "type").join(ends, "node_id", "left").select("type", F.coalesce("d", F.lit(0)).alias("d")))
    stats = d.groupBy("type").agg(F.min("d").alias("least"), F.max("d").alias("greatest"), F.avg("d").alias("mean")).join(selection.quantile(d, ["type"], "d", 0.5, "median"), "type")
    each = stats.select("type", F.explode(F.create_map(*[x for c in ("least", "greatest", "mean", "median") for x in (F.lit(c), F.col(c).cast("double"))])).alias("name", "v"))
    found.append(row(each, "degree", F.col("name"), F.col("v"), F.lit(None)))
    return reduce(DataFrame.union, found)


def extraction_summary(o: dict[str, DataFrame]) -> DataFrame:
    """One row: how many nodes, edges, types of both and relationships."""
    t = o["types"].agg(F.count("*").alias("node_types"), F.sum("n").alias("nodes"))
    e = o["edge_types"].agg(F.count("*").alias("edge_types"), F.sum("n").alias("edges"))
    return t.crossJoin(e).crossJoin(o["relationships"].agg(F.count("*").alias("relationships")))  # one row each


def _listed(df: DataFrame, name: str, label: Column, value: Column, k: int | None, detail: Column | None = None) -> DataFrame:
    """Rows (list, place, name, value, detail) of the k greatest values, ties by name; all if k is None."""
    x = df.select(label.alias("name"), value.cast("double").alias("value"), (F.lit("") if detail is None else detail).alias("detail"))
    if k is not None:
        x = x.orderBy(F.desc("value"), "name").limit(k)
    return x.select(F.lit(name).alias("list"), "name", "value", "detail")


def summary(o: dict[str, DataFrame]) -> DataFrame:
    """The ontology's summary as lists: most frequent and property-rich types, common patterns, central types, hierarchy
    indicators, common properties, unique identifiers (of more than one value) and enumerations."""
    counts = o["type_props"].groupBy("type").agg(F.count("*").alias("props"))
    types = o["types"].join(F.broadcast(counts), "type", "left").na.fill(0, ["props"])
    rel = o["relationships"]
    out = rel.select(F.col("src_type").alias("type"), F.col("dst_type").alias("o")).distinct().groupBy("type").agg(F.count("*").alias("out"))
    into = rel.select(F.col("dst_type").alias("type"), F.col("src_type").alias("i")).distinct().groupBy("type").agg(F.count("*").alias("in"))
    central = out.join(into, "type", "full").na.fill(0, ["out", "in"])
    loops = rel.filter(F.col("src_type") == F.col("dst_type"))
    told = F.lit(False)
    for t in HIERARCHY:
        told = told | F.contains(F.lower("edge_type"), F.lit(t))
    named = F.concat_ws(".", "type", "prop")
    lists = [
        _listed(types, "most_frequent_types", F.col("type"), F.col("n"), 5),
        _listed(types, "property_rich_types", F.col("type"), F.col("props"), 5),
        _listed(o["edge_types"], "most_frequent_edges", F.col("edge_type"), F.col("n"), 5),
        _listed(rel, "common_patterns", F.concat_ws(" > ", *KEY), F.col("n"), 10),
        _listed(central, "central_types", F.col("type"), F.col("out") + F.col("in"), 5),
        _listed(loops.filter(told), "hierarchy_indicators", F.concat_ws(" > ", *KEY), F.col("n"), None),
        _listed(o["type_props"].groupBy("prop").agg(F.count("*").alias("n")), "common_properties", F.col("prop"), F.col("n"), 10),
        _listed(o["profile"].filter("n_unique = present AND present > 1"), "unique_identifiers", named, F.col("present"), None),
        _listed(o["profile"].join(F.broadcast(o["choices"]), ["type", "prop"]), "enumerations", named, F.col("present"), None, F.array_join("choices", "|")),
    ]
    found = lists[0]
    for x in lists[1:]:
        found = found.union(x)
    return found


def naming(name: Column) -> Column:
    """The style of a type's name."""
    low, up = (name == F.lower(name)) & (name != F.upper(name)), (name == F.upper(name)) & (name != F.lower(name))
    first, score, space = F.substring(name, 1, 1), F.contains(name, F.lit("_")), F.contains(name, F.lit(" "))
    capital, more = (first == F.upper(first)) & (first != F.lower(first)), F.substring(name, 2, 1 << 20).rlike(r"\p{Lu}")
    style = F.when(low & score, "snake_case").when(low & ~space & ~score, "lowercase").when(up, "UPPERCASE")
    style = style.when(capital & ~score & ~space & more, "PascalCase").when(capital & ~score & ~space, "unknown")
    return style.when(~capital & name.rlike(r"\p{Lu}"), "camelCase").otherwise("unknown")


def property_naming(name: Column) -> Column:
    """The style of a property's name; one capital is enough for PascalCase."""
    plain = naming(name)
    first = F.substring(name, 1, 1)
    return F.when((plain == "unknown") & (first == F.upper(first)) & (first != F.lower(first)) & ~F.contains(name, F.lit("_")) & ~F.contains(name, F.lit(" ")), "PascalCase").otherwise(plain)


def suggestions(o: dict[str, DataFrame], with_hierarchy: bool = False) -> DataFrame:
    """(kind, severity, subject, detail): what the ontology could do better. with_hierarchy tells whether nodes have a
    hierarchy attribute."""
    row = lambda df, kind, severity, subject, detail: df.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), subject.alias("subject"), detail.cast("string").alias("detail"))
    names = o["types"].select(F.col("type").alias("name")).union(o["edge_types"].select("edge_type"))
    styles = names.groupBy(naming(F.col("name")).alias("style")).agg(F.count("*").alias("n"))
    top = styles.agg(F.max(F.struct("n", "style")).alias("m"), F.sum("n").alias("total"))
    found = [row(top.filter(F.col("m.n") < 0.7 * F.col("total")), "naming_inconsistency", "medium", F.lit("types"), F.col("m.style"))]
    total = F.broadcast(o["types"].agg(F.sum("n").alias("total")))
    sparse = o["types"].crossJoin(total).filter(F.col("n") < F.greatest(F.lit(3.0), 0.005 * F.col("total")))  # the total is one row
    found.append(row(sparse, "sparse_node_type", "low", F.col("type"), F.col("n")))
    mixed = o["type_props"].groupBy("type").agg(F.count_distinct(property_naming(F.col("prop"))).alias("styles"), F.count("*").alias("n")).filter("styles > 1 AND n > 3")
    found.append(row(mixed, "inconsistent_property_naming", "low", F.col("type"), F.col("styles")))
    named = F.concat_ws(".", "type", "prop")
    counted = o["profile"].join(F.broadcast(o["types"].select("type", "n")), "type")
    share = F.col("present") / F.col("n")
    found.append(row(counted.filter((share >= 0.9) & (share < 1)), "incomplete_required_property", "medium", named, F.concat_ws(" of ", "present", "n")))
    found.append(row(o["edge_types"].filter("edge_type = 'unspecified'"), "unnamed_edge_type", "high", F.col("edge_type"), F.col("n")))
    between = o["relationships"].groupBy("src_type", "dst_type").agg(F.array_sort(F.collect_set("edge_type")).alias("names")).filter(F.size("names") > 1)
    alike = F.forall("names", lambda a: F.forall("names", lambda b: F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))))
    found.append(row(between.filter(alike), "similar_edge_types", "medium", F.concat_ws(" > ", "src_type", "dst_type"), F.array_join("names", ",")))
    ends = o["relationships"].select(F.explode(F.array("src_type", "dst_type")).alias("type")).distinct()
    found.append(row(o["types"].join(ends, "type", "left_anti"), "disconnected_type", "high", F.col("type"), F.col("n")))
    told = F.lit(False)
    for t in HIERARCHY:
        told = told | F.contains(F.lower("edge_type"), F.lit(t))
    none = o["edge_types"].agg(F.coalesce(F.bool_or(told), F.lit(False)).alias("some")).filter(~F.col("some") & F.lit(with_hierarchy))
    found.append(row(none, "implicit_hierarchy", "medium", F.lit("hierarchy"), F.lit("")))
    found.append(row(o["profile"].filter("n_text > 0 AND n_number > 0"), "mixed_property_types", "medium", named, F.col("kind")))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def _sides(mine: DataFrame, other: DataFrame, key: list[str], kind: str, label: Column) -> DataFrame:
    """(kind, name, side): in both, in mine only or in the other only."""
    j = mine.select(*key).distinct().withColumn("m", F.lit(1)).join(other.select(*key).distinct().withColumn("o", F.lit(1)), key, "full")
    return j.select(F.lit(kind).alias("kind"), label.alias("name"), F.when(F.col("o").isNull(), "only_mine").when(F.col("m").isNull(), "only_other").otherwise("common").alias("side"))


def compare(mine: dict[str, DataFrame], other: dict[str, DataFrame]) -> DataFrame:
    """(kind, name, side) of node types, edge types, relationships, and of the properties of types that both have."""
    t = _sides(mine["types"], other["types"], ["type"], "node_type", F.col("type"))
    e = _sides(mine["edge_types"], other["edge_types"], ["edge_type"], "edge_type", F.col("edge_type"))
    r = _sides(mine["relationships"], other["relationships"], KEY, "relationship", F.concat_ws(" > ", *KEY))
    both = F.broadcast(mine["types"].select("type").join(other["types"].select("type"), "type", "left_semi"))
    p = _sides(mine["type_props"].join(both, "type", "left_semi"), other["type_props"].join(both, "type", "left_semi"), ["type", "prop"], "property", F.concat_ws(".", "type", "prop"))
    return t.union(e).union(r).union(p)


def similarity(compared: DataFrame) -> DataFrame:
    """compare() -> one row: the Jaccard of node types, edge types and relationships, their mean, and three insights: a
    significant change, an expansion by the other, a refinement of properties."""
    is_ = lambda k, s=None: (F.col("kind") == k) & (F.lit(True) if s is None else F.col("side") == s)
    kinds = {"node_types": "node_type", "edge_types": "edge_type", "relationships": "relationship"}
    split = F.when(F.col("kind") == "property", F.substring_index("name", ".", 1))
    g = compared.agg(
        *[F.count_if(is_(k, "common")).alias(f"{n}_common") for n, k in kinds.items()], *[F.count_if(is_(k)).alias(f"{n}_all") for n, k in kinds.items()],
        *[F.count_if(is_(k, s)).alias(f"{n}_{s}") for n, k in kinds.items() for s in ("only_mine", "only_other")],
        F.count_distinct(F.when(F.col("side") != "common", split)).alias("differing"),
    )
    j = {n: F.col(f"{n}_common") / F.greatest(F.lit(1), F.col(f"{n}_all")) for n in kinds}
    overall = (j["node_types"] + j["edge_types"] + j["relationships"]) / 3
    more = (F.col("node_types_only_other") > F.col("node_types_only_mine")) & (F.col("edge_types_only_other") > F.col("edge_types_only_mine"))
    refined = (F.col("differing") > 0) & (F.col("differing") / F.greatest(F.lit(1), F.col("node_types_common") + F.col("edge_types_common")) > 0.3)
    return g.select(*[F.round(c, 6).alias(n) for n, c in j.items()], F.round(overall, 6).alias("overall"), (j["node_types"] < 0.7).alias("significant_change"), more.alias("schema_expansion"), refined.alias("property_refinement"))


def merge(mine: dict[str, DataFrame], other: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Counts added up, properties of both, presence added up, unique counts at the greater, ranges widened, choices of both
    where both have some. Kinds and patterns are mine where I have the property."""
    add = lambda name, key: mine[name].select(*key, "n").union(other[name].select(*key, "n")).groupBy(*key).agg(F.sum("n").alias("n"))
    both = mine["profile"].withColumn("first", F.lit(0)).union(other["profile"].select(*mine["profile"].columns).withColumn("first", F.lit(1)))
    lead = lambda c: F.min_by(c, "first").alias(c)
    p = both.groupBy("type", "prop").agg(F.sum("present").alias("present"), F.max("n_unique").alias("n_unique"), F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), lead("kind"), lead("pattern"))
    c = mine["choices"].union(other["choices"]).select("type", "prop", F.explode("choices").alias("v")).groupBy("type", "prop").agg(F.array_sort(F.collect_set("v")).alias("choices"))
    return {"types": add("types", ["type"]), "edge_types": add("edge_types", ["edge_type"]), "relationships": add("relationships", KEY), "type_props": p.select("type", "prop"), "profile": p, "choices": c}


def changes(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """The change log (change, subject, detail): types, edge types and relationships added and removed; types whose properties
    differ, with those added and removed; and, of these types, properties whose kind, range or choices changed."""
    rows = lambda df, change, subject, detail: df.select(F.lit(change).alias("change") if isinstance(change, str) else change.alias("change"), subject.alias("subject"), detail.cast("string").alias("detail"))

    def came_and_went(name: str, key: list[str], what: str, label: Column) -> DataFrame:
        j = old[name].select(*key, F.col("n").alias("a")).join(new[name].select(*key, F.col("n").alias("b")), key, "full").filter("a IS NULL OR b IS NULL")
        return rows(j, F.when(F.col("a").isNull(), f"add_{what}").otherwise(f"remove_{what}"), label, F.coalesce("a", "b"))

    out = came_and_went("types", ["type"], "node_type", F.col("type")).union(came_and_went("edge_types", ["edge_type"], "edge_type", F.col("edge_type"))).union(came_and_went("relationships", KEY, "relationship", F.concat_ws(" > ", *KEY)))
    both = F.broadcast(old["types"].select("type").join(new["types"].select("type"), "type", "left_semi"))
    props = _sides(old["type_props"].join(both, "type", "left_semi"), new["type_props"].join(both, "type", "left_semi"), ["type", "prop"], "property", F.concat_ws(".", "type", "prop"))
    listed = lambda side: F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.substring_index("name", ".", -1)))), ",")
    modified = props.groupBy(F.substring_index("name", ".", 1).alias("type")).agg(listed("only_other").alias("added"), listed("only_mine").alias("removed")).filter("added <> '' OR removed <> ''")
    out = out.union(rows(modified, "modify_node_type", F.col("type"), F.concat(F.lit("+"), F.col("added"), F.lit(" -"), F.col("removed"))))
    touched = F.broadcast(modified.select("type"))
    a, b = (o["profile"].join(F.broadcast(o["choices"]), ["type", "prop"], "left").select("type", "prop", *[F.col(c).alias(f"{c}_{k}") for c in ("kind", "min_value", "max_value", "choices")]) for o, k in ((old, "a"), (new, "b")))
    j = a.join(b, ["type", "prop"]).join(touched, "type", "left_semi")
    named = F.concat_ws(".", "type", "prop")
    span = lambda k: F.concat_ws("..", F.round(f"min_value_{k}", 2).cast("decimal(38,2)").cast("string"), F.round(f"max_value_{k}", 2).cast("decimal(38,2)").cast("string"))
    out = out.union(rows(j.filter("kind_a <> kind_b"), "property_type_change", named, F.concat_ws(" > ", "kind_a", "kind_b")))
    out = out.union(rows(j.filter("min_value_a <> min_value_b OR max_value_a <> max_value_b"), "property_range_change", named, F.concat_ws(" > ", span("a"), span("b"))))
    less = lambda x, y: F.array_join(F.array_except(x, y), "|")
    return out.union(rows(j.filter("choices_a <> choices_b"), "property_enum_change", named, F.concat(F.lit("+"), less("choices_b", "choices_a"), F.lit(" -"), less("choices_a", "choices_b"))))


def impacts(log: DataFrame) -> DataFrame:
    """changes() -> (impact, severity, changes): what kinds of change there are and how grave each is."""
    kind = F.when(F.col("change").isin("add_node_type", "remove_node_type"), "schema_evolution").when(F.col("change").startswith("modify_"), "property_refinement").when(F.col("change").isin("add_relationship", "remove_relationship"), "connectivity_changes")
    g = log.withColumn("impact", kind).filter("impact IS NOT NULL").groupBy("impact").agg(F.count("*").alias("changes"), F.bool_or(F.col("change") == "remove_node_type").alias("removed"))
    return g.select("impact", F.when(F.col("removed"), "high").otherwise("medium").alias("severity"), "changes")


def type_motifs(edges: DataFrame) -> DataFrame:
    """Chains of a common relationship and any that goes on from its target type, with the lesser of both counts."""
    p = ontology.patterns(edges)
    a = p.filter("common").select(F.col("src_type").alias("a"), F.col("edge_type").alias("e1"), F.col("dst_type").alias("b"), F.col("n").alias("n1"))
    b = p.select(F.col("src_type").alias("b"), F.col("edge_type").alias("e2"), F.col("dst_type").alias("c"), F.col("n").alias("n2"))
    return a.join(F.broadcast(b), "b").select("a", "e1", "b", "e2", "c", F.least("n1", "n2").alias("n"))


def relationship_lookup(edges: DataFrame, src_type: str | None = None, edge_type: str | None = None, dst_type: str | None = None, examples: int = 3) -> DataFrame:
    """Relationships that match the given parts, with their counts and up to `examples` edges, the least ones."""
    e = edges
    for column, wanted in (("src_type", src_type), ("edge_type", edge_type), ("dst_type", dst_type)):
        if wanted is not None:
            e = e.filter(F.col(column) == wanted)
    first = e.withColumn("k", F.row_number().over(W.partitionBy(*KEY).orderBy("src", "dst"))).filter(F.col("k") <= examples)
    shown = first.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst"))), lambda x: F.concat_ws(">", x["src"], x["dst"])), "|").alias("examples"))
    return ontology.relationships(e).join(F.broadcast(shown), KEY)


def relationship_distribution(edges: DataFrame) -> DataFrame:
    """Per class of cardinality how many relationships have it, with their edges."""
    c = ontology.cardinality(edges).join(ontology.relationships(edges), KEY)
    return c.groupBy("cardinality").agg(F.count("*").alias("relationships"), F.sum("n").alias("edges"))


def most_connected(edges: DataFrame, k: int = 5) -> DataFrame:
    """(side, type, n): the types with the most edges out of and into them, the k first of each."""
    r = ontology.relationships(edges)
    out = r.groupBy(F.col("src_type").alias("type")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "type").limit(k)
    into = r.groupBy(F.col("dst_type").alias("type")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "type").limit(k)
    return out.select(F.lit("out").alias("side"), "type", "n").union(into.select(F.lit("in"), "type", "n"))


def cardinality_details(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per relationship: least, greatest, mean and median of targets per source and sources per target, the share of either
    type's nodes that take part, the density and the class."""
    pairs = edges.select(*KEY, "src", "dst").distinct()

    def side(node: str, name: str) -> DataFrame:
        g = pairs.groupBy(*KEY, node).agg(F.count("*").alias("c"))
        return g.groupBy(*KEY).agg(F.count("*").alias(f"{name}_nodes"), F.min("c").alias(f"{name}_min"), F.max("c").alias(f"{name}_max"), F.round(F.avg("c"), 6).alias(f"{name}_mean"), F.round(F.median("c"), 6).alias(f"{name}_median"), F.sum("c").alias(f"{name}_sum"))

    total = nodes.groupBy("type").agg(F.count("*").alias("t"))
    j = side("src", "out").join(side("dst", "in"), KEY).join(F.broadcast(total.select(F.col("type").alias("src_type"), F.col("t").alias("sources"))), "src_type").join(F.broadcast(total.select(F.col("type").alias("dst_type"), F.col("t").alias("targets"))), "dst_type")
    o, i = F.col("out_max") <= 1, F.col("in_max") <= 1
    kind = F.when(o & i, "one-to-one").when(o, "one-to-many").when(i, "many-to-one").otherwise("many-to-many")
    stats = [f"{s}_{x}" for s in ("out", "in") for x in ("min", "max", "mean", "median")]
    return j.select(*KEY, *stats, F.round(F.col("out_nodes") / F.col("sources"), 6).alias("source_coverage"), F.round(F.col("in_nodes") / F.col("targets"), 6).alias("target_coverage"), F.round(F.col("out_sum") / (F.col("sources") * F.col("targets").cast("double")), 9).alias("density"), kind.alias("cardinality"))


def edge_type_details(edges: DataFrame) -> DataFrame:
    """Per edge type: edges, sources, targets, type pairs, the most frequent type on each side, its share of all edges. Ends
    are made distinct in pieces whose number follows the edges."""
    r = materialise(ontology.relationships(edges))
    rows = r.agg(F.sum("n")).first()[0] or 0
    sides = F.explode(F.array(F.struct(F.lit(True).alias("source"), F.col("src").alias("id")), F.struct(F.lit(False).alias("source"), F.col("dst").alias("id"))))
    ends = in_pieces(edges.select("edge_type", sides.alias("x")).select("edge_type", "x.source", "x.id").filter("id IS NOT NULL"), 2 * rows, AT_ONCE, "edge_type", "source", "id").distinct()
    counts = ends.groupBy("edge_type").agg(F.count_if("source").alias("sources"), F.count_if(~F.col("source")).alias("targets"))
    n = r.groupBy("edge_type").agg(F.sum("n").alias("n")).join(counts, "edge_type", "left").na.fill(0, ["sources", "targets"])
    top = lambda side, name: r.groupBy("edge_type", side).agg(F.sum("n").alias("c")).groupBy("edge_type").agg(F.min_by(side, F.struct((-F.col("c")).alias("c"), side)).alias(name))
    pairs = r.groupBy("edge_type").agg(F.count("*").alias("type_pairs"))
    total = F.broadcast(r.agg(F.sum("n").alias("total")))
    j = n.join(pairs, "edge_type").join(top("src_type", "primary_source"), "edge_type").join(top("dst_type", "primary_target"), "edge_type").crossJoin(total)  # the total is one row
    return j.withColumn("coverage", F.round(F.col("n") / F.col("total"), 6)).drop("total")


def type_relationships(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per type, way, edge type and type at the other end: edges, their share of the type's edges that way, edges a node."""
    r = ontology.relationships(edges)
    both = r.select(F.col("src_type").alias("type"), F.lit("outgoing").alias("way"), "edge_type", F.col("dst_type").alias("other"), "n").union(r.select("dst_type", F.lit("incoming"), "edge_type", "src_type", "n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("type", "way"))  # a few rows a type
    count = F.broadcast(nodes.groupBy("type").agg(F.count("*").alias("nodes")))
    return both.withColumn("share", F.round(share, 6)).join(count, "type").select("type", "way", "edge_type", "other", "n", "share", F.round(F.col("n") / F.col("nodes"), 6).alias("per_node"))


def property_report(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """The profile with presence, requirement and uniqueness."""
    total = F.broadcast(nodes.groupBy("type").agg(F.count("*").alias("total")))
    p = rules.profile(props).join(total, "type")
    return p.withColumn("coverage", F.round(F.col("present") / F.col("total"), 6)).withColumn("requirement", ontology.requirement(F.col("present"), F.col("total"))).withColumn("uniqueness", ontology.uniqueness(F.col("n_unique"), F.col("present")))


def semantic_subgraphs(edges: DataFrame) -> DataFrame:
    """Weak components of the types over relationships: (subgraph, type, internal edges), named by their least type. Types are
    few: labels go along the relationships until nothing changes."""
    from .graph import weak_labels

    r = ontology.relationships(edges)
    labels = weak_labels(r.select(F.col("src_type").alias("src"), F.col("dst_type").alias("dst")))
    inside = r.join(F.broadcast(labels.withColumnRenamed("node_id", "src_type")), "src_type").groupBy("component").agg(F.sum("n").alias("edges"))
    return labels.join(F.broadcast(inside), "component").select(F.col("component").alias("subgraph"), F.col("node_id").alias("type"), "edges")
