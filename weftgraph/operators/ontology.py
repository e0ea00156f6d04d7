"""Ontology inference: aggregations over nodes, edges and props(node_id, type, prop, s_val, d_val)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

HIERARCHY_TERMS = ("contains", "has", "part_of", "belongs", "parent", "child", "member", "includes", "owns", "in_")


def share(a: Column, b: Column, digits: int = 6) -> Column:
    return F.when(b > 0, F.round(a / b, digits))


def node_types(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """Count and property names of each type."""
    n = nodes.groupBy(F.coalesce("type", F.lit("Unknown")).alias("type")).agg(F.count("*").alias("n"))
    names = props.select("type", "prop").distinct().groupBy("type").agg(F.array_join(F.array_sort(F.collect_list("prop")), ",").alias("properties"))
    return n.join(names, "type", "left")


def relationships(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src_type", "edge_type", "dst_type").agg(F.count("*").alias("n"))


def requirement(present: Column, total: Column) -> Column:
    return F.when(present == total, "required").when(present > 0.9 * total, "typically_present").when(present < 0.3 * total, "rarely_present").otherwise("optional")


def uniqueness(unique: Column, present: Column) -> Column:
    return F.when(unique == present, "unique").when(unique == 1, "constant").when(unique < 0.1 * present, "low_cardinality").otherwise("variable")


def property_classes(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """How often each property is there and how its values vary."""
    total = nodes.groupBy("type").agg(F.count("*").alias("total"))
    p = props.groupBy("type", "prop").agg(F.count("*").alias("present"), F.count_distinct("s_val").alias("n_unique"))
    return p.join(F.broadcast(total), "type").select("type", "prop", "present", "n_unique", requirement(F.col("present"), F.col("total")).alias("requirement"), uniqueness(F.col("n_unique"), F.col("present")).alias("uniqueness"))


def positions(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """Per type how many nodes are leaves, roots, intermediate or isolated."""
    d = nodes.select("node_id", "type").join(degrees, "node_id", "left").na.fill(0, ["in_degree", "out_degree"])
    i, o = F.col("in_degree") > 0, F.col("out_degree") > 0
    return d.groupBy("type").agg(F.count("*").alias("n"), F.count_if(i & ~o).alias("leaves"), F.count_if(~i & o).alias("roots"), F.count_if(i & o).alias("intermediate"), F.count_if(~i & ~o).alias("isolated"))


def histogram(df: DataFrame, key: str, value: str, bins: int) -> DataFrame:
    """Equal-width bins of a value per key; the last one is closed. Equal values are counted first and written, so that df is
    made once."""
    from .tables import materialise

    counted = materialise(df.groupBy(key, value).agg(F.count("*").alias("n")))
    b = counted.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    x = counted.join(F.broadcast(b), key)
    k = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))))).cast("int")
    return x.withColumn("bin", k).groupBy(key, "bin").agg(F.sum("n").alias("n"))


def connectivity(edges: DataFrame) -> DataFrame:
    """Per edge type: edges, different sources and targets, loops and pairs that also run back."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type", F.lit(True).alias("back"))
    e = edges.join(back, ["src", "dst", "edge_type"], "left")
    return e.groupBy("edge_type").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"), F.count_if(F.col("src") == F.col("dst")).alias("loops"), F.count_if(F.col("back") & (F.col("src") < F.col("dst"))).alias("two_cycles"), F.count_if(F.col("src_type") == F.col("dst_type")).alias("same_type"))


def cardinality(edges: DataFrame) -> DataFrame:
    """Per relationship the greatest counts of different ends and the class they give. With one target per source and many
    sources per target the class is one-to-many."""
    key = ["src_type", "edge_type", "dst_type"]
    pairs = edges.select(*key, "src", "dst").distinct()
    out = pairs.groupBy(*key, "src").agg(F.count("*").alias("c")).groupBy(*key).agg(F.max("c").alias("out_max"), F.round(F.avg("c"), 6).alias("out_avg"))
    into = pairs.groupBy(*key, "dst").agg(F.count("*").alias("c")).groupBy(*key).agg(F.max("c").alias("in_max"), F.round(F.avg("c"), 6).alias("in_avg"))
    o, i = F.col("out_max") <= 1, F.col("in_max") <= 1
    return out.join(into, key).withColumn("cardinality", F.when(o & i, "one-to-one").when(o, "one-to-many").when(i, "many-to-one").otherwise("many-to-many"))


def patterns(edges: DataFrame, common: float = 0.05) -> DataFrame:
    """Relationships with their share of all edges, and whether it is common."""
    r = relationships(edges)
    total = r.agg(F.sum("n").alias("total"))  # one row
    return r.join(F.broadcast(total)).select("src_type", "edge_type", "dst_type", "n", share(F.col("n"), F.col("total")).alias("share"), (F.col("n") >= common * F.col("total")).alias("common"))


def hierarchical(edges: DataFrame, most: int = 3) -> DataFrame:
    """Edge types that look like a hierarchy: few types at each side, and a telling name, one type on both sides, or a pair of
    types that is also joined the other way round."""
    r = relationships(edges)
    turned = F.broadcast(r.select(F.col("dst_type").alias("src_type"), F.col("src_type").alias("dst_type"), F.lit(True).alias("turned")).distinct())
    g = r.join(turned, ["src_type", "dst_type"], "left").groupBy("edge_type").agg(F.count_distinct("src_type").alias("source_types"), F.count_distinct("dst_type").alias("target_types"), F.bool_or(F.col("src_type") == F.col("dst_type")).alias("self_typed"), F.coalesce(F.bool_or("turned"), F.lit(False)).alias("turned"))
    name = F.lower("edge_type")
    told = F.lit(False)
    for t in HIERARCHY_TERMS:
        told = told | F.contains(name, F.lit(t))
    return g.filter((F.col("source_types") <= most) & (F.col("target_types") <= most) & (told | F.col("self_typed") | F.col("turned"))).select("edge_type", "source_types", "target_types")


def relationship_statistics(edges: DataFrame) -> DataFrame:
    """One row: patterns, types at each side, diversity patterns / (sources * targets)."""
    r = relationships(edges)
    return r.agg(F.count("*").alias("patterns"), F.count_distinct("src_type").alias("source_types"), F.count_distinct("dst_type").alias("target_types"), F.sum("n").cast("long").alias("edges")).withColumn("diversity", F.round(F.col("patterns") / (F.col("source_types") * F.col("target_types")), 6))


def sequential(props: DataFrame) -> DataFrame:
    """Whether the distinct integer values of a property follow each other without a gap. min, max and the number of
    distinct values tell it, so nothing is sorted."""
    p = props.filter("d_val IS NOT NULL").groupBy("type", "prop").agg(F.bool_and(F.col("d_val") == F.floor("d_val")).alias("integral"), F.min("d_val").alias("a"), F.max("d_val").alias("b"), F.count_distinct("d_val").alias("n"), F.count("*").alias("m"))
    return p.select("type", "prop", (F.col("integral") & (F.col("n") == F.col("m")) & (F.col("b") - F.col("a") == F.col("n") - 1)).alias("sequential"))


def _class(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]+$"), "digits").when(c.rlike("^[A-Z]+$"), "upper").when(c.rlike("^[a-z]+$"), "lower").when(c.rlike("^[A-Za-z]+$"), "letters").when(c.rlike("^[A-Za-z0-9]+$"), "alphanumeric").otherwise("mixed")


def string_shape(props: DataFrame, least: float = 0.8) -> DataFrame:
    """The character class that at least that share of a text property's values has, and a common prefix and suffix of
    three characters."""
    p = props.filter("d_val IS NULL")
    total = p.groupBy("type", "prop").agg(F.count("*").alias("total"))
    three = F.array(F.struct(F.lit("class").alias("what"), _class(F.col("s_val")).alias("x")), F.struct(F.lit("prefix").alias("what"), F.substring("s_val", 1, 3).alias("x")), F.struct(F.lit("suffix").alias("what"), F.substring("s_val", -3, 3).alias("x")))
    n = p.select("type", "prop", F.explode(three).alias("t")).groupBy("type", "prop", "t.what", "t.x").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(total), ["type", "prop"]).filter(F.col("n") >= least * F.col("total")).select("type", "prop", "what", "x", "n")


def string_affixes(props: DataFrame, least: float = 0.8, longest: int = 9) -> DataFrame:
    """The most frequent prefix and suffix of 1 to min(length // 2, longest) characters and the capitalisation that at least
    that share of a text property's values has; of equally frequent ones the shorter."""
    p = props.filter("d_val IS NULL")
    total = p.groupBy("type", "prop").agg(F.count("*").alias("total"))
    v = F.col("s_val")
    low, up = v.rlike(r"\p{Ll}"), v.rlike(r"\p{Lu}")
    title = ~v.rlike(r"(^|\P{L})\p{Ll}") & ~v.rlike(r"\p{L}\p{Lu}")
    case = F.when(low & ~up, "all_lowercase").when(up & ~low, "all_uppercase").when(title, "title_case").when(v.rlike(r"^\p{Lu}\P{Lu}*$"), "sentence_case").otherwise("mixed_case")
    sizes = F.filter(F.sequence(F.lit(1), F.lit(longest)), lambda k: k * 2 <= F.length(v))
    parts = [
        F.transform(sizes, lambda k: F.struct(F.lit("prefix").alias("what"), F.substring(v, F.lit(1), k).alias("x"))),
        F.transform(sizes, lambda k: F.struct(F.lit("suffix").alias("what"), F.substring(v, -k, k).alias("x"))),
    ]
    each = F.concat(F.array(F.struct(F.lit("capitalization").alias("what"), case.alias("x"))), *parts)
    n = p.select("type", "prop", F.explode(each).alias("t")).groupBy("type", "prop", "t.what", "t.x").agg(F.count("*").alias("n"))
    best = n.join(F.broadcast(total), ["type", "prop"]).filter(F.col("n") >= least * F.col("total")).groupBy("type", "prop", "what").agg(F.max(F.struct("n", (-F.length("x")).alias("k"), "x")).alias("b"))
    return best.select("type", "prop", "what", "b.x", "b.n")


#: Templates of texts whose lengths differ, and what the first of them begin like.
TEMPLATES = (
    (r"^\d{4}-\d{2}-\d{2}", r"^\d{4}-\d{2}-\d{2}$"),
    (r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"),
    (r"^https?://\S+", r"^https?://\S+$"),
)


def regexes(props: DataFrame, longest: int = 20, least: int = 3, first: int = 10) -> DataFrame:
    """(type, prop, pattern) of properties of `least` values or more: of values of one length up to `longest`, a class or the
    character itself for each place; of others, the first template that the `first` values by node_id all begin like."""
    p = props.select("type", "prop", "node_id", "s_val")
    g = p.groupBy("type", "prop").agg(F.min(F.length("s_val")).alias("lo"), F.max(F.length("s_val")).alias("hi"), F.count("*").alias("n")).filter(F.col("n") >= least)
    same = F.broadcast(g.filter((F.col("lo") == F.col("hi")) & (F.col("hi") <= longest)).select("type", "prop"))
    # each place's different characters, not each value's places, are what is kept
    chars = p.join(same, ["type", "prop"]).select("type", "prop", F.posexplode(F.split("s_val", "")).alias("i", "c")).filter("c <> ''")
    each = chars.groupBy("type", "prop", "i").agg(F.count_distinct("c").alias("k"), F.min("c").alias("c"), *[F.bool_and(F.col("c").rlike(x)).alias(n) for n, x in (("d", r"\d"), ("u", r"\p{Lu}"), ("l", r"\p{Ll}"), ("a", r"\p{L}"))])
    one = F.when(F.col("c").isin(*"-/:.$^*+?()[]{}\\|"), F.concat(F.lit("\\"), F.col("c"))).otherwise(F.col("c"))
    part = F.when(F.col("d"), "\\d").when(F.col("u"), "[A-Z]").when(F.col("l"), "[a-z]").when(F.col("a"), "[A-Za-z]").when(F.col("k") == 1, one).otherwise(".")
    placed = each.groupBy("type", "prop").agg(F.concat(F.lit("^"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", part.alias("x")))), lambda t: t["x"]), ""), F.lit("$")).alias("pattern"))
    some = p.join(F.broadcast(g.select("type", "prop")), ["type", "prop"]).withColumn("k", F.row_number().over(W.partitionBy("type", "prop").orderBy("node_id", "s_val"))).filter(F.col("k") <= first)
    fits = some.groupBy("type", "prop").agg(*[F.bool_and(F.col("s_val").rlike(x)).alias(f"t{i}") for i, (x, _) in enumerate(TEMPLATES)]).join(same, ["type", "prop"], "left_anti")
    template = F.coalesce(*[F.when(F.col(f"t{i}"), F.lit(x)) for i, (_, x) in enumerate(TEMPLATES)])
    return placed.union(fits.select("type", "prop", template)).filter("pattern IS NOT NULL")


def value_correlations(props: DataFrame, least: float = 0.6, pairs: int = 5) -> DataFrame:
    """(type, a, b, similarity) of text properties a and others b that stand together in `pairs` nodes or more, whose values are
    alike by more than that on average: 1 if equal, .5 if one begins the other, .8 if equal but for case, .3 if one is in the
    other. Pairs are made within a node."""
    text = props.filter("d_val IS NULL").select("type", F.col("prop").alias("a")).distinct()
    per = props.groupBy("type", "node_id").agg(F.collect_list(F.struct(F.col("prop").alias("p"), F.col("s_val").alias("v"))).alias("ps"))
    each = per.select("type", F.explode("ps").alias("m"), "ps").select("type", "m", F.explode("ps").alias("o")).filter("m.p <> o.p")
    v, w = F.col("m.v"), F.col("o.v")
    alike = F.when(v == w, 1.0).when(v.startswith(w) | w.startswith(v), 0.5).when(F.lower(v) == F.lower(w), 0.8).when(F.contains(v, w) | F.contains(w, v), 0.3).otherwise(0.0)
    g = each.select("type", F.col("m.p").alias("a"), F.col("o.p").alias("b"), alike.alias("s")).join(F.broadcast(text), ["type", "a"], "left_semi").groupBy("type", "a", "b").agg(F.avg("s").alias("s"), F.count("*").alias("n"))
    return g.filter((F.col("n") >= pairs) & (F.col("s") > least)).select("type", "a", "b", F.round("s", 6).alias("similarity"))


def diverse_samples(props: DataFrame, limit: int = 10) -> DataFrame:
    """(type, prop, s_val): all different values of a property of up to `limit`; of others the least, the greatest and evenly
    spaced ones between, numbers in order of size."""
    d = props.select("type", "prop", "s_val", "d_val").distinct()
    w = W.partitionBy("type", "prop")
    x = d.withColumn("i", F.row_number().over(w.orderBy("d_val", "s_val")) - 1).withColumn("n", F.count("*").over(w))
    step = F.col("n") / (limit - 2)
    at = F.array(*[F.floor(step * k) for k in range(1, limit - 1)])
    return x.filter((F.col("n") <= limit) | (F.col("i") == 0) | (F.col("i") == F.col("n") - 1) | F.array_contains(F.filter(at, lambda k: k < F.col("n")), F.col("i").cast("long"))).select("type", "prop", "s_val")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that isn't a node. The ends that are no nodes come first, each once, so that edges needn't be moved to
    the nodes; few of them are then broadcast, as their size is known."""
    from .tables import materialise

    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    missing = materialise(ends.join(nodes.select("node_id"), "node_id", "left_anti"))
    a, b = (missing.select(F.col("node_id").alias(f"_{k}"), F.lit(True).alias(f"_no_{k}")) for k in ("src", "dst"))
    # a null end is no node either
    marked = edges.join(a, F.col("src") == F.col("_src"), "left").join(b, F.col("dst") == F.col("_dst"), "left")
    return marked.filter("_no_src OR _no_dst OR src IS NULL OR dst IS NULL").select(*edges.columns).distinct().select("src", "dst", "edge_type")


def top_types(nodes: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent types; equal counts by name."""
    return nodes.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(k)


def schema_edges(edges: DataFrame) -> DataFrame:
    """The schema graph: of the relationships of two types the most frequent is an edge, the others virtual nodes."""
    k = F.row_number().over(W.partitionBy("src_type", "dst_type").orderBy(F.desc("n"), "edge_type"))
    return relationships(edges).withColumn("k", k).select("src_type", "dst_type", "edge_type", "n", F.when(F.col("k") == 1, "direct").otherwise("virtual").alias("kind"))


def turtle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The types and relationships as lines of Turtle."""
    c = nodes.select(F.format_string(":%s a owl:Class .", F.col("type")).alias("line")).distinct()
    r = relationships(edges).select(F.format_string(":%s a owl:ObjectProperty ; rdfs:domain :%s ; rdfs:range :%s .", "edge_type", "src_type", "dst_type").alias("line"))
    return c.union(r)
