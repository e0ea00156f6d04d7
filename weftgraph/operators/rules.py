"""Validation rules read off a graph, and what breaks them in another.

A profile has one row per (type, prop); rules are a few rows per property, so they are broadcast, and every property row is
checked once against all rules of its property. Whole-graph checks are anti-joins and aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import ontology, selection
from .tables import materialise

#: Formats as the first values show them, and as every value must have them.
SHOWN = {"date": r"^\d{4}-\d{2}-\d{2}", "email": r"^[\w.-]+@[\w.-]+", "url": r"^https?://\S+"}
WHOLE = {"date": r"^\d{4}-\d{2}-\d{2}$", "email": r"^[\w.-]+@[\w.-]+\.\w+$", "url": r"^https?://\S+$"}
FIRST = 10
ENUM = 10
PROBLEM = "problem string, severity string, subject string, property string, detail string"


def profile(props: DataFrame, median: bool = True) -> DataFrame:
    """Per (type, prop): kinds of values, presence, lengths of texts, range, mean and (if asked for) median of numbers, the
    pattern. The counts, a row per property, are written once.

    A property of up to ENUM different texts is an enumeration; other texts have a format if the first FIRST values by
    node_id all begin like it, the last of date, email and url that fits."""
    text, number = F.col("d_val").isNull(), F.col("d_val").isNotNull()
    length = F.when(text, F.length("s_val"))
    g = props.groupBy("type", "prop").agg(
        F.count("*").alias("present"), F.count_distinct("s_val").alias("n_unique"), F.count_if(text).alias("n_text"), F.count_if(number).alias("n_number"),
        F.min(length).alias("min_length"), F.max(length).alias("max_length"), F.round(F.avg(length), 6).alias("avg_length"),
        F.min("d_val").alias("min_value"), F.max("d_val").alias("max_value"), F.round(F.avg("d_val"), 4).alias("avg_value"),
        F.bool_and(F.col("d_val") == F.floor("d_val")).alias("integral"),
    )
    g = materialise(g)
    formatted = F.broadcast(g.filter((F.col("n_text") >= F.col("n_number")) & (F.col("n_unique") > ENUM)).select("type", "prop"))
    first = props.filter(text).join(formatted, ["type", "prop"], "left_semi").withColumn("k", F.row_number().over(W.partitionBy("type", "prop").orderBy("node_id", "s_val"))).filter(F.col("k") <= FIRST)
    shown = first.groupBy("type", "prop").agg(*[F.bool_and(F.col("s_val").rlike(x)).alias(f"is_{k}") for k, x in SHOWN.items()])
    if median:
        middle = selection.quantile(props, ["type", "prop"], "d_val", 0.5, "m").select("type", "prop", F.round("m", 4).alias("median_value"))
        g = g.join(middle, ["type", "prop"], "left").select(*[c for c in g.columns if c != "integral"], "median_value", "integral")
    j = g.join(F.broadcast(shown), ["type", "prop"], "left")
    fits = F.when(F.col("is_url"), "url").when(F.col("is_email"), "email").when(F.col("is_date"), "date").otherwise("string")
    kind = F.when(F.col("n_text") >= F.col("n_number"), "text").otherwise("number")
    pattern = F.when(kind == "number", F.when(F.col("integral"), "integer").otherwise("float")).when(F.col("n_unique") <= ENUM, "enumeration").otherwise(fits)
    return j.withColumn("kind", kind).withColumn("pattern", pattern).drop("integral", *[f"is_{k}" for k in SHOWN])


def edge_profile(props: DataFrame) -> DataFrame:
    """props(edge_id, edge_type, prop, s_val, d_val) -> per (edge_type, prop) what profile() has of nodes' properties."""
    return profile(props.select(F.col("edge_id").alias("node_id"), F.col("edge_type").alias("type"), "prop", "s_val", "d_val")).withColumnRenamed("type", "edge_type")


def choices(props: DataFrame, profiled: DataFrame) -> DataFrame:
    """(type, prop, choices): the values of enumerations, in order."""
    small = F.broadcast(profiled.filter("pattern = 'enumeration'").select("type", "prop"))
    return props.join(small, ["type", "prop"]).groupBy("type", "prop").agg(F.array_sort(F.collect_set("s_val")).alias("choices"))


def property_rules(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """(type, prop, rule, low, high, detail): required or preferred; string, integer or number; exact_length or length;
    enum with its choices; format; range."""
    total = F.broadcast(nodes.groupBy("type").agg(F.count("*").alias("total")))
    p = materialise(profile(props, False))
    x = p.join(total, "type").join(F.broadcast(choices(props, p)), ["type", "prop"], "left")
    none = F.lit(None)

    def rule(name, when: Column, low=none, high=none, detail=none) -> Column:
        low, high, detail = (c if isinstance(c, Column) else F.lit(c) for c in (low, high, detail))
        name = name if isinstance(name, Column) else F.lit(name)
        return F.when(when, F.struct(name.alias("rule"), low.cast("double").alias("low"), high.cast("double").alias("high"), detail.cast("string").alias("detail")))

    text, lengths = F.col("kind") == "text", F.col("min_length").isNotNull()
    each = F.array(
        rule("required", F.col("present") == F.col("total")),
        rule("preferred", (F.col("present") < F.col("total")) & (F.col("present") > 0.9 * F.col("total")), detail=F.round(F.col("present") * 100 / F.col("total"), 4)),
        rule("string", text),
        rule(F.when(F.col("pattern") == "integer", "integer").otherwise("number"), ~text),
        rule("exact_length", text & lengths & (F.col("min_length") == F.col("max_length")), F.col("min_length"), F.col("max_length")),
        rule("length", text & lengths & (F.col("min_length") < F.col("max_length")), F.col("min_length"), F.col("max_length")),
        rule("enum", F.col("pattern") == "enumeration", detail=F.array_join("choices", "|")),
        rule("format", F.col("pattern").isin(*SHOWN), detail=F.col("pattern")),
        rule("range", ~text, F.col("min_value"), F.col("max_value")),
    )
    return x.select("type", "prop", F.explode(F.filter(each, lambda r: r.isNotNull())).alias("r")).select("type", "prop", "r.*")


def array_rules(df: DataFrame, key: str, column: str) -> DataFrame:
    """(type, prop, rule, low, high, detail) of an array column by the values of `key`: array, array_length, array_items."""
    kind = df.schema[column].dataType.elementType.simpleString()
    g = df.filter(F.col(column).isNotNull()).groupBy(F.col(key).cast("string").alias("type")).agg(F.min(F.size(column)).cast("double").alias("low"), F.max(F.size(column)).cast("double").alias("high"))
    none = F.lit(None).cast("double")
    row = lambda rule, low, high, detail: F.struct(F.lit(rule).alias("rule"), low.alias("low"), high.alias("high"), F.lit(detail).cast("string").alias("detail"))
    rows = F.array(row("array", none, none, None), row("array_length", F.col("low"), F.col("high"), None), row("array_items", none, none, kind))
    return g.select("type", F.lit(column).alias("prop"), F.explode(rows).alias("r")).select("type", "prop", "r.*")


def object_profile(df: DataFrame, key: str, column: str) -> DataFrame:
    """Per value of `key`, of a text column that holds JSON objects: objects, least and most keys, the keys that at least half
    of them have and those that all have. Texts that aren't objects don't count."""
    keys = F.json_object_keys(F.col(column))
    x = df.select(F.col(key).cast("string").alias("type"), keys.alias("keys")).filter("keys IS NOT NULL")
    g = x.groupBy("type").agg(F.count("*").alias("present"), F.min(F.size("keys")).alias("min_keys"), F.max(F.size("keys")).alias("max_keys"))
    each = x.select("type", F.explode(F.array_distinct("keys")).alias("k")).groupBy("type", "k").agg(F.count("*").alias("n"))
    j = each.join(F.broadcast(g.select("type", "present")), "type")
    named = j.groupBy("type").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") >= 0.5 * F.col("present"), F.col("k")))), ",").alias("common_keys"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") == F.col("present"), F.col("k")))), ",").alias("required_keys"))
    return g.join(named, "type", "left").na.fill("", ["common_keys", "required_keys"])


#: Names of properties whose presence one number holds.
A_WORD = 62


def _numbered(names: DataFrame) -> tuple[DataFrame, int]:
    """(prop, word, bit) of the different names, which are few and written, and how many words their bits fill."""
    i = F.row_number().over(W.orderBy("prop")) - 1
    rows = materialise(names.select("prop").dropna().distinct().select("prop", F.floor(i / A_WORD).cast("int").alias("word"), F.expr(f"shiftleft(1L, CAST((row_number() OVER (ORDER BY prop) - 1) % {A_WORD} AS INT))").alias("bit")))
    return rows, -(-rows.count() // A_WORD)


def _held(props: DataFrame, numbered: DataFrame, words: int, *keys: str) -> DataFrame:
    """(keys, held): which of the numbered properties stand there, as bits; rows that have none of them are left out."""
    bits = [F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(words)]
    if not words:
        return props.select(*keys).limit(0).withColumn("held", F.array().cast("array<bigint>"))
    g = props.join(F.broadcast(numbered), "prop").groupBy(*keys).agg(*bits)
    return g.select(*keys, F.array(*[F.col(f"w{w}") for w in range(words)]).alias("held"))


def _has(held: str, word: str, bit: str) -> Column:
    return F.coalesce(F.get(F.col(held), F.col(word)).bitwiseAND(F.col(bit)), F.lit(0)) != 0


def pair_counts(props: DataFrame) -> DataFrame:
    """(type, a, b, together, only_a, only_b) of properties a < b that stand together in some node. Nodes with the same
    properties are counted first, and pairs are made of those counts."""
    numbered, words = _numbered(props)
    sets = materialise(_held(props, numbered, words, "type", "node_id").groupBy("type", "held").agg(F.count("*").alias("c")))
    x = sets.join(F.broadcast(numbered), _has("held", "word", "bit")).select("type", "held", "c", "prop")
    n = x.groupBy("type", "prop").agg(F.sum("c").alias("n"))
    a, b = x.withColumnRenamed("prop", "a"), x.select("type", "held", F.col("prop").alias("b"))
    both = a.join(b, ["type", "held"]).filter("a < b").groupBy("type", "a", "b").agg(F.sum("c").alias("together"))
    na, nb = (n.select("type", F.col("prop").alias(k), F.col("n").alias(f"n{k}")) for k in "ab")
    j = both.join(F.broadcast(na), ["type", "a"]).join(F.broadcast(nb), ["type", "b"])
    return j.select("type", "a", "b", "together", (F.col("na") - F.col("together")).alias("only_a"), (F.col("nb") - F.col("together")).alias("only_b"))


def cross_rules(nodes: DataFrame, props: DataFrame, least: int = 10) -> DataFrame:
    """(type, rule, a, b, rate) for types of that many nodes: co_occurrence if both stand together in more than .9 of the nodes
    that have either, else implication a -> b if a never stands without b."""
    big = F.broadcast(nodes.groupBy("type").agg(F.count("*").alias("c")).filter(F.col("c") >= least).select("type"))
    x = pair_counts(props).join(big, "type").withColumn("rate", F.col("together") / (F.col("together") + F.col("only_a") + F.col("only_b")))
    often = F.col("rate") > 0.9
    a, b = (F.col("only_a") == 0) & (F.col("only_b") > 0), (F.col("only_b") == 0) & (F.col("only_a") > 0)
    row = lambda r, p, q: F.struct(F.lit(r).alias("rule"), F.col(p).alias("a"), F.col(q).alias("b"), F.round(F.col("rate") * 100, 4).alias("rate"))
    r = F.when(often, row("co_occurrence", "a", "b")).when(a, row("implication", "a", "b")).when(b, row("implication", "b", "a"))
    return x.select("type", r.alias("r")).filter("r IS NOT NULL").select("type", "r.*")


def rule_set(nodes: DataFrame, props: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """All rules: properties, cross (pairs of properties), relationships (of 3 edges or more), cardinality (of 5 or more, but
    many-to-many) and the node and edge types that there are. What is read off the whole graph is written once, as checks read
    it several times; it has a few rows per property or relationship."""
    r = materialise(ontology.relationships(edges))
    often = F.broadcast(r.filter("n >= 5").select("src_type", "edge_type", "dst_type"))
    c = ontology.cardinality(edges).join(often, ["src_type", "edge_type", "dst_type"]).filter("cardinality <> 'many-to-many'")
    return {
        "properties": materialise(property_rules(nodes, props)),
        "cross": materialise(cross_rules(nodes, props)),
        "relationships": r.filter("n >= 3"),
        "observed": r.select("src_type", "edge_type", "dst_type"),
        "cardinality": materialise(c.select("src_type", "edge_type", "dst_type", "cardinality")),
        "node_types": materialise(nodes.select("type").distinct()),
        "edge_types": r.select("edge_type").distinct(),
    }


def rule_rows(rules: dict[str, DataFrame]) -> DataFrame:
    """The rule set as rows (rule, subject, detail)."""
    p = rules["properties"].select(F.concat(F.lit("property_"), F.col("rule")).alias("rule"), F.concat_ws(".", "type", "prop").alias("subject"), F.coalesce("detail", F.when(F.col("low").isNotNull(), F.concat_ws("..", F.round("low", 2).cast("decimal(38,2)").cast("string"), F.round("high", 2).cast("decimal(38,2)").cast("string"))), F.lit("")).alias("detail"))
    c = rules["cross"].select(F.concat(F.lit("property_"), F.col("rule")), F.col("type"), F.concat_ws(" ", "a", "b"))
    triple = F.concat_ws(" ", "src_type", "edge_type", "dst_type")
    r = rules["relationships"].select(F.lit("valid_relationship"), triple, F.col("n").cast("string"))
    k = rules["cardinality"].select(F.lit("cardinality_constraint"), triple, F.col("cardinality"))
    n = rules["node_types"].select(F.lit("valid_node_type"), F.col("type"), F.lit(""))
    e = rules["edge_types"].select(F.lit("valid_edge_type"), F.col("edge_type"), F.lit(""))
    return p.union(c).union(r).union(k).union(n).union(e)


def _rows(df: DataFrame, problem: str, severity, subject: str, prop, detail) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(F.lit(problem).alias("problem"), lit(severity).alias("severity"), F.col(subject).alias("subject"), lit(prop).alias("property"), lit(detail).cast("string").alias("detail"))


def _numbers_of(found: tuple[tuple[str, str, Column], ...]) -> Column:
    """A row k for each of the problems (name, severity, whether it is there); without lambdas, which stages can't compile."""
    return F.explode(F.array_remove(F.array(*[F.when(when, k).otherwise(0) for k, (_, _, when) in enumerate(found, 1)]), 0))


def _named(found: tuple[tuple[str, str, Column], ...], what: int) -> Column:
    return F.element_at(F.array(*[F.lit(x[what]) for x in found]), F.col("k"))


def property_problems(nodes: DataFrame, props: DataFrame, rules: DataFrame) -> DataFrame:
    """What breaks property rules: a missing required (high) or preferred (medium) property; per value, in one pass, format,
    range and choices (medium) and lengths (low)."""
    wanted = rules.filter("rule IN ('required', 'preferred')").select("type", "prop", "rule")
    numbered, words = _numbered(wanted)
    need = wanted.join(F.broadcast(numbered), "prop").groupBy("type").agg(F.collect_list(F.struct("prop", "rule", "word", "bit")).alias("need"))
    # a node that has all of a type's is done with by comparing numbers
    full = _held(wanted, numbered, words, "type").withColumnRenamed("held", "all")
    each_type = F.broadcast(full.join(need, "type"))
    have = _held(props, numbered, words, "node_id")
    lacks = nodes.select("node_id", "type").join(each_type, "type").join(have, "node_id", "left")
    held = lambda w: F.coalesce(F.get(F.col("held"), w), F.lit(0).cast("long"))
    lacks = lacks.filter(reduce(lambda a, b: a | b, [F.get("all", F.lit(w)).bitwiseAND(held(F.lit(w))) != F.get("all", F.lit(w)) for w in range(words)], F.lit(False)))
    lacks = lacks.select("node_id", F.explode(F.filter("need", lambda r: held(r["word"]).bitwiseAND(r["bit"]) == 0)).alias("r"))
    missing = _rows(lacks, "missing_required_property", F.when(F.col("r.rule") == "required", "high").otherwise("medium"), "node_id", F.col("r.prop"), F.col("r.rule"))

    def of(rule: str, *names: str) -> list[Column]:
        return [F.max(F.when(F.col("rule") == rule, F.col(n))).alias(f"{rule}_{n}") for n in names]

    wide = F.broadcast(rules.groupBy("type", "prop").agg(*of("range", "low", "high"), *of("length", "low", "high"), *of("exact_length", "low"), *of("enum", "detail"), *of("format", "detail")).withColumn("choices", F.split("enum_detail", r"\|")))
    v, n, size = F.col("s_val"), F.col("d_val"), F.length("s_val")
    bad_format = F.lit(False)
    for kind, pattern in WHOLE.items():
        bad_format = bad_format | ((F.col("format_detail") == kind) & ~v.rlike(pattern))
    text = n.isNull()
    # a property with a format has no length rule
    lengths = text & F.col("format_detail").isNull()
    found = (
        ("invalid_property_format", "medium", text & bad_format),
        ("out_of_range_property", "medium", (n < F.col("range_low")) | (n > F.col("range_high"))),
        ("invalid_enum_value", "medium", F.col("enum_detail").isNotNull() & ~F.array_contains("choices", v)),
        ("invalid_property_length", "low", lengths & ((size != F.col("exact_length_low")) | (size < F.col("length_low")) | (size > F.col("length_high")))),
    )
    hit = props.join(wide, ["type", "prop"]).select("node_id", "prop", "s_val", _numbers_of(found).alias("k"))
    values = hit.select(_named(found, 0).alias("problem"), _named(found, 1).alias("severity"), F.col("node_id").alias("subject"), F.col("prop").alias("property"), F.col("s_val").alias("detail"))
    return missing.union(values)


def implication_problems(props: DataFrame, cross: DataFrame) -> DataFrame:
    """Nodes with a property that implies one which they lack."""
    rules = cross.filter("rule = 'implication'").select("type", "a", "b")
    numbered, words = _numbered(rules.select(F.explode(F.array("a", "b")).alias("prop")))
    for k in "ab":
        rules = rules.join(F.broadcast(numbered.select(F.col("prop").alias(k), F.col("word").alias(f"word_{k}"), F.col("bit").alias(f"bit_{k}"))), k)
    few = F.broadcast(rules.select("type").distinct())
    have = _held(props.join(few, "type", "left_semi"), numbered, words, "type", "node_id").join(F.broadcast(rules), "type")
    x = have.filter(_has("held", "word_a", "bit_a") & ~_has("held", "word_b", "bit_b")).select("node_id", F.struct("a", "b").alias("r"))
    return _rows(x, "property_dependency_violation", "medium", "node_id", F.col("r.b"), F.col("r.a"))


def edge_problems(nodes: DataFrame, edges: DataFrame, rules: dict[str, DataFrame], ends: DataFrame | None = None) -> DataFrame:
    """Edges without a source or target (high); of the others, unknown types (high), unknown relationships (medium) and
    nodes that break a relationship's cardinality (medium). Ends that are no nodes are found first, each once, so that edges
    aren't moved to the nodes; `ends` are (node_id) of the edges, where they can be had without making edges distinct."""
    triple = ["src_type", "edge_type", "dst_type"]
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")) if ends is None else ends
    missing = materialise(ends.distinct().join(nodes.select("node_id"), "node_id", "left_anti"))

    def looked_up(e: DataFrame) -> DataFrame:
        for end in ("src", "dst"):
            no = missing.select(F.col("node_id").alias(f"_{end}"), F.lit(True).alias(f"{end}_no"))
            e = e.join(no, F.col(end) == F.col(f"_{end}"), "left").withColumn(f"{end}_is", F.col(f"{end}_no").isNull() & F.col(end).isNotNull()).drop(f"_{end}", f"{end}_no")
        return e

    e = looked_up(edges.select("src", "dst", *triple))
    kinds = F.broadcast(rules["edge_types"].distinct().withColumn("kind_is", F.lit(True)))  # a row per edge type and relationship
    seen = F.broadcast(rules["observed"].distinct().withColumn("seen_is", F.lit(True)))
    j = e.join(kinds, "edge_type", "left").join(seen, triple, "left")
    whole, known = F.col("src_is") & F.col("dst_is"), F.col("kind_is").isNotNull()
    found = (
        ("invalid_edge_source", "high", ~F.col("src_is")),
        ("invalid_edge_target", "high", ~F.col("dst_is")),
        ("invalid_edge_type", "high", whole & ~known),
        ("invalid_relationship_pattern", "medium", whole & known & F.col("seen_is").isNull()),
    )
    hit = j.select("src", "dst", *triple, _numbers_of(found).alias("k"))
    detail = F.element_at(F.array("src", "dst", "edge_type", F.concat_ws(" ", *triple)), F.col("k"))
    rows = hit.select(_named(found, 0).alias("problem"), _named(found, 1).alias("severity"), F.concat_ws(" ", "src", "edge_type", "dst").alias("subject"), F.lit(None).cast("string").alias("property"), detail.alias("detail"))
    # edge types with a cardinality are few; named as literals they keep the tables of other edges from being read
    types = [r[0] for r in rules["cardinality"].select("edge_type").dropna().distinct().collect()]
    ruled = looked_up(edges.select("src", "dst", *triple).filter(F.col("edge_type").isin(types))).filter("src_is AND dst_is").join(F.broadcast(rules["cardinality"]), triple)
    for node, other, those, violation in (("src", "dst", ("one-to-one", "many-to-one"), "one-to-many"), ("dst", "src", ("one-to-one", "one-to-many"), "many-to-one")):
        many = ruled.filter(F.col("cardinality").isin(*those)).groupBy(*triple, node).agg(F.count_distinct(other).alias("n")).filter("n > 1")
        rows = rows.union(_rows(many, "cardinality_violation", "medium", node, F.col("edge_type"), F.lit(violation)))
    return rows


def inconsistencies(nodes: DataFrame, props: DataFrame, edges: DataFrame, rules: dict[str, DataFrame], ends: DataFrame | None = None) -> DataFrame:
    """(problem, severity, subject, property, detail) of everything in a graph that breaks a rule set. Nodes of unknown types
    are reported as such and not checked further."""
    known = F.broadcast(rules["node_types"])
    odd = _rows(nodes.join(known, "type", "left_anti"), "invalid_node_type", "high", "node_id", None, F.col("type"))
    mine = nodes.join(known, "type", "left_semi")
    return odd.union(property_problems(mine, props, rules["properties"])).union(implication_problems(props, rules["cross"])).union(edge_problems(nodes, edges, rules, ends))


def anomalies(nodes: DataFrame, props: DataFrame, profiled: DataFrame) -> DataFrame:
    """Nodes that lack a property which all of their type had, or have a value of another kind than most."""
    rules = profiled.join(F.broadcast(nodes.groupBy("type").agg(F.count("*").alias("total"))), "type")
    required = rules.filter("present = total").select("type", "prop", F.lit("required").alias("rule"))
    missing = property_problems(nodes, props, required.withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double")).withColumn("detail", F.lit(None).cast("string")))
    number = F.col("s_val").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    kind = F.when(F.col("d_val").isNull(), "text").otherwise("number")
    j = props.join(F.broadcast(profiled.select("type", "prop", F.col("kind").alias("want"), "pattern")), ["type", "prop"])
    wrong = j.filter((kind != F.col("want")) | ((F.col("pattern") == "integer") & (F.col("d_val") != F.floor("d_val"))))
    off = wrong.select(F.when(number & (F.col("want") == "number") & (F.col("pattern") == "integer"), "integer_expected").otherwise("type_mismatch").alias("problem"), F.lit("medium").alias("severity"), F.col("node_id").alias("subject"), F.col("prop").alias("property"), F.col("s_val").alias("detail"))
    return missing.filter("severity = 'high'").union(off)
