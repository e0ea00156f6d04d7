"""Matching the classes of two ontologies, and methods and processes given as triples (s, p, o).

Pairs of classes come from joins: by equal or similar names (`names`), common attributes and relationships, and like shapes.
"""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Parts of a class name: words that may begin with a capital, and runs of capitals.
PARTS = r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|$)"
VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in VOWELS and (w[i] != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(w: str) -> int:
    """How many times vowels are followed by consonants."""
    kinds = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


#: The endings of Porter's steps 2, 3 and 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def stem(word: str) -> str:
    """Porter's stem of a lower-case word."""
    w = word
    if len(w) < 3:
        return w
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + to
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for end in sorted((e for e in table if w.endswith(e)), key=len, reverse=True)[:1]:
            if _measure(w[: -len(end)]) > 0:
                w = w[: -len(end)] + table[end]
    for end in sorted((e for e in STEP4 if w.endswith(e)), key=len, reverse=True)[:1]:
        rest = w[: -len(end)]
        if _measure(rest) > 1 and (end != "ion" or rest[-1:] in ("s", "t")):
            w = rest
    if w.endswith("e"):
        rest = w[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _cvc(rest)):
            w = rest
    if _measure(w) > 1 and _double(w) and w[-1] == "l":
        w = w[:-1]
    return w


def name_score(a: str, b: str) -> tuple[float, str | None]:
    """The first rule on names that fits: equal letters 1, equal stems .9, parts that overlap by more than .6 are .8, a ratio of
    matching runs above .75."""
    x, y = (re.sub("[^a-zA-Z]", "", s).lower() for s in (a, b))
    if x == y:
        return 1.0, "exact"
    if stem(x) == stem(y):
        return 0.9, "stem"
    p, q = ({t.lower() for t in re.findall(PARTS, s)} or {s.lower()} for s in (a, b))
    if len(p & q) / max(len(p | q), 1) > 0.6:
        return 0.8, "token_overlap"
    ratio = difflib.SequenceMatcher(None, x, y).ratio()
    return (ratio, "fuzzy_name") if ratio > 0.75 else (0.0, None)


def _jaccard(a: DataFrame, b: DataFrame, what: str, name: str) -> DataFrame:
    """(x, y, name) of a(x, what) and b(y, what) that share something."""
    a, b = a.select("x", what).distinct(), b.select("y", what).distinct()
    na, nb = a.groupBy("x").agg(F.count("*").alias("na")), b.groupBy("y").agg(F.count("*").alias("nb"))
    both = a.join(b, what).groupBy("x", "y").agg(F.count("*").alias("k"))
    return both.join(F.broadcast(na), "x").join(F.broadcast(nb), "y").select("x", "y", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias(name))


def _alike_shapes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, y, structure) of shapes(class, degree, diversity) that are alike by more than .4. Then one of the two numbers is, so
    that the smaller is over .4 of the greater: they lie in the same or neighbouring powers of 2.5. Zeros are a power of their own."""
    power = lambda v: F.when(v > 0, F.floor(F.log(v) / F.log(F.lit(2.5)))).otherwise(-1000).cast("int")
    s = a.select(F.col("class").alias("x"), F.col("degree").alias("d1"), F.col("diversity").alias("v1"))
    t = b.select(F.col("class").alias("y"), F.col("degree").alias("d2"), F.col("diversity").alias("v2"))
    near = None
    for p, q in (("d1", "d2"), ("v1", "v2")):
        around = s.withColumn("k", F.explode(F.array(*[power(F.col(p)) + i for i in (-1, 0, 1)])))
        met = around.join(t.withColumn("k", power(F.col(q))), "k").select("x", "d1", "v1", "y", "d2", "v2")
        near = met if near is None else near.union(met)
    alike = lambda p, q: 1 - F.abs(F.col(p) - F.col(q)) / (F.greatest(p, q) + 1e-6)
    return near.distinct().select("x", "y", ((alike("d1", "d2") + alike("v1", "v2")) / 2).alias("structure")).filter("structure > 0.4")


def matches(mine: dict[str, DataFrame], other: dict[str, DataFrame], threshold: float = 0.5, top: int = 3) -> DataFrame:
    """(loaded, inferred, score, reason): for each class of mine the `top` of other at or above the threshold.

    No pairs are made but those that a rule can fit. Each side has classes(class) and may have props(class, prop), shapes(class, degree, diversity) and relations(src, edge,
    dst). The first rule that fits decides: names, then attributes that overlap by more than .4, then shapes alike by more
    than .4, then relationships by more than .3."""
    from . import names
    from .tables import materialise

    # it is read twice, and comparing is the work
    named = materialise(names.scored(mine["classes"], other["classes"]).select("x", "y", F.col("score").alias("name"), F.col("reason").alias("why")))
    pairs, scored = named.select("x", "y"), []
    known = (mine["classes"].select(F.col("class").alias("x")).distinct(), other["classes"].select(F.col("class").alias("y")).distinct())
    if "props" in mine and "props" in other:
        scored.append((_jaccard(mine["props"].select(F.col("class").alias("x"), "prop"), other["props"].select(F.col("class").alias("y"), "prop"), "prop", "attribute"), "attribute", 0.4))
    if "shapes" in mine and "shapes" in other:
        scored.append((_alike_shapes(mine["shapes"], other["shapes"]), "structure", 0.4))
    if "relations" in mine and "relations" in other:
        ends = lambda side, c: side["relations"].select(F.explode(F.array("src", "dst")).alias(c), F.concat_ws(" ", F.array_sort(F.array("src", "dst"))).alias("signature"))
        scored.append((_jaccard(ends(mine, "x"), ends(other, "y"), "signature", "relationship"), "relationship", 0.3))
    for values, label, least in scored:
        of_classes = values.join(known[0], "x", "left_semi").join(known[1], "y", "left_semi")
        pairs = pairs.union(of_classes.filter(F.col(label) > least).select("x", "y"))
    j = pairs.distinct().join(named, ["x", "y"], "left")
    for values, _, _ in scored:
        j = j.join(values, ["x", "y"], "left")
    score, reason = F.when(F.col("why").isNotNull(), F.col("name")), F.when(F.col("why").isNotNull(), F.col("why"))
    for _, label, least in scored:
        score, reason = score.when(F.col(label) > least, F.col(label)), reason.when(F.col(label) > least, label)
    found = j.select("x", "y", F.round(score, 3).alias("score"), reason.alias("reason"), score.alias("exact")).filter(F.col("exact") >= threshold)
    k = F.row_number().over(W.partitionBy("x").orderBy(F.desc("score"), "y"))
    return found.withColumn("k", k).filter(F.col("k") <= top).select(F.col("x").alias("loaded"), F.col("y").alias("inferred"), "score", "reason")


def shapes(nodes: DataFrame, edges: DataFrame, sample: int = 5) -> DataFrame:
    """(class, degree, diversity): mean number of neighbours of the type's first `sample` nodes by id, and how many different
    types those have."""
    from .graph import both_ways

    first = nodes.withColumn("k", F.row_number().over(W.partitionBy("type").orderBy("node_id"))).filter(F.col("k") <= sample).select("node_id", F.col("type").alias("class"))
    near = both_ways(edges).select("node_id", "other").distinct().join(F.broadcast(first), "node_id")
    typed = near.join(nodes.select(F.col("node_id").alias("other"), F.col("type").alias("t")), "other", "left")
    d = typed.groupBy("class", "node_id").agg(F.count("*").alias("n")).join(F.broadcast(first), ["class", "node_id"], "right").groupBy("class").agg(F.avg(F.coalesce("n", F.lit(0))).alias("degree"))
    v = typed.groupBy("class").agg(F.count_distinct("t").alias("diversity"))
    return d.join(v, "class", "left").na.fill(0, ["diversity"])


def compared(mine: dict[str, DataFrame], other: dict[str, DataFrame], threshold: float = 0.6) -> DataFrame:
    """(side, class): exact in both, fuzzy for mine that match otherwise, only_mine, only_other."""
    a, b = mine["classes"].select("class").distinct(), other["classes"].select("class").distinct()
    exact = a.join(b, "class", "left_semi")
    found = matches(mine, other, threshold).join(F.broadcast(exact.select(F.col("class").alias("loaded"))), "loaded", "left_anti")
    fuzzy = found.select(F.col("loaded").alias("class")).distinct()
    rest = a.join(exact, "class", "left_anti").join(fuzzy, "class", "left_anti")
    theirs = b.join(exact, "class", "left_anti").join(found.select(F.col("inferred").alias("class")).distinct(), "class", "left_anti")
    named = lambda df, side: df.select(F.lit(side).alias("side"), "class")
    return named(exact, "exact").union(named(fuzzy, "fuzzy")).union(named(rest, "only_mine")).union(named(theirs, "only_other"))


# --- methods and processes as triples(s, p, o)


def classes(triples: DataFrame) -> DataFrame:
    return triples.filter("p = 'a' AND o = 'owl:Class'").select(F.col("s").alias("class")).distinct()


def properties(triples: DataFrame) -> DataFrame:
    """(src, property, dst) between classes: what isn't a type, an annotation or a literal."""
    c = F.broadcast(classes(triples).withColumnRenamed("class", "c"))
    return triples.filter("p <> 'a'").join(c, F.col("o") == F.col("c"), "left_semi").select(F.col("s").alias("src"), F.col("p").alias("property"), F.col("o").alias("dst"))


def annotations(triples: DataFrame, name: str) -> DataFrame:
    return triples.filter((F.col("s") == name) & F.col("o").startswith('"')).select("p", F.regexp_replace("o", r'^"|"(@\w+|\^\^\S+)?$', "").alias("value"))


def subproperties(triples: DataFrame, prop: str) -> DataFrame:
    return triples.filter((F.col("p") == "rdfs:subPropertyOf") & (F.col("o") == prop)).select(F.col("s").alias("property"))


def method_catalog(triples: DataFrame) -> DataFrame:
    """(method, applies_to, produces, implementable): classes whose name has Method or that apply to something; appliesTo counts
    with its subproperties."""
    sub = lambda p: triples.filter((F.col("p") == "rdfs:subPropertyOf") & F.col("o").endswith(p)).select(F.col("s").alias("p"))
    def linked(p: str) -> DataFrame:
        known = F.broadcast(sub(p))
        direct = triples.filter(F.col("p").endswith(p)).select("s", "o")
        return direct.union(triples.join(known, "p", "left_semi").select("s", "o")).distinct()

    applies, makes = linked("appliesTo"), linked("produces")
    names = triples.filter("p = 'a' AND o = 'owl:Class'").filter(F.contains("s", F.lit("Method"))).select("s").union(applies.select("s")).distinct()
    a = applies.groupBy("s").agg(F.array_sort(F.collect_set("o")).alias("applies_to"))
    m = makes.groupBy("s").agg(F.array_sort(F.collect_set("o")).alias("produces"))
    flag = triples.filter(F.col("p").endswith("isImplementable")).groupBy("s").agg(F.bool_or(F.lower("o").contains("true")).alias("implementable"))
    none = F.array().cast("array<string>")
    return names.join(a, "s", "left").join(m, "s", "left").join(flag, "s", "left").select(F.col("s").alias("method"), F.coalesce("applies_to", none).alias("applies_to"), F.coalesce("produces", none).alias("produces"), F.coalesce("implementable", F.lit(False)).alias("implementable"))


def methods_for(catalog: DataFrame, names: list[str]) -> DataFrame:
    """The methods that apply to any of the classes."""
    return catalog.filter(F.arrays_overlap("applies_to", F.array(*[F.lit(n) for n in names])) if names else F.lit(False))


def processes_with(steps: DataFrame, methods: DataFrame) -> DataFrame:
    """steps(process, method) -> (process, methods) of those that use a method by its id or the part after its colon."""
    ids = methods.select(F.explode(F.array("method", F.element_at(F.split("method", ":"), -1))).alias("m")).distinct()
    return steps.join(F.broadcast(ids), steps["method"] == ids["m"], "left_semi").groupBy("process").agg(F.array_sort(F.collect_set("method")).alias("methods"))


def processes(steps: DataFrame) -> DataFrame:
    """(process, steps, methods)."""
    return steps.groupBy("process").agg(F.count("*").alias("steps"), F.count_distinct("method").alias("methods"))


def inferred_types(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n")).select("type", "n", F.lit(1.0).alias("confidence"))


def reasoning(nodes: DataFrame, triples: DataFrame, steps: DataFrame) -> DataFrame:
    """(kind, name, detail): a graph's types, the methods that apply to them and the processes that use these."""
    types = inferred_types(nodes)
    used = method_catalog(triples).withColumn("c", F.explode("applies_to")).join(F.broadcast(types.select(F.concat(F.lit(":"), "type").alias("c"))), "c", "left_semi").groupBy("method").agg(F.array_join(F.array_sort(F.collect_set("c")), ",").alias("detail"))
    p = processes_with(steps, used)
    return types.select(F.lit("type").alias("kind"), F.col("type").alias("name"), F.col("n").cast("string").alias("detail")).union(used.select(F.lit("method"), "method", "detail")).union(p.select(F.lit("process"), "process", F.array_join("methods", ",")))
