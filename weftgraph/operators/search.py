"""Search, status and matching."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Status words, types that matter for context, failure keywords.
STATUS = {"PASSED": "PASSED", "PASS": "PASSED", "SUCCESS": "PASSED", "FAILED": "FAILED", "FAIL": "FAILED", "ERROR": "FAILED", "WARNING": "WARNING", "WARN": "WARNING"}
PRIORITY = "file|folder|filename|location|measurement|validation"
TIERS = ("exact", "context", "semantic")
FAILURE_WORDS = ("anachronism", "violation", "error", "failed", "invalid")


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def node_text(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """`key: value` pairs of a node, joined by bars, names in order."""
    p = props.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prop", "s_val"))), lambda x: F.concat_ws(": ", x["prop"], x["s_val"])), " | ").alias("t"))
    return nodes.join(p, "node_id", "left").select("node_id", F.concat_ws(" | ", F.concat(F.lit("type: "), F.col("type")), F.concat(F.lit("value: "), F.col("value")), "t").alias("text"))


def edge_text(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a, b = (nodes.select(F.col("node_id").alias(k), F.col("value").alias(f"{k}_value")) for k in ("src", "dst"))
    return text_of_edges(edges.join(a, "src").join(b, "dst"))


def text_of_edges(valued: DataFrame) -> DataFrame:
    """Edges with src_value and dst_value, as text."""
    return valued.select("src", "dst", "edge_type", F.concat_ws(" ", F.concat(F.col("src_type"), F.lit(":"), F.col("src_value")), "edge_type", F.concat(F.col("dst_type"), F.lit(":"), F.col("dst_value"))).alias("text"))


def cosine(vectors: DataFrame, query: DataFrame, least: float, k: int) -> DataFrame:
    """The k nearest vectors by cosine, at or above `least`, ties by id. query has one row; it alone is broadcast."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    q = query.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    x = vectors.join(F.broadcast(q), F.col("vec_id") != F.col("q_id"))
    c = dot("embedding", "q") / F.sqrt(dot("embedding", "embedding") * dot("q", "q"))
    return x.select("vec_id", F.round(c, 6).alias("similarity")).filter(F.col("similarity") >= least).orderBy(F.desc("similarity"), "vec_id").limit(k)


def cleaned(query: str) -> str:
    """The query in lower case with blanks for what isn't a word character or white space."""
    return re.sub(r"[^\w\s]", " ", query).strip().lower()


def exact(texts: DataFrame, query: str, value: float = 0.99, within: float = 0.95) -> DataFrame:
    """texts(id, text) that hold the query -> (id, similarity): `value` if it begins the node's value, else `within`."""
    q, t = cleaned(query), F.lower("text")
    return texts.filter(F.contains(t, F.lit(q))).select("id", F.when(F.contains(t, F.lit(f"value: {q}")), value).otherwise(within).alias("similarity"))


def exact_indexed(index, query: str, value: float = 0.99, within: float = 0.95) -> DataFrame:
    """exact() by a kept index of the texts (`text_index`)."""
    from . import text_index

    return exact(text_index.containing(index, cleaned(query)), query, value, within)


def context(edges: DataFrame, nodes: DataFrame, hits: DataFrame, k: int = 8) -> DataFrame:
    """Neighbours of hits(id): .85 for files, folders, places, measurements and validations by their type, else .70; the k best,
    ties by id. Hits and neighbours are written, so that their sizes are known and few of them are brought to the edges and nodes."""
    from .tables import materialise

    h = materialise(hits.select("id").distinct())
    ends = [edges.select(F.col(a).alias("id"), F.col(b).alias("node_id")).join(h, "id", "left_semi").select("node_id") for a, b in (("src", "dst"), ("dst", "src"))]
    near = materialise(ends[0].union(ends[1]).distinct())
    s = F.when(F.lower("type").rlike(PRIORITY), 0.85).otherwise(0.7)
    return nodes.select("node_id", "type").join(near, "node_id", "left_semi").select(F.col("node_id").alias("id"), s.alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


def context_edges(edges: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """Edges at hits(id), at .80: the k first by id."""
    from .tables import materialise

    h = materialise(hits.select(F.col("id").alias("h")).distinct())
    e = edges.select(edge_id(), "src", "dst")
    at = e.join(h, F.col("src") == F.col("h"), "left_semi").union(e.join(h, F.col("dst") == F.col("h"), "left_semi")).distinct()
    return at.select("id", F.lit(0.8).alias("similarity")).orderBy("id").limit(k)


def edge_id() -> Column:
    return F.concat_ws(" ", "src", "edge_type", "dst").alias("id")


def semantic(vectors: DataFrame, query: list[float], least: float, without: DataFrame, k: int) -> DataFrame:
    """vectors(id, embedding) by cosine with the query vector, at or above `least`, without those of `without`(id); the k best,
    ties by id. Vectors are made elsewhere: there is no model here."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot("embedding", "embedding"))
    c = F.when(size > 0, dot("embedding", q) / size / (sum(float(x) ** 2 for x in query) ** 0.5 or 1.0)).otherwise(0.0)
    return vectors.join(without.select("id"), "id", "left_anti").select("id", F.round(c, 6).alias("similarity")).filter(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id").limit(k)


def search(nodes: DataFrame, edges: DataFrame, node_texts: DataFrame, edge_texts: DataFrame, query: str, vectors: DataFrame | None = None, query_vector: list[float] | None = None, top_k: int = 5, threshold: float = 0.15) -> DataFrame:
    """(kind, place, tier, id, similarity) of the first top_k nodes and edges: exact hits, then their context, then vectors near
    the query's. Without exact nodes only the last, which then need .10 instead of .25 at least. Texts are frames (id, text) or
    kept indexes of them."""
    from .tables import materialise

    def hit(texts, *scores: float) -> DataFrame:
        return exact(texts, query, *scores) if isinstance(texts, DataFrame) else exact_indexed(texts, query, *scores)

    hits, edge_hits = materialise(hit(node_texts)), hit(edge_texts, 0.9, 0.9)  # hits are read four times
    some = not hits.isEmpty()
    tiers = []
    if some:
        tiers += [("node", 0, hits.orderBy(F.desc("similarity"), "id").limit(top_k)), ("edge", 0, edge_hits.orderBy(F.desc("similarity"), "id").limit(top_k))]
        tiers += [("node", 1, context(edges, nodes, hits)), ("edge", 1, context_edges(edges, hits))]
    if vectors is not None and query_vector is not None:
        tiers.append(("node", 2, semantic(vectors, query_vector, max(threshold, 0.25 if some else 0.10), hits, 8)))
    found = nodes.sparkSession.createDataFrame([], "kind string, tier int, id string, similarity double")
    for kind, tier, rows in tiers:
        found = found.union(rows.select(F.lit(kind).alias("kind"), F.lit(tier).alias("tier"), "id", "similarity"))
    place = F.row_number().over(W.partitionBy("kind").orderBy("tier", F.desc("similarity"), "id"))  # a few rows of each tier
    return found.withColumn("place", place).filter(F.col("place") <= top_k).select("kind", "place", F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("tier") + 1).alias("tier"), "id", "similarity")


def search_summary(found: DataFrame) -> DataFrame:
    """search() -> one row: nodes, edges, exact ones, mean and greatest similarity."""
    return found.agg(F.count_if(F.col("kind") == "node").alias("nodes"), F.count_if(F.col("kind") == "edge").alias("edges"), F.count_if(F.col("tier") == "exact").alias("exact"), F.round(F.coalesce(F.avg("similarity"), F.lit(0.0)), 6).alias("mean"), F.coalesce(F.max("similarity"), F.lit(0.0)).alias("most"))


def search_subgraph(edges: DataFrame, found: DataFrame) -> DataFrame:
    """The edges among the found nodes and, of each, its first 5 neighbours at a similarity of .9 or more and 2 below."""
    from .graph import both_ways
    from .tables import materialise

    hits = materialise(found).filter("kind = 'node'").select(F.col("id").alias("node_id"), F.when(F.col("similarity") >= 0.9, 5).otherwise(2).alias("most"))
    near = both_ways(edges).join(F.broadcast(hits), "node_id").select("node_id", "other", "most").distinct()  # hits are top_k rows
    k = F.row_number().over(W.partitionBy("node_id").orderBy("other"))
    some = near.withColumn("k", k).filter("k <= most").select(F.col("other").alias("node_id")).union(hits.select("node_id")).distinct()
    a, b = F.broadcast(some.select(F.col("node_id").alias("src"))), F.broadcast(some.select(F.col("node_id").alias("dst")))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst", "edge_type")


FIELDS = ("is_valid", "has_error", "has_warning", "status", "validation_passed")
REASONS = ("validation_reason", "error_message", "description")


def status(df: DataFrame) -> DataFrame:
    """df(id, type, FIELDS, REASONS; any may be missing) -> (id, resolved, warns).

    The first field that decides does, in this order: is_valid, has_error and has_warning if true, a known status word,
    validation_passed if true. A row with fields of which none decides is FAILED if a reason has a failure word, else WARNING;
    one without any is INFORMATIONAL. warns tells whether a row with fields is FAILED or WARNING."""
    has = {c.lower() for c in df.columns}
    col = lambda c, kind: F.col(c) if c in has else F.lit(None).cast(kind)
    flag, word = {c: col(c, "boolean") for c in FIELDS if c != "status"}, col("status", "string")
    named = F.element_at(F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair]), F.upper(F.coalesce(word, F.lit(""))))
    said = F.lower(F.concat_ws(" ", *[col(c, "string") for c in REASONS]))
    some = F.coalesce(*[F.when(c.isNotNull(), True) for c in (*flag.values(), word)], F.lit(False))
    s = F.when(~some, "INFORMATIONAL").when(flag["is_valid"], "PASSED").when(~flag["is_valid"], "FAILED").when(flag["has_error"], "FAILED").when(flag["has_warning"], "WARNING").when(named.isNotNull(), named).when(flag["validation_passed"], "PASSED").when(said.rlike("|".join(FAILURE_WORDS)), "FAILED").otherwise("WARNING")
    return df.select("id", s.alias("resolved"), (some & s.isin("FAILED", "WARNING")).alias("warns"))


def severity(vectors: DataFrame, prompts: list[tuple[str, list[float]]], least: float = 0.2, most: int = 64) -> DataFrame:
    """vectors(id, embedding) -> (id, level, prompt, similarity): the level of the prompt that is nearest by cosine, the first of
    equal ones; level and prompt are null where none reaches `least`, all three for a vector that is null, zero or of another
    length. Prompts (level, vector), `most` at most, are a matrix of literals: one projection, no join. Vectors of texts and
    prompts are made elsewhere: there is no model here."""
    if not prompts or len(prompts) > most or len({len(v) for _, v in prompts}) > 1:
        raise ValueError(f"1 to {most} prompts of one length")
    unit = [[float(x) / (math.sqrt(sum(float(y) ** 2 for y in v)) or 1.0) for x in v] for _, v in prompts]
    matrix, levels = F.array(*[F.array(*[F.lit(x) for x in v]) for v in unit]), F.array(*[F.lit(name) for name, _ in prompts])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    good = (F.size("embedding") == len(unit[0])) & (size > 0)
    rows = vectors.select("id", F.when(good, F.transform(matrix, lambda p: F.round(dot(F.col("embedding"), p) / size, 6))).alias("all"))
    best = rows.select("id", "all", F.array_max("all").alias("similarity"))
    at = F.array_position("all", F.col("similarity")).cast("int")
    near = F.col("similarity") >= least
    return best.select("id", F.when(near, F.element_at(levels, at)).alias("level"), F.when(near, at - 1).alias("prompt"), "similarity")


def walk(steps: DataFrame, start: str, most: int = 20) -> DataFrame:
    """steps(src, dst) of a process -> (step, node) in order from start, the least next one at each."""
    spark = steps.sparkSession
    now = spark.range(1).select(F.lit(0).alias("step"), F.lit(start).alias("node"))
    found = now
    for i in range(1, most + 1):
        now = now.join(steps, F.col("node") == F.col("src")).groupBy().agg(F.min("dst").alias("node")).filter("node IS NOT NULL").select(F.lit(i).alias("step"), "node")
        found = found.union(now)
    return found


# --- commands


def command(text: str, nodes: DataFrame, edges: DataFrame, node_texts: DataFrame, edge_texts: DataFrame) -> DataFrame:
    """What a line asks for, as rows (name, detail): help; nodes [part of a type]; methods; method <id>; validations; warnings;
    insights; connections <id>; timeline; search <words>. Anything else is searched for."""
    from . import methods

    spark = nodes.sparkSession
    word, _, rest = text.strip().partition(" ")
    word, rest = word.lower(), rest.strip()
    told = status(nodes.withColumnRenamed("node_id", "id"))
    row = lambda df, a, b: df.select(F.col(a).alias("name"), F.col(b).cast("string").alias("detail"))
    if word == "help":
        said = {"nodes [type]": "counts by type", "methods": "instances of methods", "method <id>": "what a method made", "validations": "counts by status", "warnings": "nodes with warnings", "insights": "how methods fared", "connections <id>": "neighbours", "timeline": "timestamps in order", "search <words>": "nodes and edges"}
        return spark.createDataFrame(list(said.items()), "name string, detail string")
    if word == "nodes":
        from .graph import type_counts

        return row(type_counts(nodes, rest), "type", "n")
    if word == "methods":
        return row(nodes.filter(F.col("type").endswith("Method")), "node_id", "type")
    if word == "method":
        return row(edges.filter((F.col("src") == rest) & (F.col("edge_type") == "produces")), "dst", "edge_type")
    if word == "validations":
        return row(told.groupBy("resolved").agg(F.count("*").alias("n")), "resolved", "n")
    if word == "warnings":
        return row(told.filter("warns"), "id", "resolved")
    if word == "insights":
        return row(methods.method_insights(nodes, edges), "method", "outputs")
    if word == "connections":
        from .graph import neighbors

        return row(neighbors(edges, rest), "other", "outgoing")
    if word == "timeline":
        return row(nodes.filter("type = 'Timestamp'").orderBy("value", "node_id"), "node_id", "value")
    query = rest if word == "search" else text
    return row(search(nodes, edges, node_texts, edge_texts, query), "id", "similarity")


def details(texts: DataFrame) -> DataFrame:
    """texts(id, text) of `key: value` parts -> (id, type, value, date, location, relation): what an answer says of a node, each
    the first that the text has."""
    of = lambda key: F.nullif(F.trim(F.regexp_extract("text", rf"(?i)(?:^|\| )\s*{key}: ([^|]+)", 1)), F.lit(""))
    date = F.nullif(F.regexp_extract("text", r"(\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?)", 1), F.lit(""))
    return texts.select("id", of("type").alias("type"), of("value").alias("value"), date.alias("date"), of("location").alias("location"), of("edge_type").alias("relation"))


# --- vectors that are kept


def save_vectors(vectors: DataFrame, folder: str, graph: str) -> None:
    """vectors(id, embedding) of a graph, in place of those that are kept of it."""
    vectors.select("id", "embedding").write.mode("overwrite").parquet(f"{folder}/{graph}")


def kept_vectors(spark, folder: str, graph: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{graph}")


def vectors_info(vectors: DataFrame) -> DataFrame:
    """One row: how many vectors there are, of how many components at least and at most."""
    return vectors.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"))
