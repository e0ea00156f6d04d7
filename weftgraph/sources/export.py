"""Graphs and ontologies as files and as graphs of their own."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import ontology, rules

#: Types of JSON Schema and of XML Schema by kind and pattern.
XSD = {"integer": "xsd:integer", "float": "xsd:float"}


def save(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes and edges as Parquet tables below a folder, which `files.tables` lists."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, key, value) lines of a graph in JSON: a node under its id, an edge under both ids with a bar, each as an object. A
    line each, so that no row holds the graph."""
    n = nodes.select(F.lit("nodes").alias("part"), F.col("node_id").alias("key"), F.to_json(F.struct(*[c for c in nodes.columns if c != "node_id"])).alias("value"))
    return n.union(edges.select(F.lit("edges"), F.concat_ws("|", "src", "dst"), F.to_json(F.struct(*[c for c in edges.columns if c not in ("src", "dst")]))))


def save_graph_lines(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """The graph as JSON lines, a node or an edge each with its part and all its columns, which `ingest.read_graph_lines` reads:
    packed text files, as names are in every line, that are written and read in many tasks."""
    line = lambda df, part: df.select(F.to_json(F.struct(F.lit(part).alias("part"), *df.columns)).alias("value"))
    line(nodes, "nodes").union(line(edges, "edges")).write.text(folder, compression="gzip")


def schema_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the schema: a node per type with its count; of the relationships of two types the most frequent is an
    edge, each further one a node Rel_... with SOURCE_OF and TARGET_OF edges."""
    k = F.row_number().over(W.partitionBy("src_type", "dst_type").orderBy(F.desc("n"), "edge_type"))
    r = ontology.relationships(edges).withColumn("k", k)  # a few rows a pair of types
    virtual = r.filter("k > 1").withColumn("id", F.concat_ws("_", F.lit("Rel"), "src_type", "edge_type", "dst_type"))
    n = nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.col("type").alias("node_id"), F.lit("NodeType").alias("type"), "n")
    n = n.union(virtual.select("id", F.lit("Relationship"), "n"))
    e = r.filter("k = 1").select(F.col("src_type").alias("src"), F.col("dst_type").alias("dst"), "edge_type", "n")
    e = e.union(virtual.select("src_type", "id", F.lit("SOURCE_OF"), "n")).union(virtual.select("id", "dst_type", F.lit("TARGET_OF"), "n"))
    return n, e


def reified(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the ontology with edge types as nodes: source type to edge type to target type, counts added up."""
    r = ontology.relationships(edges)
    n = nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.concat(F.lit("node_type:"), "type").alias("node_id"), F.lit("NodeType").alias("type"), "n")
    n = n.union(r.groupBy("edge_type").agg(F.sum("n").alias("n")).select(F.concat(F.lit("edge_type:"), "edge_type"), F.lit("EdgeType"), "n"))
    out = r.groupBy("src_type", "edge_type").agg(F.sum("n").alias("n")).select(F.concat(F.lit("node_type:"), "src_type").alias("src"), F.concat(F.lit("edge_type:"), "edge_type").alias("dst"), F.lit("source_of").alias("edge_type"), "n")
    into = r.groupBy("edge_type", "dst_type").agg(F.sum("n").alias("n")).select(F.concat(F.lit("edge_type:"), "edge_type"), F.concat(F.lit("node_type:"), "dst_type"), F.lit("targets"), "n")
    return n, out.union(into)


def turtle(nodes: DataFrame, edges: DataFrame, props: DataFrame, base: str = "http://example.org/ontology#") -> DataFrame:
    """(place, line): an OWL ontology in Turtle. Prefixes, a class per type, an object property per relationship named by its
    types, a datatype property per property with its XML Schema type."""
    spark = nodes.sparkSession
    head = [(0, f"@prefix : <{base}> ."), *[(0, f"@prefix {k}: <{v}> .") for k, v in PREFIXES.items()], (1, f"<{base[:-1]}> a owl:Ontology .")]
    c = nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(2), F.format_string(':%s a owl:Class ; rdfs:label "%s" ; rdfs:comment "%d instances" .', "type", "type", "n"))
    r = ontology.relationships(edges).select(F.lit(3), F.format_string(":%s_%s_%s a owl:ObjectProperty ; rdfs:label \"%s\" ; rdfs:domain :%s ; rdfs:range :%s .", "src_type", "edge_type", "dst_type", "edge_type", "src_type", "dst_type"))
    kind = F.when(F.col("kind") == "text", F.when(F.col("pattern") == "date", "xsd:date").otherwise("xsd:string")).when(F.col("pattern") == "integer", "xsd:integer").otherwise("xsd:float")
    d = rules.profile(props).select(F.lit(4), F.format_string(':%s_%s a owl:DatatypeProperty ; rdfs:label "%s" ; rdfs:domain :%s ; rdfs:range %s .', "type", "prop", "prop", "type", kind))
    return spark.createDataFrame(head, "place int, line string").union(c).union(r).union(d)


PREFIXES = {"owl": "http://www.w3.org/2002/07/owl#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#"}


def json_schema(nodes: DataFrame, edges: DataFrame, props: DataFrame) -> str:
    """A JSON Schema (draft 07) of the graph: a schema per node type with its properties' types, lengths, ranges, choices and
    formats, those that every node has as required; and the types of edges. It is built on the driver from a row per property."""
    by_type: dict[str, dict] = {r["type"]: {"type": "object", "properties": {"type": {"type": "string", "enum": [r["type"]]}}, "required": ["type"]} for r in nodes.select("type").distinct().orderBy("type").collect()}
    profiled = rules.profile(props)
    total = F.broadcast(nodes.groupBy("type").agg(F.count("*").alias("total")))
    for r in profiled.join(total, "type").join(rules.choices(props, profiled), ["type", "prop"], "left").orderBy("type", "prop").collect():
        if r["kind"] == "text":
            s: dict = {"type": "string", "minLength": r["min_length"], "maxLength": r["max_length"]}
            if r["pattern"] == "enumeration":
                s["enum"] = list(r["choices"])
            elif r["pattern"] in ("date", "email", "url"):
                s["format"] = {"url": "uri"}.get(r["pattern"], r["pattern"])
        else:
            s = {"type": "integer" if r["pattern"] == "integer" else "number", "minimum": r["min_value"], "maximum": r["max_value"]}
        by_type[r["type"]]["properties"][r["prop"]] = s
        if r["present"] == r["total"]:
            by_type[r["type"]]["required"].append(r["prop"])
    kinds = [r["edge_type"] for r in edges.select("edge_type").distinct().orderBy("edge_type").collect()]
    edge = {"type": "object", "properties": {"edge_type": {"type": "string", "enum": kinds}, "source": {"type": "string"}, "target": {"type": "string"}}, "required": ["edge_type", "source", "target"]}
    whole = {"$schema": "http://json-schema.org/draft-07/schema#", "type": "object", "properties": {"nodes": {"type": "object", "additionalProperties": {"oneOf": list(by_type.values())}}, "edges": {"type": "array", "items": edge}}, "required": ["nodes", "edges"]}
    return json.dumps(whole, indent=2)


def process_turtle(paths: DataFrame) -> DataFrame:
    """method paths (path and methods by >) -> (process, line): a process per path with a step per method, each with its number,
    what it uses and the step after it."""
    x = paths.select(F.split("path", ">").alias("c"), F.split("methods", ">").alias("m"))
    x = x.withColumn("process", F.concat(F.lit("process:"), F.regexp_replace(F.array_join(F.concat(F.slice("c", 1, 1), F.col("m"), F.slice("c", -1, 1)), "_"), r"\W", "")))
    step = lambda i: F.concat("process", F.lit("_Step"), i.cast("string"))
    steps = F.transform("m", lambda m, i: step(i + 1))
    head = x.select("process", F.concat("process", F.lit(" rdf:type process:Process .")).alias("line"))
    label = x.select("process", F.concat("process", F.lit(' rdfs:label "'), F.element_at("c", 1), F.lit(" to "), F.element_at("c", -1), F.lit('" .')))
    has = x.select("process", F.concat("process", F.lit(" process:hasStep "), F.array_join(steps, ", "), F.lit(" .")))
    first = x.select("process", F.concat("process", F.lit(" process:startsWith "), step(F.lit(1)), F.lit(" .")))
    each = x.select("process", F.size("m").alias("n"), F.posexplode("m").alias("i", "method"))
    one = each.select("process", F.concat(step(F.col("i") + 1), F.lit(" rdf:type process:Step ; process:usesMethod :"), F.col("method"), F.when(F.col("i") + 1 < F.col("n"), F.concat(F.lit(" ; process:followedBy "), step(F.col("i") + 2))).otherwise(""), F.lit(" .")))
    return head.union(label).union(has).union(first).union(one)
