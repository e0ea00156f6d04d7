"""Ontology files: Turtle, JSON Schema, plain JSON and process definitions. A file is one row and is parsed as a whole; files are
small, and many of them are many rows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The namespaces that names are cut from, and the primitive types.
NAMESPACES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}
PRIMITIVES = ("string", "integer", "float", "boolean", "dateTime")
_TOKEN = re.compile(r'\s+|#[^\n]*|(?P<t><[^>]*>|"""(?:[^"\\]|\\.|"(?!""))*"""(?:@[\w-]+|\^\^(?:<[^>]*>|[\w.-]*:[\w.-]*))?|"(?:[^"\\\n]|\\.)*"(?:@[\w-]+|\^\^(?:<[^>]*>|[\w.-]*:[\w.-]*))?|[\[\]();,]|\.(?=\s|$)|@prefix|@base|[^\s;,\[\]()"<]+)')


def _tokens(text: str):
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no Turtle at {text[at:at + 40]!r}")
        if m["t"]:
            yield m["t"]
        at = m.end()


def parse_turtle(text: str) -> list[tuple[str, str, str]]:
    """Triples of a Turtle text: prefixes, `a`, lists by ; and , and literals. Full names are shortened by the file's prefixes and
    NAMESPACES. Blank nodes and collections aren't read and are an error."""
    prefixes, out, words = {v: k for k, v in NAMESPACES.items()}, [], []

    def name(t: str) -> str:
        if t.startswith("<"):
            uri = t[1:-1]
            base = max((b for b in prefixes if b and uri.startswith(b)), key=len, default=None)
            return f"{prefixes[base]}:{uri[len(base):]}" if base else uri
        return "a" if t == "rdf:type" else t

    def close() -> None:
        if not words:
            return
        if words[0] in ("@prefix", "PREFIX", "prefix"):
            prefixes[words[2][1:-1]] = words[1].rstrip(":")
        elif words[0] not in ("@base", "BASE"):
            subject, i = name(words[0]), 1
            while i < len(words):
                p = name(words[i])
                i += 1
                while i < len(words):
                    out.append((subject, p, name(words[i])))
                    i += 1
                    if i < len(words) and words[i] == ",":
                        i += 1
                        continue
                    break
                while i < len(words) and words[i] == ";":
                    i += 1
        words.clear()

    for t in _tokens(text):
        if t in ("[", "]", "(", ")"):
            raise ValueError("blank nodes and collections aren't read")
        if t == ".":
            close()
        else:
            words.append(t)
    close()
    return out


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """(file, s, p, o) of the Turtle files at path."""

    def run(parts):
        for part in parts:
            rows = [(f, *t) for f, text in zip(part["file"], part["text"]) for t in parse_turtle(text)]
            yield pd.DataFrame(rows, columns=["file", "s", "p", "o"])

    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("text")).mapInPandas(run, "file string, s string, p string, o string")


def turtle_graph(triples: DataFrame, core: str = "core") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, annotations) of triples(s, p, o): classes, primitive types, classes that properties imply; an edge from
    domain to range for each object and datatype property; annotations are the triples whose predicate is of `core`."""
    said = lambda p: triples.filter(F.col("p") == p).select(F.col("s").alias("k"), F.regexp_replace("o", r'^"|"(@[\w-]+|\^\^\S+)?$', "").alias("v"))
    of = lambda kind: triples.filter((F.col("p") == "a") & (F.col("o") == kind)).select("s").distinct()
    comment = said("rdfs:comment").groupBy("k").agg(F.min("v").alias("comment"))
    classes = of("owl:Class").join(comment, F.col("s") == F.col("k"), "left").select(F.col("s").alias("node_id"), F.lit("Class").alias("type"), F.coalesce("comment", F.lit("")).alias("comment"))
    ends = said("rdfs:domain").groupBy("k").agg(F.min("v").alias("src")).join(said("rdfs:range").groupBy("k").agg(F.min("v").alias("dst")), "k")
    kinds = of("owl:ObjectProperty").withColumn("kind", F.lit("object")).union(of("owl:DatatypeProperty").withColumn("kind", F.lit("datatype")))
    edges = kinds.join(ends, F.col("s") == F.col("k")).select("src", "dst", F.col("s").alias("edge_type"), "kind")
    spark = triples.sparkSession
    primitive = spark.createDataFrame([(f"xsd:{t}", "Primitive", f"XSD Primitive Type: {t}") for t in PRIMITIVES], "node_id string, type string, comment string")
    known = classes.select("node_id").union(primitive.select("node_id"))
    implied = edges.select(F.col("src").alias("node_id"), F.lit("ImpliedClass").alias("type")).union(edges.select("dst", F.when(F.col("kind") == "object", "ImpliedClass").otherwise("Primitive")))
    implied = implied.groupBy("node_id").agg(F.min("type").alias("type")).join(known, "node_id", "left_anti").withColumn("comment", F.lit(""))
    notes = triples.filter(F.col("p").startswith(f"{core}:")).select("s", "p", F.regexp_replace("o", r'^"|"(@[\w-]+|\^\^\S+)?$', "").alias("value"))
    return classes.union(primitive).union(implied), edges, notes


def read_json_schema(spark: SparkSession, path: str) -> DataFrame:
    """(type, prop, kind, required) of a JSON Schema of node types, as `export.json_schema` writes it."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    raw.createOrReplaceTempView("weft_json_schema")
    kinds = spark.sql("SELECT t.value AS t FROM weft_json_schema, LATERAL variant_explode(variant_get(v, '$.properties.nodes.additionalProperties.oneOf')) t")
    spark.catalog.dropTempView("weft_json_schema")
    one = kinds.select(F.variant_get("t", "$.properties.type.enum[0]", "string").alias("type"), F.variant_get("t", "$.required", "array<string>").alias("need"), F.variant_get("t", "$.properties", "map<string,variant>").alias("props"))
    each = one.select("type", "need", F.explode("props").alias("prop", "s")).filter("prop <> 'type'")
    return each.select("type", "prop", F.try_variant_get("s", "$.type", "string").alias("kind"), F.coalesce(F.array_contains("need", F.col("prop")), F.lit(False)).alias("required"))


def read_ontology_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(types, relationships) of {"node_types": {name: {"count", "properties": [...]}}, "relationships": [{"source_type",
    "edge_type", "target_type", "count"}]}."""
    kind = "node_types map<string,struct<count:long,properties:array<string>>>, relationships array<struct<source_type:string,edge_type:string,target_type:string,count:long>>"
    x = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("x"))
    types = x.select(F.explode("x.node_types").alias("type", "i")).select("type", F.coalesce("i.count", F.lit(0)).alias("n"), F.coalesce("i.properties", F.array().cast("array<string>")).alias("properties"))
    rel = x.select(F.explode("x.relationships").alias("r")).select(F.col("r.source_type").alias("src_type"), F.col("r.edge_type").alias("edge_type"), F.col("r.target_type").alias("dst_type"), F.coalesce("r.count", F.lit(0)).alias("n"))
    return types, rel


def read_processes(spark: SparkSession, path: str) -> DataFrame:
    """(file, process, name, description, steps) of the processes that Turtle files define, found by patterns in their text."""
    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    each = raw.select("file", "value", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(r"(process:\w+)\s+(?:rdf:type|a)\s+process:Process"), 1))).alias("process"))
    after = lambda p: F.call_function("regexp_extract", F.col("value"), F.concat(F.col("process"), F.lit(p)), F.lit(1))
    label, comment = after(r'\s+rdfs:label\s+"([^"]+)"'), after(r'\s+rdfs:comment\s+"([^"]+)"')
    steps = after(r"(?s)\b.*?process:hasStep\s+([\w:,\s]+)")
    n = F.size(F.filter(F.split(steps, r",\s*"), lambda s: F.trim(s) != ""))
    return each.select("file", "process", F.when(label != "", label).otherwise(F.element_at(F.split("process", ":"), -1)).alias("name"), comment.alias("description"), n.alias("steps"))
