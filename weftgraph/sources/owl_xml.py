"""OWL/XML ontologies as triples(s, p, o), by Spark's XML source: axioms are rows, and a file is read as a stream of them and never
held whole. That source doesn't split a file, so a file is a task's work; write() makes a file per task.

An axiom's element is the row; its entities are named by IRI or abbreviatedIRI, in order where one kind occurs twice. Each kind of
axiom is a scan of its own. Literals come in double quotes, as from Turtle. Axioms of other kinds, and those between class
expressions instead of names, give no triples.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The entities of a declaration and the types they declare.
DECLARED = {"Class": "owl:Class", "ObjectProperty": "owl:ObjectProperty", "DataProperty": "owl:DatatypeProperty"}
#: Axioms of two entities, (axiom, first, second, predicate); the same element twice is a pair of it.
PAIRS = (
    ("SubClassOf", "Class", "Class", "rdfs:subClassOf"),
    ("ObjectPropertyDomain", "ObjectProperty", "Class", "rdfs:domain"),
    ("ObjectPropertyRange", "ObjectProperty", "Class", "rdfs:range"),
    ("DataPropertyDomain", "DataProperty", "Class", "rdfs:domain"),
    ("DataPropertyRange", "DataProperty", "Datatype", "rdfs:range"),
    ("SubObjectPropertyOf", "ObjectProperty", "ObjectProperty", "rdfs:subPropertyOf"),
)
NOTE = "AnnotationAssertion"
NAMED = "struct<_IRI:string,_abbreviatedIRI:string>"


def _name(x: Column) -> Column:
    return F.coalesce(x["_abbreviatedIRI"], x["_IRI"])


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").schema(schema).option("rowTag", tag).option("mode", "DROPMALFORMED").load(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of the OWL/XML files at a path, which may be a folder."""
    d = _rows(spark, path, "Declaration", ", ".join(f"{k} {NAMED}" for k in DECLARED))
    found = [d.select(_name(F.col(k)).alias("s"), F.lit("a").alias("p"), F.lit(v).alias("o")).filter("s IS NOT NULL") for k, v in DECLARED.items()]
    for tag, a, b, p in PAIRS:
        x = _rows(spark, path, tag, ", ".join(f"{k} array<{NAMED}>" for k in dict.fromkeys((a, b))))
        first, second = F.get(a, F.lit(0)), F.get(b, F.lit(1 if a == b else 0))
        whole = x.filter((F.size(a) == (2 if a == b else 1)) & (F.size(b) == (2 if a == b else 1)))
        found.append(whole.select(_name(first).alias("s"), F.lit(p).alias("p"), _name(second).alias("o")))
    n = _rows(spark, path, NOTE, f"AnnotationProperty {NAMED}, IRI string, AbbreviatedIRI string, Literal string")
    found.append(n.select(F.coalesce("AbbreviatedIRI", "IRI").alias("s"), _name(F.col("AnnotationProperty")).alias("p"), F.concat(F.lit('"'), "Literal", F.lit('"')).alias("o")))
    return reduce(DataFrame.union, found).filter("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")


def write(triples: DataFrame, folder: str) -> None:
    """Writes the triples that read() knows, a subfolder for each kind of axiom. A domain or range is of an object property
    unless its subject is declared a datatype property."""
    data = triples.filter("p = 'a' AND o = 'owl:DatatypeProperty'").select(F.col("s").alias("d")).distinct()
    t = triples.join(data, F.col("s") == F.col("d"), "left").withColumn("is_data", F.col("d").isNotNull())
    named = lambda c: F.struct(F.col(c).alias("_abbreviatedIRI"))
    save = lambda df, tag, name: df.write.format("xml").option("rootTag", "Ontology").option("rowTag", tag).option("declaration", 'version="1.0"').save(f"{folder}/{name}")
    for kind, o in DECLARED.items():
        save(t.filter((F.col("p") == "a") & (F.col("o") == o)).select(named("s").alias(kind)), "Declaration", kind)
    for tag, a, b, p in PAIRS:
        rows = t.filter(F.col("p") == p)
        if a != b:
            rows = rows.filter(F.col("is_data") == (a == "DataProperty"))
        both = [F.array(named("s"), named("o")).alias(a)] if a == b else [named("s").alias(a), named("o").alias(b)]
        save(rows.select(*both), tag, tag)
    notes = t.filter(F.col("o").startswith('"')).select(named("p").alias("AnnotationProperty"), F.col("s").alias("AbbreviatedIRI"), F.regexp_replace("o", r'^"|"(@[\w-]+|\^\^\S+)?$', "").alias("Literal"))
    save(notes, NOTE, NOTE)
