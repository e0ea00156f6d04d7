"""Methods that enrich a graph, with provenance. A method is a pure function (nodes, edges) -> (new nodes, new edges, inputs,
outputs); running it adds an instance node, edges from its inputs and to its outputs. Methods register by their id; one that is
registered later under the same id is an error."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import enrich

NODE, EDGE = "node_id string, type string, value string", "src string, dst string, edge_type string"
#: Extensions that are recognised.
EXTENSIONS = ("pdf", "doc", "docx", "txt", "rtf", "odt", "jpg", "jpeg", "png", "gif", "bmp", "svg", "tiff", "mp3", "wav", "flac", "aac", "ogg", "mp4", "avi", "mkv", "mov", "wmv", "flv", "py", "js", "html", "css", "java", "cpp", "c", "php", "json", "xml", "csv", "xlsx", "sql", "zip", "rar", "7z", "tar", "gz", "pptx")


class Made(NamedTuple):
    """What a method adds, and the ids (node_id) that it read and made."""

    nodes: DataFrame
    edges: DataFrame
    inputs: DataFrame
    outputs: DataFrame


METHODS: dict[str, Callable[[DataFrame, DataFrame], Made]] = {}


def method(name: str):
    def register(f: Callable[[DataFrame, DataFrame], Made]) -> Callable[[DataFrame, DataFrame], Made]:
        if name in METHODS:
            raise ValueError(f"a method {name} is there already")
        METHODS[name] = f
        return f

    return register


@method("FileExtension")
def file_extension(nodes: DataFrame, edges: DataFrame) -> Made:
    """Files without has_extension get one from their file name, if it is recognised: an extension node `.ext` and an edge."""
    files = nodes.filter("type = 'file'").select(F.col("node_id").alias("src"))
    bare = files.join(edges.filter("edge_type = 'has_extension'").select("src"), "src", "left_anti")
    named = bare.join(edges.filter("edge_type = 'has_name'").select("src", F.col("dst").alias("name_id")), "src").join(nodes.select(F.col("node_id").alias("name_id"), "value"), "name_id")
    found = named.select("src", F.lower(F.regexp_extract("value", r"\.([a-zA-Z0-9]+)$", 1)).alias("ext")).filter(F.col("ext").isin(*EXTENSIONS)).distinct()
    own = F.concat(F.lit("extension:."), F.col("ext"))
    new = found.select(own.alias("node_id"), F.lit("extension").alias("type"), F.concat(F.lit("."), "ext").alias("value")).distinct()
    fresh = new.join(nodes.select("node_id"), "node_id", "left_anti")
    return Made(fresh, found.select("src", own.alias("dst"), F.lit("has_extension").alias("edge_type")), bare.select(F.col("src").alias("node_id")), new.select("node_id"))


@method("FileHistogram")
def file_histogram(nodes: DataFrame, edges: DataFrame) -> Made:
    """A node per extension with the number of files that have it."""
    n = edges.filter("edge_type = 'has_extension'").join(nodes.select(F.col("node_id").alias("dst"), "value"), "dst").groupBy("dst", "value").agg(F.count("*").alias("n"))
    made = n.select(F.concat(F.lit("histogram:"), "value").alias("node_id"), F.lit("histogram").alias("type"), F.concat_ws("=", "value", F.col("n").cast("string")).alias("value"))
    return Made(made, n.select(F.concat(F.lit("histogram:"), "value").alias("src"), "dst", F.lit("counts").alias("edge_type")), n.select(F.col("dst").alias("node_id")), made.select("node_id"))


@method("DateDetection")
def date_detection(nodes: DataFrame, edges: DataFrame) -> Made:
    """Components that hold a date or a time, told apart by the names that they are part of and by their siblings, become
    Timestamp nodes; a date and a time of one name are one timestamp, the least of each."""
    part = edges.filter("edge_type = 'has_component'").select("src", F.col("dst").alias("node_id"))
    token = part.join(nodes.filter("type = 'component'").select("node_id", F.col("value").alias("token")), "node_id").join(nodes.select(F.col("node_id").alias("src"), F.col("value").alias("parent")), "src")
    dated, timed = F.col("token").rlike(r"^20\d{6}$"), F.col("token").rlike(r"^\d{2}:\d{2}(:\d{2})?$")
    around = token.groupBy("src").agg(F.count_if(dated).alias("sibling_dates"), F.count_if(timed).alias("sibling_times"))
    context = token.join(around, "src")
    kinds = enrich.date_tokens(context.select("token", "parent", "sibling_dates", "sibling_times").distinct()).select("token", "kind", "text").distinct()
    found = context.select("src", "node_id", "token").join(kinds, "token")
    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("text")))
    g = found.groupBy("src").agg(least("date").alias("d"), least("time").alias("t"))
    stamp = F.concat_ws(" ", "d", "t")
    g = g.filter("d IS NOT NULL OR t IS NOT NULL").select("src", stamp.alias("value"), F.concat(F.lit("timestamp:"), stamp).alias("dst"))
    made = g.select(F.col("dst").alias("node_id"), F.lit("Timestamp").alias("type"), "value").distinct()
    return Made(made, g.select("src", "dst", F.lit("has_timestamp").alias("edge_type")).distinct(), found.select("node_id").distinct(), made.select("node_id"))


def run(name: str, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with what a method adds. An instance node named by the method has an edge `uses` from each input and
    `produces` to each output; a method that finds nothing to do adds nothing."""
    if name not in METHODS:
        raise ValueError(f"no method {name}; there are {', '.join(sorted(METHODS))}")
    made = METHODS[name](nodes, edges)
    own = F.lit(f"method:{name}")
    some = made.outputs.limit(1).select(own.alias("node_id"), F.lit(f"{name}Method").alias("type"), F.lit(name).alias("value"))
    used = made.inputs.crossJoin(F.broadcast(some.select(F.col("node_id").alias("_own")))).select(F.col("node_id").alias("src"), F.col("_own").alias("dst"), F.lit("uses").alias("edge_type"))  # one row or none
    gave = made.outputs.select(own.alias("src"), F.col("node_id").alias("dst"), F.lit("produces").alias("edge_type"))
    n = nodes.select("node_id", "type", "value").union(made.nodes).union(some)
    return n, edges.select("src", "dst", "edge_type").union(made.edges).union(used).union(gave).distinct()


def run_process(names: list[str], nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    """(nodes, edges, status of each step): methods one after another, each on what the last one left, which is written out. A
    step that isn't known is skipped and said so; the others go on."""
    from .tables import materialise

    said = []
    for name in names:
        if name not in METHODS:
            said.append((name, "unknown"))
            continue
        n, e = run(name, nodes, edges)
        nodes, edges = materialise(n), materialise(e)
        said.append((name, "done"))
    return nodes, edges, said


def method_insights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(method, outputs, failed, warnings): what each method instance produced, and how its results fared by their status."""
    from .search import status

    of = edges.filter("edge_type = 'produces'").select(F.col("src").alias("method"), F.col("dst").alias("id"))
    fared = status(nodes.withColumnRenamed("node_id", "id")).select("id", "resolved")
    return of.join(fared, "id").groupBy("method").agg(F.count("*").alias("outputs"), F.count_if(F.col("resolved") == "FAILED").alias("failed"), F.count_if(F.col("resolved") == "WARNING").alias("warnings"))
