"""Files as graphs: paths with names, components and extensions, folders with sizes and kinds, and what to read how."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ingest

#: Kinds of files by extension.
MIME = {"txt": "text/plain", "csv": "text/csv", "json": "application/json", "html": "text/html", "xml": "text/xml", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "zip": "application/zip", "gz": "application/gzip", "py": "text/x-python", "md": "text/markdown", "parquet": "application/vnd.apache.parquet", "mp4": "video/mp4", "mp3": "audio/mpeg"}


def path_graph(paths: DataFrame, column: str = "path") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a folder per prefix, a file per path, its file name without extension, components shared by all names, and
    extensions; contains, has_name, has_component and has_extension."""
    n = ingest.path_nodes(paths, column)
    files, folders = n.filter("type = 'file'"), n.filter("type = 'folder'")
    stem = F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")
    named = files.select("node_id", "depth", stem.alias("stem"), ingest.extension(F.col("name")).alias("ext"))
    # names are split by the delimiters of their depth; those of files are a level of their own
    levels = folders.select("depth", "name").union(named.select(F.lit(-1), "stem"))
    active = F.broadcast(ingest.delimiters(levels).groupBy("depth").agg(F.array_join(F.array_sort(F.collect_set("delimiter")), "").alias("set")))  # a row per depth
    owners = folders.select(F.concat(F.lit("folder:"), "node_id").alias("src"), "depth", "name").union(named.select(F.concat(F.lit("filename:"), "stem"), F.lit(-1), F.col("stem"))).distinct()
    split = owners.join(active, "depth", "left")
    text = F.col("name")
    for d in ingest.DELIMITERS:
        text = F.when(F.contains(F.coalesce(F.col("set"), F.lit("")), F.lit(d)), F.replace(text, F.lit(d), F.lit("\u0001"))).otherwise(text)
    parts = split.select("src", F.explode(F.filter(F.split(text, "\u0001"), lambda x: x != "")).alias("component"))
    kind = lambda c: F.concat(F.lit("folder:"), F.col(c))
    up = n.filter("depth > 0").select(F.regexp_replace("node_id", "/[^/]*$", "").alias("parent"), "node_id", "type")
    row = lambda df, src, edge, dst: df.select(src.alias("src"), F.lit(edge).alias("edge_type"), dst.alias("dst"))
    edges = row(up, kind("parent"), "contains", F.concat_ws(":", "type", "node_id"))
    edges = edges.union(row(named, F.concat(F.lit("file:"), "node_id"), "has_name", F.concat(F.lit("filename:"), "stem")))
    edges = edges.union(row(parts, F.col("src"), "has_component", F.concat(F.lit("component:"), "component")).distinct())
    edges = edges.union(row(named.filter("ext <> ''"), F.concat(F.lit("file:"), "node_id"), "has_extension", F.concat(F.lit("extension:"), "ext")))
    nodes = n.select(F.concat_ws(":", "type", "node_id").alias("node_id"), "type", F.when(F.col("type") == "folder", F.col("name")).otherwise(F.col("node_id")).alias("value"))
    made = lambda df, t, c: df.select(F.concat(F.lit(f"{t}:"), c).alias("node_id"), F.lit(t).alias("type"), F.col(c).alias("value")).distinct()
    nodes = nodes.union(made(named, "filename", "stem")).union(made(parts, "component", "component")).union(made(named.filter("ext <> ''"), "extension", "ext"))
    return nodes, edges


def folder_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, modified) of all files below a folder; their contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return f.select(F.regexp_replace("path", "^[a-z]+:/+", "/").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def folder_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """folder_files() -> path_graph() with has_size and has_type edges to a node per size and per kind, for every file."""
    nodes, edges = path_graph(files)
    kinds = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    file = F.concat(F.lit("file:"), F.regexp_replace("path", "^/+", ""))
    f = files.select(file.alias("src"), F.col("size").cast("string").alias("size"), F.coalesce(F.element_at(kinds, ingest.extension(F.col("path"))), F.lit("unknown")).alias("kind"))
    more = f.select("src", F.lit("has_size"), F.concat(F.lit("file_size:"), "size")).union(f.select("src", F.lit("has_type"), F.concat(F.lit("file_type:"), "kind")))
    made = f.select(F.concat(F.lit("file_size:"), "size"), F.lit("file_size"), "size").union(f.select(F.concat(F.lit("file_type:"), "kind"), F.lit("file_type"), "kind")).distinct()
    return nodes.union(made), edges.union(more)


def allowed_file(name: str, allowed: set[str]) -> bool:
    return "." in name and name.rsplit(".", 1)[1].lower() in allowed


def file_patterns(text: str | None) -> list[str]:
    """Patterns of a list by commas or lines."""
    return [p.strip() for line in (text or "").splitlines() for p in line.split(",") if p.strip()]


def is_graph_json(path: str, first: int = 3) -> bool:
    """Whether a JSON file holds a graph: nodes by whole numbers and edges by two of them with an underscore, by the first few."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, dict) or not isinstance(data.get("nodes"), dict) or not isinstance(data.get("edges"), dict):
        return False
    whole = lambda s: s.lstrip("-").isdigit()
    return all(whole(k) for k in list(data["nodes"])[:first]) and all(k.count("_") == 1 and all(map(whole, k.split("_"))) for k in list(data["edges"])[:first])


def read_any(spark: SparkSession, path: str, rules: list[ingest.ColumnRule] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a CSV file by its column rules, of a graph in JSON or JSON lines, or of a JSON tree."""
    end = path.rsplit(".", 1)[-1].lower()
    if end == "csv":
        if not rules:
            raise ValueError("a CSV file needs column rules")
        df = spark.read.option("header", "true").csv(path)
        if said := ingest.validate(rules, df.columns):
            raise ValueError("; ".join(said))
        return ingest.frame_nodes(df, rules), ingest.frame_edges(df, rules)
    if end == "jsonl":
        n, e = ingest.read_graph_lines(spark, path)
        return n.select("node_id", "type", "value"), e.select("src", "dst", "edge_type")
    if end != "json":
        raise ValueError(f"{path}: neither CSV nor JSON")
    if is_graph_json(path):
        n, e = ingest.read_graph_json(spark, path)
        return n.select("node_id", "type", "value"), e.select("src", "dst", "edge_type")
    tree = ingest.json_nodes(spark.read.text(path, wholetext=True).select(F.lit(0).alias("doc"), F.col("value").alias("j")), "j")
    return tree.select(F.col("path").alias("node_id"), "type", "value"), ingest.json_edges(tree).drop("doc")


def tables(spark: SparkSession, folder: str) -> DataFrame:
    """(id, nodes, edges) of the graphs saved below a folder, by their Parquet footers."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select("path")
    part = lambda k: F.element_at(F.split("path", "/"), k)
    ids = [r["id"] for r in found.select(part(-3).alias("id")).distinct().orderBy("id").collect()]  # one per saved graph
    rows = [(i, spark.read.parquet(f"{folder}/{i}/nodes").count(), spark.read.parquet(f"{folder}/{i}/edges").count()) for i in ids]
    return spark.createDataFrame(rows, "id string, nodes long, edges long")
