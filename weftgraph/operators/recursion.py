"""Walks along edges by recursion in SQL: parents at any depth, simple paths, the course of a process.

Each is one WITH RECURSIVE whose step is one join, however deep the data are; a step works on what the last one found. Results
are written to the shared folder, since the limits of recursion are the session's and hold only while it runs.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise

LIMITS = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": "-1"}


@contextmanager
def _unlimited(spark):
    """Recursion that ends when nothing new is found, not at a number of rows or levels."""
    before = {k: spark.conf.get(k) for k in LIMITS}
    try:
        for k, v in LIMITS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _recursive(body: str, **tables: DataFrame) -> DataFrame:
    """The rows of a query over views of the tables, which it names in braces."""
    spark = next(iter(tables.values())).sparkSession
    names = {k: f"weft_{k}_{uuid.uuid4().hex[:8]}" for k in tables}
    try:
        for k, name in names.items():
            tables[k].createOrReplaceTempView(name)
        with _unlimited(spark):
            return materialise(spark.sql(body.format(**names)))
    finally:
        for name in names.values():
            spark.catalog.dropTempView(name)


def ancestors(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """edges(src, dst) from children to parents -> (node_id, parent, level) for start(node_id), or for all: the parents, theirs,
    and so on. A node met on several ways has a row for each length of way. Edges must not have a cycle."""
    edge = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    own = start.select("node_id").distinct() if start is not None else edge.select(F.col("src").alias("node_id")).distinct()
    return _recursive(
        """WITH RECURSIVE up(node_id, parent, level) AS (
             SELECT s.node_id, e.dst, 1 FROM {own} s JOIN {edge} e ON e.src = s.node_id
             UNION ALL SELECT up.node_id, e.dst, up.level + 1 FROM up JOIN {edge} e ON e.src = up.parent)
           SELECT DISTINCT node_id, parent, level FROM up""",
        own=materialise(own), edge=materialise(edge),
    )


def paths(steps: DataFrame, depth: int | None = None) -> DataFrame:
    """steps(src, dst, method) between classes -> (path, methods, length): simple paths of methods, all prefixes among them, of
    up to `depth` methods or of any number. Their number is that of the paths: for graphs of classes."""
    more = "" if depth is None else f" AND p.length < {int(depth)}"
    found = _recursive(
        f"""WITH RECURSIVE p(nodes, methods, length) AS (
             SELECT array(src, dst), array(method), 1 FROM {{steps}} WHERE src <> dst
             UNION ALL SELECT concat(p.nodes, array(s.dst)), concat(p.methods, array(s.method)), p.length + 1
             FROM p JOIN {{steps}} s ON s.src = element_at(p.nodes, -1) WHERE NOT array_contains(p.nodes, s.dst){more})
           SELECT * FROM p""",
        steps=materialise(steps.select("src", "dst", "method").dropna().distinct()),
    )
    return found.select(F.array_join("nodes", ">").alias("path"), F.array_join("methods", ">").alias("methods"), "length")


def walk(steps: DataFrame, start: str, most: int = 1000) -> DataFrame:
    """steps(src, dst) of a process -> (step, node) from start, the least next one at each, until there is none or `most` steps
    are made, which ends a cycle."""
    spark = steps.sparkSession
    least = steps.groupBy("src").agg(F.min("dst").alias("dst"))  # before the recursion, which then only joins
    begin = spark.createDataFrame([(start,)], "node string")
    return _recursive(
        f"""WITH RECURSIVE w(step, node) AS (
             SELECT 0, node FROM {{begin}}
             UNION ALL SELECT w.step + 1, l.dst FROM w JOIN {{least}} l ON l.src = w.node WHERE w.step < {int(most)} AND l.dst IS NOT NULL)
           SELECT step, node FROM w""",
        begin=begin, least=materialise(least),
    )
