"""Queries on sources and sinks: what a file would hold, and what reading it again gives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import columns
from ..operators import recursion, views
from ..operators.tables import shared_base
from ..sources import export, files, ingest, owl_xml, semantic
from .catalog import GEO, REL, STEPS_SQL, E, N, P, T, _paths, add, process_steps, with_
from .ontology_queries import RICH, _rich, profile_sql


def _written(df: DataFrame, column: str, order: list[str]) -> str:
    """A text file of few lines, in order, in the shared folder."""
    path = f"{shared_base(df.sparkSession)}/weft-text-{uuid.uuid4().hex[:12]}"
    df.orderBy(*order).coalesce(1).select(column).write.text(path)
    return path


# --- paths and trees

PG = r"""WITH q AS (SELECT list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS parts FROM pages WHERE url IS NOT NULL),
x AS (SELECT parts, unnest(generate_series(1, len(parts))) AS i FROM q WHERE len(parts) > 0),
pn AS (SELECT array_to_string(parts[1:i], '/') AS id, parts[i] AS name, i - 1 AS depth, max(CASE WHEN i = len(parts) THEN 'file' ELSE 'folder' END) AS type FROM x GROUP BY 1, 2, 3),
nm AS (SELECT id, CASE WHEN length(name) > 1 AND contains(name[2:], '.') THEN regexp_replace(name, '\.[^.]*$', '') ELSE name END AS stem, lower(regexp_extract(name, '\.([A-Za-z0-9]+)$', 1)) AS ext FROM pn WHERE type = 'file'),
lv AS (SELECT DISTINCT depth, name FROM pn WHERE type = 'folder' UNION SELECT -1, stem FROM nm),
dl AS (SELECT depth, list(d) AS ds FROM (SELECT depth, d FROM lv, (SELECT unnest(['_', '-', '.', ' ']) AS d) GROUP BY 1, 2 HAVING sum(CASE WHEN contains(name, d) THEN 1 ELSE 0 END) >= 0.2 * count(*)) GROUP BY 1),
ow AS (SELECT 'folder:' || id AS src, depth, name FROM pn WHERE type = 'folder' UNION SELECT 'filename:' || stem, -1, stem FROM nm),
cp AS (SELECT DISTINCT src, component FROM (SELECT src, unnest(string_split(list_reduce(list_concat([name], coalesce(ds, CAST([] AS VARCHAR[]))), lambda a, c: replace(a, c, chr(1))), chr(1))) AS component FROM ow LEFT JOIN dl USING (depth)) WHERE component <> '') """
add(
    "path_graph_edges",
    lambda s, d: files.path_graph(_paths(s, d))[1],
    PG + "SELECT 'folder:' || regexp_replace(id, '/[^/]*$', '') AS src, 'contains' AS edge_type, type || ':' || id AS dst FROM pn WHERE depth > 0 UNION ALL SELECT 'file:' || id, 'has_name', 'filename:' || stem FROM nm UNION ALL SELECT src, 'has_component', 'component:' || component FROM cp UNION ALL SELECT 'file:' || id, 'has_extension', 'extension:' || ext FROM nm WHERE ext <> ''",
    False,
)
add(
    "path_graph_nodes",
    lambda s, d: files.path_graph(_paths(s, d))[0],
    PG + "SELECT type || ':' || id AS node_id, type, CASE WHEN type = 'folder' THEN name ELSE id END AS value FROM pn UNION ALL SELECT DISTINCT 'filename:' || stem, 'filename', stem FROM nm UNION ALL SELECT DISTINCT 'component:' || component, 'component', component FROM cp UNION ALL SELECT DISTINCT 'extension:' || ext, 'extension', ext FROM nm WHERE ext <> ''",
    False,
)
add("json_edges", lambda s, d: ingest.json_edges(ingest.json_nodes(T(s, d, "events").select(F.col("event_id").alias("doc"), "props"), "props")), "SELECT event_id AS doc, 'root' AS src, 'root.' || key AS dst, key AS edge_type FROM (SELECT event_id, unnest(json_keys(CAST(props AS JSON))) AS key FROM events WHERE props IS NOT NULL)", False)


def _engines(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as engines, their lines as cycles."""
    w = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return T(s, d, "lineitem").select(F.col("l_suppkey").cast("int").alias("unit_number"), F.row_number().over(w).alias("time_cycles"), F.col("l_quantity").alias("T2"), F.col("l_extendedprice").alias("P2"), F.col("l_discount").alias("setting_1"), F.col("l_tax").alias("setting_2"), F.lit(None).cast("double").alias("setting_3"))


def _engine_graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rul = T(s, d, "supplier").select(F.col("s_suppkey").cast("int").alias("unit_number"), (F.col("s_suppkey") % 121).cast("int").alias("rul"))
    return ingest.turbofan_graph(_engines(s, d), rul, ("T2", "P2"))


TF = """WITH c AS (SELECT l_suppkey AS u, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) AS t, l_quantity AS T2, l_extendedprice AS P2, l_discount AS setting_1, l_tax AS setting_2 FROM lineitem),
l AS (SELECT 'Engine_' || u AS engine, u, name, t, reading FROM (UNPIVOT c ON T2, P2, setting_1, setting_2 INTO NAME name VALUE reading)),
r AS (SELECT engine, u, name, floor((row_number() OVER (PARTITION BY u, name ORDER BY t) - 1) / 10) AS run, reading FROM l),
g AS (SELECT engine, name, CAST(run AS BIGINT) AS run, avg(reading) AS mean, engine || '_' || name || CASE WHEN name LIKE 'setting%' THEN '' ELSE '_Sensor' END AS stream, CASE name WHEN 'T2' THEN '°R' WHEN 'P2' THEN 'psia' END AS unit FROM r GROUP BY 1, 2, 3) """
add(
    "turbofan_nodes",
    lambda s, d: _engine_graph(s, d)[0].withColumn("value", F.when(F.col("type").isin("measurement_sequence", "setting_value"), columns.binary_round(F.col("value").cast("double"), 3).cast("decimal(20,3)").cast("string")).otherwise(F.col("value"))),
    TF + """SELECT DISTINCT engine AS node_id, 'turbofan_engine' AS type, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS unit FROM g
    UNION ALL SELECT DISTINCT stream, CASE name WHEN 'T2' THEN 'temperature_sensor' WHEN 'P2' THEN 'pressure_sensor' ELSE 'operational_setting' END, name, unit FROM g
    UNION ALL SELECT stream || '_' || run, CASE WHEN name LIKE 'setting%' THEN 'setting_value' ELSE 'measurement_sequence' END, CAST(CAST(round(round(mean, 6), 3) AS DECIMAL(20, 3)) AS VARCHAR), unit FROM g
    UNION ALL SELECT engine || '_RUL_Predictor', 'rul_predictor', CAST(s_suppkey % 121 AS VARCHAR), 'cycles' FROM (SELECT DISTINCT engine, u FROM l) JOIN supplier ON s_suppkey = u""",
    False,
)
add("turbofan_edges", lambda s, d: _engine_graph(s, d)[1], TF + "SELECT DISTINCT engine AS src, CASE WHEN name LIKE 'setting%' THEN 'has_operational_setting' ELSE 'has_sensor' END AS edge_type, stream AS dst FROM g UNION ALL SELECT stream, CASE WHEN name LIKE 'setting%' THEN 'produces_setting_value' ELSE 'produces_measurement' END, stream || '_' || run FROM g UNION ALL SELECT engine, 'has_rul_prediction', engine || '_RUL_Predictor' FROM (SELECT DISTINCT engine, u FROM l) JOIN supplier ON s_suppkey = u", False)

# --- ontologies as graphs and files

add("schema_graph_nodes", lambda s, d: export.schema_graph(N(s, d), _doubled(s, d))[0], with_("e2 AS (SELECT * FROM e UNION ALL SELECT src, dst, 'owns', src_type, dst_type FROM e WHERE edge_type = 'placed' AND src <> 'customer:1')", "r AS (SELECT src_type, edge_type, dst_type, count(*) AS n FROM e2 GROUP BY ALL)") + "SELECT type AS node_id, 'NodeType' AS type, count(*) AS n FROM n GROUP BY n.type UNION ALL SELECT 'Rel_' || src_type || '_' || edge_type || '_' || dst_type, 'Relationship', n FROM r QUALIFY row_number() OVER (PARTITION BY src_type, dst_type ORDER BY n DESC, edge_type) > 1")


def _doubled(s: SparkSession, d: str) -> DataFrame:
    """The edges with a second, rarer edge type between customers and orders."""
    e = E(s, d)
    return e.union(e.filter("edge_type = 'placed' AND src <> 'customer:1'").withColumn("edge_type", F.lit("owns")))


DOUBLE = "e2 AS (SELECT * FROM e UNION ALL SELECT src, dst, 'owns', src_type, dst_type FROM e WHERE edge_type = 'placed' AND src <> 'customer:1')", "r AS (SELECT src_type, edge_type, dst_type, count(*) AS n FROM e2 GROUP BY ALL)"
add(
    "schema_graph_edges",
    lambda s, d: export.schema_graph(N(s, d), _doubled(s, d))[1],
    with_(*DOUBLE, "k AS (SELECT *, row_number() OVER (PARTITION BY src_type, dst_type ORDER BY n DESC, edge_type) AS k, 'Rel_' || src_type || '_' || edge_type || '_' || dst_type AS id FROM r)")
    + "SELECT src_type AS src, dst_type AS dst, edge_type, n FROM k WHERE k = 1 UNION ALL SELECT src_type, id, 'SOURCE_OF', n FROM k WHERE k > 1 UNION ALL SELECT id, dst_type, 'TARGET_OF', n FROM k WHERE k > 1",
)
add("reified_nodes", lambda s, d: export.reified(N(s, d), E(s, d))[0], with_(REL) + "SELECT 'node_type:' || type AS node_id, 'NodeType' AS type, count(*) AS n FROM n GROUP BY n.type UNION ALL SELECT 'edge_type:' || edge_type, 'EdgeType', CAST(sum(n) AS BIGINT) FROM r GROUP BY edge_type")
add("reified_edges", lambda s, d: export.reified(N(s, d), E(s, d))[1], with_(REL) + "SELECT 'node_type:' || src_type AS src, 'edge_type:' || edge_type AS dst, 'source_of' AS edge_type, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY src_type, r.edge_type UNION ALL SELECT 'edge_type:' || edge_type, 'node_type:' || dst_type, 'targets', CAST(sum(n) AS BIGINT) FROM r GROUP BY r.edge_type, dst_type")
add("graph_json", lambda s, d: export.graph_json(N(s, d).filter("type IN ('nation', 'region')"), E(s, d, ("in_region",)).select("src", "dst", "edge_type")), """SELECT 'nodes' AS part, node_id AS key, '{"type":"' || type || '","value":"' || value || '","hierarchy":' || hierarchy || '}' AS value FROM n WHERE type IN ('nation', 'region') UNION ALL SELECT 'edges', src || '|' || dst, '{"edge_type":"in_region"}' FROM e WHERE edge_type = 'in_region'""")


def _triples(s: SparkSession, d: str) -> DataFrame:
    lines = export.turtle(N(s, d), E(s, d), _rich(s, d))
    return semantic.read_turtle(s, _written(lines, "line", ["place", "line"])).select("s", "p", "o")


KIND = "CASE WHEN kind = 'text' THEN CASE WHEN pattern = 'date' THEN 'xsd:date' ELSE 'xsd:string' END WHEN pattern = 'integer' THEN 'xsd:integer' ELSE 'xsd:float' END"
add(
    "turtle_triples",
    _triples,
    with_(RICH, *profile_sql("px", "pf"), REL, "tt AS (SELECT type, count(*) AS c FROM n GROUP BY 1)", "o AS (SELECT ':' || src_type || '_' || edge_type || '_' || dst_type AS s, * FROM r)", f"dp AS (SELECT ':' || type || '_' || prop AS s, prop, type, {KIND} AS k FROM pf)")
    + """SELECT 'http://example.org/ontology' AS s, 'a' AS p, 'owl:Ontology' AS o UNION ALL SELECT ':' || type, unnest(['a', 'rdfs:label', 'rdfs:comment']), unnest(['owl:Class', '"' || type || '"', '"' || c || ' instances"']) FROM tt
    UNION ALL SELECT s, unnest(['a', 'rdfs:label', 'rdfs:domain', 'rdfs:range']), unnest(['owl:ObjectProperty', '"' || edge_type || '"', ':' || src_type, ':' || dst_type]) FROM o
    UNION ALL SELECT s, unnest(['a', 'rdfs:label', 'rdfs:domain', 'rdfs:range']), unnest(['owl:DatatypeProperty', '"' || prop || '"', ':' || type, k]) FROM dp""",
)
add(
    "turtle_graph_edges",
    lambda s, d: semantic.turtle_graph(_triples(s, d))[1],
    with_(RICH, *profile_sql("px", "pf"), REL) + f"SELECT ':' || src_type AS src, ':' || dst_type AS dst, ':' || src_type || '_' || edge_type || '_' || dst_type AS edge_type, 'object' AS kind FROM r UNION ALL SELECT ':' || type, {KIND}, ':' || type || '_' || prop, 'datatype' FROM pf",
)
add(
    "turtle_graph_nodes",
    lambda s, d: semantic.turtle_graph(_triples(s, d))[0],
    "SELECT ':' || type AS node_id, 'Class' AS type, count(*) || ' instances' AS comment FROM n GROUP BY n.type UNION ALL SELECT 'xsd:' || t, 'Primitive', 'XSD Primitive Type: ' || t FROM (VALUES ('string'), ('integer'), ('float'), ('boolean'), ('dateTime')) v(t) UNION ALL SELECT 'xsd:date', 'Primitive', ''",
)


def _schema(s: SparkSession, d: str) -> DataFrame:
    text = s.createDataFrame([(0, export.json_schema(N(s, d), E(s, d), _rich(s, d)))], "i int, line string")
    return semantic.read_json_schema(s, _written(text, "line", ["i"]))


add("json_schema", _schema, with_(RICH, *profile_sql("px", "pf")) + "SELECT type, prop, CASE WHEN kind = 'text' THEN 'string' WHEN pattern = 'integer' THEN 'integer' ELSE 'number' END AS kind, present = total AS required FROM pf JOIN (SELECT type, count(*) AS total FROM n GROUP BY 1) USING (type)")


def _processes(s: SparkSession, d: str) -> DataFrame:
    return export.process_turtle(recursion.paths(process_steps(s, d), 3).drop("length"))


def _read_processes(s: SparkSession, d: str) -> DataFrame:
    return semantic.read_processes(s, _written(_processes(s, d), "line", ["process", "line"])).select("process", "name", "steps")


#: The simple paths of up to three methods.
PATHS = f"WITH RECURSIVE {STEPS_SQL}, " + """
w AS (SELECT [src, dst] AS c, [method] AS m FROM m UNION ALL SELECT list_append(c, dst), list_append(w.m, method) FROM w JOIN m ON c[-1] = src WHERE len(w.m) < 3 AND NOT list_contains(c, dst)),
z AS (SELECT *, 'process:' || regexp_replace(array_to_string(list_concat(list_concat([c[1]], m), [c[-1]]), '_'), '\\W', '', 'g') AS process FROM w) """
add("process_files", lambda s, d: _read_processes(s, d), PATHS + "SELECT process, c[1] || ' to ' || c[-1] AS name, CAST(len(m) AS INTEGER) AS steps FROM z", False)
add(
    "process_turtle",
    lambda s, d: _processes(s, d),
    PATHS + """SELECT process, process || ' rdf:type process:Process .' AS line FROM z UNION ALL SELECT process, process || ' rdfs:label "' || c[1] || ' to ' || c[-1] || '" .' FROM z UNION ALL SELECT process, process || ' process:startsWith ' || process || '_Step1 .' FROM z
    UNION ALL SELECT process, process || ' process:hasStep ' || array_to_string(list_transform(generate_series(1, len(m)), lambda i: process || '_Step' || i), ', ') || ' .' FROM z
    UNION ALL SELECT process, process || '_Step' || i || ' rdf:type process:Step ; process:usesMethod :' || m[i] || CASE WHEN i < len(m) THEN ' ; process:followedBy ' || process || '_Step' || (i + 1) ELSE '' END || ' .' FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM z)""",
    False,
)


def _schema_triples(s: SparkSession, d: str) -> DataFrame:
    """The graph's types, relationships and properties as an ontology."""
    n, e, p = N(s, d), E(s, d), P(s, d)
    colon = lambda c: F.concat(F.lit(":"), F.col(c))
    say = lambda df, a, b, c: df.select(a.alias("s"), F.lit(b).alias("p"), c.alias("o"))
    types, rel = n.groupBy("type").agg(F.count("*").alias("n")), e.select("src_type", "edge_type", "dst_type").distinct()
    own = p.groupBy("type", "prop").agg(F.bool_or(F.col("d_val").isNotNull()).alias("number"))
    found = say(types, colon("type"), "a", F.lit("owl:Class")).union(say(types, colon("type"), "rdfs:subClassOf", F.lit(":node"))).union(say(types, colon("type"), "rdfs:comment", F.concat(F.lit('"'), F.col("n").cast("string"), F.lit(' & more <nodes>"'))))
    found = found.union(say(rel, colon("edge_type"), "a", F.lit("owl:ObjectProperty"))).union(say(rel, colon("edge_type"), "rdfs:domain", colon("src_type"))).union(say(rel, colon("edge_type"), "rdfs:range", colon("dst_type")))
    found = found.union(say(own, colon("prop"), "a", F.lit("owl:DatatypeProperty"))).union(say(own, colon("prop"), "rdfs:domain", colon("type"))).union(say(own, colon("prop"), "rdfs:range", F.when(F.col("number"), "xsd:double").otherwise("xsd:string")))
    return found.distinct()


def _owl_xml(s: SparkSession, d: str) -> DataFrame:
    folder = f"{shared_base(s)}/weft-owl-{uuid.uuid4().hex[:12]}"
    owl_xml.write(_schema_triples(s, d), folder)
    return owl_xml.read(s, f"{folder}/*")


add(
    "owl_xml_triples",
    _owl_xml,
    with_("ty AS (SELECT type, count(*) AS k FROM n GROUP BY 1)", "re AS (SELECT DISTINCT src_type, edge_type, dst_type FROM e)", "ow AS (SELECT type, prop, bool_or(d_val IS NOT NULL) AS number FROM p GROUP BY 1, 2)")
    + """SELECT ':' || type AS s, 'a' AS p, 'owl:Class' AS o FROM ty UNION SELECT ':' || type, 'rdfs:subClassOf', ':node' FROM ty UNION SELECT ':' || type, 'rdfs:comment', '"' || k || ' & more <nodes>"' FROM ty
    UNION SELECT ':' || edge_type, 'a', 'owl:ObjectProperty' FROM re UNION SELECT ':' || edge_type, 'rdfs:domain', ':' || src_type FROM re UNION SELECT ':' || edge_type, 'rdfs:range', ':' || dst_type FROM re
    UNION SELECT ':' || prop, 'a', 'owl:DatatypeProperty' FROM ow UNION SELECT ':' || prop, 'rdfs:domain', ':' || type FROM ow UNION SELECT ':' || prop, 'rdfs:range', CASE WHEN number THEN 'xsd:double' ELSE 'xsd:string' END FROM ow""",
)


def _lines(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    folder = f"{shared_base(s)}/weft-lines-{uuid.uuid4().hex[:12]}.jsonl"
    export.save_graph_lines(N(s, d), E(s, d), folder)
    return ingest.read_graph_lines(s, folder)


attribute = lambda c: F.col("attrs")[c].alias(c)
add("graph_lines_nodes", lambda s, d: _lines(s, d)[0].select("node_id", "type", "value", F.col("attrs")["hierarchy"].cast("int").alias("hierarchy")), "SELECT * FROM n")
add("graph_lines_edges", lambda s, d: _lines(s, d)[1].select("src", "dst", "edge_type", attribute("src_type"), attribute("dst_type")), "SELECT * FROM e")
