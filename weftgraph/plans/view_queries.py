"""Queries on views, channels and methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import channels, methods, views
from ..sources import files
from .catalog import E, N, P, T, _channel_tokens, _items, _paths, add, with_
from .io_queries import PG

# --- sorting, grouping, options

add("sorted_by_children", lambda s, d: views.sorted_by(N(s, d), E(s, d), P(s, d), "children", reverse=True), "SELECT type, node_id, row_number() OVER (PARTITION BY type ORDER BY coalesce(c, 0) DESC, node_id) AS place FROM n LEFT JOIN (SELECT dst AS node_id, count(*) AS c FROM e GROUP BY 1) USING (node_id)")
add("sorted_by_property", lambda s, d: views.sorted_by(N(s, d), E(s, d), P(s, d), "property", "c_acctbal"), "SELECT type, node_id, row_number() OVER (PARTITION BY type ORDER BY d_val NULLS LAST, node_id) AS place FROM n LEFT JOIN (SELECT node_id, d_val FROM p WHERE prop = 'c_acctbal') USING (node_id)")
add("first_by_property", lambda s, d: views.sorted_by(N(s, d), E(s, d), P(s, d), "property", "c_acctbal", most=25), "SELECT type, node_id, row_number() OVER (PARTITION BY type ORDER BY d_val NULLS LAST, node_id) AS place FROM n LEFT JOIN (SELECT node_id, d_val FROM p WHERE prop = 'c_acctbal') USING (node_id) QUALIFY place <= 25")
UP = "up AS (SELECT src AS node_id, src_type AS type, edge_type, dst AS parent, dst_type AS parent_type, value AS parent_value FROM e JOIN n ON n.node_id = dst)"
add("sorted_by_parent", lambda s, d: views.sorted_by(N(s, d), E(s, d, ("in_nation", "in_region")), P(s, d), "parent"), with_(UP, "fp AS (SELECT node_id, min((parent, parent_type, parent_value)) AS p FROM up WHERE edge_type IN ('in_nation', 'in_region') GROUP BY 1)") + "SELECT type, node_id, row_number() OVER (PARTITION BY type ORDER BY p[2] NULLS LAST, p[3] NULLS LAST, node_id) AS place FROM n LEFT JOIN fp USING (node_id)")
add("sorted_by_name", lambda s, d: views.sorted_by(N(s, d), E(s, d), P(s, d), "name"), "SELECT type, node_id, row_number() OVER (PARTITION BY type ORDER BY lower(value), node_id) AS place FROM n")
add("sort_strategy", lambda s, d: views.sort_strategy(N(s, d), E(s, d), P(s, d)), with_("tt AS (SELECT type, count(*) AS total FROM n GROUP BY 1)", "bp AS (SELECT type, min(prop) AS prop FROM (SELECT type, prop, count(*) AS c, count(d_val) AS k, count(DISTINCT d_val) AS v FROM p GROUP BY 1, 2) JOIN tt USING (type) WHERE c >= 0.7 * total AND c = k AND v > 0.3 * c GROUP BY 1)", "kd AS (SELECT src_type AS type, count(DISTINCT dst_type) AS kinds FROM e GROUP BY 1)") + "SELECT type, CASE WHEN prop IS NOT NULL THEN 'property' WHEN kinds > 1 THEN 'parent' ELSE 'name' END AS strategy, prop FROM tt LEFT JOIN bp USING (type) LEFT JOIN kd USING (type)")
add("parents_listing", lambda s, d: views.parents_of(E(s, d), N(s, d)), with_(UP) + "SELECT * FROM up")
add("children_listing", lambda s, d: views.children_of(E(s, d), N(s, d)), "SELECT dst AS node_id, dst_type AS type, edge_type, src AS child, src_type AS child_type, value AS child_value FROM e JOIN n ON n.node_id = src")
add("grouped_by_property", lambda s, d: views.grouped(N(s, d), E(s, d), P(s, d), "property", "c_mktsegment"), "SELECT coalesce(s_val, 'Other') AS key, count(*) AS n FROM n LEFT JOIN (SELECT node_id, s_val FROM p WHERE prop = 'c_mktsegment') USING (node_id) GROUP BY 1")
add("grouped_by_parent", lambda s, d: views.grouped(N(s, d), E(s, d), P(s, d), "parent"), "SELECT coalesce(k, 'Other') AS key, count(*) AS n FROM n LEFT JOIN (SELECT src AS node_id, min_by(dst_type, dst) AS k FROM e GROUP BY 1) USING (node_id) GROUP BY 1")
add("grouped_by_type", lambda s, d: views.grouped(N(s, d), E(s, d), P(s, d), "type"), "SELECT type AS key, count(*) AS n FROM n GROUP BY 1")
add("measurement_properties", lambda s, d: views.measurement_properties(P(s, d)), "SELECT type, prop, count(*) AS n FROM p WHERE d_val IS NOT NULL AND len(list_intersect(string_split(lower(prop), '_'), ['id', 'type', 'hierarchy', 'index', 'count', 'level', 'depth', 'position'])) = 0 GROUP BY 1, 2")
add("view_options", lambda s, d: views.options(N(s, d), E(s, d), P(s, d)), "SELECT DISTINCT type, 'sort' AS option, prop AS name FROM p WHERE d_val IS NOT NULL UNION ALL SELECT type, 'colour', prop FROM p WHERE d_val IS NULL GROUP BY 1, 3 HAVING count(DISTINCT s_val) <= 20 UNION ALL SELECT DISTINCT src_type, 'parent', dst_type FROM e")
add("timeline_filter", lambda s, d: views.chosen(_items(s, d), ["event"], ["event:1", "event:2", "order:1"]), "SELECT 'event:' || event_id AS name, 'event' AS category, CAST(ts AS TIMESTAMP) AS t FROM events WHERE event_id IN (1, 2)", False)

# --- channels


def _reactor(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as channels of a letter grid, their files, folders that speak of a reactor, and events as timestamps of the files."""
    t = T(s, d, "part").select("p_partkey", F.substring(F.lit("ABCDEFGHJKLMNPQRSTUVWXY"), (F.col("p_partkey") % 23 + 1).cast("int"), F.lit(1)).alias("l"), F.lpad((F.floor(F.col("p_partkey") / 23) % 26).cast("string"), 2, "0").alias("m"))
    ch = t.groupBy(F.concat("l", "m").alias("c")).agg(F.min("p_partkey").alias("k"))
    node = lambda df, kind, key, value: df.select(F.concat(F.lit(f"{kind}:"), key.cast("string")).alias("node_id"), F.lit(kind).alias("type"), value.alias("value"))
    ev = T(s, d, "events")
    folders = s.createDataFrame([("/r/CANDU heavy water/A01_B07",), ("/r/agr/plans",)], "v string")
    nodes = node(ch, "channel", F.col("c"), F.col("c")).union(node(ch, "file", F.col("k"), F.concat(F.lit("scan of "), F.col("c"), F.lit(" and Y25")))).union(node(folders, "folder", F.col("v"), F.col("v")))
    nodes = nodes.union(node(ev.filter("event_id % 3 = 0"), "Timestamp", F.col("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    edge = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("edge_type"))
    file, stamp = F.concat(F.lit("file:"), F.col("k").cast("string")), F.concat(F.lit("Timestamp:"), F.col("event_id").cast("string"))
    has = edge(ch, file, F.concat(F.lit("channel:"), "c"), "shows").union(edge(ch.filter("c < 'C'"), F.lit("folder:/r/agr/plans"), F.concat(F.lit("channel:"), "c"), "holds"))
    return nodes, has.union(edge(ev.filter("event_id % 3 = 0"), F.concat(F.lit("file:"), (F.col("event_id") % 150).cast("string")), stamp, "at"))


RX = """WITH t AS (SELECT p_partkey AS k, substr('ABCDEFGHJKLMNPQRSTUVWXY', CAST(p_partkey % 23 + 1 AS INT), 1) || lpad(CAST((p_partkey // 23) % 26 AS VARCHAR), 2, '0') AS c FROM part), ch AS (SELECT c, min(k) AS k FROM t GROUP BY 1),
n AS (SELECT 'channel:' || c AS node_id, 'channel' AS type, c AS value FROM ch UNION ALL SELECT 'file:' || k, 'file', 'scan of ' || c || ' and Y25' FROM ch UNION ALL SELECT 'folder:' || v, 'folder', v FROM (VALUES ('/r/CANDU heavy water/A01_B07'), ('/r/agr/plans')) x(v) UNION ALL SELECT 'Timestamp:' || event_id, 'Timestamp', strftime(ts, '%Y-%m-%d %H:%M:%S') FROM events WHERE event_id % 3 = 0),
e AS (SELECT 'file:' || k AS src, 'channel:' || c AS dst FROM ch UNION ALL SELECT 'folder:/r/agr/plans', 'channel:' || c FROM ch WHERE c < 'C' UNION ALL SELECT 'file:' || (event_id % 150), 'Timestamp:' || event_id FROM events WHERE event_id % 3 = 0),
b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e) """
LETTERS = r"^[A-Y](?:0[1-9]|1[0-9]|2[0-5])$"
EVIDENCE = RX + rf""", sm AS (SELECT DISTINCT upper(value) AS c FROM n WHERE type = 'channel'), tx AS (SELECT string_agg(lower(value), ' ') AS v FROM n WHERE type IN ('file', 'folder', 'filename', 'component')),
q AS (SELECT count(*) AS samples, count(*) FILTER (regexp_matches(c, '{LETTERS}')) AS f1, count(*) FILTER (regexp_matches(c, '^\d{{4}}$')) AS f2 FROM sm),
st AS (SELECT least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN EXISTS (SELECT 1 FROM b JOIN n m ON m.node_id = x AND m.type = 'channel' JOIN n o ON o.node_id = y AND o.type = 'Timestamp') THEN 0.2 ELSE 0 END + CASE WHEN EXISTS (SELECT 1 FROM n WHERE type = 'folder') THEN 0.2 ELSE 0 END + CASE WHEN (SELECT count(*) FROM n WHERE type = 'channel') > 10 THEN 0.1 ELSE 0 END) AS structure),
rt AS (SELECT * FROM (VALUES ('CANDU', 592, 200, 600, ['candu', 'canadian', 'deuterium', 'uranium', 'heavy water']), ('AGR', 2398, 300, 1000, ['agr', 'advanced', 'gas', 'cooled', 'graphite'])) v(reactor, active, lo, hi, words)),
ev AS (SELECT reactor, samples, CASE reactor WHEN 'CANDU' THEN f1 ELSE f2 END / CAST(samples AS DOUBLE) AS pattern, (CASE WHEN samples / CAST(active AS DOUBLE) > 1 THEN 0.5 WHEN samples / CAST(active AS DOUBLE) >= 0.1 THEN samples / CAST(active AS DOUBLE) ELSE 0 END + CASE WHEN samples < lo THEN samples / CAST(lo AS DOUBLE) WHEN samples > hi THEN hi / CAST(samples AS DOUBLE) ELSE 1 END) / 2 AS grid, len(list_filter(words, lambda w: contains(v, w))) / 5.0::DOUBLE AS keyword, structure FROM rt, q, st, tx),
es AS (SELECT *, pattern * 0.5::DOUBLE + grid * 0.3::DOUBLE + keyword * 0.1::DOUBLE + structure * 0.1::DOUBLE AS score FROM ev) """
add("reactor_evidence", lambda s, d: channels.evidence(*_reactor(s, d)).select("reactor", "samples", *[F.round(c, 6).alias(c) for c in ("pattern", "grid", "keyword", "structure", "score")], "accepted", "instance"), EVIDENCE + "SELECT reactor, samples, round(pattern, 6) AS pattern, round(grid, 6) AS grid, round(keyword, 6) AS keyword, round(structure, 6) AS structure, round(score, 6) AS score, score >= 0.7 AS accepted, score > 0.8 AS instance FROM es", False)
add("reactor_type", lambda s, d: channels.reactor_type(channels.evidence(*_reactor(s, d))).select("reactor", "instance"), EVIDENCE + "SELECT reactor, instance FROM (SELECT reactor, score, score > 0.8 AS instance FROM es ORDER BY score DESC, reactor LIMIT 1) WHERE score >= 0.7", False)
CORE = RX + rf""", ow AS (SELECT node_id, value AS c FROM n WHERE type = 'channel' AND regexp_matches(value, '{LETTERS}')), sn AS (SELECT DISTINCT c, o.node_id AS stamp, o.value AS tm FROM ow JOIN b x ON x.x = ow.node_id JOIN b y ON y.x = x.y JOIN n o ON o.node_id = y.y AND o.type = 'Timestamp'),
ms AS (SELECT c, count(*) AS m, max(tm) AS last FROM sn GROUP BY 1), fd AS (SELECT c, min(regexp_extract(f.value, '([^/\\]*)$', 1)) AS folder FROM ow JOIN e ON e.dst = ow.node_id JOIN n f ON f.node_id = e.src AND f.type = 'folder' GROUP BY 1),
sd AS (SELECT type, value, unnest(list_distinct(regexp_extract_all(upper(value), '\b[A-Y](?:0[1-9]|1[0-9]|2[0-5])\b'))) AS c FROM n WHERE type NOT IN ('channel', 'Timestamp')),
cv AS (SELECT c, 'channel' AS kind, coalesce(m, 0) AS measurements, last, folder, CASE WHEN m > 0 THEN 'active' ELSE 'inactive' END AS status FROM (SELECT DISTINCT c FROM ow) LEFT JOIN ms USING (c) LEFT JOIN fd USING (c)
 UNION ALL SELECT c, 'implicit_channel', 0, NULL, min(CASE WHEN type = 'folder' THEN regexp_extract(value, '([^/\\]*)$', 1) END), 'referenced' FROM sd WHERE c NOT IN (SELECT c FROM ow) GROUP BY c) """
add("core_view", lambda s, d: channels.core_view(*_reactor(s, d)), CORE + "SELECT c AS channel, lpad(CAST(ascii(c) - 64 AS VARCHAR), 2, '0') || c[2:] AS shown, kind, measurements, last, folder, status FROM cv", False)
add("core_view_near", lambda s, d: channels.core_view(*_reactor(s, d), hops=1).groupBy("status").agg(F.count("*").alias("n")), CORE + "SELECT CASE status WHEN 'active' THEN 'inactive' ELSE status END AS status, count(*) AS n FROM cv GROUP BY 1", False)


def _found(s: SparkSession, d: str) -> DataFrame:
    """Tokens of parts as channels of three reactor types."""
    c = F.upper("token")
    kind = F.when(c.rlike("^[A-Z]"), "CANDU").when(c.rlike(r"^\d{4}$") & (F.substring(c, 1, 1) < "5"), "AGR").otherwise("other")
    return _channel_tokens(s, d).select(c.alias("channel_id"), kind.alias("reactor")).distinct()


TK = "WITH tk AS (SELECT unnest([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(p_partkey % 26 + 1 AS INT), 1) || lpad(CAST((p_partkey // 26) % 30 AS VARCHAR), 2, '0'), lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0')]) AS c FROM part), fo AS (SELECT DISTINCT c AS channel_id, CASE WHEN c ~ '^[A-Z].*' THEN 'CANDU' WHEN c[1] < '5' THEN 'AGR' ELSE 'other' END AS reactor FROM tk) "
add(
    "channel_positions",
    lambda s, d: channels.positions(_found(s, d)),
    TK + r""", z AS (SELECT *, CAST(channel_id[2:] AS INT) AS num, instr('ABCDEFGHJKLMNPQRSTUVWXY', channel_id[1]) - 1 AS rw, TRY_CAST(channel_id[1:2] AS INT) AS a, TRY_CAST(channel_id[3:4] AS INT) AS b, TRY_CAST(channel_id AS INT) AS dg FROM fo),
    p AS (SELECT channel_id, reactor, 'letter_number' AS system, num - 1 AS x, rw AS y FROM z WHERE reactor = 'CANDU' AND regexp_matches(channel_id, '^[A-Y]\d{2,3}$') AND rw BETWEEN 0 AND 24 AND num - 1 BETWEEN 0 AND 23
      UNION ALL SELECT channel_id, reactor, 'four_digit', (b - 2) // 2, (a - 2) // 2 FROM z WHERE reactor = 'AGR' AND a >= 2 AND b >= 2 AND a % 2 = 0 AND b % 2 = 0
      UNION ALL SELECT channel_id, reactor, 'numeric', dg % CAST(floor(sqrt(dg * 2)) AS INT), dg // CAST(floor(sqrt(dg * 2)) AS INT) FROM z WHERE reactor = 'other' AND dg > 0)
    SELECT channel_id, reactor, system, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CASE system WHEN 'letter_number' THEN round_even(sqrt((x - 12.0) ** 2 + (y - 12.5) ** 2), 2) WHEN 'four_digit' THEN round_even(sqrt((x - 24.5) ** 2 + (y - 24.5) ** 2), 2) END AS distance,
    CASE WHEN system = 'letter_number' THEN CASE WHEN y < 12.5 THEN 'N' ELSE 'S' END || CASE WHEN x < 12 THEN 'W' ELSE 'E' END END AS sector, CASE WHEN system = 'four_digit' THEN CAST(x // 7 AS INTEGER) END AS assembly_x, CASE WHEN system = 'four_digit' THEN CAST(y // 7 AS INTEGER) END AS assembly_y, CASE WHEN system = 'four_digit' THEN CAST(x % 7 AS INTEGER) END AS sub_x, CASE WHEN system = 'four_digit' THEN CAST(y % 7 AS INTEGER) END AS sub_y FROM p""",
    False,
)


def _checked(s: SparkSession, d: str, kind: str) -> DataFrame:
    return channels.validated(_found(s, d).filter(F.col("reactor") == kind), kind)


CHECKED = TK + r""", k AS (SELECT channel_id, list_filter([CASE WHEN NOT regexp_matches(channel_id, '^[A-Y](?:0[1-9]|1[0-9]|2[0-5])$') THEN 'pattern_mismatch' END, CASE WHEN channel_id IN ('A01', 'A02', 'A23', 'A24', 'Y01', 'Y02', 'Y23', 'Y24') THEN 'excluded_position' END, CASE WHEN CAST(channel_id[2:] AS INT) NOT BETWEEN 1 AND 25 THEN 'number_out_of_range' END], lambda q: q IS NOT NULL) AS bad FROM fo WHERE reactor = 'CANDU') """
add("channel_validation", lambda s, d: _checked(s, d, "CANDU").select("channel_id", "valid", "score", F.array_join("anomalies", ",").alias("anomalies")), CHECKED + "SELECT channel_id, len(bad) = 0 AS valid, round((6 - len(bad)) / 6.0::DOUBLE, 6) AS score, array_to_string(bad, ',') AS anomalies FROM k", False)
add("channel_validation_summary", lambda s, d: channels.validation_summary(_checked(s, d, "CANDU")), CHECKED + ", g AS (SELECT count(*) AS total, count(*) FILTER (len(bad) = 0) AS valid FROM k), a AS (SELECT kind, count(*) AS c FROM (SELECT unnest(bad) AS kind FROM k) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) SELECT total, valid, total - valid AS invalid, round(valid / CAST(total AS DOUBLE) * 100, 4) AS compliance, (SELECT string_agg(kind || '=' || c, ',' ORDER BY c DESC, kind) FROM a) AS anomalies, CASE WHEN valid > 0.9 * total THEN 'high' WHEN valid > 0.7 * total THEN 'medium' ELSE 'low' END AS grade FROM g", False)
add("channel_validation_even", lambda s, d: _checked(s, d, "AGR").select("channel_id", "valid", F.array_join("anomalies", ",").alias("anomalies")), TK + r""", k AS (SELECT channel_id, CAST(channel_id[1:2] AS INT) AS a, CAST(channel_id[3:4] AS INT) AS b FROM fo WHERE reactor = 'AGR'), m AS (SELECT channel_id, list_filter([CASE WHEN NOT regexp_matches(channel_id, '^(?:0[2-9]|[1-4][0-9]|5[2-9]|[6-9][0-9])(?:[0-9][0-9])$') THEN 'pattern_mismatch' END, CASE WHEN NOT ((a BETWEEN 2 AND 48 OR a BETWEEN 52 AND 98) AND a % 2 = 0 AND b % 2 = 0 AND b BETWEEN 2 AND 98) THEN 'even_number_violation' END], lambda q: q IS NOT NULL) AS bad FROM k) SELECT channel_id, len(bad) = 0 AS valid, array_to_string(bad, ',') AS anomalies FROM m""", False)
add("channel_duplicates", lambda s, d: channels.duplicates(_channel_tokens(s, d).select(F.col("token").alias("channel_id"))), TK + "SELECT c AS channel_id, count(*) AS n FROM tk GROUP BY 1 HAVING count(*) > 1", False)

# --- methods


def _path_graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The path graph with whole file names and without extensions, which the method is to find."""
    n, e = files.path_graph(_paths(s, d))
    whole = n.filter("type = 'file'").select(F.concat(F.lit("name:"), "node_id").alias("node_id"), F.lit("filename").alias("type"), F.regexp_extract("value", r"([^/]*)$", 1).alias("value"))
    names = n.filter("type = 'file'").select(F.col("node_id").alias("src"), F.lit("has_name").alias("edge_type"), F.concat(F.lit("name:"), "node_id").alias("dst"))
    return n.filter("type IN ('file', 'folder')").union(whole), e.filter("edge_type = 'contains'").union(names)


EXT = PG + f", fx AS (SELECT 'file:' || id AS src, ext FROM nm WHERE ext IN ({', '.join(repr(x) for x in methods.EXTENSIONS)})) "
add("method_file_extension_edges", lambda s, d: methods.run("FileExtension", *_path_graph(s, d))[1].filter("edge_type NOT IN ('contains', 'has_name')"), EXT + "SELECT src, 'extension:.' || ext AS dst, 'has_extension' AS edge_type FROM fx UNION ALL SELECT 'file:' || id, 'method:FileExtension', 'uses' FROM nm WHERE (SELECT count(*) FROM fx) > 0 UNION ALL SELECT DISTINCT 'method:FileExtension', 'extension:.' || ext, 'produces' FROM fx", False)
add("method_file_extension_nodes", lambda s, d: methods.run("FileExtension", *_path_graph(s, d))[0].filter("type NOT IN ('file', 'folder', 'filename')"), EXT + "SELECT DISTINCT 'extension:.' || ext AS node_id, 'extension' AS type, '.' || ext AS value FROM fx UNION ALL SELECT 'method:FileExtension', 'FileExtensionMethod', 'FileExtension' WHERE (SELECT count(*) FROM fx) > 0", False)
add("process_file_histogram", lambda s, d: methods.run_process(["FileExtension", "NoSuchMethod", "FileHistogram"], *_path_graph(s, d))[0].filter("type = 'histogram'"), EXT + "SELECT 'histogram:.' || ext AS node_id, 'histogram' AS type, '.' || ext || '=' || count(*) AS value FROM fx GROUP BY ext", False)


def _dated(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as names with their date, ten years on, and a time as components."""
    o = T(s, d, "orders").select("o_orderkey", F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 10 YEARS"), "yyyyMMdd").alias("d"), F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":15")).alias("t"))
    name = F.concat(F.lit("filename:"), F.col("o_orderkey").cast("string"))
    parts = o.select(name.alias("src"), F.explode(F.array("d", "t")).alias("v"))
    n = o.select(name.alias("node_id"), F.lit("filename").alias("type"), F.concat_ws("_", F.lit("order"), "d").alias("value")).union(parts.select(F.concat(F.lit("component:"), "v"), F.lit("component"), "v").distinct())
    return n, parts.select("src", F.concat(F.lit("component:"), "v").alias("dst"), F.lit("has_component").alias("edge_type"))


add("method_date_detection", lambda s, d: methods.run("DateDetection", *_dated(s, d))[1].filter("edge_type = 'has_timestamp'"), "SELECT DISTINCT 'filename:' || o_orderkey AS src, 'timestamp:' || strftime(o_orderdate + INTERVAL 10 YEAR, '%Y-%m-%d') || ' ' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':15' AS dst, 'has_timestamp' AS edge_type FROM orders", False)
add("method_insights", lambda s, d: methods.method_insights(*methods.run("DateDetection", *_dated(s, d))), "SELECT 'method:DateDetection' AS method, count(DISTINCT strftime(o_orderdate + INTERVAL 10 YEAR, '%Y-%m-%d') || '|' || (o_orderkey % 24)) AS outputs, 0::BIGINT AS failed, 0::BIGINT AS warnings FROM orders", False)
