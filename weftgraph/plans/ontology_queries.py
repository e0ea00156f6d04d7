"""Queries on ontologies: profiles, rules, what breaks them, summary, suggestions, comparison, merge, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ontology, ontology_reports, rules
from ..sources import star_graph as star
from .catalog import REL, REQ, UNI, E, N, P, T, add, with_

# --- a graph with formats, mixed kinds and rare properties


def _rich(s: SparkSession, d: str) -> DataFrame:
    """The properties and, made up from keys, a customer's contact, an order's day, a part's link and note, a supplier's
    rating: each with a few values that don't fit."""
    c, o, p, u = (T(s, d, t) for t in ("customer", "orders", "part", "supplier"))

    def rows(df: DataFrame, kind: str, key: str, prop: str, text, number=None) -> DataFrame:
        n = F.lit(None).cast("double") if number is None else number
        return df.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("node_id"), F.lit(kind).alias("type"), F.lit(prop).alias("prop"), text.alias("s_val"), n.alias("d_val"))

    k = lambda x: F.col(x).cast("string")
    more = [
        rows(c, "customer", "c_custkey", "contact", F.when(F.col("c_custkey") % 50 == 49, "none given").otherwise(F.concat(F.lit("c"), k("c_custkey"), F.lit("@mail.example")))),
        rows(o.filter("o_orderkey % 20 <> 0"), "order", "o_orderkey", "day", F.date_format("o_orderdate", "yyyy-MM-dd")),
        rows(p, "part", "p_partkey", "link", F.concat(F.lit("http://parts.example/"), k("p_partkey"))),
        rows(p.filter("p_size > 25"), "part", "p_partkey", "note", F.concat(F.lit("size "), k("p_size"))),
        rows(u, "supplier", "s_suppkey", "rating", F.when(F.col("s_suppkey") % 3 == 0, "unrated").otherwise(k("s_suppkey")), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey").cast("double"))),
    ]
    out = P(s, d).select("node_id", "type", "prop", "s_val", "d_val")
    for x in more:
        out = out.union(x)
    return out


RICH = """px AS (SELECT node_id, type, prop, s_val, d_val FROM p
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', 'contact', CASE WHEN c_custkey % 50 = 49 THEN 'none given' ELSE 'c' || c_custkey || '@mail.example' END, NULL FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'order', 'day', strftime(o_orderdate, '%Y-%m-%d'), NULL FROM orders WHERE o_orderkey % 20 <> 0
  UNION ALL SELECT 'part:' || p_partkey, 'part', 'link', 'http://parts.example/' || p_partkey, NULL FROM part
  UNION ALL SELECT 'part:' || p_partkey, 'part', 'note', 'size ' || p_size, NULL FROM part WHERE p_size > 25
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', 'rating', CASE WHEN s_suppkey % 3 = 0 THEN 'unrated' ELSE CAST(s_suppkey AS VARCHAR) END, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_suppkey AS DOUBLE) END FROM supplier)"""


def _first(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, properties, edges) of the part of the graph that rules are read off: no parts, no building customers' segments,
    no orders of 300,000 or more, whole contacts, no notes, one order per customer at most."""
    n, p, e = N(s, d), _rich(s, d), E(s, d, ("in_nation", "in_region", "placed"))
    p = p.filter("type <> 'part' AND s_val NOT IN ('BUILDING', 'none given') AND NOT (prop = 'o_totalprice' AND d_val >= 300000) AND NOT (prop = 'contact' AND length(s_val) > 16)")
    one = e.filter("edge_type = 'placed'").groupBy("src").agg(F.min("dst").alias("dst"))
    e = e.filter("edge_type <> 'placed'").union(e.join(one, ["src", "dst"], "left_semi").select(*e.columns))
    return n.filter("type <> 'part'"), p, e


FIRST = (
    "fn AS (SELECT * FROM n WHERE type <> 'part')",
    "fp AS (SELECT * FROM px WHERE type <> 'part' AND s_val NOT IN ('BUILDING', 'none given') AND NOT (prop = 'o_totalprice' AND d_val >= 300000) AND NOT (prop = 'contact' AND length(s_val) > 16))",
    "fe AS (SELECT * FROM e WHERE edge_type IN ('in_nation', 'in_region') UNION ALL SELECT * FROM e WHERE edge_type = 'placed' QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) = 1)",
)


def profile_sql(p: str, out: str) -> tuple[str, ...]:
    return (
        f"{out}0 AS (SELECT type, prop, count(*) AS present, count(DISTINCT s_val) AS n_unique, count(*) FILTER (d_val IS NULL) AS n_text, count(d_val) AS n_number, CAST(min(length(s_val)) FILTER (d_val IS NULL) AS INTEGER) AS min_length, CAST(max(length(s_val)) FILTER (d_val IS NULL) AS INTEGER) AS max_length, round(avg(length(s_val)) FILTER (d_val IS NULL), 6) AS avg_length, min(d_val) AS min_value, max(d_val) AS max_value, round(avg(d_val), 4) AS avg_value, round(median(d_val), 4) AS median_value, bool_and(d_val = floor(d_val)) AS integral FROM {p} GROUP BY 1, 2)",
        rf"{out}f AS (SELECT type, prop, bool_and(regexp_matches(s_val, '^\d{{4}}-\d{{2}}-\d{{2}}')) AS d, bool_and(regexp_matches(s_val, '^[\w.-]+@[\w.-]+')) AS m, bool_and(regexp_matches(s_val, '^https?://\S+')) AS u FROM (SELECT * FROM {p} WHERE d_val IS NULL QUALIFY row_number() OVER (PARTITION BY type, prop ORDER BY node_id, s_val) <= 10) GROUP BY 1, 2)",
        f"{out} AS (SELECT x.* EXCLUDE (integral), CASE WHEN n_text >= n_number THEN 'text' ELSE 'number' END AS kind, CASE WHEN n_text < n_number THEN CASE WHEN integral THEN 'integer' ELSE 'float' END WHEN n_unique <= 10 THEN 'enumeration' WHEN u THEN 'url' WHEN m THEN 'email' WHEN d THEN 'date' ELSE 'string' END AS pattern FROM {out}0 x LEFT JOIN {out}f USING (type, prop))",
    )


def rules_sql(n: str, p: str, pf: str, out: str) -> tuple[str, ...]:
    """Property rules; names of CTEs of nodes, properties and profile."""
    return (
        f"{out}c AS (SELECT type, prop, string_agg(DISTINCT s_val, '|' ORDER BY s_val) AS choices FROM {p} JOIN {pf} USING (type, prop) WHERE pattern = 'enumeration' GROUP BY 1, 2)",
        f"{out}x AS (SELECT * FROM {pf} JOIN (SELECT type, count(*) AS total FROM {n} GROUP BY 1) USING (type) LEFT JOIN {out}c USING (type, prop))",
        f"""{out} AS (SELECT type, prop, 'required' AS rule, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, CAST(NULL AS VARCHAR) AS detail FROM {out}x WHERE present = total
        UNION ALL SELECT type, prop, 'preferred', NULL, NULL, CAST(round(present * 100.0::DOUBLE / total, 4) AS VARCHAR) FROM {out}x WHERE present < total AND present > 0.9 * total
        UNION ALL SELECT type, prop, CASE WHEN kind = 'text' THEN 'string' WHEN pattern = 'integer' THEN 'integer' ELSE 'number' END, NULL, NULL, NULL FROM {out}x
        UNION ALL SELECT type, prop, CASE WHEN min_length = max_length THEN 'exact_length' ELSE 'length' END, min_length, max_length, NULL FROM {out}x WHERE kind = 'text'
        UNION ALL SELECT type, prop, 'enum', NULL, NULL, choices FROM {out}x WHERE pattern = 'enumeration'
        UNION ALL SELECT type, prop, 'format', NULL, NULL, pattern FROM {out}x WHERE pattern IN ('date', 'email', 'url')
        UNION ALL SELECT type, prop, 'range', min_value, max_value, NULL FROM {out}x WHERE kind = 'number')""",
    )


def pairs_sql(p: str, out: str) -> tuple[str, ...]:
    return (
        f"{out}w AS (SELECT DISTINCT type, node_id, prop FROM {p})",
        f"{out}n AS (SELECT type, prop, count(*) AS c FROM {out}w GROUP BY 1, 2)",
        f"{out} AS (SELECT q.type, a, b, together, x.c - together AS only_a, y.c - together AS only_b FROM (SELECT x.type, x.prop AS a, y.prop AS b, count(*) AS together FROM {out}w x JOIN {out}w y ON x.node_id = y.node_id AND x.prop < y.prop GROUP BY 1, 2, 3) q JOIN {out}n x ON x.type = q.type AND x.prop = a JOIN {out}n y ON y.type = q.type AND y.prop = b)",
    )


def cross_sql(n: str, pr: str, out: str) -> str:
    return f"""{out} AS (SELECT type, CASE WHEN together > 0.9 * (together + only_a + only_b) THEN 'co_occurrence' ELSE 'implication' END AS rule,
      CASE WHEN together <= 0.9 * (together + only_a + only_b) AND only_a > 0 THEN b ELSE a END AS a, CASE WHEN together <= 0.9 * (together + only_a + only_b) AND only_a > 0 THEN a ELSE b END AS b, round(together * 100.0::DOUBLE / (together + only_a + only_b), 4) AS rate
      FROM {pr} JOIN (SELECT type FROM {n} GROUP BY 1 HAVING count(*) >= 10) USING (type) WHERE together > 0.9 * (together + only_a + only_b) OR (only_a = 0) <> (only_b = 0))"""


CARD = """cd AS (SELECT src_type, edge_type, dst_type, CASE WHEN o <= 1 AND i <= 1 THEN 'one-to-one' WHEN o <= 1 THEN 'one-to-many' WHEN i <= 1 THEN 'many-to-one' ELSE 'many-to-many' END AS cardinality FROM
  (SELECT src_type, edge_type, dst_type, max(c) AS o FROM (SELECT src_type, edge_type, dst_type, src, count(DISTINCT dst) AS c FROM fe GROUP BY ALL) GROUP BY 1, 2, 3) JOIN
  (SELECT src_type, edge_type, dst_type, max(c) AS i FROM (SELECT src_type, edge_type, dst_type, dst, count(DISTINCT src) AS c FROM fe GROUP BY ALL) GROUP BY 1, 2, 3) USING (src_type, edge_type, dst_type) JOIN
  (SELECT src_type, edge_type, dst_type FROM fe GROUP BY 1, 2, 3 HAVING count(*) >= 5) USING (src_type, edge_type, dst_type) WHERE cardinality <> 'many-to-many')"""

add("property_profile", lambda s, d: rules.profile(_rich(s, d)), with_(RICH, *profile_sql("px", "pf")) + "SELECT * FROM pf")
add("edge_property_profile", lambda s, d: rules.edge_profile(star.edge_props(s, d)), with_(f"ep AS ({star.edge_props_sql()})", *profile_sql("ep", "pf")) + "SELECT * RENAME (type AS edge_type) FROM pf")
add("property_report", lambda s, d: ontology_reports.property_report(N(s, d), _rich(s, d)), with_(RICH, *profile_sql("px", "pf")) + f"SELECT *, round(present / CAST(total AS DOUBLE), 6) AS coverage, {REQ} AS requirement, {UNI} AS uniqueness FROM pf JOIN (SELECT type, count(*) AS total FROM n GROUP BY 1) USING (type)")
add("property_rules", lambda s, d: rules.property_rules(N(s, d), _rich(s, d)), with_(RICH, *profile_sql("px", "pf"), *rules_sql("n", "px", "pf", "ru")) + "SELECT * FROM ru")
add("array_rules", lambda s, d: rules.array_rules(T(s, d, "embeddings"), "label", "embedding"), "SELECT CAST(label AS VARCHAR) AS type, 'embedding' AS prop, unnest(['array', 'array_length', 'array_items']) AS rule, unnest([NULL, min(len(embedding)), NULL])::DOUBLE AS low, unnest([NULL, max(len(embedding)), NULL])::DOUBLE AS high, unnest([NULL, NULL, 'float']) AS detail FROM embeddings WHERE embedding IS NOT NULL GROUP BY label", False)
add(
    "property_profile_object",
    lambda s, d: rules.object_profile(T(s, d, "events"), "event_type", "props"),
    """WITH k AS (SELECT event_type AS type, json_keys(CAST(props AS JSON)) AS keys FROM events WHERE props IS NOT NULL), g AS (SELECT type, count(*) AS present, min(len(keys)) AS lo, max(len(keys)) AS hi FROM k GROUP BY 1),
    u AS (SELECT type, key, count(*) AS n FROM (SELECT type, unnest(list_distinct(keys)) AS key FROM k) GROUP BY 1, 2),
    j AS (SELECT type, string_agg(key, ',' ORDER BY key) FILTER (n >= 0.5 * present) AS common_keys, string_agg(key, ',' ORDER BY key) FILTER (n = present) AS required_keys FROM u JOIN g USING (type) GROUP BY 1)
    SELECT type, present, CAST(lo AS INTEGER) AS min_keys, CAST(hi AS INTEGER) AS max_keys, coalesce(common_keys, '') AS common_keys, coalesce(required_keys, '') AS required_keys FROM g LEFT JOIN j USING (type)""",
    False,
)
add("cross_property_rules", lambda s, d: rules.cross_rules(N(s, d), _rich(s, d)), with_(RICH, *pairs_sql("px", "pr"), cross_sql("n", "pr", "cx")) + "SELECT * FROM cx")
add("correlated_presence", lambda s, d: rules.pair_counts(_rich(s, d)).withColumn("given_a", F.round(F.col("together") / (F.col("together") + F.col("only_a")), 6)).withColumn("given_b", F.round(F.col("together") / (F.col("together") + F.col("only_b")), 6)).filter("given_a > 0.8 OR given_b > 0.8"), with_(RICH, *pairs_sql("px", "pr")) + "SELECT *, round(together / CAST(together + only_a AS DOUBLE), 6) AS given_a, round(together / CAST(together + only_b AS DOUBLE), 6) AS given_b FROM pr WHERE given_a > 0.8 OR given_b > 0.8")


def _rule_set(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return rules.rule_set(*_first(s, d))


RULED = (RICH, *FIRST, *profile_sql("fp", "pf"), *rules_sql("fn", "fp", "pf", "ru"), *pairs_sql("fp", "pr"), cross_sql("fn", "pr", "cx"), CARD, "fr AS (SELECT src_type, edge_type, dst_type, count(*) AS n FROM fe GROUP BY ALL)")
D2 = "CAST(CAST(round({0}, 2) AS DECIMAL(38, 2)) AS VARCHAR)"
add(
    "rule_set",
    lambda s, d: rules.rule_rows(_rule_set(s, d)),
    with_(*RULED)
    + f"""SELECT 'property_' || rule AS rule, type || '.' || prop AS subject, coalesce(detail, CASE WHEN low IS NOT NULL THEN {D2.format("low")} || '..' || {D2.format("high")} END, '') AS detail FROM ru
    UNION ALL SELECT 'property_' || rule, type, a || ' ' || b FROM cx UNION ALL SELECT 'valid_relationship', src_type || ' ' || edge_type || ' ' || dst_type, CAST(n AS VARCHAR) FROM fr WHERE n >= 3
    UNION ALL SELECT 'cardinality_constraint', src_type || ' ' || edge_type || ' ' || dst_type, cardinality FROM cd UNION ALL SELECT DISTINCT 'valid_node_type', type, '' FROM fn UNION ALL SELECT DISTINCT 'valid_edge_type', edge_type, '' FROM fe""",
)


def _found(s: SparkSession, d: str) -> DataFrame:
    """What in the whole graph, without one region, breaks the rules of its part."""
    return rules.inconsistencies(N(s, d).filter("node_id <> 'region:1'"), _rich(s, d), E(s, d), _rule_set(s, d), star.ends(s, d))


FOUND = (
    *RULED,
    "gn AS (SELECT * FROM n WHERE node_id <> 'region:1')",
    "kn AS (SELECT * FROM gn WHERE type IN (SELECT type FROM fn))",
    "ge AS (SELECT *, src || ' ' || edge_type || ' ' || dst AS edge FROM e)",
    "we AS (SELECT * FROM ge WHERE src IN (SELECT node_id FROM gn) AND dst IN (SELECT node_id FROM gn))",
    "wd AS (SELECT type, prop, max(low) FILTER (rule = 'range') AS rlo, max(high) FILTER (rule = 'range') AS rhi, max(low) FILTER (rule IN ('length', 'exact_length')) AS llo, max(high) FILTER (rule IN ('length', 'exact_length')) AS lhi, max(detail) FILTER (rule = 'enum') AS ch, max(detail) FILTER (rule = 'format') AS fm FROM ru GROUP BY 1, 2)",
    "pv AS (SELECT * FROM px JOIN wd USING (type, prop))",
    "pp AS (SELECT DISTINCT node_id, prop FROM px)",
    r"""pb AS (SELECT 'invalid_node_type' AS problem, 'high' AS severity, node_id AS subject, CAST(NULL AS VARCHAR) AS property, type AS detail FROM gn WHERE type NOT IN (SELECT type FROM fn)
    UNION ALL SELECT 'missing_required_property', CASE rule WHEN 'required' THEN 'high' ELSE 'medium' END, kn.node_id, ru.prop, rule FROM kn JOIN ru ON ru.type = kn.type AND rule IN ('required', 'preferred') LEFT JOIN pp ON pp.node_id = kn.node_id AND pp.prop = ru.prop WHERE pp.prop IS NULL
    UNION ALL SELECT 'invalid_property_format', 'medium', node_id, prop, s_val FROM pv WHERE d_val IS NULL AND ((fm = 'date' AND NOT regexp_matches(s_val, '^\d{4}-\d{2}-\d{2}$')) OR (fm = 'email' AND NOT regexp_matches(s_val, '^[\w.-]+@[\w.-]+\.\w+$')) OR (fm = 'url' AND NOT regexp_matches(s_val, '^https?://\S+$')))
    UNION ALL SELECT 'out_of_range_property', 'medium', node_id, prop, s_val FROM pv WHERE d_val < rlo OR d_val > rhi
    UNION ALL SELECT 'invalid_enum_value', 'medium', node_id, prop, s_val FROM pv WHERE ch IS NOT NULL AND NOT list_contains(string_split(ch, '|'), s_val)
    UNION ALL SELECT 'invalid_property_length', 'low', node_id, prop, s_val FROM pv WHERE d_val IS NULL AND fm IS NULL AND (length(s_val) < llo OR length(s_val) > lhi)
    UNION ALL SELECT DISTINCT 'property_dependency_violation', 'medium', x.node_id, cx.b, cx.a FROM px x JOIN cx ON cx.type = x.type AND cx.rule = 'implication' AND cx.a = x.prop LEFT JOIN pp ON pp.node_id = x.node_id AND pp.prop = cx.b WHERE pp.prop IS NULL
    UNION ALL SELECT 'invalid_edge_source', 'high', edge, NULL, src FROM ge WHERE src NOT IN (SELECT node_id FROM gn) UNION ALL SELECT 'invalid_edge_target', 'high', edge, NULL, dst FROM ge WHERE dst NOT IN (SELECT node_id FROM gn)
    UNION ALL SELECT 'invalid_edge_type', 'high', edge, NULL, edge_type FROM we WHERE edge_type NOT IN (SELECT edge_type FROM fe)
    UNION ALL SELECT 'invalid_relationship_pattern', 'medium', edge, NULL, we.src_type || ' ' || we.edge_type || ' ' || we.dst_type FROM we LEFT JOIN fr USING (src_type, edge_type, dst_type) WHERE fr.n IS NULL AND edge_type IN (SELECT edge_type FROM fe)
    UNION ALL SELECT 'cardinality_violation', 'medium', src, edge_type, 'one-to-many' FROM we JOIN cd USING (src_type, edge_type, dst_type) WHERE cardinality IN ('one-to-one', 'many-to-one') GROUP BY src_type, edge_type, dst_type, src HAVING count(DISTINCT dst) > 1
    UNION ALL SELECT 'cardinality_violation', 'medium', dst, edge_type, 'many-to-one' FROM we JOIN cd USING (src_type, edge_type, dst_type) WHERE cardinality IN ('one-to-one', 'one-to-many') GROUP BY src_type, edge_type, dst_type, dst HAVING count(DISTINCT src) > 1)""",
)
add("inconsistencies", _found, with_(*FOUND) + "SELECT * FROM pb")
add("inconsistency_severities", lambda s, d: _found(s, d).groupBy("severity", "problem").agg(F.count("*").alias("n")), with_(*FOUND) + "SELECT severity, problem, count(*) AS n FROM pb GROUP BY 1, 2")


def _anomalies(s: SparkSession, d: str) -> DataFrame:
    n, p, _ = _first(s, d)
    return rules.anomalies(N(s, d), _rich(s, d), rules.profile(p.filter("s_val <> 'unrated'")))


add(
    "anomalies",
    _anomalies,
    with_(RICH, *FIRST, "f2 AS (SELECT * FROM fp WHERE s_val <> 'unrated')", *profile_sql("f2", "pf"), "pp AS (SELECT DISTINCT node_id, prop FROM px)", "tt AS (SELECT type, count(*) AS total FROM n GROUP BY 1)")
    + r"""SELECT 'missing_required_property' AS problem, 'high' AS severity, n.node_id AS subject, pf.prop AS property, 'required' AS detail FROM n JOIN pf USING (type) JOIN tt USING (type) LEFT JOIN pp ON pp.node_id = n.node_id AND pp.prop = pf.prop WHERE present = total AND pp.prop IS NULL
    UNION ALL SELECT CASE WHEN regexp_matches(s_val, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') AND kind = 'number' AND pattern = 'integer' THEN 'integer_expected' ELSE 'type_mismatch' END, 'medium', node_id, prop, s_val FROM px JOIN pf USING (type, prop) WHERE CASE WHEN d_val IS NULL THEN 'text' ELSE 'number' END <> kind OR (pattern = 'integer' AND d_val <> floor(d_val))""",
)

# --- ontologies as a whole


def _one(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return ontology_reports.extract(N(s, d), E(s, d), _rich(s, d))


def _two(s: SparkSession, d: str) -> tuple[dict, dict]:
    """The ontology of the first part and that of the whole graph without regions."""
    n, p, e = _first(s, d)
    return ontology_reports.extract(n, e, p), ontology_reports.extract(N(s, d).filter("type <> 'region'"), E(s, d).filter("edge_type <> 'in_region'"), _rich(s, d))


add("ontology_extraction", lambda s, d: ontology_reports.extraction_summary(_one(s, d)), with_(REL) + "SELECT (SELECT count(DISTINCT type) FROM n) AS node_types, (SELECT count(*) FROM n) AS nodes, count(DISTINCT edge_type) AS edge_types, CAST(sum(n) AS BIGINT) AS edges, count(*) AS relationships FROM r")
LISTS = """
SELECT 'most_frequent_types' AS list, type AS name, CAST(count(*) AS DOUBLE) AS value, '' AS detail FROM n GROUP BY type QUALIFY row_number() OVER (ORDER BY count(*) DESC, type) <= 5
UNION ALL (SELECT 'property_rich_types', type, coalesce(c, 0), '' FROM (SELECT DISTINCT type FROM n) LEFT JOIN (SELECT type, count(*) AS c FROM pf GROUP BY 1) USING (type) ORDER BY 3 DESC, 2 LIMIT 5)
UNION ALL (SELECT 'most_frequent_edges', edge_type, count(*), '' FROM e GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)
UNION ALL (SELECT 'common_patterns', src_type || ' > ' || edge_type || ' > ' || dst_type, n, '' FROM r ORDER BY 3 DESC, 2 LIMIT 10)
UNION ALL (SELECT 'central_types', type, count(DISTINCT other) FILTER (way = 1) + count(DISTINCT other) FILTER (way = 2), '' FROM (SELECT src_type AS type, dst_type AS other, 1 AS way FROM r UNION ALL SELECT dst_type, src_type, 2 FROM r) GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)
UNION ALL (SELECT 'hierarchy_indicators', src_type || ' > ' || edge_type || ' > ' || dst_type, n, '' FROM r WHERE src_type = dst_type AND regexp_matches(lower(edge_type), 'parent|child|contains|part_of|belongs_to|member_of'))
UNION ALL (SELECT 'common_properties', prop, count(*), '' FROM pf GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
UNION ALL (SELECT 'unique_identifiers', type || '.' || prop, present, '' FROM pf WHERE n_unique = present AND present > 1)
UNION ALL (SELECT 'enumerations', type || '.' || prop, present, (SELECT string_agg(DISTINCT s_val, '|' ORDER BY s_val) FROM px WHERE px.type = pf.type AND px.prop = pf.prop) FROM pf WHERE pattern = 'enumeration')"""
add("ontology_summary", lambda s, d: ontology_reports.summary(_one(s, d)), with_(RICH, *profile_sql("px", "pf"), REL) + LISTS)
add(
    "ontology_suggestions",
    lambda s, d: ontology_reports.suggestions(_one(s, d), True),
    with_(RICH, *profile_sql("px", "pf"), REL, "tt AS (SELECT type, count(*) AS n FROM n GROUP BY 1)", "nm AS (SELECT type AS x FROM tt UNION ALL SELECT DISTINCT edge_type FROM e)", "st AS (SELECT CASE WHEN x = lower(x) AND contains(x, '_') THEN 'snake_case' WHEN x = lower(x) AND NOT contains(x, ' ') THEN 'lowercase' ELSE 'unknown' END AS style, count(*) AS n FROM nm GROUP BY 1)")
    + """SELECT 'naming_inconsistency' AS kind, 'medium' AS severity, 'types' AS subject, style AS detail FROM (SELECT *, sum(n) OVER () AS total FROM st QUALIFY row_number() OVER (ORDER BY n DESC, style DESC) = 1) WHERE n < 0.7 * total
    UNION ALL SELECT 'sparse_node_type', 'low', type, CAST(n AS VARCHAR) FROM tt WHERE n < greatest(3, 0.005 * (SELECT sum(n) FROM tt))
    UNION ALL SELECT 'inconsistent_property_naming', 'low', type, CAST(count(DISTINCT contains(prop, '_')) AS VARCHAR) FROM pf GROUP BY type HAVING count(DISTINCT contains(prop, '_')) > 1 AND count(*) > 3
    UNION ALL SELECT 'incomplete_required_property', 'medium', type || '.' || prop, present || ' of ' || n FROM pf JOIN tt USING (type) WHERE present >= 0.9 * n AND present < n
    UNION ALL SELECT 'mixed_property_types', 'medium', type || '.' || prop, kind FROM pf WHERE n_text > 0 AND n_number > 0""",
)
SIDES = (
    *FIRST,
    *profile_sql("fp", "pa"),
    *profile_sql("px", "pb"),
    "ta AS (SELECT type, count(*) AS n FROM fn GROUP BY 1)", "tb AS (SELECT type, count(*) AS n FROM n WHERE type <> 'region' GROUP BY 1)",
    "ra AS (SELECT src_type, edge_type, dst_type, count(*) AS n FROM fe GROUP BY ALL)", "rb AS (SELECT src_type, edge_type, dst_type, count(*) AS n FROM e WHERE edge_type <> 'in_region' GROUP BY ALL)",
    "ea AS (SELECT edge_type, CAST(sum(n) AS BIGINT) AS n FROM ra GROUP BY 1)", "eb AS (SELECT edge_type, CAST(sum(n) AS BIGINT) AS n FROM rb GROUP BY 1)",
    "ca AS (SELECT type, prop, list_sort(list(DISTINCT s_val)) AS c FROM fp JOIN pa USING (type, prop) WHERE pattern = 'enumeration' GROUP BY 1, 2)", "cb AS (SELECT type, prop, list_sort(list(DISTINCT s_val)) AS c FROM px JOIN pb USING (type, prop) WHERE pattern = 'enumeration' GROUP BY 1, 2)",
    "bt AS (SELECT type FROM ta JOIN tb USING (type))",
    """cm AS (SELECT 'node_type' AS kind, type AS name, CASE WHEN tb.n IS NULL THEN 'only_mine' WHEN ta.n IS NULL THEN 'only_other' ELSE 'common' END AS side FROM ta FULL JOIN tb USING (type)
    UNION ALL SELECT 'edge_type', edge_type, CASE WHEN eb.n IS NULL THEN 'only_mine' WHEN ea.n IS NULL THEN 'only_other' ELSE 'common' END FROM ea FULL JOIN eb USING (edge_type)
    UNION ALL SELECT 'relationship', src_type || ' > ' || edge_type || ' > ' || dst_type, CASE WHEN rb.n IS NULL THEN 'only_mine' WHEN ra.n IS NULL THEN 'only_other' ELSE 'common' END FROM ra FULL JOIN rb USING (src_type, edge_type, dst_type)
    UNION ALL SELECT 'property', type || '.' || prop, CASE WHEN b.present IS NULL THEN 'only_mine' WHEN a.present IS NULL THEN 'only_other' ELSE 'common' END FROM (SELECT * FROM pa SEMI JOIN bt USING (type)) a FULL JOIN (SELECT * FROM pb SEMI JOIN bt USING (type)) b USING (type, prop))""",
)
add("ontology_compare", lambda s, d: ontology_reports.compare(*_two(s, d)), with_(RICH, *SIDES) + "SELECT * FROM cm")
add(
    "ontology_similarity",
    lambda s, d: ontology_reports.similarity(ontology_reports.compare(*_two(s, d))),
    with_(RICH, *SIDES, "k AS (SELECT kind, count(*) AS a, count(*) FILTER (side = 'common') AS c, count(*) FILTER (side = 'only_mine') AS m, count(*) FILTER (side = 'only_other') AS o FROM cm GROUP BY 1)", "j AS (SELECT max(c / CAST(a AS DOUBLE)) FILTER (kind = 'node_type') AS nt, max(c / CAST(a AS DOUBLE)) FILTER (kind = 'edge_type') AS et, max(c / CAST(a AS DOUBLE)) FILTER (kind = 'relationship') AS rl, bool_and(o > m) FILTER (kind IN ('node_type', 'edge_type')) AS more, sum(c) FILTER (kind IN ('node_type', 'edge_type')) AS common FROM k)", "dp AS (SELECT count(DISTINCT split_part(name, '.', 1)) AS d FROM cm WHERE kind = 'property' AND side <> 'common')")
    + "SELECT round(nt, 6) AS node_types, round(et, 6) AS edge_types, round(rl, 6) AS relationships, round((nt + et + rl) / 3, 6) AS overall, nt < 0.7 AS significant_change, more AS schema_expansion, d > 0 AND d / CAST(common AS DOUBLE) > 0.3 AS property_refinement FROM j, dp",
)
add("ontology_merged_types", lambda s, d: ontology_reports.merge(*_two(s, d))["types"], with_(RICH, *SIDES) + "SELECT type, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM ta UNION ALL SELECT * FROM tb) GROUP BY 1")
add("ontology_merged_relationships", lambda s, d: ontology_reports.merge(*_two(s, d))["relationships"], with_(RICH, *SIDES) + "SELECT src_type, edge_type, dst_type, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM ra UNION ALL SELECT * FROM rb) GROUP BY 1, 2, 3")


def _merged(s: SparkSession, d: str) -> DataFrame:
    m = ontology_reports.merge(*_two(s, d))
    return m["profile"].join(F.broadcast(m["choices"].select("type", "prop", F.array_join("choices", "|").alias("choices"))), ["type", "prop"], "left")


add(
    "ontology_merged_profile",
    _merged,
    with_(RICH, *SIDES)
    + """SELECT type, prop, CAST(coalesce(a.present, 0) + coalesce(b.present, 0) AS BIGINT) AS present, greatest(a.n_unique, b.n_unique) AS n_unique, least(a.min_length, b.min_length) AS min_length, greatest(a.max_length, b.max_length) AS max_length, least(a.min_value, b.min_value) AS min_value, greatest(a.max_value, b.max_value) AS max_value,
    coalesce(a.kind, b.kind) AS kind, coalesce(a.pattern, b.pattern) AS pattern, (SELECT string_agg(DISTINCT v, '|' ORDER BY v) FROM (SELECT type AS t, prop AS q, unnest(c) AS v FROM (SELECT * FROM ca UNION ALL SELECT * FROM cb)) WHERE t = coalesce(a.type, b.type) AND q = coalesce(a.prop, b.prop)) AS choices FROM pa a FULL JOIN pb b USING (type, prop)""",
)
CHANGES = (
    RICH,
    *SIDES,
    "md AS (SELECT split_part(name, '.', 1) AS type, coalesce(string_agg(split_part(name, '.', 2), ',' ORDER BY name) FILTER (side = 'only_other'), '') AS plus, coalesce(string_agg(split_part(name, '.', 2), ',' ORDER BY name) FILTER (side = 'only_mine'), '') AS minus FROM cm WHERE kind = 'property' GROUP BY 1 HAVING plus <> '' OR minus <> '')",
    "pj AS (SELECT a.type || '.' || a.prop AS name, a.kind AS ka, b.kind AS kb, a.min_value AS la, b.min_value AS lb, a.max_value AS ha, b.max_value AS hb, ca.c AS xa, cb.c AS xb FROM pa a JOIN pb b USING (type, prop) JOIN md USING (type) LEFT JOIN ca USING (type, prop) LEFT JOIN cb USING (type, prop))",
    f"""lg AS (SELECT CASE WHEN ta.n IS NULL THEN 'add_node_type' ELSE 'remove_node_type' END AS change, type AS subject, CAST(coalesce(ta.n, tb.n) AS VARCHAR) AS detail FROM ta FULL JOIN tb USING (type) WHERE ta.n IS NULL OR tb.n IS NULL
    UNION ALL SELECT CASE WHEN ea.n IS NULL THEN 'add_edge_type' ELSE 'remove_edge_type' END, edge_type, CAST(coalesce(ea.n, eb.n) AS VARCHAR) FROM ea FULL JOIN eb USING (edge_type) WHERE ea.n IS NULL OR eb.n IS NULL
    UNION ALL SELECT CASE WHEN ra.n IS NULL THEN 'add_relationship' ELSE 'remove_relationship' END, src_type || ' > ' || edge_type || ' > ' || dst_type, CAST(coalesce(ra.n, rb.n) AS VARCHAR) FROM ra FULL JOIN rb USING (src_type, edge_type, dst_type) WHERE ra.n IS NULL OR rb.n IS NULL
    UNION ALL SELECT 'modify_node_type', type, '+' || plus || ' -' || minus FROM md
    UNION ALL SELECT 'property_type_change', name, ka || ' > ' || kb FROM pj WHERE ka <> kb
    UNION ALL SELECT 'property_range_change', name, {D2.format("la")} || '..' || {D2.format("ha")} || ' > ' || {D2.format("lb")} || '..' || {D2.format("hb")} FROM pj WHERE la <> lb OR ha <> hb
    UNION ALL SELECT 'property_enum_change', name, '+' || array_to_string(list_filter(xb, lambda v: NOT list_contains(xa, v)), '|') || ' -' || array_to_string(list_filter(xa, lambda v: NOT list_contains(xb, v)), '|') FROM pj WHERE xa <> xb)""",
)
add("ontology_changes", lambda s, d: ontology_reports.changes(*_two(s, d)), with_(*CHANGES) + "SELECT * FROM lg")
add("ontology_impacts", lambda s, d: ontology_reports.impacts(ontology_reports.changes(*_two(s, d))), with_(*CHANGES) + "SELECT CASE WHEN change LIKE '%node_type' AND change NOT LIKE 'modify%' THEN 'schema_evolution' WHEN change LIKE 'modify%' THEN 'property_refinement' ELSE 'connectivity_changes' END AS impact, CASE WHEN bool_or(change = 'remove_node_type') THEN 'high' ELSE 'medium' END AS severity, count(*) AS changes FROM lg WHERE change IN ('add_node_type', 'remove_node_type', 'modify_node_type', 'add_relationship', 'remove_relationship') GROUP BY 1")
add("type_motifs", lambda s, d: ontology_reports.type_motifs(E(s, d)), with_(REL) + "SELECT x.src_type AS a, x.edge_type AS e1, x.dst_type AS b, y.edge_type AS e2, y.dst_type AS c, least(x.n, y.n) AS n FROM r x JOIN r y ON x.dst_type = y.src_type WHERE x.n >= 0.05 * (SELECT sum(n) FROM r)")
add("relationship_lookup", lambda s, d: ontology_reports.relationship_lookup(E(s, d), edge_type="in_nation"), with_(REL) + "SELECT src_type, edge_type, dst_type, n, examples FROM r JOIN (SELECT src_type, edge_type, dst_type, string_agg(src || '>' || dst, '|' ORDER BY src, dst) AS examples FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY src_type, edge_type, dst_type ORDER BY src, dst) <= 3) GROUP BY 1, 2, 3) USING (src_type, edge_type, dst_type) WHERE edge_type = 'in_nation'")
add(
    "relationship_details",
    lambda s, d: ontology_reports.cardinality_details(E(s, d), N(s, d)),
    with_(
        "o AS (SELECT src_type, edge_type, dst_type, count(*) AS k, min(c) AS out_min, max(c) AS out_max, round(avg(c), 6) AS out_mean, round(median(c), 6) AS out_median, sum(c) AS z FROM (SELECT src_type, edge_type, dst_type, src, count(DISTINCT dst) AS c FROM e GROUP BY ALL) GROUP BY 1, 2, 3)",
        "i AS (SELECT src_type, edge_type, dst_type, count(*) AS l, min(c) AS in_min, max(c) AS in_max, round(avg(c), 6) AS in_mean, round(median(c), 6) AS in_median FROM (SELECT src_type, edge_type, dst_type, dst, count(DISTINCT src) AS c FROM e GROUP BY ALL) GROUP BY 1, 2, 3)",
        "tt AS (SELECT type, count(*) AS t FROM n GROUP BY 1)",
    )
    + "SELECT src_type, edge_type, dst_type, out_min, out_max, out_mean, out_median, in_min, in_max, in_mean, in_median, round(k / CAST(x.t AS DOUBLE), 6) AS source_coverage, round(l / CAST(y.t AS DOUBLE), 6) AS target_coverage, round(z / (CAST(x.t AS DOUBLE) * y.t), 9) AS density, CASE WHEN out_max <= 1 AND in_max <= 1 THEN 'one-to-one' WHEN out_max <= 1 THEN 'one-to-many' WHEN in_max <= 1 THEN 'many-to-one' ELSE 'many-to-many' END AS cardinality FROM o JOIN i USING (src_type, edge_type, dst_type) JOIN tt x ON x.type = src_type JOIN tt y ON y.type = dst_type",
)
add("relationship_distribution", lambda s, d: ontology_reports.relationship_distribution(E(s, d)), with_(REL, CARD.replace("FROM fe", "FROM e").replace("HAVING count(*) >= 5", "").replace("WHERE cardinality <> 'many-to-many'", "")) + "SELECT cardinality, count(*) AS relationships, CAST(sum(n) AS BIGINT) AS edges FROM cd JOIN r USING (src_type, edge_type, dst_type) GROUP BY 1")
add("most_connected_types", lambda s, d: ontology_reports.most_connected(E(s, d)), with_(REL) + "(SELECT 'out' AS side, src_type AS type, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5) UNION ALL (SELECT 'in', dst_type, CAST(sum(n) AS BIGINT) FROM r GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)")
add(
    "edge_type_details",
    lambda s, d: ontology_reports.edge_type_details(E(s, d)),
    with_(REL, "x AS (SELECT edge_type, src_type AS ps FROM r GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY edge_type ORDER BY sum(n) DESC, src_type) = 1)", "y AS (SELECT edge_type, dst_type AS pt FROM r GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY edge_type ORDER BY sum(n) DESC, dst_type) = 1)")
    + "SELECT edge_type, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, count(DISTINCT src_type || '>' || dst_type) AS type_pairs, any_value(ps) AS primary_source, any_value(pt) AS primary_target, round(count(*) / CAST((SELECT count(*) FROM e) AS DOUBLE), 6) AS coverage FROM e JOIN x USING (edge_type) JOIN y USING (edge_type) GROUP BY 1",
)
add(
    "type_relationships",
    lambda s, d: ontology_reports.type_relationships(N(s, d), E(s, d)),
    with_(REL, "z AS (SELECT src_type AS type, 'outgoing' AS way, edge_type, dst_type AS other, n FROM r UNION ALL SELECT dst_type, 'incoming', edge_type, src_type, n FROM r)")
    + "SELECT z.type, way, edge_type, other, n, round(n / CAST(sum(n) OVER (PARTITION BY z.type, way) AS DOUBLE), 6) AS share, round(n / CAST(c AS DOUBLE), 6) AS per_node FROM z JOIN (SELECT type, count(*) AS c FROM n GROUP BY 1) k ON k.type = z.type",
)
add(
    "semantic_subgraphs",
    lambda s, d: ontology_reports.semantic_subgraphs(E(s, d, ("in_region", "supplies"))),
    "SELECT min(least(src_type, dst_type)) OVER (PARTITION BY edge_type) AS subgraph, unnest([src_type, dst_type]) AS type, n AS edges FROM (SELECT src_type, dst_type, edge_type, count(*) AS n FROM e WHERE edge_type IN ('in_region', 'supplies') GROUP BY ALL)",
)
REGEX = (
    RICH,
    "g AS (SELECT type, prop, min(length(s_val)) AS lo, max(length(s_val)) AS hi FROM px GROUP BY 1, 2 HAVING count(*) >= 3)",
    "cs AS (SELECT type, prop, i, count(DISTINCT c) AS k, min(c) AS c, bool_and(regexp_matches(c, '[0-9]')) AS d, bool_and(regexp_matches(c, '[A-Z]')) AS u, bool_and(regexp_matches(c, '[a-z]')) AS l, bool_and(regexp_matches(c, '[A-Za-z]')) AS a FROM (SELECT type, prop, i, s_val[i] AS c FROM (SELECT type, prop, s_val, unnest(generate_series(1, length(s_val))) AS i FROM px JOIN g USING (type, prop) WHERE lo = hi AND hi <= 20)) GROUP BY 1, 2, 3)",
    r"pl AS (SELECT type, prop, '^' || string_agg(CASE WHEN d THEN '\d' WHEN u THEN '[A-Z]' WHEN l THEN '[a-z]' WHEN a THEN '[A-Za-z]' WHEN k > 1 THEN '.' WHEN contains('-/:.$^*+?()[]{}\|', c) THEN '\' || c ELSE c END, '' ORDER BY i) || '$' AS pattern FROM cs GROUP BY 1, 2)",
    r"tp AS (SELECT type, prop, bool_and(regexp_matches(s_val, '^\d{4}-\d{2}-\d{2}')) AS d, bool_and(regexp_matches(s_val, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) AS m, bool_and(regexp_matches(s_val, '^https?://\S+')) AS u FROM (SELECT px.* FROM px JOIN g USING (type, prop) WHERE NOT (lo = hi AND hi <= 20) QUALIFY row_number() OVER (PARTITION BY type, prop ORDER BY node_id, s_val) <= 10) GROUP BY 1, 2)",
)
add("regex_synthesis", lambda s, d: ontology.regexes(_rich(s, d)), with_(*REGEX) + r"SELECT * FROM pl UNION ALL SELECT type, prop, CASE WHEN d THEN '^\d{4}-\d{2}-\d{2}$' WHEN m THEN '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$' ELSE '^https?://\S+$' END FROM tp WHERE d OR m OR u")
add(
    "value_correlations",
    lambda s, d: ontology.value_correlations(_twins(s, d)),
    with_(RICH, "tw AS (SELECT * FROM px UNION ALL SELECT node_id, type, prop || '_copy', CASE WHEN length(node_id) % 2 = 0 THEN s_val ELSE lower(s_val) END, NULL FROM px WHERE prop IN ('c_mktsegment', 'o_orderstatus', 'p_type'))", "pw AS (SELECT x.type, x.prop AS a, y.prop AS b, CASE WHEN x.s_val = y.s_val THEN 1.0::DOUBLE WHEN starts_with(x.s_val, y.s_val) OR starts_with(y.s_val, x.s_val) THEN 0.5 WHEN lower(x.s_val) = lower(y.s_val) THEN 0.8 WHEN contains(x.s_val, y.s_val) OR contains(y.s_val, x.s_val) THEN 0.3 ELSE 0 END AS s FROM tw x JOIN tw y ON x.node_id = y.node_id AND x.prop <> y.prop)")
    + "SELECT type, a, b, round(avg(s), 6) AS similarity FROM pw WHERE (type, a) IN (SELECT (type, prop) FROM tw WHERE d_val IS NULL) GROUP BY 1, 2, 3 HAVING count(*) >= 5 AND avg(s) > 0.6",
)


def _twins(s: SparkSession, d: str) -> DataFrame:
    """The properties with copies of three, half of them in lower case."""
    p = _rich(s, d)
    v = F.when(F.length("node_id") % 2 == 0, F.col("s_val")).otherwise(F.lower("s_val"))
    return p.union(p.filter("prop IN ('c_mktsegment', 'o_orderstatus', 'p_type')").select("node_id", "type", F.concat("prop", F.lit("_copy")), v, F.lit(None).cast("double")))


add("value_samples", lambda s, d: ontology.diverse_samples(P(s, d)), with_("q AS (SELECT *, row_number() OVER (PARTITION BY type, prop ORDER BY d_val NULLS FIRST, s_val) - 1 AS i, count(*) OVER (PARTITION BY type, prop) AS n FROM (SELECT DISTINCT type, prop, s_val, d_val FROM p))") + "SELECT type, prop, s_val FROM q WHERE n <= 10 OR i = 0 OR i = n - 1 OR i IN (SELECT CAST(floor(n / CAST(8 AS DOUBLE) * k) AS BIGINT) FROM range(1, 9) r(k) WHERE floor(n / CAST(8 AS DOUBLE) * k) < n)")

add(
    "type_analysis",
    lambda s, d: ontology_reports.type_analysis(N(s, d), E(s, d), P(s, d)).select("type", "section", "name", F.round("value", 6).alias("value"), F.round("share", 6).alias("share")),
    with_(REL, "tt AS (SELECT type, count(*) AS n FROM n GROUP BY 1)", "en AS (SELECT node_id, count(*) AS d FROM (SELECT src AS node_id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1)", "dd AS (SELECT type, coalesce(d, 0) AS d FROM n LEFT JOIN en USING (node_id))",
          "ds AS (SELECT type, min(d) AS a, max(d) AS b, avg(d) AS c, median(d) AS m FROM dd GROUP BY 1)")
    + """SELECT type, 'nodes' AS section, 'count' AS name, n::DOUBLE AS value, round(n / CAST((SELECT sum(n) FROM tt) AS DOUBLE), 6) AS share FROM tt
    UNION ALL SELECT type, 'hierarchy', CAST(hierarchy AS VARCHAR), count(*), round(count(*) / CAST(any_value(tt.n) AS DOUBLE), 6) FROM n JOIN tt USING (type) GROUP BY type, hierarchy
    UNION ALL SELECT type, 'property', prop, count(DISTINCT node_id), round(count(DISTINCT node_id) / CAST(any_value(tt.n) AS DOUBLE), 6) FROM p JOIN tt USING (type) GROUP BY type, prop
    UNION ALL SELECT src_type, 'outgoing', edge_type || ' ' || dst_type, n, round(n / CAST(sum(n) OVER (PARTITION BY src_type) AS DOUBLE), 6) FROM r
    UNION ALL SELECT dst_type, 'incoming', edge_type || ' ' || src_type, n, round(n / CAST(sum(n) OVER (PARTITION BY dst_type) AS DOUBLE), 6) FROM r
    UNION ALL SELECT type, 'degree', unnest(['least', 'greatest', 'mean', 'median']), round(unnest([a, b, c, m]::DOUBLE[]), 6), NULL FROM ds""",
)
