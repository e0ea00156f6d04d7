"""Queries on structure and rewrites whose SQL works the answer out by recursion or by counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import graph, ontology
from ..sources import star_graph as star
from .catalog import BOTH, GEO, ORACLES, REL, E, N, P, _closed, add, with_

add("edge_filter", lambda s, d: graph.where_all(star.edges_at(s, d, "nation:3"), {"edge_type": "in_nation", "dst": "nation:3"}), "SELECT * FROM e WHERE edge_type = 'in_nation' AND dst = 'nation:3'")
add("neighborhood_induced", lambda s, d: graph.neighborhood(_around(s, d, "order:1"), "order:1"), with_(BOTH, "nb AS (SELECT DISTINCT other FROM b WHERE node_id = 'order:1')") + "SELECT * FROM e WHERE src = 'order:1' OR dst = 'order:1' UNION SELECT * FROM e WHERE src IN (SELECT other FROM nb) AND dst IN (SELECT other FROM nb)")


def _around(s: SparkSession, d: str, node: str) -> DataFrame:
    """The edges at a node, by its key, and those among the types of its neighbours."""
    at = star.edges_at(s, d, node)
    kinds = [r["t"] for r in at.select(F.explode(F.array("src_type", "dst_type")).alias("t")).distinct().collect()]  # a few types
    between = tuple({e.edge_type for e in star.EDGES if e.src[0] in kinds and e.dst[0] in kinds and node.partition(":")[0] not in (e.src[0], e.dst[0])})
    return at.union(E(s, d, between)).distinct() if between else at


# --- trees and cycles: components and closures by recursion

WALK = "und AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), rch(a, b) AS (SELECT node_id, node_id FROM gn UNION SELECT rch.a, und.b FROM rch JOIN und ON und.a = rch.b)"
TREE = "SELECT n, e, components, components = 1 AND e = n - 1 AS is_tree FROM (SELECT (SELECT count(*) FROM gn) AS n, (SELECT count(*) FROM g) AS e, (SELECT count(DISTINCT m) FROM (SELECT a, min(b) AS m FROM rch GROUP BY 1)) AS components)"
add("is_tree", lambda s, d: graph.is_tree(N(s, d).filter("type IN ('nation', 'region')"), E(s, d, ("in_region",))), with_("gn AS (SELECT node_id FROM n WHERE type IN ('nation', 'region'))", "g AS (SELECT * FROM e WHERE edge_type = 'in_region')", WALK) + TREE)
add(
    "is_tree_of_one_region",
    lambda s, d: graph.is_tree(*_one_region(s, d)),
    with_("gn AS (SELECT 'region:1' AS node_id UNION SELECT src FROM e WHERE dst = 'region:1')", "g AS (SELECT * FROM e WHERE dst = 'region:1')", WALK) + TREE,
)


def _one_region(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = star.edges_at(s, d, "region:1")
    return e.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct(), e


def _ring(s: SparkSession, d: str, closed: bool) -> DataFrame:
    """Nations and regions; closed, with an edge from each region to its least nation."""
    e = E(s, d, ("in_region",)).select("src", "dst")
    return e.union(e.groupBy(F.col("dst").alias("a")).agg(F.min("src").alias("b")).select(F.col("a").alias("src"), F.col("b").alias("dst"))) if closed else e


def _cyclic(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(k, graph.has_cycle(_ring(s, d, k == "closed"))) for k in ("open", "closed")], "graph string, cyclic boolean")


add(
    "has_cycle",
    _cyclic,
    with_("g0 AS (SELECT 'open' AS graph, src, dst FROM e WHERE edge_type = 'in_region')", "g AS (SELECT * FROM g0 UNION ALL SELECT 'closed', src, dst FROM g0 UNION ALL SELECT 'closed', dst, min(src) FROM g0 GROUP BY dst)", "cl(graph, a, b) AS (SELECT graph, src, dst FROM g UNION SELECT cl.graph, cl.a, g.dst FROM cl JOIN g ON g.graph = cl.graph AND g.src = cl.b)")
    + "SELECT graph, bool_or(a = b) AS cyclic FROM cl GROUP BY 1",
)
add(
    "tree_reach",
    lambda s, d: graph.tree_reach(E(s, d, ("in_nation", "in_region")).union(E(s, d, ("placed",))), N(s, d).filter("type IN ('customer', 'supplier')")),
    with_("g AS (SELECT DISTINCT src, dst FROM e WHERE edge_type IN ('in_nation', 'in_region', 'placed'))", "rc(a, b) AS (SELECT node_id, node_id FROM n WHERE type IN ('customer', 'supplier') UNION SELECT rc.a, g.dst FROM rc JOIN g ON g.src = rc.b)")
    + "SELECT a AS start, count(DISTINCT b) AS reached, count(dst) = count(DISTINCT b) - 1 AS is_tree FROM rc LEFT JOIN g ON g.src = rc.b GROUP BY 1",
)
for _name in ("is_tree", "is_tree_of_one_region", "has_cycle", "tree_reach"):
    ORACLES[_name] = ORACLES[_name].replace("WITH ", "WITH RECURSIVE ", 1)

# --- motifs


def _typed(s: SparkSession, d: str) -> DataFrame:
    """The edges of nations, regions and customers with an edge from each region back to its customers with an even number."""
    e = E(s, d, GEO).filter("src_type <> 'supplier'")
    up = E(s, d, ("in_region",)).select(F.col("src").alias("n"), F.col("dst").alias("r"))
    back = e.filter("edge_type = 'in_nation'").join(F.broadcast(up), F.col("dst") == F.col("n")).filter(F.substring_index("src", ":", -1).cast("int") % 2 == 0)
    return e.union(back.select(F.col("r").alias("src"), F.col("src").alias("dst"), F.lit("serves").alias("edge_type"), F.lit("region").alias("src_type"), F.lit("customer").alias("dst_type")))


CYCLE = ["customer", "nation", "region"], ["in_nation", "in_region", "serves"], "cycle"
add("motif_typed_cycle", lambda s, d: graph.motif(_typed(s, d), *CYCLE), "SELECT x.src AS n0, x.dst AS n1, y.dst AS n2 FROM e x JOIN e y ON x.dst = y.src WHERE x.edge_type = 'in_nation' AND x.src_type = 'customer' AND y.edge_type = 'in_region' AND CAST(split_part(x.src, ':', 2) AS INT) % 2 = 0")
add("motif_typed_star", lambda s, d: graph.motif(E(s, d), ["customer", "order"], ["placed"], "star"), "SELECT src AS center, count(*) AS leaves FROM e WHERE edge_type = 'placed' GROUP BY 1 HAVING count(*) >= 2")
add("hierarchical_edges", lambda s, d: ontology.hierarchical(E(s, d)), with_(REL) + "SELECT edge_type, count(DISTINCT src_type) AS source_types, count(DISTINCT dst_type) AS target_types FROM r GROUP BY 1 HAVING source_types <= 3 AND target_types <= 3 AND (regexp_matches(lower(edge_type), 'contains|has|part_of|belongs|parent|child|member|includes|owns|in_') OR bool_or(src_type = dst_type) OR bool_or((dst_type, src_type) IN (SELECT (src_type, dst_type) FROM r)))")
add("naming_styles", lambda s, d: P(s, d).select("prop").distinct().select("prop", columns.naming_style(F.col("prop")).alias("style")), "SELECT DISTINCT prop, CASE WHEN regexp_matches(prop, '^[a-z0-9]+(_[a-z0-9]+)+$') THEN 'snake_case' WHEN regexp_matches(prop, '^[a-z]+[A-Z]') THEN 'camelCase' WHEN regexp_matches(prop, '^[A-Z][a-z]') THEN 'PascalCase' WHEN regexp_matches(prop, '^[a-z0-9]+$') THEN 'lower' ELSE 'other' END AS style FROM p")

# --- rewrites


def _new_edges(s: SparkSession) -> DataFrame:
    rows = [("nation:1", "region:2", "borders"), ("nation:1", "region:2", "borders"), ("nation:x", "region:2", "borders"), ("nation:2", "region:x", "borders")]
    return s.createDataFrame([(*r, "nation", "region") for r in rows], "src string, dst string, edge_type string, src_type string, dst_type string")


def _geo(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return N(s, d).filter("type IN ('nation', 'region')"), E(s, d, ("in_region",))


def _with_present(s: SparkSession, d: str) -> DataFrame:
    return _new_edges(s).union(_geo(s, d)[1].filter("src = 'nation:3'"))


add("add_edges", lambda s, d: graph.add_edges(*_geo(s, d), _with_present(s, d))[0], "SELECT * FROM e WHERE edge_type = 'in_region' UNION ALL SELECT 'nation:1', 'region:2', 'borders', 'nation', 'region'")
add("add_edges_refused", lambda s, d: graph.add_edges(*_geo(s, d), _with_present(s, d))[1], "SELECT src, dst, edge_type, 'already there' AS reason FROM e WHERE edge_type = 'in_region' AND src = 'nation:3' UNION ALL SELECT 'nation:x', 'region:2', 'borders', 'no source' UNION ALL SELECT 'nation:2', 'region:x', 'borders', 'no target'")
add("remove_edges", lambda s, d: graph.remove_edges(E(s, d, GEO), E(s, d, GEO).filter("src IN ('nation:3', 'customer:1')")), "SELECT * FROM e WHERE edge_type IN ('in_nation', 'in_region') AND src NOT IN ('nation:3', 'customer:1')")
add(
    "update_attributes",
    lambda s, d: graph.update_attributes(P(s, d).filter("type = 'supplier'"), P(s, d).filter("type = 'supplier'").select("node_id", "type", F.explode(F.array(F.lit("s_acctbal"), F.lit("grade"))).alias("prop"), F.lit("new").alias("s_val"), F.lit(None).cast("double").alias("d_val"), F.lit(1).alias("seq")).filter("node_id < 'supplier:5'")),
    "SELECT * FROM p WHERE type = 'supplier' AND node_id >= 'supplier:5' UNION ALL SELECT node_id, type, unnest(['s_acctbal', 'grade']), 'new', NULL FROM p WHERE type = 'supplier' AND node_id < 'supplier:5'",
)
add("simple_edges", lambda s, d: graph.simple(_typed(s, d).union(E(s, d, ("in_region",)).withColumn("edge_type", F.lit("also")))), "SELECT src, dst, CASE WHEN edge_type = 'in_region' THEN 'also' ELSE edge_type END AS edge_type FROM e WHERE edge_type IN ('in_nation', 'in_region') AND src_type <> 'supplier' UNION ALL SELECT y.dst, x.src, 'serves' FROM e x JOIN e y ON x.dst = y.src WHERE x.edge_type = 'in_nation' AND x.src_type = 'customer' AND y.edge_type = 'in_region' AND CAST(split_part(x.src, ':', 2) AS INT) % 2 = 0")
add("undirected_edges", lambda s, d: graph.undirected(_closed(s, d).withColumn("edge_type", F.lit("e"))), with_("c AS (SELECT src, dst FROM e WHERE edge_type IN ('in_nation', 'in_region') UNION SELECT x.src, y.dst FROM e x JOIN e y ON x.dst = y.src WHERE x.edge_type = 'in_nation' AND x.src_type = 'customer' AND y.edge_type = 'in_region')") + "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, 'e' AS edge_type FROM c")
add("connected_nodes", lambda s, d: graph.connected(E(s, d, GEO), N(s, d).filter("type = 'region'"), "in_region", "in"), "SELECT DISTINCT dst AS node_id, src AS other FROM e WHERE edge_type = 'in_region'")
add("edge_attribute_index", lambda s, d: graph.edge_attribute_index(E(s, d, GEO), "edge_type", 7), "SELECT edge_type AS value, src, dst, count(*) OVER (PARTITION BY edge_type) AS n FROM e WHERE edge_type IN ('in_nation', 'in_region') QUALIFY row_number() OVER (PARTITION BY edge_type ORDER BY src, dst) <= 7")
add("collapse_stats", lambda s, d: graph.collapse_stats(N(s, d), E(s, d, ("in_region", "in_nation")), ["in_region"], True)[2], "SELECT count(*) AS edges_collapsed, count(DISTINCT src) AS nodes_changed, (SELECT count(DISTINCT dst) FROM e WHERE edge_type = 'in_region') AS orphans FROM e WHERE edge_type = 'in_region'")
add("collapse_nodes", lambda s, d: graph.collapse_stats(N(s, d), E(s, d, ("in_region", "in_nation")), ["in_region"], True)[0], "SELECT * FROM n WHERE node_id NOT IN (SELECT dst FROM e WHERE edge_type = 'in_region')")
add("merged_attributes", lambda s, d: graph.merged_attributes(P(s, d), N(s, d).filter("type = 'order'").limit(0).union(N(s, d).filter("node_id IN ('part:1', 'part:2', 'customer:1')"))), "SELECT prop, string_agg(DISTINCT s_val, '|' ORDER BY s_val) AS values FROM p WHERE node_id IN ('part:1', 'part:2', 'customer:1') GROUP BY 1")
add("graph_summary_attributes", lambda s, d: graph.attributes_summary(*_geo(s, d), P(s, d)), "SELECT 'type' AS what, type AS name, count(*) AS n FROM n WHERE type IN ('nation', 'region') GROUP BY n.type UNION ALL SELECT 'hierarchy', CAST(hierarchy AS VARCHAR), count(*) FROM n WHERE type IN ('nation', 'region') GROUP BY hierarchy UNION ALL SELECT 'edge_type', 'in_region', count(*) FROM e WHERE edge_type = 'in_region' UNION ALL SELECT 'property', prop, count(*) FROM p GROUP BY prop UNION ALL SELECT 'structure', 'components', count(*) FROM n WHERE type = 'region' UNION ALL SELECT 'structure', 'largest_component', max(c) + 1 FROM (SELECT dst, count(*) AS c FROM e WHERE edge_type = 'in_region' GROUP BY 1) UNION ALL SELECT 'structure', 'diameter', NULL")
add(
    "structural_sample",
    lambda s, d: graph.sampled(N(s, d), E(s, d), 300),
    with_(BOTH, "a0 AS (SELECT node_id, 0 AS tier, 0 AS w FROM (SELECT *, count(*) OVER (PARTITION BY type) AS c, row_number() OVER (PARTITION BY type ORDER BY node_id) AS k FROM n) WHERE k <= CASE WHEN c < 50 THEN 5 ELSE 3 END)", "a1 AS (SELECT unnest([src, dst]) AS node_id, 1 AS tier, 0 AS w FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY edge_type ORDER BY src, dst) <= 3))",
          "a2 AS (SELECT node_id, 2 AS tier, -count(DISTINCT other) AS w FROM b GROUP BY 1 ORDER BY 3, 1 LIMIT 100)", "al AS (SELECT node_id, min((tier, w)) AS x FROM (SELECT * FROM a0 UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2) GROUP BY 1)")
    + "SELECT node_id, type FROM n WHERE node_id IN (SELECT node_id FROM al ORDER BY x, node_id LIMIT 100)",
)
