"""Queries on kept structures: the bucketed adjacency, exact order statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adjacency, selection
from .catalog import BOTH, E, N, P, add, with_


def _of(s: SparkSession, d: str, *types: str) -> DataFrame:
    return N(s, d).filter(F.col("type").isin(*types)).select("node_id")


# --- kept adjacency: each query moves ids to the buckets of the edges

add(
    "kept_neighbors",
    lambda s, d: adjacency.neighbors(adjacency.keep(E(s, d)), _of(s, d, "supplier", "nation")),
    with_(BOTH) + "SELECT node_id, other, bool_or(way = 'out') AS outgoing, bool_or(way = 'in') AS incoming FROM b WHERE t IN ('supplier', 'nation') GROUP BY ALL",
)
add("kept_neighbors_of_one", lambda s, d: adjacency.neighbors_of_one(adjacency.keep(E(s, d)), "supplier:3"), with_(BOTH) + "SELECT other, bool_or(way = 'out') AS outgoing, bool_or(way = 'in') AS incoming FROM b WHERE node_id = 'supplier:3' GROUP BY other")
add(
    "kept_induced",
    lambda s, d: adjacency.induced(adjacency.keep(E(s, d)), _of(s, d, "supplier", "nation", "region", "part")),
    "SELECT src, dst, edge_type FROM e WHERE src_type IN ('supplier', 'nation', 'region', 'part') AND dst_type IN ('supplier', 'nation', 'region', 'part')",
)
add(
    "kept_neighborhoods",
    lambda s, d: adjacency.neighborhoods(adjacency.keep(E(s, d)), _of(s, d, "nation")),
    with_(BOTH, "nb AS MATERIALIZED (SELECT DISTINCT other FROM b WHERE t = 'nation')")
    + "SELECT src, dst, edge_type FROM e WHERE src_type = 'nation' OR dst_type = 'nation' UNION SELECT src, dst, edge_type FROM e WHERE src IN (SELECT other FROM nb) AND dst IN (SELECT other FROM nb)",
)

# --- exact order statistics by refinement

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
add(
    "property_quartiles",
    lambda s, d: selection.quantiles(P(s, d), ["type", "prop"], "d_val", QUARTILES).select("type", "prop", *[F.round(c, 6).alias(c) for c in QUARTILES]),
    "SELECT type, prop, " + ", ".join(f"round(quantile_cont(d_val, {x}), 6) AS {c}" for c, x in QUARTILES.items()) + " FROM p WHERE d_val IS NOT NULL GROUP BY type, prop",
)
