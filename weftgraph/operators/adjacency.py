"""Kept adjacency: both directions of the edges as a bucketed and sorted table, which joins by node read without an exchange.

The table has a row for each end of each edge, (node_id, other, way, edge_type, other_type, weight), in buckets by node_id. If
some nodes have over MOST_AT_ONE ends, it is in buckets by (node_id, part): part is 0 but for those hubs, whose ends are dealt
over several parts by the other end, so that no bucket holds a hub whole; lookups ask for each part of those. The hubs are a
frame of their own with at most ends / MOST_AT_ONE rows. Lookups for single nodes read one bucket; joins with frames of ids move the ids, never the edges.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialise, shared_base

#: Ends of a node in one part, and ends in a bucket that the number of buckets aims at.
MOST_AT_ONE = 1_000_000
AIM = 2_000_000
#: Groups by a hash of the node, in which ends are counted before nodes are.
SLOTS = 1 << 16
#: Columns of an edge end beyond the nodes.
REST = ("way", "edge_type", "other_type", "weight")


@dataclass(frozen=True)
class Adjacency:
    """ends: the bucketed table; hubs(node_id, parts): nodes with more than one part, None if there are none."""

    ends: DataFrame
    hubs: DataFrame | None
    buckets: int

    @property
    def keys(self) -> list[str]:
        return ["node_id"] if self.hubs is None else ["node_id", "part"]

    def asked(self, ids: DataFrame) -> DataFrame:
        """ids(node_id, ...) with a row for each part of a node."""
        if self.hubs is None:
            return ids
        j = ids.join(self.hubs, "node_id", "left")
        return j.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def _ends(edges: DataFrame) -> DataFrame:
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)

    def end(a: str, b: str, way: str) -> Column:
        return F.struct(F.col(a).alias("node_id"), F.col(b).alias("other"), F.lit(way).alias("way"), "edge_type", F.col(f"{b}_type").alias("other_type"), weight.alias("weight"))

    both = F.array(end("src", "dst", "out"), end("dst", "src", "in"))
    return edges.filter("src IS NOT NULL AND dst IS NOT NULL").select(F.explode(both).alias("x")).select("x.*")


def _hubs(ends: DataFrame, most: int) -> tuple[DataFrame | None, int]:
    """(the nodes with over `most` ends, None if there are none; the number of ends). Nodes are counted only where a slot of them
    has over `most` ends together, so that ends aren't moved to be counted."""
    slot = F.pmod(F.xxhash64("node_id"), F.lit(SLOTS))
    slots = materialise(ends.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")))
    total, fullest = slots.agg(F.sum("n"), F.max("n")).first()
    if (fullest or 0) <= most:
        return None, total or 0
    near = ends.withColumn("slot", slot).join(F.broadcast(slots.filter(F.col("n") > most).select("slot")), "slot", "left_semi")  # SLOTS rows at most
    counted = near.groupBy("node_id").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    hubs = materialise(counted.select("node_id", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    return (None if hubs.isEmpty() else hubs), total


def keep(edges: DataFrame, most: int = MOST_AT_ONE, buckets: int | None = None) -> Adjacency:
    """Writes the adjacency of edges(src, dst, edge_type, src_type, dst_type[, weight]) to the shared folder. Edges with a null
    end are left out, repeated ones kept; a loop has both its ends at one node."""
    spark = edges.sparkSession
    ends = materialise(_ends(edges))
    hubs, total = _hubs(ends, most)
    split = hubs is not None
    keys = ["node_id", "part"] if split else ["node_id"]
    if split:
        dealt = F.pmod(F.xxhash64("other"), F.coalesce("parts", F.lit(1))).cast("int")
        ends = ends.join(hubs, "node_id", "left").withColumn("part", dealt).drop("parts")
    # fewer buckets than shuffle partitions would make a join shuffle both sides
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // AIM))
    name = f"weft_adjacency_{uuid.uuid4().hex[:12]}"
    rows = ends.select(*keys, "other", *REST).repartition(n, *keys)
    rows.write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", f"{shared_base(spark)}/{name}").saveAsTable(name)
    return Adjacency(spark.table(name), hubs, n)


def ends_at(kept: Adjacency, ids: DataFrame) -> DataFrame:
    """The edge ends at ids(node_id), which may repeat: the ids are moved to the buckets."""
    asked = kept.asked(ids.select("node_id").filter("node_id IS NOT NULL").distinct())
    return kept.ends.join(asked, kept.keys)


def neighbors(kept: Adjacency, ids: DataFrame) -> DataFrame:
    """(node_id, other, outgoing, incoming) for each of ids(node_id). Rows of one pair are in one part, so that the aggregate
    needs no exchange either."""
    flags = [F.bool_or(F.col("way") == way).alias(name) for way, name in (("out", "outgoing"), ("in", "incoming"))]
    return ends_at(kept, ids).groupBy(*kept.keys, "other").agg(*flags).select("node_id", "other", "outgoing", "incoming")


def neighbors_of_one(kept: Adjacency, node: str) -> DataFrame:
    """(other, outgoing, incoming) of one node: its buckets are all that is read."""
    at = kept.ends.filter(F.col("node_id") == node)
    if kept.hubs is not None:
        hub = kept.hubs.filter(F.col("node_id") == node).first()
        at = at.filter(F.col("part").isin(*range(hub["parts"] if hub else 1)))
    return at.groupBy("other").agg(F.bool_or(F.col("way") == "out").alias("outgoing"), F.bool_or(F.col("way") == "in").alias("incoming"))


def induced(kept: Adjacency, ids: DataFrame) -> DataFrame:
    """(src, dst, edge_type) of the edges with both ends in ids(node_id)."""
    keep_ids = ids.select("node_id").distinct()
    out = ends_at(kept, keep_ids).filter("way = 'out'")
    return out.join(keep_ids.select(F.col("node_id").alias("other")), "other", "left_semi").select(F.col("node_id").alias("src"), F.col("other").alias("dst"), "edge_type")


def neighborhoods(kept: Adjacency, ids: DataFrame) -> DataFrame:
    """(src, dst, edge_type): the edges at any of ids(node_id) and those among all their neighbours, each once."""
    at = materialise(ends_at(kept, ids))
    out = F.col("way") == "out"
    touching = at.select(F.when(out, F.col("node_id")).otherwise(F.col("other")).alias("src"), F.when(out, F.col("other")).otherwise(F.col("node_id")).alias("dst"), "edge_type")
    near = at.select(F.col("other").alias("node_id")).distinct()
    return touching.union(induced(kept, near)).distinct()
