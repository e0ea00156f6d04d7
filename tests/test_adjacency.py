"""Kept adjacency: rows as from the edges themselves, hubs in parts, no exchange on the edges' side of a join."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import adjacency, graph

from .test_operators import edges, rows

PAIRS = [("a", "b"), ("b", "a"), ("a", "c"), ("c", "d"), ("d", "b"), ("e", "e"), ("a", "b"), *[("hub", f"x{i}") for i in range(40)], *[(f"x{i}", "hub") for i in range(0, 40, 7)]]


@pytest.fixture(scope="module", params=[8, 1_000])
def kept(spark, request):
    return adjacency.keep(edges(spark, PAIRS), most=request.param)


def ids(spark, some):
    return spark.createDataFrame([(x,) for x in some], "node_id string")


def test_neighbours_equal_those_of_the_edges(spark, kept):
    e = edges(spark, PAIRS)
    for node in ("a", "b", "e", "hub", "x7", "none"):
        want = rows(graph.neighbors(e, node))
        assert rows(adjacency.neighbors_of_one(kept, node)) == want
        assert rows(adjacency.neighbors(kept, ids(spark, [node, node])).drop("node_id")) == want
    both = rows(adjacency.neighbors(kept, ids(spark, ["a", "hub", None])))
    assert {r[0] for r in both} == {"a", "hub"} and len(both) == 2 + 40


def test_induced_and_neighbourhoods(spark, kept):
    e, few = edges(spark, PAIRS), ids(spark, ["a", "b", "c", "e"])
    assert rows(adjacency.induced(kept, few).distinct()) == sorted(map(tuple, graph.induced(e, few).select("src", "dst", "edge_type").distinct().collect()))
    assert rows(adjacency.neighborhoods(kept, ids(spark, ["a"]))) == sorted(map(tuple, graph.neighborhood(e, "a").select("src", "dst", "edge_type").distinct().collect()))


def test_hubs_are_dealt_out(spark):
    k = adjacency.keep(edges(spark, PAIRS), most=8)
    assert rows(k.hubs) == [("hub", 6)]
    assert k.keys == ["node_id", "part"] and k.ends.filter("node_id = 'hub'").select("part").distinct().count() > 1
    assert k.ends.filter("node_id <> 'hub' AND part > 0").isEmpty()


def _below(node, found):
    """The operators on the way down to the scan of the adjacency, or None."""
    name = node.getClass().getSimpleName()
    if name == "FileSourceScanExec" and "weft_adjacency" in node.toString():
        return [name]
    kids = node.children()
    for i in range(kids.size()):
        way = _below(kids.apply(i), found)
        if way:
            return [name, *way]
    return None


def test_the_edges_stay_where_they_are(spark):
    """1,000 ids, joined by sort-merge: the ids are exchanged, the bucketed side isn't, and the aggregate isn't either."""
    k = adjacency.keep(edges(spark, [(f"n{i}", f"n{i * 7 % 5000}") for i in range(5_000)]))
    asked = spark.range(1_000).select(F.concat(F.lit("n"), "id").alias("node_id"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for c, v in zip(old, ("-1", "false")):
            spark.conf.set(c, v)
        plan = adjacency.neighbors(k, asked)._jdf.queryExecution().executedPlan()
        way = _below(plan, [])
        assert way and "SortMergeJoinExec" in way and "ShuffleExchangeExec" not in way
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert adjacency.neighbors_of_one(k, "n3").count() == 2


@pytest.mark.parametrize("most", [8, 45, 46, 1_000])
def test_nodes_are_counted_only_in_full_slots(spark, monkeypatch, most):
    """The hub has 46 ends; in four slots, others are counted with it."""
    monkeypatch.setattr(adjacency, "SLOTS", 4)
    hubs, total = adjacency._hubs(adjacency._ends(edges(spark, PAIRS)), most)
    assert total == 2 * len(PAIRS) and (rows(hubs) if hubs else []) == ([("hub", -(-46 // most))] if most < 46 else [])
    assert adjacency._hubs(adjacency._ends(edges(spark, PAIRS[:1]).limit(0)), most) == (None, 0)
