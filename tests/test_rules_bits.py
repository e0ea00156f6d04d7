"""Presence of properties as bits, and edges that are looked up by the ends that aren't nodes."""

from pyspark.sql import functions as F

from weftgraph.operators import rules

KIND = "src string, dst string, edge_type string, src_type string, dst_type string"
RULE = "type string, prop string, rule string, low double, high double, detail string"


def _rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_more_properties_than_a_word_holds(spark):
    """70 properties: node 0 has all, node 1 lacks the 69th, node 2 has none."""
    names = [f"p{i:02}" for i in range(70)]
    props = spark.createDataFrame([(f"n{k}", "t", p, "x", None) for k in (0, 1) for p in names if (k, p) != (1, "p68")], "node_id string, type string, prop string, s_val string, d_val double")
    nodes = spark.createDataFrame([(f"n{k}", "t") for k in range(3)], "node_id string, type string")
    rule = spark.createDataFrame([("t", p, "required", None, None, None) for p in names], RULE)
    found = rules.property_problems(nodes, props, rule)
    assert _rows(found.filter("subject <> 'n2'").select("problem", "severity", "subject", "property")) == [str(("missing_required_property", "high", "n1", "p68"))]
    assert found.filter("subject = 'n2'").count() == 70
    pairs = rules.pair_counts(props)
    assert pairs.count() == 70 * 69 // 2
    assert [tuple(r) for r in pairs.filter("a = 'p68'").collect()] == [("t", "p68", "p69", 1, 0, 1)]
    cross = spark.createDataFrame([("t", "implication", "p69", "p68", 1.0), ("t", "implication", "p68", "p69", 1.0)], "type string, rule string, a string, b string, rate double")
    assert _rows(rules.implication_problems(props, cross).select("subject", "property", "detail")) == [str(("n1", "p68", "p69"))]


def test_edges_are_not_moved_to_the_nodes(spark, monkeypatch):
    """Only the ends that are no nodes are looked for in the edges, and one written frame has them."""
    pairs = [("a", "b"), ("a", "x"), ("y", "b"), ("y", "x"), (None, "b"), ("a", "c")]
    e = spark.createDataFrame([(a, b, "e", "t", "t") for a, b in pairs], KIND)
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    schema = "src_type string, edge_type string, dst_type string"
    known = {"edge_types": spark.createDataFrame([("e",)], "edge_type string"), "observed": spark.createDataFrame([("t", "e", "t")], schema), "cardinality": spark.createDataFrame([("t", "e", "t", "one-to-one")], schema + ", cardinality string")}
    written, write = [], rules.materialise
    monkeypatch.setattr(rules, "materialise", lambda df: (written.append(df.columns), write(df))[1])
    found = rules.edge_problems(n, e, known)
    want = [("invalid_edge_source", "y e b"), ("invalid_edge_source", "y e x"), ("invalid_edge_source", "e b"), ("invalid_edge_target", "a e x"), ("invalid_edge_target", "y e x"), ("cardinality_violation", "a")]
    assert _rows(found.select("problem", "subject")) == sorted(map(str, want))
    assert written == [["node_id"]]
    assert _rows(rules.edge_problems(n, e, known, e.select(F.explode(F.array("src", "dst")).alias("node_id")))) == _rows(found)


def test_a_profile_without_the_median_is_the_same_elsewhere(spark):
    rows = [(f"n{i}", "t", "day", f"2024-01-{i:02}", None) for i in range(1, 20)] + [(f"n{i}", "t", "size", str(i), float(i)) for i in range(9)]
    p = spark.createDataFrame(rows, "node_id string, type string, prop string, s_val string, d_val double")
    assert _rows(rules.profile(p, False)) == _rows(rules.profile(p).drop("median_value"))
    assert dict(rules.profile(p, False).select("prop", "pattern").collect()) == {"day": "date", "size": "integer"}
