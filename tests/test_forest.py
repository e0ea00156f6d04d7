"""Euler tours of forests against plain recursion."""

import random

import pytest

from weftgraph.operators import forest


def frame(spark, parents):
    return spark.createDataFrame(list(parents.items()), "node_id string, parent string")


def checked(spark, parents):
    rows = {r["node_id"]: r for r in forest.tour(frame(spark, parents)).collect()}
    assert rows.keys() == parents.keys()
    above = {}
    for x in parents:
        way = [x]
        while parents[way[-1]] is not None:
            way.append(parents[way[-1]])
        above[x] = way
    size = {x: 0 for x in parents}
    for way in above.values():
        for y in way:
            size[y] += 1
    for x, r in rows.items():
        assert (r["root"], r["depth"], r["size"]) == (above[x][-1], len(above[x]) - 1, size[x]), x
    for root in {r["root"] for r in rows.values()}:
        assert sorted(r["entry"] for r in rows.values() if r["root"] == root) == list(range(size[root]))
    for x in random.Random(1).sample(sorted(parents), min(40, len(parents))):
        inside = {y for y, r in rows.items() if r["root"] == rows[x]["root"] and rows[x]["entry"] <= r["entry"] <= rows[x]["exit"]}
        assert inside == {y for y in parents if x in above[y]}
    return rows


def test_forest_of_all_shapes(spark):
    r = random.Random(2)
    parents = {f"n{i}": None if i % 97 == 0 else f"n{r.randrange(i)}" for i in range(300)}
    parents |= {f"p{i}": f"p{i - 1}" if i else None for i in range(130)}  # a path
    parents |= {"hub": None} | {f"h{i}": "hub" for i in range(150)} | {"alone": None}
    rows = checked(spark, parents)
    assert rows["p0"]["size"] == 130 and rows["alone"]["size"] == 1 and rows["hub"]["exit"] == 150


def test_descendants_and_pairs(spark):
    t = forest.tour(frame(spark, {"a": None, "b": "a", "c": "b", "d": "a", "e": None}))
    some = spark.createDataFrame([("b",), ("e",), ("none",)], "node_id string")
    assert sorted(map(tuple, forest.descendants(t, some).collect())) == [("b", "b"), ("b", "c"), ("e", "e")]
    pairs = spark.createDataFrame([("c", "a"), ("a", "c"), ("d", "b"), ("e", "a"), ("a", "a"), ("x", "a")], "x string, y string")
    assert {(r["x"], r["y"]): r["below"] for r in forest.is_below(t, pairs).collect()} == {("c", "a"): True, ("a", "c"): False, ("d", "b"): False, ("e", "a"): False, ("a", "a"): True, ("x", "a"): None}


@pytest.mark.parametrize(("parents", "said"), [({"a": "b", "b": "c", "c": "a"}, "cycle"), ({"a": "x"}, "isn't a node"), ({"a": None, "b": "b"}, "cycle")])
def test_what_is_no_forest(spark, parents, said):
    with pytest.raises(ValueError, match=said):
        forest.tour(frame(spark, parents))
    with pytest.raises(ValueError, match="more than one"):
        forest.tour(spark.createDataFrame([("a", None), ("b", None), ("c", "a"), ("c", "b")], "node_id string, parent string"))


def test_an_empty_forest(spark):
    assert forest.tour(spark.createDataFrame([], "node_id string, parent string")).count() == 0


def test_rounds_bring_no_nodes_to_the_driver(spark, monkeypatch):
    plans = []
    write = forest.materialise

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(forest, "materialise", noted)
    arcs = spark.createDataFrame([(f"a{i}", f"a{i + 1}" if i < 5 else None, 1) for i in range(6)], "arc string, next string, weight long")
    assert sorted(map(tuple, forest._jumped(arcs).collect())) == [(f"a{i}", 6 - i) for i in range(6)]
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)
