"""Recursion in SQL: deep data, ways that meet, limits that are put back."""

from weftgraph.operators import recursion


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_ancestors_at_any_depth(spark):
    deep = [(f"n{i}", f"n{i + 1}") for i in range(120)]  # beyond the session's 100 levels
    found = recursion.ancestors(edges(spark, deep), edges(spark, [("n0", "x")]).selectExpr("src AS node_id"))
    assert rows(found) == sorted(("n0", f"n{i}", i) for i in range(1, 121))
    met = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "e"), ("a", "b"), (None, "e"), ("e", None)]
    assert rows(recursion.ancestors(edges(spark, met)).filter("node_id = 'a'")) == [("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("a", "e", 1), ("a", "e", 3)]
    assert recursion.ancestors(edges(spark, [])).count() == 0


def test_limits_are_put_back(spark):
    before = {k: spark.conf.get(k) for k in recursion.LIMITS}
    recursion.ancestors(edges(spark, [("a", "b")]))
    assert {k: spark.conf.get(k) for k in recursion.LIMITS} == before


def test_simple_paths(spark):
    steps = spark.createDataFrame([("a", "b", "m"), ("b", "c", "n"), ("c", "a", "o"), ("c", "d", "p"), ("d", "d", "q")], "src string, dst string, method string")
    every = {"a>b": "m", "b>c": "n", "c>a": "o", "c>d": "p", "a>b>c": "m>n", "b>c>a": "n>o", "b>c>d": "n>p", "c>a>b": "o>m", "a>b>c>d": "m>n>p"}
    assert {r["path"]: r["methods"] for r in recursion.paths(steps).collect()} == every
    assert {r["path"] for r in recursion.paths(steps, 2).collect()} == {p for p in every if p.count(">") <= 2}


def test_walks(spark):
    steps = edges(spark, [("a", "c"), ("a", "b"), ("b", "d"), ("d", None)])
    assert rows(recursion.walk(steps, "a")) == [(0, "a"), (1, "b"), (2, "d")]
    assert rows(recursion.walk(edges(spark, [("a", "b"), ("b", "a")]), "a", 3)) == [(0, "a"), (1, "b"), (2, "a"), (3, "b")]
    assert rows(recursion.walk(steps, "z")) == [(0, "z")]
