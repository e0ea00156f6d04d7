"""Small fixtures whose results are known by hand."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import enrich, graph, matching, ontology, propagation, search, series
from weftgraph.sources import ingest


def edges(spark, pairs, kind="e"):
    return spark.createDataFrame([(a, b, kind, "t", "t") for a, b in pairs], "src string, dst string, edge_type string, src_type string, dst_type string")


def nodes(spark, ids):
    return spark.createDataFrame([(i, "t", i) for i in ids], "node_id string, type string, value string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_degree_counts_neighbours_once(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("a", "c")])
    got = {r.node_id: (r.out_degree, r.in_degree, r.total_degree) for r in graph.degrees(e).collect()}
    assert got == {"a": (2, 1, 2), "b": (1, 1, 1), "c": (0, 1, 1)}


def test_tree_and_cycles(spark):
    tree = [("0", "1"), ("0", "2"), ("1", "3")]
    assert graph.is_tree(nodes(spark, "0123"), edges(spark, tree)).first().is_tree
    assert not graph.is_tree(nodes(spark, "01234"), edges(spark, tree)).first().is_tree
    assert not graph.has_cycle(edges(spark, tree))
    assert graph.has_cycle(edges(spark, [*tree, ("3", "0")]))


def test_components_of_a_long_chain(spark):
    e = edges(spark, [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("x", "y")])
    got = {r.component for r in graph.weak_labels(e).collect()}
    assert got == {"000", "x"}


def test_triangles(spark):
    assert rows(graph.triangles(edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]))) == [("a", "b", "c")]


def test_motif_census_counts_paths(spark):
    e = edges(spark, [("a", "m"), ("b", "m"), ("m", "x"), ("m", "y")])
    assert [r.n for r in graph.two_hop_census(e).collect()] == [4]


def test_chain_has_no_repeated_node(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c")])
    assert rows(graph.chains(e, [("t", "e", "t")] * 2)) == [("a", "b", "c")]


def test_empty_graph(spark):
    e, n = edges(spark, []), nodes(spark, [])
    assert graph.degrees(e).count() == 0 and graph.weak_labels(e).count() == 0 and ontology.cardinality(e).count() == 0
    assert graph.subsume(n, e, F.lit(True), "x")[1].count() == 0


def test_cardinality_names(spark):
    got = ontology.cardinality(edges(spark, [("a", "x"), ("b", "x")])).first()
    assert got.cardinality == "one-to-many"


@pytest.mark.parametrize(
    ("pairs", "sources", "want"),
    [
        ([("0", "2"), ("0", "3"), ("1", "2"), ("1", "4"), ("2", "5"), ("3", "6"), ("4", "7")], {"0": 2020.0, "1": 2010.0}, {"2": 2015, "3": 2020, "4": 2010, "5": 2015, "6": 2020, "7": 2010}),
        ([("0", "1"), ("1", "2"), ("3", "4"), ("4", "5")], {"0": 2020.0}, {"1": 2020, "2": 2020}),
        ([("m1", "o1"), ("m2", "o1"), ("m3", "o2"), ("o1", "l"), ("o2", "l")], {"m1": 2001.0, "m2": 2005.0, "m3": 2020.0}, {"o1": 2003, "o2": 2020, "l": 2008.6667}),
    ],
)
def test_matrix_propagation(spark, pairs, sources, want):
    p = spark.createDataFrame([(k, "s", "t", str(v), v) for k, v in sources.items()], "node_id string, type string, prop string, s_val string, d_val double")
    src = propagation.sources(p, ["s"], "t")
    got = {r.node_id: r["mean"] for r in propagation.means(propagation.hops(src, edges(spark, pairs), 2, 0.7), src).collect()}
    assert got == pytest.approx(want, abs=1e-3)


def _sources(spark, values):
    p = spark.createDataFrame([(k, "s", "t", "", float(v)) for k, v in values.items()], "node_id string, type string, prop string, s_val string, d_val double")
    return propagation.sources(p, ["s"], "t")


def test_mixtures_fold_as_by_hand(spark):
    src = _sources(spark, {f"s{i}": v for i, v in enumerate((0, 1, 10, 30, 50, 70, 90, 100))})
    x = {r.node_id: round(r.x, 4) for r in src.collect()}
    e = [(f"s{i}", "x") for i in range(8)] + [("s7", "y"), ("s7", "m"), ("m", "x")]
    got = propagation.mixtures(propagation.hops(src, edges(spark, e), 2, 0.7), src, most=4).filter("node_id = 'x'").first().c
    parts = []
    for m, d, w in sorted([(x[f"s{i}"], 1, 0.7) for i in range(8)] + [(x["s7"], 2, 0.49)]):
        s = 0.025 + 0.015 * d
        near = next((p for p in parts if abs(p[0] - m) < 0.05), None)
        if near:
            t = near[1] + w
            mean = (near[1] * near[0] + w * m) / t
            near[2] = math.sqrt((near[1] * (near[2] ** 2 + (near[0] - mean) ** 2) + w * (s**2 + (m - mean) ** 2)) / t)
            near[0], near[1] = mean, t
        elif len(parts) < 4:
            parts.append([m, w, s])
        else:
            least = min(range(4), key=lambda i: parts[i][1])
            if parts[least][1] < w:
                parts[least] = [m, w, s]
    total = sum(p[1] for p in parts)
    assert [tuple(c) for c in got] == [pytest.approx((m, w / total, s)) for m, w, s in parts]


def test_signals_add_up_sources_of_a_value(spark):
    src = _sources(spark, {"a": 1, "b": 1, "c": 2})
    got = {(r.node_id, r.distance): r.influence for r in propagation.signals(src, edges(spark, [("a", "x"), ("b", "x"), ("x", "y"), ("c", "y")]), 2, 0.5).collect()}
    assert got == {("x", 1): 1.0, ("y", 2): 0.5, ("y", 1): 0.5}


def test_belief_against_matrices(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("e", "c"), ("d", "b")]
    src = _sources(spark, {"a": 1, "e": 3})
    got = {(r.source, r.node_id): r.influence for r in propagation.belief_influences(src, edges(spark, pairs)).collect()}
    ids = "abcde"
    m = np.zeros((5, 5))
    for u, v in pairs:
        m[ids.index(u), ids.index(v)] = 1
    x = np.zeros((5, 2))
    x[0, 0] = x[4, 1] = 1
    for _ in range(15):
        old = x.copy()
        x = 0.1 * x + 0.9 * 0.85 * m.T @ x
        x[0], x[4] = (1, 0), (0, 1)
        if abs(x - old).max() < 1e-3:
            break
    assert got == {("ae"[j], ids[i]): pytest.approx(x[i, j]) for i in range(5) for j in range(2) if x[i, j] > 0}


@pytest.mark.parametrize("heat", [False, True])
def test_spectral_against_matrices(spark, heat):
    """Polynomials of the Laplacian against the same filters by all its eigenvectors."""
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "e"), ("e", "f"), ("c", "b"), ("e", "e"), ("g", "h")]
    ids = "abcdefghi"
    src = _sources(spark, {"a": 1, "f": 3, "g": 1})
    n = spark.createDataFrame([(x,) for x in ids], "node_id string")
    got = {(r.x, r.node_id, r.distance): r.influence for r in propagation.spectral_influences(n, edges(spark, pairs), src, 2, 0.9, heat=heat).collect()}
    m = np.zeros((9, 9))
    for u, v in pairs:
        if u != v:
            m[ids.index(u), ids.index(v)] = m[ids.index(v), ids.index(u)] = 1
    values, vectors = np.linalg.eigh(np.diag(m.sum(1)) - m)
    top, want = max(m.sum(1)[ids.index(u)] + m.sum(1)[ids.index(v)] for u, v in pairs if u != v), {}
    xs = {r.node_id: round(r.x, 1) for r in src.collect()}
    for x in set(xs.values()):
        start = np.array([xs.get(t) == x for t in ids], dtype=float)
        for d in (1, 2):
            f = np.exp(-values * d * 0.0008) * np.exp(-0.5 * (values / top) ** 2) if heat else 0.8 * np.exp(-0.5 * ((values - top * 0.05 * d) / (top * 0.15)) ** 2) + 0.2
            y = vectors @ (f * (vectors.T @ start))
            y = y / np.linalg.norm(y) * 0.9**d
            y = abs(y) if heat else np.maximum(y, 0)
            for i, t in enumerate(ids):
                if t not in xs and y[i] > (0.01 if heat else 0.001):
                    w = y[i] * (0.5 if heat else 1)
                    want[x, t, d] = pytest.approx(w * 1.3 if w < 0.012 else w, abs=2e-5)
    assert len(want) > 3 and got == want


def test_spectral_without_sources_or_edges(spark):
    n = spark.createDataFrame([("a",), ("b",)], "node_id string")
    assert propagation.spectral_influences(n, edges(spark, []), _sources(spark, {"a": 1})).count() == 0
    assert propagation.spectral_influences(n, edges(spark, [("a", "b")]), _sources(spark, {"a": 1}).limit(0)).count() == 0
    with pytest.raises(ValueError, match="digits"):
        propagation.spectral_influences(n, edges(spark, []), _sources(spark, {"a": 1}), digits=4)


def test_chebyshev_meets_the_filters():
    for heat in (False, True):
        for f in propagation.filters(7.0, 3, heat):
            c, v = propagation.chebyshev(f, 7.0, propagation.ORDER), np.linspace(0, 7, 200)
            assert abs(np.polynomial.chebyshev.chebval(2 * v / 7 - 1, c) - f(v)).max() < 2e-5


@pytest.mark.parametrize(
    ("n", "pairs", "density", "depth", "decay"),
    [(10, 9, 0.1, 3, 0.718873), (8, 7, 0.125, 2, 0.7), (6, 4, 0.1333, 2, 0.7), (19, 18, 0.0526, 3, 0.718873), (6, 5, 0.1667, 2, 0.7)],
)
def test_tuning_of_known_shapes(n, pairs, density, depth, decay):
    """Depth and decay of five shapes worked out from the formulas."""
    got = propagation.tuned(n, pairs, 0.0, 2 if (n, pairs) == (6, 4) else 1, 3 if (n, pairs) == (6, 4) else n)
    assert (round(got["density"], 4), got["depth"], round(got["decay"], 6)) == (density, depth, decay)


@pytest.mark.parametrize("method", propagation.METHODS)
def test_propagation_by_each_method(spark, method):
    pairs = [("a", "b"), ("b", "c"), ("c", "d")]
    n, p = spark.createDataFrame([(x,) for x in "abcdz"], "node_id string"), spark.createDataFrame([("a", "s", "t", "5", 5.0), ("d", "s", "t", "9", 9.0)], "node_id string, type string, prop string, s_val string, d_val double")
    got = {r.node_id: r for r in propagation.propagate(n, edges(spark, pairs), p, ["s"], "t", method).collect()}
    assert got["a"].kind == got["d"].kind == "source" and got["b"].kind == "inferred" and got["z"].kind == "isolated"
    assert sum(c.w for c in got["b"].c) == pytest.approx(1) and got["a"].x <= got["b"].x <= got["d"].x


def test_paths(spark):
    p = spark.createDataFrame([("a/b_c/x_1.txt",), ("a/b_d/y_2.txt",), ("a",)], "path string")
    got = {r.node_id: r.type for r in ingest.path_nodes(p).collect()}
    assert got == {"a": "folder", "a/b_c": "folder", "a/b_d": "folder", "a/b_c/x_1.txt": "file", "a/b_d/y_2.txt": "file"}
    assert {r.component for r in ingest.path_components(p).filter("node_id = 'a/b_c/x_1.txt'").collect()} == {"x", "1", "txt"}


def test_json_tree(spark):
    d = spark.createDataFrame([(1, json.dumps({"a": {"b": [1, None]}, "c": True})), (2, "not json"), (3, None)], "doc int, j string")
    got = {(r.doc, r.path): r.type for r in ingest.json_nodes(d, "j").collect()}
    assert got[1, "root.a.b.0"] == "int" and got[1, "root.a.b.1"] == "NoneType" and got[1, "root.c"] == "bool" and not any(k == 3 for k, _ in got)


def test_turbofan_and_rul(spark, tmp_path):
    (tmp_path / "t.txt").write_text(" ".join(["1", "2"] + ["0.5"] * 24) + "\n\n")
    (tmp_path / "r.txt").write_text("112\n98\n")
    t = ingest.read_turbofan(spark, str(tmp_path / "t.txt"))
    assert t.count() == 1 and ingest.turbofan_measurements(t).count() == 21
    assert rows(ingest.read_rul(spark, str(tmp_path / "r.txt"))) == [(1, 112), (2, 98)]


def test_graph_json(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": {"1": {"type": "t", "value": "v"}}, "edges": {"1_2": {"edge_type": "e"}}}))
    n, e = ingest.read_graph_json(spark, str(tmp_path / "g.json"))
    assert [(r.node_id, r.type) for r in n.collect()] == [("1", "t")] and [(r.src, r.dst, r.edge_type) for r in e.collect()] == [("1", "2", "e")]


def test_rules_are_checked():
    rule = ingest.ColumnRule("a", "t", "", "out", 0, "b")
    assert len(ingest.validate([rule], ["a"])) == 2


def test_six_digits_by_context(spark):
    t = spark.createDataFrame([("241005", "", 0, 0), ("101112", "", 0, 0), ("101112", "x_20240101", 0, 0), ("20240001", "", 0, 0), ("ab", "", 0, 0)], "token string, parent string, sibling_dates int, sibling_times int")
    assert rows(enrich.date_tokens(t)) == [("101112", "date", "2010-11-12"), ("101112", "time", "10:11:12"), ("241005", "date", "2024-10-05")]


def test_grids(spark):
    assert enrich.letter_grid(spark).count() == 567 and enrich.even_grid(spark).count() == 2304


def test_trend_labels(spark):
    up = [(1, "s", t, 100.0 + 10 * t) for t in range(9)] + [(2, "s", t, 5.0) for t in range(9)] + [(3, "s", 0, 1.0)] + [(4, "s", 0, 100.0), (4, "s", 1, 98.5)] + [(5, "s", t, v) for t, v in enumerate((100.0, 0.0, 0.0, 110.0))] + [(6, "s", 0, -10.0), (6, "s", 1, -9.0)] + [(7, "s", 0, 0.0), (7, "s", 1, 9.0)]
    got = {r.asset: r.trend for r in series.trends(spark.createDataFrame(up, "asset int, sensor string, t int, value double")).collect()}
    # of four values, the first one against the last two; a change of exactly ten percent isn't strong
    assert got == {1: "increasing_strong", 2: "stable", 3: "stable", 4: "decreasing_slight", 5: "decreasing_strong", 6: "decreasing_moderate", 7: "stable"}


def test_statuses(spark):
    d = spark.createDataFrame(
        [(1, True, None, None, None, None), (2, None, True, None, None, None), (3, None, None, None, "warn", None), (4, None, False, None, None, "an Error"), (5, None, None, None, None, "an error"), (6, None, False, None, "odd", None), (7, False, True, None, "pass", None), (8, None, None, False, None, "fine")],
        "id int, is_valid boolean, has_error boolean, has_warning boolean, status string, description string",
    )
    got = search.status(d).orderBy("id").collect()
    assert [r.resolved for r in got] == ["PASSED", "FAILED", "WARNING", "FAILED", "INFORMATIONAL", "WARNING", "FAILED", "WARNING"]
    assert [r.id for r in got if r.warns] == [2, 3, 4, 6, 7, 8]
    assert search.status(d.select("id")).filter("resolved = 'INFORMATIONAL' AND NOT warns").count() == 8


def test_stems():
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "rational": "ration", "digitizer": "digit", "operator": "oper", "hopefulness": "hope", "triplicate": "triplic", "electrical": "electr", "goodness": "good", "revival": "reviv", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "sky": "sky"}
    assert {w: matching.stem(w) for w in want} == want


def test_names_by_the_first_rule_that_fits():
    assert matching.name_score("Part_1", "part") == (1.0, "exact")
    assert matching.name_score("Connections", "connected") == (0.9, "stem")
    assert matching.name_score("SensorReadingValue", "ValueOfSensorReading")[1] == "token_overlap"
    assert matching.name_score("locatin", "location")[1] == "fuzzy_name" and matching.name_score("abc", "xyz") == (0.0, None)



def test_components_and_cycles_of_long_paths(spark):
    order = random.Random(3).sample(range(1000, 1400), 400)
    path = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in zip(order, order[1:])] + [("x", "x"), ("y", "z")], "src string, dst string")
    want = {f"n{i}": "n1000" for i in order} | {"x": "x", "y": "y", "z": "y"}
    assert {r.node_id: r.component for r in graph.weak_labels(path).collect()} == want
    chain = path.filter("src LIKE 'n%'")
    nodes = chain.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    assert graph.is_tree(nodes, chain).first().is_tree
    assert not graph.has_cycle(chain)
    assert graph.has_cycle(chain.union(spark.createDataFrame([(f"n{order[300]}", f"n{order[290]}")], "src string, dst string")))
    assert graph.has_cycle(path)
    assert not graph.has_cycle(chain.limit(0))


def test_affixes_of_any_length(spark):
    values = {"code": [f"P-{i}{i}" for i in range(10, 20)], "long": [f"measurement {i} unit" for i in range(10)], "name": ["Red Car", "Blue Boat", "Old Town", "New York", "x"]}
    props = spark.createDataFrame([(str(i), "t", p, v, None) for p, vs in values.items() for i, v in enumerate(vs)], "node_id string, type string, prop string, s_val string, d_val double")
    got = {(r.prop, r.what): (r.x, r.n) for r in ontology.string_affixes(props).collect()}
    assert got == {("code", "prefix"): ("P", 10), ("code", "capitalization"): ("all_uppercase", 10), ("long", "prefix"): ("m", 10), ("long", "suffix"): ("t", 10), ("long", "capitalization"): ("all_lowercase", 10), ("name", "capitalization"): ("title_case", 4)}


def test_json_of_any_depth(spark):
    deep = '{"a": ' * 12 + "[1, {}]" + "}" * 12
    got = {(r.path, r.type, r.value) for r in ingest.json_nodes(spark.createDataFrame([(1, deep), (2, None)], "doc int, j string"), "j").collect()}
    want = {("root" + ".a" * i, "dict", None) for i in range(12)} | {("root" + ".a" * 12, "list", None), ("root" + ".a" * 12 + ".0", "int", "1"), ("root" + ".a" * 12 + ".1", "dict", None)}
    assert got == want


def test_severity_by_the_nearest_prompt(spark):
    v = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, -3.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 1.0]), (6, [1.0])], "id long, embedding array<float>")
    got = {r["id"]: tuple(r)[1:3] for r in search.severity(v, [("low", [0.0, 2.0]), ("high", [3.0, 0.0])]).collect()}
    assert got == {1: ("high", 1), 2: (None, None), 3: (None, None), 4: (None, None), 5: ("low", 0), 6: (None, None)}
    with pytest.raises(ValueError, match="prompts"):
        search.severity(v, [])


def test_moments_against_all_pairs(spark):
    """Carried as sums, a node's weight by distance and its whole mean are those of all pairs; a component's mean is one of its
    interval; rows are bounded by intervals."""
    r = random.Random(9)
    ids = [f"s{i}" for i in range(300)]
    pairs = [(x, f"m{r.randrange(6)}") for x in ids] + [(f"m{i}", f"t{j}") for i in range(6) for j in range(3) if r.random() < 0.7] + [("m0", "s1")]
    src, e = _sources(spark, {x: r.random() * 90 for x in ids}), edges(spark, pairs)
    pairwise = propagation.hops(src, e, 3, 0.8, cut=0.0).join(src.select(F.col("node_id").alias("source"), "x"), "source")
    want = {(k.node_id, k.distance): (k.w, k.wx, k.wxx) for k in pairwise.groupBy("node_id", "distance").agg(F.sum("influence").alias("w"), F.sum(F.col("influence") * F.col("x")).alias("wx"), F.sum(F.col("influence") * F.col("x") ** 2).alias("wxx")).collect()}
    carried = propagation.moments(src, e, 3, 0.8, bins=8)
    got = {(k.node_id, k.distance): (k.w, k.wx, k.wxx) for k in carried.groupBy("node_id", "distance").agg(F.sum("w").alias("w"), F.sum("wx").alias("wx"), F.sum("wxx").alias("wxx")).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert carried.groupBy("node_id", "distance").count().agg(F.max("count")).first()[0] <= 8 < pairwise.groupBy("node_id", "distance").count().agg(F.max("count")).first()[0]
    for k in carried.collect():
        assert k.bin / 8 - 1e-9 <= k.wx / k.w <= (k.bin + 1) / 8 + 1e-9
    for k in propagation.merged_mixtures(carried).collect():
        w, wx = (sum(v[i] for (n, _), v in want.items() if n == k.node_id) for i in (0, 1))
        assert sum(c.w for c in k.c) == pytest.approx(1) and len(k.c) <= 5
        if len(k.c) < 5:  # none was replaced
            assert sum(c.w * c.m for c in k.c) == pytest.approx(wx / w)


def test_belief_says_whether_it_settled(spark):
    src, e = _sources(spark, {"a": 1}), edges(spark, [("a", "b"), ("b", "c"), ("c", "b")])
    assert [propagation.belief(src, e, rounds=n)[1] for n in (2, 60)] == [False, True]
