"""Plans that keep what a task or a shuffle holds from growing with the whole graph."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import adjacency, blocks, graph, ontology, ontology_reports, propagation, search, tables
from weftgraph.sources import star_graph

KIND = "src string, dst string, edge_type string, src_type string, dst_type string"


def _plan(df, physical=False):
    q = df._jdf.queryExecution()
    return (q.executedPlan() if physical else q.optimizedPlan()).toString()


def test_dangling_edges_look_for_their_ends_once(spark):
    pairs = [("a", "b"), ("a", "b"), ("a", "x"), ("y", "b"), ("y", "x"), (None, "b"), ("a", None)]
    e = spark.createDataFrame([(a, b, "e", "t", "t") for a, b in pairs], KIND)
    found = ontology.dangling(spark.createDataFrame([("a",), ("b",)], "node_id string"), e)
    assert sorted(map(str, found.select("src", "dst").collect())) == sorted(map(str, e.select("src", "dst").distinct().filter("NOT (src <=> 'a' AND dst <=> 'b')").collect()))
    assert "LeftAnti" not in _plan(found)


def test_capped_neighbors_leave_other_ends_out_first(spark):
    e = spark.createDataFrame([("h", f"n{i}", "e", "t", "t") for i in range(9)] + [("n1", "g", "e", "t", "t")], KIND)
    found = graph.capped_neighbors(e, spark.createDataFrame([("h", 0.95), ("g", 0.5), ("n8", 0.1)], "node_id string, similarity double"))
    assert sorted(map(tuple, found.collect())) == [("g", "n1"), *[("h", f"n{i}") for i in range(5)], ("n8", "h")]
    assert "LeftSemi" in _plan(found)


def test_samples_have_no_type_in_one_task(spark):
    n = spark.range(2000).select(F.concat(F.lit("n"), "id").alias("node_id"), F.when(F.col("id") < 4, "rare").otherwise("many").alias("type"))
    e = n.select(F.col("node_id").alias("src"), F.lit("n0").alias("dst"), F.lit("e").alias("edge_type"))
    found = graph.sampled(n, e, 300)
    assert found.count() == 100 and {r[0] for r in found.collect()} >= {"n0", "n1", "n2", "n3", "n10", "n100"}
    assert _plan(found, True).count("WindowGroupLimit") >= 4


def test_edge_texts_move_keys_and_no_ids(spark):
    d = "/root/testdata/sf0.001"
    valued = star_graph.edge_values(spark, d)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(search.text_of_edges(valued)) == rows(search.edge_text(star_graph.edges(spark, d), star_graph.nodes(spark, d)))
    moved = [line for line in _plan(valued, True).splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not any("src#" in line or "dst#" in line or ":" in line.split("hashpartitioning")[1] for line in moved)
    assert sum("REPARTITION" in line for line in moved) == 2  # lineitem's pairs, which are then made distinct and joined where they are


def test_context_brings_few_hits_to_the_edges(spark):
    e = spark.createDataFrame([("h", f"n{i}", "e", "t", "t") for i in range(9)] + [("n1", "g", "e", "t", "t")], KIND).distinct()
    n = spark.createDataFrame([(f"n{i}", "file" if i > 6 else "t") for i in range(9)] + [("g", "t"), ("h", "t")], "node_id string, type string")
    found = search.context(e, n, spark.createDataFrame([("h", 0.9), ("h", 0.9), ("g", 0.9)], "id string, similarity double"), 3)
    assert list(map(tuple, found.collect())) == [("n7", 0.85), ("n8", 0.85), ("n0", 0.7)]
    assert "Aggregate" not in _plan(found)  # the edges were read once, before


def test_pairs_are_made_distinct_in_pieces_that_follow_the_rows(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    want = sorted(map(tuple, star_graph.edges(spark, d).collect()))
    lines = star_graph.table(spark, d, "lineitem").count()
    monkeypatch.setattr(star_graph, "AT_ONCE", 500)
    e = star_graph.edges(spark, d)
    moved = [line for line in _plan(e, True).splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 2 and all(f", {-(-lines // 500)}), REPARTITION_BY_NUM" in line for line in moved)
    assert sorted(map(tuple, e.collect())) == want and len(set(want)) == len(want)
    # no task packs lines before they are dealt
    assert all("Aggregate" not in below.split("FileScan")[0] for below in _plan(e, True).split("Exchange hashpartitioning")[1:])


def test_spectral_terms_are_added_up_and_dropped_as_they_come(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i * 7 % 30}", "e", "t", "t", 1.0) for i in range(1, 30)], KIND + ", weight double")
    kept = adjacency.keep(e)
    degree = kept.ends.groupBy("node_id").agg(F.sum("weight").alias("d"))
    start = spark.createDataFrame([("n1", 1.0, 0.0), ("n2", 0.0, 1.0)], "node_id string, v0 double, v1 double")
    terms = [propagation.chebyshev(f, 20.0, 4) for f in propagation.filters(20.0, 2, True)]
    was = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    found = []
    for fold in (2, 100):
        with tables.few_shuffle_files(spark):
            found.append({r[0]: [round(x, 9) for x in r[1:]] for r in propagation._sums(kept, degree, start, ["v0", "v1"], 20.0, terms, fold).collect()})
    assert found[0] == found[1] and len(found[0]) > 2
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("weft_round_")]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == was


def _shuffled(spark):
    """Records that all stages until now have written to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_spectral_terms_move_no_edges(spark):
    """Terms are made of files: with more of them no more is shuffled."""
    e = spark.createDataFrame([(f"n{i}", f"n{i * 7 % 300}", "e", "t", "t") for i in range(1, 300)], KIND).cache()
    n, src = spark.createDataFrame([(f"n{i}",) for i in range(300)], "node_id string").cache(), spark.createDataFrame([("n1", 0.1), ("n5", 0.9)], "node_id string, x double").cache()
    moved = []
    for order in (4, 4, 12):
        at = _shuffled(spark)
        propagation.spectral_influences(n, e, src, order=order).write.format("noop").mode("overwrite").save()
        moved.append(_shuffled(spark) - at)
    assert 0 < moved[2] <= moved[1] + 50


@pytest.mark.parametrize("heat", [False, True])
def test_blocks_give_what_tables_give(spark, heat, monkeypatch):
    """Parallel edges with weights, loops, ends that are no nodes, nulls, nodes without edges and repeated sources, in three parts;
    and two nodes of one hash, for which another hash is taken."""
    rows = [(f"n{i % 50}", f"n{i * i % 53}", "e", "t", "t", 1.0 + i % 3) for i in range(120)] + [("n1", None, "e", "t", "t", 1.0), (None, "n1", "e", "t", "t", 1.0), ("n3", "n4", "e", "t", "t", None)]
    e = spark.createDataFrame(rows, KIND + ", weight double")
    n = spark.createDataFrame([(f"n{i}",) for i in range(51)] + [("alone",), (None,)], "node_id string")
    src = spark.createDataFrame([("n1", 0.1), ("n1", 0.3), ("n7", 0.3), ("n7", 0.3), ("n52", 0.9), ("alone", 0.5)], "node_id string, x double")
    xs = [0.1, 0.3, 0.5, 0.9]
    real, whole = F.xxhash64, blocks.Blocks.__init__
    monkeypatch.setattr(blocks.F, "xxhash64", lambda *c: real(c[0], F.when(c[0] == 0, F.substring(c[1], 1, 2)).otherwise(F.col(c[1]))) if len(c) == 2 else real(*c))
    monkeypatch.setattr(blocks.Blocks, "__init__", lambda self, a, b: whole(self, a, b, 3))
    terms = lambda top: [propagation.chebyshev(f, top, 5) for f in propagation.filters(top, 2, heat)]
    got, want = ({(r.x, r.node_id, r.distance): r.z for r in way(n, e, src, xs, terms, 0.9, heat, 1e-6).collect()} for way in (propagation._by_blocks, propagation._by_tables))
    assert len(want) > 10 and got == {k: pytest.approx(v, rel=1e-9, abs=1e-12) for k, v in want.items()}


def test_products_of_pairs_that_come_in_pieces(tmp_path, monkeypatch):
    """Tiles of several pieces, and more pairs than are gathered at once."""
    r, sizes = np.random.default_rng(3), (40, 30)
    monkeypatch.setattr(blocks, "NUMBERS", 21)
    whole = np.zeros((70, 70))
    for p, n in enumerate(sizes):
        np.arange(n, dtype=np.int64).tofile(tmp_path / f"nodes.{p}")
    for p, q in ((0, 0), (0, 1), (1, 1)):
        with open(tmp_path / f"tile.{p * 2 + q}", "wb") as f:
            pairs = [(i, j) for i in range(sizes[p]) for j in range(sizes[q]) if (p < q or i < j) and r.random() < 0.2]
            for at in range(0, len(pairs), 50):
                u, v = np.array(pairs[at : at + 50]).T
                w = r.random(len(u))
                for a in (np.array([len(u)], np.int64), u.astype(np.int32), v.astype(np.int32), w):
                    f.write(a.tobytes())
                whole[40 * p + u, 40 * q + v] = whole[40 * q + v, 40 * p + u] = w
    x = r.random((3, 70))
    for p, own in ((0, slice(0, 40)), (1, slice(40, 70))):
        got = blocks._product(str(tmp_path), p, 2, True, 3, lambda q: x[:, :40] if q == 0 else x[:, 40:])
        assert np.allclose(got, x @ whole[:, own])


def test_ends_of_edge_types_are_made_distinct_in_pieces_that_follow_the_edges(spark, monkeypatch):
    pairs = [(f"n{i % 40}", f"m{i % 7}") for i in range(200)] + [(None, "m1"), ("n1", None)]
    e = spark.createDataFrame([(a, b, "e", "t", "u") for a, b in pairs] + [(None, "x", "f", "t", "u")], KIND)
    monkeypatch.setattr(ontology_reports, "AT_ONCE", 20)
    found = ontology_reports.edge_type_details(e)
    assert sorted(tuple(r[c] for c in ("edge_type", "n", "sources", "targets", "type_pairs")) for r in found.collect()) == [("e", 202, 40, 7, 1), ("f", 1, 0, 1, 1)]
    assert [line.split("REPARTITION")[0].rstrip(", )").rsplit(", ", 1)[1] for line in set(_plan(ontology_reports.edge_type_details(e), True).splitlines()) if "REPARTITION_BY_NUM" in line] == ["21"]  # 406 ends


def test_degrees_are_counted_in_pieces_and_bins_of_equal_values(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    want = sorted(tuple(r) for r in graph.degrees(star_graph.edges(spark, d)).collect())
    monkeypatch.setattr(star_graph, "AT_ONCE", 500)
    found = star_graph.degrees(spark, d)
    ends = sum(2 * star_graph.table(spark, d, e.table).count() for e in star_graph.EDGES)
    moved = [line for line in _plan(found, True).splitlines() if "Exchange hashpartitioning" in line]
    # the pairs of lineitem twice, and all ends once
    assert sum(f", {-(-ends // 500)}), REPARTITION_BY_NUM" in line for line in moved) == 1 and len(moved) == 3
    assert sorted(tuple(r) for r in found.select("node_id", "out_degree", "in_degree", "total_degree").collect()) == want
    values = spark.createDataFrame([("a", v) for v in (0, 0, 5, 10, None)] + [("b", 3), ("b", 3)], "t string, v long")
    bins = ontology.histogram(values, "t", "v", 10)
    assert sorted(map(tuple, bins.collect())) == [("a", 0, 2), ("a", 5, 1), ("a", 9, 2), ("b", 0, 2)]
    assert "LocalRelation" not in _plan(bins) and "LogicalRDD" not in _plan(bins)  # of what was written, so that degrees are made once
