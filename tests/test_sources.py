"""Files and ontologies read and written."""

import json

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import channels, methods, search, series, views
from weftgraph.sources import export, files, ingest, semantic

from .test_operators import edges, nodes, rows


def test_folder_graph(spark, tmp_path):
    (tmp_path / "a_b").mkdir()
    for name in ("x_1.txt", "y_2.TXT", "z"):
        (tmp_path / "a_b" / name).write_text("1234")
    found = files.folder_files(spark, str(tmp_path))
    assert {r.size for r in found.collect()} == {4} and found.count() == 3
    n, e = files.folder_graph(found)
    ends = {(r.src.rpartition("/")[2], r.edge_type, r.dst) for r in e.collect()}
    assert {("x_1.txt", "has_size", "file_size:4"), ("y_2.TXT", "has_size", "file_size:4"), ("z", "has_size", "file_size:4"), ("y_2.TXT", "has_type", "file_type:text/plain"), ("z", "has_type", "file_type:unknown"), ("x_1.txt", "has_extension", "extension:txt")} <= ends
    assert ("filename:x_1", "has_component", "component:x") in ends and n.filter("type = 'file_size'").count() == 1


def test_uploads(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,x\n")
    rules = [ingest.ColumnRule("a", "A", "e", "out", 0, "b"), ingest.ColumnRule("b", "B", "e", "out", 1, "central")]
    n, e = files.read_any(spark, str(tmp_path / "t.csv"), rules)
    assert n.count() == 3 and rows(e) == [("A:1", "B:x", "e"), ("A:2", "B:x", "e")]
    for bad in (None, [ingest.ColumnRule("z", "A", "e", "out", 0, "central")]):
        with pytest.raises(ValueError):
            files.read_any(spark, str(tmp_path / "t.csv"), bad)
    (tmp_path / "g.json").write_text(json.dumps({"nodes": {"1": {"type": "t", "value": "v"}, "2": {"type": "t"}}, "edges": {"1_2": {"edge_type": "e"}}}))
    (tmp_path / "j.json").write_text(json.dumps({"a": [1, {"b": None}]}))
    assert files.is_graph_json(str(tmp_path / "g.json")) and not files.is_graph_json(str(tmp_path / "j.json"))
    assert rows(files.read_any(spark, str(tmp_path / "g.json"))[1]) == [("1", "2", "e")]
    assert rows(files.read_any(spark, str(tmp_path / "j.json"))[1]) == [("root", "root.a", "a"), ("root.a", "root.a.0", "0"), ("root.a", "root.a.1", "1"), ("root.a.1", "root.a.1.b", "b")]
    with pytest.raises(ValueError):
        files.read_any(spark, "x.pdf")


def test_names_and_patterns(spark):
    assert files.allowed_file("a.CSV", {"csv"}) and not files.allowed_file("csv", {"csv"}) and files.file_patterns("*.a, b\n\nc*") == ["*.a", "b", "c*"] and files.file_patterns(None) == []
    names = spark.createDataFrame([("A.txt",), ("b.csv",)], "name string")
    assert [r.name for r in names.filter(ingest.pattern_matches(F.col("name"), ["a*"])).collect()] == ["A.txt"] and names.filter(ingest.pattern_matches(F.col("name"), [])).count() == 2


def test_saved_graphs_are_listed(spark, tmp_path):
    export.save(nodes(spark, ["a", "b"]), edges(spark, [("a", "b")]), f"{tmp_path}/g1")
    export.save(nodes(spark, ["a"]), edges(spark, []), f"{tmp_path}/g0")
    assert rows(files.tables(spark, str(tmp_path))) == [("g0", 1, 0), ("g1", 2, 1)]


TTL = '''@prefix : <http://x/o#> .
@prefix owl: <http://www.w3.org/2002/07/owl#> . # a comment; with . signs
@prefix core: <http://x/core#> .
:A a owl:Class ; rdfs:comment "first; of, all. \\"quoted\\""@en , """long
one""" .
<http://x/o#B> rdf:type owl:Class .
:p a owl:ObjectProperty ; rdfs:domain :A ; rdfs:range :C ; .
:q a owl:DatatypeProperty ; rdfs:domain :A ; rdfs:range <http://www.w3.org/2001/XMLSchema#date> ; core:unit "m/s" .
:A core:weight "5"^^xsd:integer .
'''


def test_turtle(spark, tmp_path):
    got = semantic.parse_turtle(TTL)
    assert (":B", "a", "owl:Class") in got and (":A", "rdfs:comment", '"first; of, all. \\"quoted\\""@en') in got and (":q", "rdfs:range", "xsd:date") in got and len(got) == 13 - 1
    with pytest.raises(ValueError):
        semantic.parse_turtle(":a :b [ :c :d ] .")
    (tmp_path / "o.ttl").write_text(TTL)
    t = semantic.read_turtle(spark, str(tmp_path / "o.ttl"))
    assert t.count() == len(got)
    n, e, notes = semantic.turtle_graph(t)
    kinds = {r.node_id: r.type for r in n.collect()}
    assert kinds[":A"] == kinds[":B"] == "Class" and kinds[":C"] == "ImpliedClass" and kinds["xsd:date"] == kinds["xsd:string"] == "Primitive"
    assert rows(e) == [(":A", ":C", ":p", "object"), (":A", "xsd:date", ":q", "datatype")] and rows(notes) == [(":A", "core:weight", "5"), (":q", "core:unit", "m/s")]


def test_ontology_json(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"node_types": {"A": {"count": 3, "properties": ["p"]}, "B": {}}, "relationships": [{"source_type": "A", "edge_type": "e", "target_type": "B", "count": 2}]}))
    t, r = semantic.read_ontology_json(spark, str(tmp_path / "o.json"))
    assert [(x.type, x.n, x.properties) for x in t.orderBy("type").collect()] == [("A", 3, ["p"]), ("B", 0, [])] and rows(r) == [("A", "e", "B", 2)]


def test_turbofan_graph(spark, tmp_path):
    line = " ".join(str(i) for i in range(26))
    (tmp_path / "t.txt").write_text("\n".join(f"1 {c} {line.split(' ', 2)[2]}" for c in range(1, 13)) + "\n\n")
    df = ingest.read_turbofan(spark, str(tmp_path / "t.txt"))
    assert df.count() == 12 and len(ingest.SENSORS) == 21 and rows(ingest.first_rows(df, 1, 3, 2).select("time_cycles")) == [(1,), (2,)]
    n, e = ingest.turbofan_graph(df, spark.createDataFrame([(1, 9)], "unit_number int, rul int"))
    count = {r.edge_type: r["count"] for r in e.groupBy("edge_type").count().collect()}
    assert count == {"has_sensor": 21, "has_operational_setting": 3, "produces_measurement": 42, "produces_setting_value": 6, "has_rul_prediction": 1}
    assert n.filter("type = 'rul_predictor'").first().value == "9" and n.select("node_id").distinct().count() == n.count() == 1 + 24 + 48 + 1


def test_methods_register_once_and_run(spark):
    with pytest.raises(ValueError):
        methods.method("FileExtension")(lambda n, e: None)
    with pytest.raises(ValueError):
        methods.run("Nothing", nodes(spark, []), edges(spark, []))
    n, e = methods.run("FileExtension", nodes(spark, ["a"]), edges(spark, [("a", "b")]))
    assert n.count() == 1 and e.count() == 1  # nothing to do adds nothing
    assert methods.run_process(["Nothing", "FileExtension"], nodes(spark, ["a"]), edges(spark, []))[2] == [("Nothing", "unknown"), ("FileExtension", "done")]


def test_channels(spark):
    found = spark.createDataFrame([("A01", "CANDU"), ("B12", "CANDU"), ("I05", "CANDU"), ("B25", "CANDU"), ("0878", "AGR"), ("0979", "AGR"), ("X7", "z"), ("8", "z"), ("none", "z")], "channel_id string, reactor string")
    got = {r.channel_id: (r.x, r.y, r.sector, r.assembly_x) for r in channels.positions(found).collect()}
    assert got == {"A01": (0, 0, "NW", None), "B12": (11, 1, "NW", None), "0878": (38, 3, None, 5), "X7": (6, 23, None, None), "8": (0, 2, None, None)}
    v = {r.channel_id: (r.valid, r.anomalies) for r in channels.validated(spark.createDataFrame([("A01",), ("B12",), ("Z99",), (None,)], "channel_id string"), "CANDU").collect()}
    assert v == {"A01": (False, ["excluded_position"]), "B12": (True, []), "Z99": (False, ["pattern_mismatch", "number_out_of_range"]), None: (False, ["missing_identifier"])}
    assert channels.validated(found, "z").filter("valid").count() == 8


def test_no_channels_are_no_reactor(spark):
    n, e = nodes(spark, ["a"]), edges(spark, [])
    got = channels.evidence(n, e).collect()
    assert {(r.pattern, r.grid, r.keyword, r.structure) for r in got} == {(0.0, 0.0, 0.0, 0.5)} and channels.reactor_type(channels.evidence(n, e)).count() == 0


def test_sorting_puts_what_is_missing_last(spark):
    p = spark.createDataFrame([("a", "t", "k", "2", 2.0), ("b", "t", "k", "1", 1.0)], "node_id string, type string, prop string, s_val string, d_val double")
    order = lambda **how: [r.node_id for r in views.sorted_by(nodes(spark, ["a", "b", "c"]), edges(spark, []), p, **how).orderBy("place").collect()]
    assert order(how="property", prop="k") == ["b", "a", "c"] and order(how="property", prop="k", reverse=True) == ["a", "b", "c"] and order(how="name", reverse=True) == ["c", "b", "a"]
    with pytest.raises(ValueError):
        order(how="luck")


def test_overlaps_are_strict_and_found_in_any_bucket(spark):
    spans = [("a", 0, 10), ("b", 10, 20), ("c", 3, 4), ("d", 9, 25), ("e", 5, 5), ("f", -7, 1)]
    df = spark.createDataFrame(spans, "asset string, created long, destroyed long")
    want = sorted((x, y, max(a, c), min(b, d), min(b, d) - max(a, c)) for x, a, b in spans for y, c, d in spans if x < y and max(a, c) < min(b, d))
    for width in (1, 4, 100):
        assert rows(series.overlaps(df, width)) == want


def test_commands(spark, tmp_path):
    n, e = nodes(spark, ["a", "b"]), edges(spark, [("a", "b")])
    texts = n.select(F.col("node_id").alias("id"), F.concat(F.lit("type: t | value: "), "value").alias("text"))
    ask = lambda line: [tuple(r) for r in search.command(line, n, e, texts, texts.limit(0)).collect()]
    assert ("methods", "instances of methods") in ask("help") and ask("nodes t") == [("t", "2")] and ask("connections a") == [("b", "true")]
    assert ask("validations") == [("INFORMATIONAL", "2")] and ask("warnings") == ask("methods") == ask("timeline") == ask("insights") == ask("method x") == []
    assert ("a", "0.99") in ask("search a") and ("b", "0.7") in ask("a")
    d = search.details(spark.createDataFrame([(1, "type: t | value: x y | seen 2024-01-02 03:04 | location: here")], "id int, text string")).first()
    assert (d.type, d.value, d.date, d.location, d.relation) == ("t", "x y", "2024-01-02 03:04", "here", None)
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "id string, embedding array<double>")
    search.save_vectors(v, str(tmp_path), "g")
    assert rows(search.vectors_info(search.kept_vectors(spark, str(tmp_path), "g"))) == [(2, 2, 2)]
    found = search.search(n, e, texts, texts.limit(0), "nothing like it", v, [0.0, 1.0])
    assert [(r.tier, r.id, r.similarity) for r in found.collect()] == [("semantic", "b", 1.0)]


def test_graph_lines_are_packed(spark, tmp_path):
    e = spark.range(20_000).selectExpr("'customer:' || id AS src", "'order:' || id AS dst", "'placed' AS edge_type", "'customer' AS src_type", "'order' AS dst_type")
    n = spark.createDataFrame([("a", "t", "v")], "node_id string, type string, value string")
    export.save_graph_lines(n, e, f"{tmp_path}/g.jsonl")
    _, more = ingest.read_graph_lines(spark, f"{tmp_path}/g.jsonl")
    assert more.count() == 20_000 and more.filter("substring(src, 10) = substring(dst, 7) AND attrs['dst_type'] = 'order'").count() == 20_000
    assert sum(f.stat().st_size for f in (tmp_path / "g.jsonl").glob("part-*")) < 20_000 * 30  # a line has some 110 bytes


def test_graph_lines_there_and_back(spark, tmp_path):
    n = spark.createDataFrame([("a", "t", 'v "x"\n', 1), ("b", None, None, None)], "node_id string, type string, value string, level int")
    e = spark.createDataFrame([("a", "b", "e", 0.5)], "src string, dst string, edge_type string, weight double")
    export.save_graph_lines(n, e, f"{tmp_path}/g.jsonl")
    (tmp_path / "g.jsonl" / "odd.txt").write_text("no object\n[1]\n{}\n")
    got, more = ingest.read_graph_lines(spark, f"{tmp_path}/g.jsonl")
    assert {r.node_id: (r.type, r.value, r.attrs.get("level")) for r in got.collect()} == {"a": ("t", 'v "x"\n', "1"), "b": (None, None, None)}
    assert [(r.src, r.dst, r.edge_type, r.attrs["weight"]) for r in more.collect()] == [("a", "b", "e", "0.5")]
    nodes, edges = files.read_any(spark, f"{tmp_path}/g.jsonl")
    assert nodes.columns == ["node_id", "type", "value"] and edges.count() == 1
