"""Readers that turn tables, paths, JSON trees and sensor text into graph frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import binary_round
from ..operators.tables import materialise
from .star_graph import union


@dataclass(frozen=True)
class ColumnRule:
    """How a column becomes nodes and edges. connects_to: another column, or 'central' for no edge; direction: 'out' runs
    from this column's node, anything else to it."""

    column: str
    node_type: str
    edge_type: str
    direction: str
    hierarchy_level: int
    connects_to: str


def validate(rules: list[ColumnRule], columns: list[str]) -> list[str]:
    """What is wrong with the rules, in words; empty if nothing is."""
    said = [f"{f} of rule {i} is missing" for i, r in enumerate(rules) for f in ("column", "node_type", "edge_type", "direction", "connects_to") if getattr(r, f) in (None, "")]
    said += [f"hierarchy_level of rule {i} is missing" for i, r in enumerate(rules) if r.hierarchy_level is None]
    said += [f"column {r.column} isn't in the table" for r in rules if r.column not in columns]
    known = {r.column for r in rules}
    return said + [f"column {r.column} connects to {r.connects_to}, which has no rule" for r in rules if r.connects_to != "central" and r.connects_to not in known]


def frame_nodes(df: DataFrame, rules: list[ColumnRule]) -> DataFrame:
    """A node per distinct non-null value of each column; one scan, values unpivoted before the distinct."""
    each = F.array(*[F.struct(F.lit(r.node_type).alias("type"), F.col(r.column).cast("string").alias("value"), F.lit(r.hierarchy_level).alias("hierarchy")) for r in rules])
    rows = df.select(F.explode(each).alias("x")).select("x.*").filter("value IS NOT NULL").distinct()
    return rows.select(F.concat_ws(":", "type", "value").alias("node_id"), "type", "value", "hierarchy")


def frame_edges(df: DataFrame, rules: list[ColumnRule]) -> DataFrame:
    """Edges between the values of a row; of the edges of an ordered pair the rule listed first stays."""
    kind = {r.column: r.node_type for r in rules}
    each = []
    for i, r in enumerate(rules):
        if r.connects_to != "central":
            own, other = (F.concat(F.lit(f"{kind[c]}:"), F.col(c).cast("string")) for c in (r.column, r.connects_to))
            src, dst = (own, other) if r.direction == "out" else (other, own)
            each.append(F.struct(src.alias("src"), dst.alias("dst"), F.lit(i).alias("rule"), F.lit(r.edge_type).alias("edge_type")))
    rows = df.select(F.explode(F.array(*each)).alias("x")).select("x.*").dropna()
    first = rows.groupBy("src", "dst").agg(F.min(F.struct("rule", "edge_type")).alias("x"))
    return first.select("src", "dst", "x.edge_type")


# --- paths

DELIMITERS = ("_", "-", ".", " ")


def path_nodes(paths: DataFrame, column: str = "path") -> DataFrame:
    """A folder node for each prefix of each path and a file node for each whole one, with its depth."""
    parts = F.filter(F.split(F.col(column), "/"), lambda x: x != "")
    rows = paths.select(parts.alias("parts")).filter(F.size("parts") > 0).select("parts", F.posexplode("parts").alias("i", "name"))
    rows = rows.select(F.array_join(F.slice("parts", 1, F.col("i") + 1), "/").alias("node_id"), F.when(F.col("i") + 1 == F.size("parts"), "file").otherwise("folder").alias("type"), "name", F.col("i").alias("depth"))
    # a path that is a prefix of another one is a folder
    return rows.groupBy("node_id", "name", "depth").agg(F.max("type").alias("type"))


def path_edges(paths: DataFrame, column: str = "path") -> DataFrame:
    n = path_nodes(paths, column).filter("depth > 0")
    return n.select(F.regexp_replace("node_id", "/[^/]*$", "").alias("src"), F.col("node_id").alias("dst"), F.lit("contains").alias("edge_type"))


def delimiters(names: DataFrame, least: float = 0.2) -> DataFrame:
    """(depth, name) -> which delimiters are active at each depth: those in at least that share of its distinct names."""
    each = F.array(*[F.struct(F.lit(d).alias("delimiter"), F.contains("name", F.lit(d)).cast("int").alias("has")) for d in DELIMITERS])
    rows = names.select("depth", "name").distinct().select("depth", F.explode(each).alias("x"))
    return rows.groupBy("depth", "x.delimiter").agg(F.sum("x.has").cast("long").alias("n_with"), F.count("*").alias("n_names")).filter(F.col("n_with") >= least * F.col("n_names"))


def path_components(paths: DataFrame, column: str = "path", least: float = 0.2) -> DataFrame:
    """Tokens of each name, split by the delimiters active at its depth: (node_id, component)."""
    n = path_nodes(paths, column)
    active = delimiters(n, least).groupBy("depth").agg(F.array_join(F.array_sort(F.collect_set("delimiter")), "").alias("set"))  # a row per depth
    joined = n.join(F.broadcast(active), "depth", "left")
    one = lambda d: F.contains(F.coalesce(F.col("set"), F.lit("")), F.lit(d))
    text: Column = F.col("name")
    for d in DELIMITERS:
        text = F.when(one(d), F.replace(text, F.lit(d), F.lit("\u0001"))).otherwise(text)
    return joined.select("node_id", F.explode(F.filter(F.split(text, "\u0001"), lambda x: x != "")).alias("component")).distinct()


# --- sensor text

TURBOFAN = "unit_number time_cycles setting_1 setting_2 setting_3 T2 T24 T30 T50 P2 P15 P30 Nf Nc epr Ps30 phi NRf NRc BPR farB htBleed Nf_dmd PCNfR_dmd W31 W32".split()


def read_turbofan(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated numbers under their 26 names."""
    x = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "").select(x.alias("x"))
    return rows.select(*[F.get("x", i).cast("int" if i < 2 else "double").alias(c) for i, c in enumerate(TURBOFAN)])


def turbofan_measurements(df: DataFrame) -> DataFrame:
    """(unit_number, time_cycles, sensor, value), one row per reading."""
    return df.unpivot(["unit_number", "time_cycles"], TURBOFAN[5:], "sensor", "value")


def first_rows(df: DataFrame, units: int, cycles: int, rows: int) -> DataFrame:
    return df.filter((F.col("unit_number") <= units) & (F.col("time_cycles") <= cycles)).orderBy("unit_number", "time_cycles").limit(rows)


def every_second(df: DataFrame, key: str, order: list[str], long: int = 100) -> DataFrame:
    """Rows of keys with more than `long` rows, every second one; all rows of the others."""
    w = W.partitionBy(key)
    marked = df.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(*order)))
    return marked.filter((F.col("_n") <= long) | (F.col("_i") % 2 == 1)).drop("_n", "_i")


def read_rul(spark: SparkSession, path: str) -> DataFrame:
    """One value per line; the unit is the line's number. The file has a line per unit and is read as one."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\r?\n")).alias("i", "x"))
    return lines.select((F.col("i") + 1).alias("unit_number"), F.trim("x").cast("int").alias("rul"))


# --- graph JSON and JSON trees


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """{"nodes": {id: attributes}, "edges": {"src_dst": attributes}}. An edge's ends are its attributes source and target, if it
    has them; else its key is cut at its first underscore."""
    raw = spark.read.text(path, wholetext=True)
    kind = "nodes map<string,map<string,string>>, edges map<string,map<string,string>>"
    x = raw.select(F.from_json("value", kind).alias("x"))
    n = x.select(F.explode("x.nodes").alias("node_id", "attrs")).select("node_id", F.col("attrs")["type"].alias("type"), F.col("attrs")["value"].alias("value"), "attrs")
    e = x.select(F.explode("x.edges").alias("k", "attrs")).select(F.coalesce(F.col("attrs")["source"], F.substring_index("k", "_", 1)).alias("src"), F.coalesce(F.col("attrs")["target"], F.regexp_replace("k", "^[^_]*_", "")).alias("dst"), F.col("attrs")["edge_type"].alias("edge_type"), "attrs")
    return n, e


def read_graph_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as read_graph_json() has them, of the lines that `export.save_graph_lines` writes: files are split at lines,
    and no row holds more than a node or an edge. Lines that are no objects, or of no part, are left out."""
    x = spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("a"))
    own = lambda *names: F.map_filter("a", lambda k, v: ~k.isin("part", *names))
    n = x.filter(F.col("a")["part"] == "nodes").select(*[F.col("a")[c].alias(c) for c in ("node_id", "type", "value")], own("node_id").alias("attrs"))
    e = x.filter(F.col("a")["part"] == "edges").select(*[F.col("a")[c].alias(c) for c in ("src", "dst", "edge_type")], own("src", "dst").alias("attrs"))
    return n, e


def json_nodes(df: DataFrame, column: str) -> DataFrame:
    """(doc, path, type, value) of each value in JSON texts, however deep, containers without value; `doc` is kept from df.
    Each level is one generator over the level above, which is written, and the last is the one without rows."""
    spark, now, found = df.sparkSession, df.select("doc", F.lit("root").alias("path"), F.try_parse_json(column).alias("v")), []
    while True:
        now = materialise(now.filter("v IS NOT NULL"))
        if found and now.isEmpty():
            return union(found)
        kind = F.schema_of_variant("v")
        named = F.when(kind.startswith("OBJECT"), "dict").when(kind.startswith("ARRAY"), "list").when(kind == "STRING", "str").when(kind == "BIGINT", "int").when(kind == "BOOLEAN", "bool").when(kind == "VOID", "NoneType").otherwise("float")
        found.append(now.select("doc", "path", named.alias("type"), F.when(~named.isin("dict", "list", "NoneType"), F.col("v").cast("string")).alias("value")))
        now = spark.sql("SELECT doc, path || '.' || coalesce(key, cast(pos AS string)) AS path, value AS v FROM {d}, LATERAL variant_explode(v)", d=now)


def pattern_matches(name: Column, patterns: list[str]) -> Column:
    """Whether a name matches one of the glob patterns, ignoring case; no patterns match every name."""
    found = F.lit(not patterns)
    for p in patterns:
        body = "".join(".*" if c == "*" else "\\" + c if not c.isalnum() else c for c in p)
        found = found | name.rlike(f"(?i)^{body}$")
    return found


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def json_edges(tree: DataFrame) -> DataFrame:
    """json_nodes() -> (doc, src, dst, edge_type): each value hangs from its container by its key or place; the document from
    the root by `root`."""
    parent, key = F.regexp_replace("path", r"\.[^.]*$", ""), F.regexp_extract("path", r"\.([^.]*)$", 1)
    return tree.filter("path <> 'root'").select("doc", parent.alias("src"), F.col("path").alias("dst"), key.alias("edge_type"))


# --- turbofan graphs

#: The sensors' types and units.
SENSORS = {
    "T2": ("temperature_sensor", "°R"), "T24": ("temperature_sensor", "°R"), "T30": ("temperature_sensor", "°R"), "T50": ("temperature_sensor", "°R"),
    "P2": ("pressure_sensor", "psia"), "P15": ("pressure_sensor", "psia"), "P30": ("pressure_sensor", "psia"), "Ps30": ("pressure_sensor", "psia"),
    "Nf": ("speed_sensor", "rpm"), "Nc": ("speed_sensor", "rpm"), "NRf": ("speed_sensor", "rpm"), "NRc": ("speed_sensor", "rpm"), "Nf_dmd": ("speed_sensor", "rpm"),
    "epr": ("ratio_sensor", "ratio"), "BPR": ("ratio_sensor", "ratio"), "PCNfR_dmd": ("ratio_sensor", "ratio"),
    "W31": ("flow_sensor", "lbm/s"), "W32": ("flow_sensor", "lbm/s"), "phi": ("flow_sensor", "pps"), "farB": ("flow_sensor", "ratio"), "htBleed": ("bleed_sensor", "lbm/s"),
}
SETTINGS = ("setting_1", "setting_2", "setting_3")


def turbofan_graph(df: DataFrame, rul: DataFrame | None = None, sensors: tuple[str, ...] = tuple(SENSORS), chunk: int = 10) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of read_turbofan(): engines, their sensors and settings, runs of `chunk` readings of each, and with
    rul(unit_number, rul) a prediction per engine; has_sensor, has_operational_setting, produces_measurement,
    produces_setting_value, has_rul_prediction. Series are unpivoted in one scan."""
    engine = F.concat(F.lit("Engine_"), F.col("unit_number").cast("string"))
    long = df.unpivot(["unit_number", "time_cycles"], [*sensors, *SETTINGS], "name", "reading").filter("reading IS NOT NULL")
    w = W.partitionBy("unit_number", "name").orderBy("time_cycles")
    runs = long.withColumn("run", F.floor((F.row_number().over(w) - 1) / chunk)).groupBy("unit_number", "name", "run").agg(F.count("*").alias("n"), F.avg("reading").alias("mean"), F.min("time_cycles").alias("a"), F.max("time_cycles").alias("b"))
    is_setting = F.col("name").startswith("setting_")
    kind = F.element_at(F.create_map(*[F.lit(x) for k, (t, _) in SENSORS.items() for x in (k, t)]), F.col("name"))
    unit = F.element_at(F.create_map(*[F.lit(x) for k, (_, u) in SENSORS.items() for x in (k, u)]), F.col("name"))
    stream = F.concat(engine, F.lit("_"), F.col("name"), F.when(is_setting, F.lit("")).otherwise("_Sensor"))
    streams = runs.select("unit_number", "name").distinct()
    n = df.select(engine.alias("node_id"), F.lit("turbofan_engine").alias("type"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("unit")).distinct()
    n = n.union(streams.select(stream, F.when(is_setting, "operational_setting").otherwise(kind), F.col("name"), unit))
    measure = F.concat(stream, F.lit("_"), F.col("run").cast("string"))
    n = n.union(runs.select(measure, F.when(is_setting, "setting_value").otherwise("measurement_sequence"), binary_round(F.col("mean"), 6).cast("string"), unit))
    e = streams.select(engine.alias("src"), F.when(is_setting, "has_operational_setting").otherwise("has_sensor").alias("edge_type"), stream.alias("dst"))
    e = e.union(runs.select(stream, F.when(is_setting, "produces_setting_value").otherwise("produces_measurement"), measure))
    if rul is not None:
        last = df.groupBy("unit_number").agg(F.max("time_cycles").alias("cycle")).join(rul, "unit_number")
        predictor = F.concat(engine, F.lit("_RUL_Predictor"))
        n = n.union(last.select(predictor, F.lit("rul_predictor"), F.col("rul").cast("string"), F.lit("cycles")))
        e = e.union(last.select(engine, F.lit("has_rul_prediction"), predictor))
    return n, e
