"""Tables as a property graph: nodes(node_id, type, value, hierarchy), edges(src, dst, edge_type, src_type, dst_type) and
props(node_id, type, prop, s_val, d_val), one row per present property.

Ids are `type:key`, so no join or counter is needed to make them, and every frame is a union of projections: filters on a
type or an edge type prune whole tables, and only columns in use are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import in_pieces


@dataclass(frozen=True)
class NodeSource:
    """A table whose rows are nodes. value: a column; props: numeric and text property columns."""

    table: str
    type: str
    key: str
    value: str
    hierarchy: int
    numbers: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()


@dataclass(frozen=True)
class EdgeSource:
    """A table whose rows are edges between the nodes that two of its columns name."""

    table: str
    edge_type: str
    src: tuple[str, str]
    dst: tuple[str, str]
    repeats: bool = False


NODES = (
    NodeSource("region", "region", "r_regionkey", "r_name", 0),
    NodeSource("nation", "nation", "n_nationkey", "n_name", 1),
    NodeSource("customer", "customer", "c_custkey", "c_name", 2, ("c_acctbal",), ("c_mktsegment",)),
    NodeSource("supplier", "supplier", "s_suppkey", "s_name", 3, ("s_acctbal",), ()),
    NodeSource("orders", "order", "o_orderkey", "o_orderkey", 3, ("o_totalprice",), ("o_orderstatus", "o_orderpriority")),
    NodeSource("part", "part", "p_partkey", "p_name", 4, ("p_size", "p_retailprice"), ("p_brand", "p_type")),
)
EDGES = (
    EdgeSource("nation", "in_region", ("nation", "n_nationkey"), ("region", "n_regionkey")),
    EdgeSource("customer", "in_nation", ("customer", "c_custkey"), ("nation", "c_nationkey")),
    EdgeSource("supplier", "in_nation", ("supplier", "s_suppkey"), ("nation", "s_nationkey")),
    EdgeSource("orders", "placed", ("customer", "o_custkey"), ("order", "o_orderkey")),
    EdgeSource("lineitem", "contains", ("order", "l_orderkey"), ("part", "l_partkey"), True),
    EdgeSource("lineitem", "supplies", ("supplier", "l_suppkey"), ("part", "l_partkey"), True),
)


#: Rows that are made distinct in one task, which holds them.
AT_ONCE = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union([table(spark, sf_dir, n.table).select(node_id(n.type, F.col(n.key)).alias("node_id"), F.lit(n.type).alias("type"), F.col(n.value).cast("string").alias("value"), F.lit(n.hierarchy).alias("hierarchy")) for n in NODES])


def distinct_pairs(keys: DataFrame, rows: int) -> DataFrame:
    """keys.distinct() of a table of `rows` rows, in pieces of AT_ONCE."""
    return in_pieces(keys, rows, AT_ONCE, *keys.columns).distinct()


def _rows(spark: SparkSession, sf_dir: str, chosen: list[EdgeSource]) -> dict[str, int]:
    """How many rows the tables with repeated edges have, by the files' footers."""
    return {name: table(spark, sf_dir, name).count() for name in {e.table for e in chosen if e.repeats}}


def edges(spark: SparkSession, sf_dir: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """Distinct edges; `types` keeps the tables of other edge types from being read."""
    found = []
    rows = _rows(spark, sf_dir, [e for e in EDGES if types is None or e.edge_type in types])
    for e in EDGES:
        if types is None or e.edge_type in types:
            keys = table(spark, sf_dir, e.table).select(F.col(e.src[1]).alias("s"), F.col(e.dst[1]).alias("d")).dropna()
            keys = distinct_pairs(keys, rows[e.table]) if e.repeats else keys  # on the keys, before text ids are made
            found.append(_named(keys, e))
    return union(found)


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id) of the edges' ends, on the tables' own keys, each once a column: pairs needn't be distinct for it."""
    found = []
    rows = _rows(spark, sf_dir, list(EDGES))
    for t, a, b in dict.fromkeys((e.table, e.src, e.dst) for e in EDGES):
        both = table(spark, sf_dir, t).select(F.col(a[1]).alias("s"), F.col(b[1]).alias("d")).dropna()
        for kind, k in ((a[0], "s"), (b[0], "d")):
            keys = both.select(k)
            found.append((distinct_pairs(keys, rows[t]) if t in rows else keys.distinct()).select(node_id(kind, F.col(k)).alias("node_id")))
    return union(found)


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per property of a node; numbers also as double, text without d_val."""
    found = []
    for n in NODES:
        if n.numbers or n.texts:
            both = [F.struct(F.lit(c).alias("prop"), F.col(c).cast("string").alias("s_val"), (F.col(c).cast("double") if c in n.numbers else F.lit(None).cast("double")).alias("d_val")) for c in (*n.numbers, *n.texts)]
            rows = table(spark, sf_dir, n.table).select(node_id(n.type, F.col(n.key)).alias("node_id"), F.lit(n.type).alias("type"), F.explode(F.array(*both)).alias("p"))
            found.append(rows.select("node_id", "type", "p.prop", "p.s_val", "p.d_val").filter("s_val IS NOT NULL"))
    return union(found)


#: Columns that are properties of edges: (table, edge type, source, target, place among edges of equal ends, numbers, texts).
EDGE_PROPS = (("lineitem", "contains", ("order", "l_orderkey"), ("part", "l_partkey"), "l_linenumber", ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), ("l_returnflag", "l_linestatus")),)


def edge_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_id, edge_type, prop, s_val, d_val): one row per property of an edge, of each of several edges of equal ends."""
    found = []
    for t, kind, a, b, place, numbers, texts in EDGE_PROPS:
        both = [F.struct(F.lit(c).alias("prop"), F.col(c).cast("string").alias("s_val"), (F.col(c).cast("double") if c in numbers else F.lit(None).cast("double")).alias("d_val")) for c in (*numbers, *texts)]
        own = F.concat_ws(" ", node_id(a[0], F.col(a[1])), F.lit(kind), node_id(b[0], F.col(b[1])), F.col(place).cast("string"))
        rows = table(spark, sf_dir, t).select(own.alias("edge_id"), F.lit(kind).alias("edge_type"), F.explode(F.array(*both)).alias("p"))
        found.append(rows.select("edge_id", "edge_type", "p.prop", "p.s_val", "p.d_val").filter("s_val IS NOT NULL"))
    return union(found)


def edge_props_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{a[0]}:' || {a[1]} || ' {kind} {b[0]}:' || {b[1]} || ' ' || {place} AS node_id, '{kind}' AS type, '{c}' AS prop, CAST({c} AS VARCHAR) AS s_val, {c + '::DOUBLE' if c in numbers else 'CAST(NULL AS DOUBLE)'} AS d_val FROM {t} WHERE {c} IS NOT NULL"
        for t, kind, a, b, place, numbers, texts in EDGE_PROPS
        for c in (*numbers, *texts)
    )


# --- by key: filters and counts on the tables' own keys, before ids are made of them


def _key(df: DataFrame, column: str, text: str) -> Column | None:
    """column = text in the column's own type, which a scan can take over; None if no key reads like that."""
    kind = df.schema[column].dataType.simpleString()
    if kind in ("int", "bigint", "smallint"):
        return F.col(column) == int(text) if text.lstrip("-").isdigit() and str(int(text)) == text else None
    return F.col(column) == text


def edges_at(spark: SparkSession, sf_dir: str, node: str) -> DataFrame:
    """The distinct edges at one node. Only tables with edges at its type are read, with its key as a filter on the scan."""
    kind, _, key = node.partition(":")
    found = []
    for e in EDGES:
        t = table(spark, sf_dir, e.table).select(F.col(e.src[1]).alias("s"), F.col(e.dst[1]).alias("d"))
        keep = [c for c in (_key(t, "s", key) if e.src[0] == kind else None, _key(t, "d", key) if e.dst[0] == kind else None) if c is not None]
        if keep:
            keys = t.filter(reduce(lambda a, b: a | b, keep)).dropna()
            found.append(_named(keys.distinct() if e.repeats else keys, e))
    return union(found) if found else edges(spark, sf_dir, (EDGES[0].edge_type,)).limit(0)


def _named(keys: DataFrame, e: EdgeSource, *more: str) -> DataFrame:
    return keys.select(node_id(e.src[0], F.col("s")).alias("src"), node_id(e.dst[0], F.col("d")).alias("dst"), F.lit(e.edge_type).alias("edge_type"), F.lit(e.src[0]).alias("src_type"), F.lit(e.dst[0]).alias("dst_type"), *more)


def _pairs(spark: SparkSession, sf_dir: str, e: EdgeSource) -> DataFrame:
    t = table(spark, sf_dir, e.table)
    keys = t.select(F.col(e.src[1]).cast("long").alias("s"), F.col(e.dst[1]).cast("long").alias("d")).dropna()
    return distinct_pairs(keys, t.count()) if e.repeats else keys


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, type, out_degree, in_degree, total_degree) on numeric keys. No two types have more than one kind of edge
    between them, which is checked, so that different edges lead to different neighbours and counts of each kind add up."""
    ends = [frozenset((e.src[0], e.dst[0])) for e in EDGES]
    if len(set(ends)) < len(ends) or any(e.src[0] == e.dst[0] for e in EDGES):
        raise ValueError("neighbours could be counted twice")
    kinds = list(dict.fromkeys(end for e in EDGES for end in (e.src[0], e.dst[0])))
    found, rows = [], 0
    for e in EDGES:
        rows += 2 * table(spark, sf_dir, e.table).count()  # by the files' footers
        one = [F.struct(F.lit(kinds.index(kind)).alias("t"), F.col(k).alias("k"), F.lit(o).cast("long").alias("o"), F.lit(1 - o).cast("long").alias("i")) for (kind, _), k, o in ((e.src, "s", 1), (e.dst, "d", 0))]
        found.append(_pairs(spark, sf_dir, e).select(F.explode(F.array(*one)).alias("x")).select("x.*"))
    # both ends of a pair at once, so that pairs are made once, and in pieces that follow the rows
    g = in_pieces(union(found), rows, AT_ONCE, "t", "k").groupBy("t", "k").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    g = g.withColumn("type", F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("t") + 1))
    return g.select(F.concat_ws(":", "type", F.col("k").cast("string")).alias("node_id"), "type", "out_degree", "in_degree", (F.col("out_degree") + F.col("in_degree")).alias("total_degree"))


def cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per relationship the greatest and mean numbers of targets per source and sources per target, on numeric keys."""
    found = []
    for e in EDGES:
        p = _pairs(spark, sf_dir, e)
        out = p.groupBy("s").agg(F.count("*").alias("c")).agg(F.max("c").alias("out_max"), F.round(F.avg("c"), 6).alias("out_avg"))
        into = p.groupBy("d").agg(F.count("*").alias("c")).agg(F.max("c").alias("in_max"), F.round(F.avg("c"), 6).alias("in_avg"))
        found.append(out.crossJoin(into).select(F.lit(e.src[0]).alias("src_type"), F.lit(e.edge_type).alias("edge_type"), F.lit(e.dst[0]).alias("dst_type"), "out_max", "out_avg", "in_max", "in_avg"))  # one row each
    o, i = F.col("out_max") <= 1, F.col("in_max") <= 1
    return union(found).filter("out_max IS NOT NULL").withColumn("cardinality", F.when(o & i, "one-to-one").when(o, "one-to-many").when(i, "many-to-one").otherwise("many-to-many"))


def edge_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges whose ends are nodes, with src_value and dst_value, on the tables' own keys: what is moved to the nodes is two
    keys, and text ids are made of them afterwards. Distinct pairs are found where their sources are."""
    of = {n.type: n for n in NODES}
    found = []
    for e in EDGES:
        keys = table(spark, sf_dir, e.table).select(F.col(e.src[1]).alias("s"), F.col(e.dst[1]).alias("d")).dropna()
        keys = keys.repartition("s").distinct() if e.repeats else keys
        for (kind, _), key, value in ((e.src, "s", "src_value"), (e.dst, "d", "dst_value")):
            n = of[kind]
            keys = keys.join(table(spark, sf_dir, n.table).select(F.col(n.key).alias(key), F.col(n.value).cast("string").alias(value)), key)
        found.append(_named(keys, e, "src_value", "dst_value"))
    return union(found)


# --- the same three relations as SQL, for oracles


def nodes_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{n.type}:' || {n.key} AS node_id, '{n.type}' AS type, CAST({n.value} AS VARCHAR) AS value, {n.hierarchy} AS hierarchy FROM {n.table}" for n in NODES)


def edges_sql() -> str:
    return " UNION ALL ".join(f"SELECT DISTINCT '{e.src[0]}:' || {e.src[1]} AS src, '{e.dst[0]}:' || {e.dst[1]} AS dst, '{e.edge_type}' AS edge_type, '{e.src[0]}' AS src_type, '{e.dst[0]}' AS dst_type FROM {e.table} WHERE {e.src[1]} IS NOT NULL AND {e.dst[1]} IS NOT NULL" for e in EDGES)


def props_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{n.type}:' || {n.key} AS node_id, '{n.type}' AS type, '{c}' AS prop, {c + ' AS s_val, CAST(NULL AS DOUBLE)' if c in n.texts else 'CAST(' + c + ' AS VARCHAR) AS s_val, CAST(' + c + ' AS DOUBLE)'} AS d_val FROM {n.table} WHERE {c} IS NOT NULL"
        for n in NODES
        for c in (*n.numbers, *n.texts)
    )


def graph_sql(body: str) -> str:
    """body over the relations n, e and p."""
    return f"WITH n AS ({nodes_sql()}), e AS ({edges_sql()}), p AS ({props_sql()}) {body}"
