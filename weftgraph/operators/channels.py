"""Reactor channels in a graph: evidence for a reactor type, positions, validation, and the core's view of channels.

Nodes are (node_id, type, value), edges (src, dst, ...). Channels, reactor types and checks are small tables beside the graph;
whatever scales with the graph is a filter, a join by id or an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .enrich import EXCLUDED, FOUR_DIGITS, GRID_HEIGHT, GRID_WIDTH, LETTER_CHANNEL, ROW_LETTERS
from .graph import both_ways

#: Patterns, grids, excluded positions, keywords and usual numbers of channels of each reactor type.
SIGNATURES = {
    "CANDU": {"patterns": (LETTER_CHANNEL, LETTER_CHANNEL.replace("[A-Y]", "[A-Y]-")), "grid": (24, 25), "excluded": EXCLUDED, "keywords": ("candu", "canadian", "deuterium", "uranium", "heavy water"), "count": (200, 600)},
    "AGR": {"patterns": (FOUR_DIGITS, r"^\d{4}$"), "grid": (49, 49), "excluded": ("50", "51", "99"), "keywords": ("agr", "advanced", "gas", "cooled", "graphite"), "count": (300, 1000)},
}
#: Weights of patterns, grid, keywords and structure; a type is accepted at .7, and the reactor itself above .8.
WEIGHTS = (0.5, 0.3, 0.1, 0.1)
ACCEPT, INSTANCE = 0.7, 0.8
AGR_SIZE = 49
GENERIC = r"^[A-Z]?\d{1,4}$"


def samples(nodes: DataFrame) -> DataFrame:
    """(channel_id): the different channels of channel nodes, and of components that are one as a whole, in capitals."""
    v = F.upper("value")
    whole = F.lit(False)
    for s in SIGNATURES.values():
        for p in s["patterns"]:
            whole = whole | v.rlike(p)
    return nodes.filter((F.col("type") == "channel") | ((F.col("type") == "component") & whole)).select(v.alias("channel_id")).filter("channel_id <> ''").distinct()


def evidence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(reactor, samples, pattern, grid, keyword, structure, score, accepted, instance), a row for each type.

    pattern: the share of channels that fit; grid: the mean of how full the grid is (.5 if over full, 0 below a tenth) and how
    near the channels' number is to the usual; keyword: the share of keywords in names of files, folders and components;
    structure: .5, more with timestamps at channels, with folders and with more than ten channel nodes."""
    found = samples(nodes)
    counts = found.agg(F.count("*").alias("samples"), *[F.count_if(_any(s["patterns"], F.col("channel_id"))).alias(f"fit_{k}") for k, s in SIGNATURES.items()])
    text = nodes.filter(F.col("type").isin("file", "folder", "filename", "component")).select(F.lower("value").alias("v"))
    words = text.agg(*[F.coalesce(F.bool_or(F.contains("v", F.lit(w))), F.lit(False)).cast("int").alias(f"word_{k}_{i}") for k, s in SIGNATURES.items() for i, w in enumerate(s["keywords"])])
    channel = nodes.filter("type = 'channel'").select("node_id")
    stamps = nodes.filter("type = 'Timestamp'").select(F.col("node_id").alias("other"))
    near = both_ways(edges).join(channel, "node_id", "left_semi").join(stamps, "other", "left_semi").agg(F.count("*").alias("stamped"))
    shape = nodes.agg(F.count_if(F.col("type") == "folder").alias("folders"), F.count_if(F.col("type") == "channel").alias("channels"))
    one = counts.crossJoin(words).crossJoin(near).crossJoin(shape)  # one row each
    n, rows = F.col("samples"), []
    structure = F.least(F.lit(1.0), 0.5 + F.when(F.col("stamped") > 0, 0.2).otherwise(0.0) + F.when(F.col("folders") > 0, 0.2).otherwise(0.0) + F.when(F.col("channels") > 10, 0.1).otherwise(0.0))
    for k, s in SIGNATURES.items():
        active = s["grid"][0] * s["grid"][1] - len(s["excluded"])
        low, high = s["count"]
        cover = n / active
        full = F.when(cover > 1, 0.5).when(cover >= 0.1, cover).otherwise(0.0)
        usual = F.when(n == 0, 0.0).when(n < low, n / low).when(n > high, high / n).otherwise(1.0)
        word = sum((F.col(f"word_{k}_{i}") for i in range(len(s["keywords"]))), F.lit(0)) / len(s["keywords"])
        rows.append(F.struct(F.lit(k).alias("reactor"), F.when(n > 0, F.col(f"fit_{k}") / n).otherwise(0.0).alias("pattern"), ((full + usual) / 2).alias("grid"), word.alias("keyword")))
    x = one.withColumn("structure", structure).select("samples", "structure", F.explode(F.array(*rows)).alias("r")).select("r.reactor", "samples", "r.pattern", "r.grid", "r.keyword", "structure")
    score = F.col("pattern") * WEIGHTS[0] + F.col("grid") * WEIGHTS[1] + F.col("keyword") * WEIGHTS[2] + F.col("structure") * WEIGHTS[3]
    return x.withColumn("score", score).withColumn("accepted", F.col("score") >= ACCEPT).withColumn("instance", F.col("score") > INSTANCE)


def _any(patterns: tuple[str, ...], c: Column) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | c.rlike(p)
    return found


def reactor_type(scored: DataFrame) -> DataFrame:
    """evidence() -> the one type of the greatest score, if it is accepted; ties by name."""
    return scored.orderBy(F.desc("score"), "reactor").limit(1).filter("accepted").select("reactor", "score", "instance")


def positions(found: DataFrame) -> DataFrame:
    """found(channel_id, reactor) -> where each lies: by letter and number, by two even numbers with its 7 by 7 assembly, or, for
    other types, by its first letter and number, or by a number on a grid of side sqrt(2 n). What fits no rule has no row."""
    c = F.col("channel_id")
    number = F.substring(c, 2, 9).try_cast("int")
    row = F.expr(f"instr('{ROW_LETTERS}', substring(channel_id, 1, 1)) - 1")
    candu = (F.col("reactor") == "CANDU") & c.rlike(r"^[A-Y]\d{2,3}$") & row.between(0, GRID_HEIGHT - 1) & (number - 1).between(0, GRID_WIDTH - 1)
    first, last = F.substring(c, 1, 2).try_cast("int"), F.substring(c, 3, 2).try_cast("int")
    even = (first >= 2) & (last >= 2) & (first % 2 == 0) & (last % 2 == 0)
    agr = (F.col("reactor") == "AGR") & c.rlike(r"^\d{4}$") & even
    letters, digits = F.regexp_extract(c, "([A-Z]+)", 1), F.regexp_extract(c, r"(\d+)", 1).try_cast("int")
    other = ~F.col("reactor").isin("CANDU", "AGR") & digits.isNotNull()
    side = F.floor(F.sqrt(digits * 2)).cast("int")
    numeric = other & (letters == "") & (side > 0)
    x = F.when(candu, number - 1).when(agr, F.floor((last - 2) / 2)).when(other & (letters != ""), digits - 1).when(numeric, digits % side)
    y = F.when(candu, row).when(agr, F.floor((first - 2) / 2)).when(other & (letters != ""), F.ascii(F.substring(letters, 1, 1)) - 65).when(numeric, F.floor(digits / side))
    system = F.when(candu, "letter_number").when(agr, "four_digit").when(other & (letters != ""), "generic").when(numeric, "numeric")
    p = found.select(c, "reactor", x.cast("int").alias("x"), y.cast("int").alias("y"), system.alias("system")).filter("x IS NOT NULL AND y IS NOT NULL")
    w, h = F.when(F.col("system") == "letter_number", GRID_WIDTH).otherwise(AGR_SIZE), F.when(F.col("system") == "letter_number", GRID_HEIGHT).otherwise(AGR_SIZE)
    placed = F.col("system").isin("letter_number", "four_digit")
    distance = F.when(placed, F.bround(F.sqrt(F.pow(F.col("x") - w / 2, 2) + F.pow(F.col("y") - h / 2, 2)), 2))
    sector = F.when(F.col("system") == "letter_number", F.concat(F.when(F.col("y") < h / 2, "N").otherwise("S"), F.when(F.col("x") < w / 2, "W").otherwise("E")))
    seven = lambda v, f: F.when(F.col("system") == "four_digit", f(F.col(v)).cast("int"))
    return p.select("channel_id", "reactor", "system", "x", "y", distance.alias("distance"), sector.alias("sector"), seven("x", lambda v: F.floor(v / 7)).alias("assembly_x"), seven("y", lambda v: F.floor(v / 7)).alias("assembly_y"), seven("x", lambda v: v % 7).alias("sub_x"), seven("y", lambda v: v % 7).alias("sub_y"))


def validated(found: DataFrame, reactor: str) -> DataFrame:
    """found(channel_id) -> (channel_id, valid, score, anomalies, warnings): each check of the reactor type in order. Pattern,
    excluded positions, number range and even numbers are critical; an overlong id warns. The letter and duplicate checks of a
    single channel always pass; `duplicates` is the check over all. A missing id fails at once with score 0."""
    c = F.col("channel_id")
    first, last = F.substring(c, 1, 2).try_cast("int"), F.substring(c, 3, 2).try_cast("int")
    number = F.regexp_extract(c, r"(\d+)", 1).try_cast("int")
    long = F.length(c) > 10
    none = F.lit(False)
    if reactor == "CANDU":
        checks = [("pattern_mismatch", ~c.rlike(LETTER_CHANNEL), True), ("excluded_position", c.isin(*EXCLUDED), True), ("invalid_letter", none, True), ("number_out_of_range", F.coalesce(~number.between(1, 25), none), True), ("suspicious_format", long, False), ("duplicate", none, True)]
    elif reactor == "AGR":
        even = (first.between(2, 48) | first.between(52, 98)) & (first % 2 == 0) & (last % 2 == 0) & last.between(2, 98)
        checks = [("pattern_mismatch", ~c.rlike(FOUR_DIGITS), True), ("excluded_position", c.isin(*SIGNATURES["AGR"]["excluded"]), True), ("even_number_violation", c.rlike(r"^\d{4}$") & ~F.coalesce(even, none), True), ("range", none, True), ("suspicious_format", long, False), ("duplicate", none, True)]
    else:
        checks = [("pattern_mismatch", ~c.rlike(GENERIC), True), ("format", none, True), ("duplicate", none, True)]
    missing = c.isNull() | (c == "")
    failed = F.array(*[F.when(bad, F.struct(F.lit(kind).alias("kind"), F.lit(critical).alias("critical"))) for kind, bad, critical in checks])
    x = found.select(c, missing.alias("missing"), F.filter(failed, lambda f: f.isNotNull()).alias("failed"))
    kinds = lambda critical: F.transform(F.filter("failed", lambda f: f["critical"] == critical), lambda f: f["kind"])
    anomalies = F.when(F.col("missing"), F.array(F.lit("missing_identifier"))).otherwise(kinds(True))
    score = F.when(F.col("missing"), 0.0).otherwise((len(checks) - F.size("failed")) / len(checks))
    return x.select("channel_id", (F.size(anomalies) == 0).alias("valid"), F.round(score, 6).alias("score"), anomalies.alias("anomalies"), F.when(F.col("missing"), F.array().cast("array<string>")).otherwise(kinds(False)).alias("warnings"))


def duplicates(found: DataFrame) -> DataFrame:
    """(channel_id, n) of channels that several rows have."""
    return found.groupBy("channel_id").agg(F.count("*").alias("n")).filter("n > 1")


def validation_summary(checked: DataFrame) -> DataFrame:
    """validated() -> one row: how many are valid, the share in percent, the five most frequent anomalies and a grade: high above
    .9 valid, medium above .7, else low."""
    g = checked.agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"))
    kinds = checked.select(F.explode("anomalies").alias("kind")).groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(5)
    top = kinds.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "kind"))), lambda x: F.concat_ws("=", x["kind"], (-x["m"]).cast("string"))), ",").alias("anomalies"))
    share = F.when(F.col("total") > 0, F.col("valid") / F.col("total")).otherwise(0.0)
    return g.crossJoin(top).select("total", "valid", (F.col("total") - F.col("valid")).alias("invalid"), F.round(share * 100, 4).alias("compliance"), "anomalies", F.when(share > 0.9, "high").when(share > 0.7, "medium").otherwise("low").alias("grade"))


def anonymous(channel: Column) -> Column:
    """A01 as 0101: the letter's number in two digits."""
    return F.when((F.length(channel) >= 3) & channel.rlike("^[A-Za-z]"), F.concat(F.lpad((F.ascii(F.upper(F.substring(channel, 1, 1))) - 64).cast("string"), 2, "0"), F.substring(channel, 2, 1 << 20))).otherwise(channel)


def core_view(nodes: DataFrame, edges: DataFrame, pattern: str = LETTER_CHANNEL, hops: int = 2) -> DataFrame:
    """(channel, shown, kind, measurements, last, folder, status) of each channel of a graph.

    Channel nodes have the timestamps that lie `hops` steps away (at 2, over any node between; at 1, beside them), are active if
    there are any, and have the folder that holds them. Channels that only folder names or other texts mention are referenced,
    with the least folder that does."""
    own = nodes.filter("type = 'channel'").select("node_id", F.upper("value").alias("channel")).filter(F.col("channel").rlike(pattern))
    stamps = nodes.filter("type = 'Timestamp'").select(F.col("node_id").alias("stamp"), F.col("value").alias("at"))
    ends = both_ways(edges).select("node_id", "other").distinct()
    near = own.join(ends, "node_id").select("channel", F.col("other").alias("step"))
    if hops == 2:
        near = near.join(ends.withColumnRenamed("node_id", "step"), "step").select("channel", F.col("other").alias("step"))
    seen = near.join(stamps, F.col("step") == F.col("stamp")).select("channel", "stamp", "at").distinct().groupBy("channel").agg(F.count("*").alias("measurements"), F.max("at").alias("last"))
    folders = nodes.filter("type = 'folder'").select(F.col("node_id").alias("src"), F.regexp_extract("value", r"([^/\\]*)$", 1).alias("folder"))
    held = own.join(edges.select("src", F.col("dst").alias("node_id")), "node_id").join(folders, "src").groupBy("channel").agg(F.min("folder").alias("folder"))
    explicit = own.select("channel").distinct().join(seen, "channel", "left").join(held, "channel", "left")
    explicit = explicit.select("channel", F.lit("channel").alias("kind"), F.coalesce("measurements", F.lit(0)).alias("measurements"), "last", "folder", F.when(F.col("measurements") > 0, "active").otherwise("inactive").alias("status"))
    word = pattern.replace("^", r"\b").replace("$", r"\b")
    said = nodes.filter("type NOT IN ('channel', 'Timestamp')").select("type", "value", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("value"), F.lit(word), 0))).alias("channel"))
    name = F.regexp_extract("value", r"([^/\\]*)$", 1)
    implicit = said.groupBy("channel").agg(F.min(F.when(F.col("type") == "folder", name)).alias("folder")).join(own.select("channel").distinct(), "channel", "left_anti")
    rest = implicit.select("channel", F.lit("implicit_channel"), F.lit(0).cast("long"), F.lit(None).cast("string"), "folder", F.lit("referenced"))
    return explicit.union(rest).select("channel", anonymous(F.col("channel")).alias("shown"), "kind", "measurements", "last", "folder", "status")
