"""Tolerant as-of join: shards by a hash of key and time chunk with a halo, joined by DuckDB's ASOF LEFT JOIN in Arrow tasks.

For each left row the match is the latest right row of the same key at or before its time and at most `tolerance` earlier.
The right side has one row per key and time (`tie_groups` makes that beforehand, with partial sums before its shuffle).

* A key's time is cut into chunks of four tolerances. A shard is a hash of key and chunk, modulo a number that follows the
  rows, so that a shard has about `rows` of them.
* A key with more rows than a shard, and over a thousandth of all, has chunks of its own width: halved until none holds more
  than a shard, at most `HALVINGS` times; left rows of a chunk that is still too large are dealt over several shards, each with
  the chunk's right rows. There are fewer than 1000 such keys by arithmetic, whatever the input; this list is all that the
  driver sees or broadcasts.
* The halo: the last right row of each chunk goes to the following chunks as well, up to the next chunk of that key that has
  right rows or the end of the tolerance. A chunk gets one row by it, so the halo is no larger than the number of chunks.

Defined results: a left row with a null key or time is returned without a match; right rows of that kind match nothing; rows
that are equal are rows of their own; an empty side gives no rows, or rows without a match. Columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ._shared import materialise, ship

HOUR = 3_600_000_000
#: Rows of a shard, both sides together.
ROWS = 100_000
#: Share of all rows beyond which a key is split by chunks of its own: fewer keys than this can have it.
SPLIT_KEYS = 1000
#: A chunk of four tolerances is halved at most so often.
HALVINGS = 14
SHARDS_A_PARTITION = 8
#: Chunks are looked at in blocks of two to this power.
BLOCK_BITS = 9


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone counts as UTC, whatever the session's zone."""
    c = F.col(f"`{column}`")
    if df.schema[column].dataType == T.TimestampNTZType():
        since = c - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        return (since.cast("interval second").cast("decimal(24,6)") * 1_000_000).cast("long")
    return F.unix_micros(c.cast("timestamp"))


def tie_groups(right: DataFrame, by: list[str], best: list[Column], number: str) -> DataFrame:
    """One row for each combination of `by`: the columns of the row that is least by `best`, and how many rows there were.
    Ties in `best` go to the least remaining columns, so that the outcome doesn't depend on the order of rows."""
    rest = [c for c in right.columns if c not in by]
    order = [x.alias(f"_b{i}") for i, x in enumerate(best)]
    least = F.min(F.struct(*order, *[F.col(f"`{c}`").alias(f"_r{i}") for i, c in enumerate(rest)]))
    grouped = right.groupBy(*by).agg(least.alias("_x"), F.count("*").alias(number))
    return grouped.select(*by, *[F.col(f"_x._r{i}").alias(c) for i, c in enumerate(rest)], number)


def _split_keys(left: DataFrame, right: DataFrame, width: int, rows: int, total: int) -> list[tuple]:
    """(key, halvings, salts) of the keys that need chunks of their own."""
    both = left.select("k", "t").union(right.select("k", "t"))
    counts = both.groupBy("k").agg(F.count("*").alias("n"))
    most = max(rows, total // SPLIT_KEYS)
    large = counts.filter((F.col("n") > most) & F.col("k").isNotNull()).select("k")
    keys = [r["k"] for r in large.collect()]
    if not keys:
        return []
    fine = both.filter(F.col("k").isin(keys) & F.col("t").isNotNull()).groupBy("k", F.floor(F.col("t") / (width >> HALVINGS)).alias("slot")).agg(F.count("*").alias("n"))
    level = fine.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(HALVINGS))))
    chunk = level.groupBy("k", "level", F.expr(f"shiftright(slot, {HALVINGS} - level)").alias("chunk")).agg(F.sum("n").alias("n"))
    fullest = chunk.groupBy("k", "level").agg(F.max("n").alias("n"))
    fits = F.min(F.when(F.col("n") <= rows, F.col("level")))
    chosen = fullest.groupBy("k").agg(F.coalesce(fits, F.lit(HALVINGS)).alias("level"), F.max(F.when(F.col("level") == HALVINGS, F.col("n"))).alias("n"))
    salts = F.when(F.col("level") == HALVINGS, F.ceil(F.col("n") / rows)).otherwise(F.lit(1)).cast("int")
    return [tuple(r) for r in chosen.select("k", "level", salts).collect()]


def _with_next(last: DataFrame) -> DataFrame:
    """last(k, chunk, ...) with `next`, the key's next chunk in the table. Chunks are looked at in blocks, and then the blocks'
    first chunks, so that no window holds all of a key that has many."""
    block = last.withColumn("block", F.shiftright("chunk", BLOCK_BITS)).withColumn("next", F.lead("chunk").over(W.partitionBy("k", "block").orderBy("chunk")))
    ends = last.groupBy("k", F.shiftright("chunk", BLOCK_BITS).alias("block")).agg(F.min("chunk").alias("first"), F.max("chunk").alias("chunk"))
    ends = ends.withColumn("after", F.lead("first").over(W.partitionBy("k").orderBy("block"))).select("k", "chunk", "after")
    return block.join(ends, ["k", "chunk"], "left").withColumn("next", F.coalesce("next", "after"))


def _matcher(n_left: int, n_right: int, tolerance: int):
    """The task of one shard: an as-of join of two Arrow tables (shard, k, t, l0.. or r0..)."""

    def run(left, right):
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        try:
            con.register("l", left)
            con.register("r", right)
            near = f"r.t >= l.t - {tolerance}"
            payload = [f"CASE WHEN {near} THEN r.r{i} END AS r{i}" for i in range(n_right)]
            columns = ["l.k AS k", "l.t AS t", *[f"l.l{i} AS l{i}" for i in range(n_left)], f"CASE WHEN {near} THEN r.t END AS at", *payload]
            return con.sql(f"SELECT {', '.join(columns)} FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.t >= r.t").to_arrow_table()
        finally:
            con.close()

    return run


def asof(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, tolerance: int, matched: str = "matched_at", rows: int = ROWS) -> DataFrame:
    """left's rows and columns, the time of the match as `matched`, and right's other columns; nulls where nothing matches.
    Times are integers. right must have one row per key and time. Both sides are written once to the shared folder, as they are
    read by several passes and by tasks that may have to run again."""
    spark = left.sparkSession
    ship(spark)
    mine, theirs = [c for c in left.columns if c not in (key, left_time)], [c for c in right.columns if c not in (key, right_time)]
    a = materialise(left.select(F.col(f"`{key}`").alias("k"), F.col(f"`{left_time}`").cast("long").alias("t"), *[F.col(f"`{c}`").alias(f"l{i}") for i, c in enumerate(mine)]), "asof-left")
    b = right.select(F.col(f"`{key}`").cast(a.schema["k"].dataType).alias("k"), F.col(f"`{right_time}`").cast("long").alias("t"), *[F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(theirs)])
    b = materialise(b.filter("k IS NOT NULL AND t IS NOT NULL"), "asof-right")

    width = max(4 * tolerance, 1 << HALVINGS)
    width = -(-width >> HALVINGS) << HALVINGS  # each halving is exact
    total, partitions = a.count() + b.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-total // rows), SHARDS_A_PARTITION * partitions)
    split = _split_keys(a, b, width, -(-total // shards), total)

    def placed(df: DataFrame) -> DataFrame:
        if split:
            own = spark.createDataFrame(split, T.StructType([a.schema["k"], T.StructField("level", T.IntegerType()), T.StructField("salts", T.IntegerType())]))
            df = df.join(F.broadcast(own), "k", "left")  # fewer than SPLIT_KEYS rows
        else:
            df = df.withColumns({"level": F.lit(None).cast("int"), "salts": F.lit(None).cast("int")})
        df = df.withColumns({"level": F.coalesce("level", F.lit(0)), "salts": F.coalesce("salts", F.lit(1))})
        return df.withColumn("width", F.expr(f"shiftright({width}L, level)")).withColumn("chunk", F.floor(F.col("t") / F.col("width")))

    def shard(*unit) -> Column:
        return F.pmod(F.xxhash64(*unit), F.lit(shards)).alias("shard")

    names = [f"l{i}" for i in range(len(mine))]
    salt = F.pmod(F.xxhash64(*(names or ["t"])), F.col("salts")).cast("int")
    loose = F.col("k").isNull() | F.col("t").isNull()
    ours = placed(a).select(F.when(loose, shard("k", "t", *names)).otherwise(shard("k", "level", "chunk", salt)).alias("shard"), "k", "t", *names)

    held = [f"r{i}" for i in range(len(theirs))]
    there = placed(b)
    last = there.groupBy("k", "level", "salts", "width", "chunk").agg(F.max("t").alias("t"), *[F.max_by(c, "t").alias(c) for c in held])
    last = _with_next(last)
    upto = F.least(F.coalesce("next", F.lit((1 << 62))), F.floor((F.col("t") + tolerance) / F.col("width")))
    halo = last.withColumn("upto", upto).filter("upto > chunk").withColumn("chunk", F.explode(F.sequence(F.col("chunk") + 1, F.col("upto"))))
    unit = ["k", "level", "salts", "chunk", "t", *held]
    dealt = there.select(*unit).union(halo.select(*unit)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    other = dealt.select(shard("k", "level", "chunk", "salt"), "k", "t", *held)

    kind = lambda df, c, name: T.StructField(name, df.schema[c].dataType)
    schema = T.StructType([kind(a, "k", "k"), kind(a, "t", "t"), *[kind(a, c, c) for c in names], T.StructField("at", T.LongType()), *[kind(b, c, c) for c in held]])
    done = ours.groupBy("shard").cogroup(other.groupBy("shard")).applyInArrow(_matcher(len(mine), len(theirs), tolerance), schema)
    back = {"k": key, "t": left_time, "at": matched} | dict(zip(names, mine)) | dict(zip(held, theirs))
    return done.select(*[F.col(c).alias(back[c]) for c in [*(next(x for x, y in back.items() if y == c) for c in left.columns), "at", *held]])


def crc(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def _floored(t: Column, h: Column) -> Column:
    return F.when(h % 2 == 1, t - F.pmod(t, F.lit(HOUR))).otherwise(t)


def clicks_to_sales(clicks: DataFrame, sales: DataFrame, hours: int = 240) -> DataFrame:
    """The latest order of each click's client at most `hours` earlier; ties by priority, then sale_id.

    A row per click_id: of copies that differ, the one of least time, then client, counts (null last). Clicks without a
    click_id are copies of one. Null priority, sale_id and total lose ties."""
    picked = clicks.select("click_id", "client_id", micros(clicks, "ts").alias("ts_us"))
    first = F.min(F.struct(F.col("ts_us").isNull(), "ts_us", F.col("client_id").isNull(), "client_id"))
    once = picked.groupBy("click_id").agg(first.alias("x")).select("click_id", F.col("x.client_id").alias("client_id"), _floored(F.col("x.ts_us"), F.coalesce(crc("click_id"), F.lit(0))).alias("ts_us"))

    h = F.coalesce(crc("sale_id"), F.lit(0))
    base = sales.select("client_id", _floored(micros(sales, "sold_at"), h).alias("t"), "sale_id", F.col("priority").cast("long").alias("priority"), F.floor(100 * F.col("total") + 0.5).cast("long").alias("total_cents"), h.alias("h"))
    own = F.struct("sale_id", "priority")
    second = F.struct((-1 - F.col("sale_id")).alias("sale_id"), (6 - F.col("priority")).alias("priority"))
    orders = base.filter("client_id IS NOT NULL AND t IS NOT NULL").withColumn("o", F.explode(F.when(F.col("h") % 3 != 0, F.array(own, second)).otherwise(F.array(own))))
    orders = orders.select("client_id", "t", F.col("o.sale_id").alias("sale_id"), F.col("o.priority").alias("priority"), "total_cents")
    last = F.lit((1 << 63) - 1)
    best = [F.coalesce("priority", last), F.coalesce(-F.col("sale_id"), last), F.coalesce(-F.col("total_cents"), last)]
    groups = tie_groups(orders, ["client_id", "t"], best, "n_tied").drop("priority")

    found = asof(once, groups, "client_id", "ts_us", "t", hours * HOUR)
    return found.select("click_id", "client_id", "ts_us", "sale_id", (F.col("ts_us") - F.col("matched_at")).alias("lag_us"), "total_cents", F.coalesce("n_tied", F.lit(0)).cast("long").alias("n_tied"))


def crc_sql(column: str) -> str:
    """crc32 of a number's digits, by the table of the reflected polynomial."""
    return f"CAST(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda c: ord(c)::BIGINT)), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8))) AS BIGINT)"


ORACLE = f"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
c0 AS (SELECT click_id, arg_min(struct_pack(ts := ts, client_id := client_id), struct_pack(a := ts IS NULL, b := coalesce(epoch_us(ts), 0), c := client_id IS NULL, d := coalesce(client_id, 0))) AS x FROM clicks GROUP BY click_id),
c1 AS (SELECT click_id, x.client_id AS client_id, epoch_us(x.ts) AS t, coalesce({crc_sql("click_id")}, 0) AS h FROM c0, tab),
c AS (SELECT click_id, client_id, CASE WHEN h % 2 = 1 THEN t - ((t % {HOUR}) + {HOUR}) % {HOUR} ELSE t END AS ts_us FROM c1),
s1 AS (SELECT sale_id, client_id, epoch_us(sold_at) AS t, priority, CAST(floor(100 * total + 0.5) AS BIGINT) AS total_cents, coalesce({crc_sql("sale_id")}, 0) AS h FROM sales, tab),
s2 AS (SELECT * REPLACE (CASE WHEN h % 2 = 1 THEN t - ((t % {HOUR}) + {HOUR}) % {HOUR} ELSE t END AS t) FROM s1 WHERE client_id IS NOT NULL AND t IS NOT NULL),
o AS (SELECT client_id, t, sale_id, priority, total_cents FROM s2 UNION ALL SELECT client_id, t, -1 - sale_id, 6 - priority, total_cents FROM s2 WHERE h % 3 <> 0),
g AS (SELECT *, count(*) OVER (PARTITION BY client_id, t) AS n FROM o
      QUALIFY row_number() OVER (PARTITION BY client_id, t ORDER BY priority NULLS LAST, sale_id DESC NULLS LAST, total_cents DESC NULLS LAST) = 1),
m AS (SELECT c.*, g.* EXCLUDE (client_id, priority) FROM c ASOF LEFT JOIN g ON c.client_id = g.client_id AND c.ts_us >= g.t)
SELECT click_id, client_id, ts_us, CASE WHEN near THEN sale_id END AS sale_id, CASE WHEN near THEN ts_us - t END AS lag_us, CASE WHEN near THEN total_cents END AS total_cents, CASE WHEN near THEN n ELSE 0 END AS n_tied
FROM (SELECT *, coalesce(ts_us - t <= {240 * HOUR}, false) AS near FROM m)
"""
