"""The as-of join against a plain loop, with hot keys that are split by time and dealt over several shards."""

import random
from datetime import datetime, timedelta
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import asof_join

HOUR = asof_join.HOUR


def brute(left, right, tolerance):
    out = []
    for i, k, t in left:
        best = max((r for r in right if k is not None and t is not None and r[0] == k and r[1] <= t and t - r[1] <= tolerance), key=lambda r: r[1], default=None)
        out.append((i, k, t, *((best[1], best[2]) if best else (None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [10, 100_000])
@pytest.mark.parametrize("one_moment", [False, True])
def test_asof_equals_a_loop(spark, rows, one_moment):
    r = random.Random(rows)
    left = [(i, r.choice([1, 1, 1, 2, 3, None]), None if r.random() < 0.05 else r.randrange(-5_000, 60_000)) for i in range(600)]
    if one_moment:  # no chunk is short enough to part these
        left += [(1000 + i, 1, 20_000) for i in range(200)]
    right = sorted({(k, r.randrange(-6_000, 60_000)) for k in [1] * 150 + [2] * 4 + [4]})
    right = [(k, t, f"v{k}{t}") for k, t in right]
    a = spark.createDataFrame(left, "i long, k long, t long")
    b = spark.createDataFrame(right, "k long, at long, v string")
    for tolerance in (90, 4_000):
        found = asof_join.asof(a, b, "k", "t", "at", tolerance, rows=rows)
        assert found.columns == ["i", "k", "t", "matched_at", "v"]
        assert sorted(map(tuple, found.collect()), key=repr) == brute(left, right, tolerance)


def test_a_hot_key_is_split(spark):
    """A key with most rows gets narrower chunks until none holds more than asked; one moment with more is salted."""
    spread = spark.range(4_000).select(F.lit(7).cast("long").alias("k"), (F.col("id") * 1_000).alias("t"))
    few = spark.range(50).select((F.col("id") + 100).alias("k"), F.col("id").alias("t"))
    width = 1 << 22
    ((key, level, salts),) = asof_join._split_keys(spread.union(few), few.limit(0), width, 100, 4_050)
    assert (key, salts) == (7, 1) and (width >> level) // 1_000 <= 100 < (width >> (level - 1)) // 1_000
    once = spark.range(1_000).select(F.lit(7).cast("long").alias("k"), F.lit(5).cast("long").alias("t"))
    assert asof_join._split_keys(once, few, width, 100, 1_050) == [(7, asof_join.HALVINGS, 10)]


def frames(spark, clicks, sales):
    c = spark.createDataFrame(clicks, "click_id long, ts timestamp_ntz, client_id long, kind string, k string, shard int")
    s = spark.createDataFrame(sales, "sale_id long, client_id long, total double, sold_at timestamp_ntz, priority int, t string, ts_us int")
    return c, s


def test_clicks_by_plain_python(spark):
    r = random.Random(12)
    start = datetime(2024, 1, 1)
    when = lambda: start + timedelta(seconds=r.randrange(30 * 86_400), microseconds=r.randrange(1_000_000)) if r.random() < 0.95 else None
    clicks = [(i, when(), r.choice([1, 1, 2, 3, None]), "x", "y", 0) for i in range(300)]
    clicks += clicks[:40] + [(None, start, 1, "x", "y", 0)]
    sales = [(i, r.choice([1, 1, 2, None]), r.choice([None, 1.005, r.random() * 100]), w.replace(minute=0, second=0, microsecond=0) if (w := when()) and i % 2 else w, r.choice([None, 1, 3, 5])) for i in range(120)]
    sales = [(*s, "z", 0) for s in [*sales, *sales[:10]]]
    c, s = frames(spark, clicks, sales)
    got = sorted(map(tuple, asof_join.clicks_to_sales(c, s).collect()), key=repr)

    us = lambda t: None if t is None else int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    h = lambda i: 0 if i is None else crc32(str(i).encode())
    used = lambda t, i: t if t is None or h(i) % 2 == 0 else t - t % HOUR
    orders = []
    for sale, client, total, at, priority, *_ in sales:
        cents = None if total is None else int((100 * total + 0.5) // 1)
        if client is not None and at is not None:
            t = used(us(at), sale)
            orders.append((client, t, sale, priority, cents))
            if h(sale) % 3:
                orders.append((client, t, -1 - sale, None if priority is None else 6 - priority, cents))
    want = []
    for i, t, client, *_ in {x[0]: x for x in clicks}.values():
        t = used(us(t), i)
        near = [o for o in orders if client is not None and t is not None and o[0] == client and 0 <= t - o[1] <= 240 * HOUR]
        if near:
            tied = [o for o in near if o[1] == max(x[1] for x in near)]
            _, at, sale, _, cents = min(tied, key=lambda o: (o[3] is None, o[3] or 0, -o[2]))
            want.append((i, client, t, sale, t - at, cents, len(tied)))
        else:
            want.append((i, client, t, None, None, None, 0))
    assert got == sorted(want, key=repr)


def test_odd_tables(spark):
    start = datetime(2024, 1, 1)
    c, s = frames(spark, [(1, start, 1, "a", "b", 0), (2, None, None, None, None, None)], [(1, 1, 2.0, start, 1, "z", 0), (None, None, None, None, None, None, None)])
    assert asof_join.clicks_to_sales(c.limit(0), s).count() == 0
    assert [tuple(r)[3:] for r in asof_join.clicks_to_sales(c, s.limit(0)).collect()] == [(None, None, None, 0)] * 2
    assert asof_join.clicks_to_sales(c.limit(0), s.limit(0)).count() == 0
    nothing = spark.createDataFrame([(None, start, 1, 1.0, None)], "sale_id long, sold_at timestamp_ntz, client_id long, total double, priority int")
    assert {(r["click_id"], r["sale_id"], r["n_tied"]) for r in asof_join.clicks_to_sales(c, nothing).collect()} == {(1, None, 1), (2, None, 0)}


def test_times_without_a_zone_are_utc(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 31, 2, 30),)], "ts timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # that hour doesn't exist there
        assert df.select(asof_join.micros(df, "ts")).first()[0] == 1711852200000000
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_crc_in_sql():
    con = duckdb.connect()
    tab = asof_join.ORACLE.split("c0 AS")[0].rstrip().rstrip(",")
    for n in (0, 7, 123456, 987654321012):
        assert con.execute(f"{tab} SELECT {asof_join.crc_sql('n')} FROM (SELECT {n} AS n), tab").fetchall() == [(crc32(str(n).encode()),)]
