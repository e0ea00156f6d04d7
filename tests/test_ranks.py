"""Places by ranges against sorting each group."""

import random

from pyspark.sql import functions as F

from weftgraph.operators import ranks


def test_places_equal_those_of_sorted_groups(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["hot"] * 8 + ["a", "b", None]), r.choice([None, r.randrange(20)])) for i in range(2_000)] + [(9_000, "one", 1)]
    df = spark.createDataFrame(rows, "id int, g string, v int").repartition(7)
    for order, key in (([F.col("v").asc_nulls_last(), F.col("id").asc()], lambda x: (x[2] is None, x[2] or 0, x[0])), ([F.col("v").desc_nulls_last(), F.col("id").asc()], lambda x: (x[2] is None, -(x[2] or 0), x[0]))):
        got = {x["id"]: x["place"] for x in ranks.placed(df, "g", order, partitions=9).collect()}
        want = {x[0]: k for g in {x[1] for x in rows} for k, x in enumerate(sorted((x for x in rows if x[1] == g), key=key), 1)}
        assert got == want
    assert ranks.placed(df.limit(0), "g", [F.col("id").asc()]).count() == 0


def test_no_window_over_a_group(spark):
    df = spark.range(50_000).select(F.lit("hot").alias("g"), F.xxhash64("id").alias("v"))
    p = ranks.placed(df, "g", [F.col("v").asc()], partitions=8)
    assert p.agg(F.max("place"), F.count_distinct("place")).first()[:] == (50_000, 50_000)
    assert p.filter("place <= 40000").join(p.filter("place > 40000").agg(F.min("v").alias("m"))).filter("v >= m").isEmpty()
