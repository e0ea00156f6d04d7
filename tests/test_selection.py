"""Order statistics by refinement against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import selection


def sorted_quantile(xs, share):
    xs = sorted(xs, key=lambda x: (math.isnan(x), x))
    at = share * (len(xs) - 1)
    a, part = xs[math.floor(at)], at - math.floor(at)
    return a if part == 0 else (1 - part) * a + part * xs[math.floor(at) + 1]


def equal(a, b):
    return (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, rel=1e-12)


@pytest.mark.parametrize("share", [0.0, 0.5, 0.9])
def test_quantiles_equal_those_of_sorted_lists(spark, share):
    r = random.Random(7)
    groups = {
        "hot": [r.gauss(0, 1) for _ in range(3_000)],
        "steep": [10.0 ** r.uniform(-300, 300) * r.choice([-1, 1]) for _ in range(200)],
        "equal": [4.5] * 500 + [4.5000001] * 499,
        "one": [3.0],
        "two": [1.0, 2.0],
        "odd ones": [float("inf"), float("-inf"), 1.0, 1.0, -0.0, 0.0, float("nan")],
        "ends": [float("inf")] * 3 + [float("-inf")] * 4,
        "none is a number": [float("nan")] * 2,
        "wide": [-1.7e308, 1.7e308, 0.0, 5.0],
        None: [2.0, 8.0, 4.0],
    }
    rows = [(g, i % 2 == 0 if g == "two" else None, x) for g, xs in groups.items() for i, x in enumerate(xs)] + [("hot", None, None), ("empty", None, None)]
    df = spark.createDataFrame(rows, "g string, h boolean, x double").repartition(5)
    got = {(x["g"], x["h"]): x["q"] for x in selection.quantile(df, ["g", "h"], "x", share, "q").collect()}
    want = {(g, None): sorted_quantile(xs, share) for g, xs in groups.items() if g != "two"} | {("two", True): 1.0, ("two", False): 2.0}
    assert got.keys() == want.keys()
    for k, x in want.items():
        assert equal(got[k], x), (k, got[k], x)


def test_state_is_bounded_by_intervals(spark):
    df = spark.range(200_000).select(F.lit("k").alias("g"), (F.xxhash64("id") / 1e9).alias("v"))
    state = df.agg(F.lit("k").alias("g"), F.min("v").alias("low"), F.max("v").alias("high"))
    h = selection.histogram(df, state, ["g"])
    assert h.count() <= selection.BUCKETS + 3 and h.agg(F.sum("n")).first()[0] == 200_000
    plan = h._jdf.queryExecution().toString()
    assert "partial_count" in plan and "percentile" not in plan


def test_empty_and_null(spark):
    df = spark.createDataFrame([("a", None)], "g string, x double")
    assert selection.quantile(df, ["g"], "x", 0.5, "q").collect() == []
    with pytest.raises(ValueError, match="share"):
        selection.quantile(df, ["g"], "x", 1.5, "q")
