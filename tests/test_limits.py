"""Values that lie on a limit: the same on either side of it in Spark and in SQL."""

import duckdb
from pyspark.sql import functions as F

from weftgraph.operators import series
from weftgraph.plans import all_queries


def test_quality_does_not_depend_on_the_order_of_rows(spark):
    """The middle of three values is the mean but for the last bit of their sum, and the others are half the range from it."""
    rows = [(1, "s", 2, 4.08), (1, "s", 3, 5.21), (1, "s", 1, 2.95)]
    for shift in range(3):
        df = spark.createDataFrame(rows[shift:] + rows[:shift], "asset int, sensor string, t int, value double").coalesce(1)
        assert series.quality(df).first()["outlier_count"] == 0


def test_turbofan_means_round_as_sql_does(spark, tmp_path):
    """0.5005 and the like are stored a little below what they are written as."""
    line = "1L AS l_orderkey, id AS l_linenumber, 1L AS l_partkey, id AS l_suppkey, 2.0D AS l_quantity, (5005 + 10 * id) / 10000.0D AS l_extendedprice, 0.05D AS l_discount, 0.01D AS l_tax"
    spark.range(40).selectExpr(*line.split(", ", 5)[:5], *line.split(", ", 5)[5].split(", ")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(40).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(tuple(r) for r in all_queries.QUERIES["turbofan_nodes"](spark, str(tmp_path)).na.fill("-").collect())
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(tuple("-" if x is None else x for x in r) for r in con.execute(all_queries.ORACLES["turbofan_nodes"]).fetchall())
    assert got == want


def test_overlapping_spans_meet_on_one_side_only(spark):
    """A span is in one bucket on one side, so that long ones don't meet each other in each of theirs."""
    df = spark.createDataFrame([(f"a{i}", i % 7, 100 + i) for i in range(60)], "asset string, created long, destroyed long")
    found = series.overlaps(df, 1)
    assert found.count() == 60 * 59 // 2 == found.select("a", "b").distinct().count()
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    assert [tuple(r) for r in found.filter("a = 'a1' AND b = 'a5'").collect()] == [("a1", "a5", 5, 101, 96)]


def test_overlaps_of_few_bytes_are_made_in_many_tasks(spark):
    df = spark.createDataFrame([(f"a{i}", i, i + 9) for i in range(60)], "asset string, created long, destroyed long")
    found = series.overlaps(df, 1)
    assert found.count() == sum(min(8, 59 - i) for i in range(60))
    made = found.select(F.spark_partition_id().alias("p")).distinct().count()
    assert made > spark.sparkContext.defaultParallelism
