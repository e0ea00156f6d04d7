"""Places in an order within groups, without a window over a group: rows are dealt by ranges of (group, order), numbered in the
order of their partition, and each partition's share of a group begins where those before it end. The window that adds up
these beginnings has a row per partition and group, however many rows a group has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .tables import materialise


def placed(df: DataFrame, group: str, order: list[Column], name: str = "place", partitions: int | None = None) -> DataFrame:
    """df with the place of each row in its group, from 1. The order should be total: equal rows have places in any order.
    Null groups are a group."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(group).asc_nulls_first(), *order]
    dealt = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    rows = materialise(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()))
    share = rows.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_g").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    share = share.withColumn("_before", before)
    j = rows.join(share, F.col("_part").eqNullSafe(F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return j.select(*df.columns, (F.col("_before") + F.col("_seq") - F.col("_first") + 1).alias(name))
