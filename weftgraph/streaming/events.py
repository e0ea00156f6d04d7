"""Event metrics as a stream: the same aggregates as in batch, with a watermark for late events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import shared_base


def windows(events: DataFrame, width: str = "1 day", late: str = "30 days") -> DataFrame:
    """Events per type and window: count, sum, least and greatest value. Works on batch and stream frames alike."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    g = w.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total", "low", "high")


def run_available(spark: SparkSession, folder: str, name: str, transform) -> DataFrame:
    """Reads the files name* of a folder as a stream, one a trigger, runs transform over what is there and returns the
    result's last state from the shared folder. Each trigger replaces a window's row by its newest."""
    out = f"{shared_base(spark)}/weft-stream-{uuid.uuid4().hex[:12]}"
    schema = spark.read.parquet(f"{folder}/{name}").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*")
    source = source.withColumn("ts", F.col("ts").cast("timestamp"))
    frame = transform(source)
    kind = frame.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    query = frame.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows").drop("batch")
    keys = [c for c in kind.fieldNames() if c in ("start", "event_type")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in kind.fieldNames() if c not in keys]), "_batch").alias("x"))
    return newest.select(*keys, "x.*")
