"""Tables between the rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where spark.checkpoint.dir is unset, a local session, as in tests, uses a
    folder of its own, and any other is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return base.rstrip("/")


def local_path(uri: str) -> str | None:
    """The path of a file:// or scheme-less uri, None for any other store."""
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def materialise(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage."""
    path = f"{shared_base(df.sparkSession)}/weft-round-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_pieces(df: DataFrame, rows: int, most: int, *keys: str) -> DataFrame:
    """df of `rows` rows dealt by keys into pieces of about `most` rows, whose number follows the rows: neither the size of files
    nor that of what is shuffled, which packs keys well, decides what a task and the stages in it hold."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // most)), *keys)


def scratch(df: DataFrame) -> tuple[DataFrame, str]:
    """(df written as a table of the warehouse and read again, its name): for drop() once nothing reads it any more."""
    name = f"weft_round_{uuid.uuid4().hex[:12]}"
    df.write.format("parquet").saveAsTable(name)
    return df.sparkSession.table(name), name


def drop(spark: SparkSession, names: list[str]) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@contextmanager
def few_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """What a query within it shuffles is removed from disk when the query ends, and not only when the driver collects garbage:
    for rounds that write what they find and are never run again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
