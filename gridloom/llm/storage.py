"""Cutting lineage into the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own where that is unset on a local master, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = getattr(spark, "_gridloom_shared", None)
    if not found:
        found = spark._gridloom_shared = tempfile.mkdtemp(prefix="gridloom-")
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: later jobs start from files that survive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._gridloom_path = path
    for tables in _stages:
        tables.append(table)
    return table


#: The tables written in each stage that is under way.
_stages: list[list[DataFrame]] = []


def settle(make: Callable[[], DataFrame]) -> DataFrame:
    """The result of a stage as a written table, without the tables that the stage wrote on the way."""
    _stages.append([])
    try:
        out = materialize(make())
    finally:
        inner = _stages.pop()
    discard(*(t for t in inner if t is not out))
    return out


_collected = 0.0


def _collect(spark: SparkSession) -> None:
    """Have the driver drop plans that nothing refers to: Spark deletes shuffle files and broadcasts only after that. Every few seconds at most."""
    global _collected
    if time.monotonic() - _collected > 4:
        gc.collect()
        spark._jvm.System.gc()
        _collected = time.monotonic()


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._gridloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        _collect(tables[0].sparkSession)


#: Rows of a few numbers each that may be broadcast, some 50 MB on every machine.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, marked for broadcast where a count shows that it is small; else it is shuffled."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def file_row() -> tuple[Column, Column]:
    """Two columns that name a row of a table that is read from Parquet: a hash of its file's path, and its place in the file."""
    return F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")
