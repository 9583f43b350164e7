"""Connected components over an edge table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """The folder in spark.checkpoint.dir; one of our own where that is unset on a local master, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark._gridloom_graph = getattr(spark, "_gridloom_graph", None) or tempfile.mkdtemp(prefix="gridloom-graph-")
    return folder.rstrip("/")


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    """The table by way of the shared folder, so that lineage does not grow with the rounds, and its path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _delete(spark, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Per node of the edges: node, component (its smallest reachable node).

    Alternates two steps on the edge table until it is one star per component: every
    node hands its larger neighbours to its smallest neighbour (large star),
    then its smaller neighbours to the smallest (small star). The number of
    rounds grows with the logarithm of the nodes. Null ends are left out.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    loops = e.where("u = v").select("u")
    e, path = _written(e.where("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last = path
        e, path = _written(small.where("u <> v").distinct())
        _delete(e.sparkSession, last)
        # settled where every u has one v, which is no u itself
        ends = e.select("u", F.lit(1).alias("edges"), F.lit(0).alias("center")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("edges"), F.lit(1).alias("center")))
        if ends.groupBy("u").agg(F.sum("edges").alias("edges"), F.max("center").alias("center")).where("edges > 1 or edges + center > 1").isEmpty():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).unionByName(loops.select(F.col("u").alias("node"), F.col("u").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
