"""Files of a folder, in a fixed order and within bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kinds


def list_files(spark: SparkSession, folder: str, *, extensions: tuple[str, ...] = (), recurse: bool = True, most_files: int = 500, most_bytes: int | None = None) -> DataFrame:
    """Files of a folder by path: path, size, modified, kind (by extension). At most `most_files`, of `most_bytes` together: a file that would go beyond is left out, and smaller ones behind it may still come in.

    Their contents are not read. The choice is made along the order, on the driver, which sees the names of one file after another.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recurse).lower()).load(folder)
    listed = found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    if extensions:
        listed = listed.where(kinds.extension(F.col("path")).isin([e.lower().lstrip(".") for e in extensions]))
    taken, total = [], 0
    for r in listed.orderBy("path").toLocalIterator():
        if len(taken) >= most_files:
            break
        if most_bytes is None or total + r["size"] <= most_bytes:
            taken.append(tuple(r))
            total += r["size"]
    out = spark.createDataFrame(taken, "path string, size long, modified timestamp")
    names = F.create_map(*(F.lit(x) for pair in kinds.EXTENSIONS.items() for x in pair))
    return out.withColumn("kind", F.coalesce(F.try_element_at(names, kinds.extension(F.col("path"))), F.lit("Unknown")))
