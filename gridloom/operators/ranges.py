"""Work along an order of all rows: ranges, each a task's, and what is carried from one to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph


def ranged(df: DataFrame, *keys: Column | str) -> DataFrame:
    """The rows in ranges of an order, in the shared folder, with _p, the number of their range.

    They are written, so that all that reads them sees the same ranges. Keys that
    tell all rows apart let equal ones be split.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id())
    return graph._written(dealt)[0]


def per_range(table: DataFrame, *aggregates: Column) -> list:
    """One row of aggregates for each range that has rows, in order: as many as there were tasks."""
    return table.groupBy("_p").agg(*aggregates).orderBy("_p").collect()
