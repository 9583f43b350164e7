"""Ordered processors over documents, with a policy for failures and a record of each step."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Processor:
    """id; the columns it makes, from those it finds; and, per row, a message where it fails (null where it does not)."""

    id: str
    columns: Callable[[DataFrame], dict[str, Column]]
    failure: Callable[[DataFrame], Column] | None = None


def process(df: DataFrame, processors: list[Processor], on_failure: str = "throw") -> DataFrame:
    """The processed rows with `steps`: an array of (id, index, status, message), status Completed, Failed or Skipped.

    A row on which a processor fails keeps the columns it had before it. on_failure:
    throw ends the query with the first failure of a row, continue goes on
    with the next processor, stop skips the row's remaining ones. Ids
    are unique in any case, and not blank.
    """
    ids = [p.id.strip().lower() for p in processors]
    if not all(ids) or len(set(ids)) < len(ids):
        raise ValueError("processors need unique ids that are not blank")
    if on_failure not in ("throw", "continue", "stop"):
        raise ValueError("on_failure: throw, continue or stop")
    out = df.withColumns({"steps": F.array().cast("array<struct<id:string,index:int,status:string,message:string>>"), "_on": F.lit(True)})
    for k, p in enumerate(processors):
        message = p.failure(out) if p.failure else F.lit(None)
        out = out.withColumn("_why", F.when(F.col("_on"), message.cast("string")))
        if on_failure == "throw":
            told = F.concat(F.lit(f"processor {p.id} ({k}): "), F.col("_why"))
            out = out.withColumn("_on", F.when(F.col("_why").isNotNull(), F.raise_error(told).cast("boolean")).otherwise(F.col("_on")))
        fine = F.col("_on") & F.col("_why").isNull()
        made = {n: F.when(fine, c).otherwise(F.col(n) if n in out.columns else F.lit(None)) for n, c in p.columns(out).items()}
        status = F.when(~F.col("_on"), "Skipped").when(F.col("_why").isNotNull(), "Failed").otherwise("Completed")
        step = F.struct(F.lit(p.id).alias("id"), F.lit(k).alias("index"), status.alias("status"), F.col("_why").alias("message"))
        on = {"_on": F.col("_on") & F.col("_why").isNull()} if on_failure == "stop" else {}
        out = out.withColumns(made | {"steps": F.concat("steps", F.array(step))} | on)
    return out.drop("_on", "_why")
