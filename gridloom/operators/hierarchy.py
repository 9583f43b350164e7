"""Chunks of documents that are trees of sections: packed under a token budget, with overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import documents


def pack(sums: Column, most: int, overlap: int) -> Column:
    """Runs of blocks as an array of (first, fresh, last), from the sums of the tokens before each block and after the last.

    A run takes blocks while its tokens are `most` or fewer, one block at least. The
    next run begins with the last blocks of the one before, of `overlap` tokens
    at most, if its first fresh block fits behind them.
    """

    def step(s: Column, i: Column) -> Column:
        fits = (F.get(sums, i + 1) - F.get(sums, s["first"]) <= most) | (i == s["fresh"])
        # the longest overlap that leaves the run shorter than the last
        back = F.array_min(F.filter(F.sequence(s["first"] + 1, i), lambda f: (F.get(sums, i) - F.get(sums, f) <= overlap) & (F.get(sums, i + 1) - F.get(sums, f) <= most)))
        done = F.concat(s["runs"], F.array(F.struct(s["first"].alias("first"), s["fresh"].alias("fresh"), (i - 1).alias("last"))))
        return F.when(fits, s).otherwise(F.struct(done.alias("runs"), F.coalesce(back, i).alias("first"), i.alias("fresh")))

    blocks = F.size(sums) - 1
    begun = F.struct(F.array().cast("array<struct<first:int,fresh:int,last:int>>").alias("runs"), F.lit(0).alias("first"), F.lit(0).alias("fresh"))
    return F.aggregate(F.sequence(F.lit(0), blocks - 1), begun, step, lambda s: F.concat(s["runs"], F.array(F.struct(s["first"].alias("first"), s["fresh"].alias("fresh"), (blocks - 1).alias("last")))))


def chunks(sections: DataFrame, key: str, *, most: int = 512, overlap: int = 64, split: str = r"\n[ \t]*\n\s*", tokens=documents.token_estimate) -> DataFrame:
    """Sections (key, section, path, text) in chunks: key, chunk (from 0 in the document), section, path, first_block, last_block, n_overlap (blocks that the last chunk has, too), tokens and text.

    A chunk stays within its section. Its blocks are what `split` separates; no
    chunk has more than `most` tokens but one of a single larger block. `tokens`
    counts those of a text column; blank blocks do not count.
    """
    if not 0 <= overlap < most:
        raise ValueError("overlap: less than the tokens of a chunk")
    blocks = F.transform(F.filter(F.split("text", split), lambda b: b.rlike(r"\S")), lambda b: F.regexp_replace(b, r"\n+\z", ""))
    cut = sections.select(key, "section", "path", blocks.alias("_b")).where(F.size("_b") > 0)
    counted = cut.withColumn("_t", F.transform("_b", lambda b: tokens(b).cast("long")))
    none = F.array(F.lit(0).cast("long"))
    summed = counted.withColumn("_s", F.aggregate("_t", none, lambda s, t: F.concat(s, F.array(F.element_at(s, -1) + t))))
    runs = summed.select(key, "section", "path", "_b", "_s", F.explode(pack(F.col("_s"), most, overlap)).alias("r"))
    text = F.array_join(F.slice("_b", F.col("r.first") + 1, F.col("r.last") - F.col("r.first") + 1), "\n\n")
    number = F.row_number().over(Window.partitionBy(key).orderBy("section", "r.first")) - 1
    return runs.select(key, number.cast("long").alias("chunk"), "section", "path", F.col("r.first").cast("long").alias("first_block"), F.col("r.last").cast("long").alias("last_block"), (F.col("r.fresh") - F.col("r.first")).cast("long").alias("n_overlap"), (F.get("_s", F.col("r.last") + 1) - F.get("_s", F.col("r.first"))).alias("tokens"), text.alias("text"))
