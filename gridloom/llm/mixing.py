"""Mixing sources to target weights by hash thresholds.

Every document has a place in [0, 2**60) by a hash of its id, the same in every
run and for every budget, so that what a smaller budget takes is part of what
a larger one takes. Tokens are summed by source and hash bucket; in each source
the bucket in which the budget ends is found from these sums, and only that
bucket is cut finer, until its few documents decide. The result is one hash
threshold a source, and the documents are filtered by it without any sort.

A target above a source's size takes every document once, and the documents
below the threshold of what is left once more.

Cases: a null text has size 0; a null source is the last source; a document
without an id is placed by its text; rows with the same id are taken alike; an
empty table gives an empty result. A source without words has target 0, and a
document without words is no part of the mix. Other columns are not looked at
by `plan`, and pass through `mix` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
#: A source is taken at most so many times.
REPEATS = 2.0
#: Bits of the hash, and of each step of the histogram.
BITS, STEP = 60, 12
#: Sources whose sums and thresholds the driver handles and broadcasts, at most.
MAX_SOURCES = 100_000


def place(key: str, text: str):
    """The document's place, 60 bits of the MD5 of its id as text, or of the text of a document without an id."""
    name = F.coalesce(F.col(key).cast("string"), F.col(text), F.lit(""))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def size(text: str):
    """Words of the text, by white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> dict[str | None, float]:
    """Target tokens by source: shares of the budget by weight, stopped at `repeats` sizes, the excess shared again by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    most = {s: repeats * n for s, n in order}
    left, free, out = share * sum(n for _, n in order), [s for s, _ in order], {}
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > most[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        for s in full:
            out[s] = most[s]
        left -= sum(most[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def _thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source: the place below which documents are taken, so that their sizes come nearest to the budget.

    rows: source, place, size. budgets: source, budget; a few rows.
    """
    pending, shift = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").cast("double")), BITS
    while True:
        shift -= STEP
        last = shift <= 24
        # after two steps a bucket holds one document in 2**24 of its source: few enough to decide each
        bucket = F.col("place") if last else F.shiftright("place", shift)
        inside = rows.join(F.broadcast(pending), (rows["source"].eqNullSafe(pending["source"])) & (F.shiftright("place", shift + STEP) == F.col("prefix"))).select(rows["source"], bucket.alias("bucket"), "size", "budget")
        sums = inside.groupBy("source", "bucket", "budget").agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        left = F.col("budget") - F.col("upto") + F.col("size")  # of the budget, before this bucket
        # the last document is taken where that comes nearer to the budget than to stop before it
        bound = F.col("bucket") + (F.col("size") - left < left).cast("long") if last else F.col("bucket")
        over = sums.withColumn("upto", upto).where(F.col("upto") > F.col("budget")).groupBy("source").agg(F.min_by(F.struct(bound.alias("bucket"), left.alias("budget")), "bucket").alias("x"))
        cut = storage.materialize(over.select("source", F.col("x.bucket").alias("prefix"), F.col("x.budget").alias("budget")))
        if last:
            return cut.select("source", F.col("prefix").alias("threshold"))
        pending = cut


def _limits(rows: DataFrame, weights: tuple[float, ...], share: float, repeats: float) -> DataFrame:
    """Per source, at most MAX_SOURCES rows: of, source_size, target, whole (times that every document is taken) and threshold."""
    by_source = rows.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(by_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r.source: r.n for r in by_source}
    target = targets(list(sizes.items()), weights, share, repeats)
    table = []
    for s, n in sizes.items():
        whole = int(target[s] // n) if n else 0
        table.append((s, n, float(target[s]), whole, float(target[s] - whole * n)))
    table = rows.sparkSession.createDataFrame(table, "of string, source_size long, target double, whole int, budget double")
    cut = _thresholds(rows, table.select(F.col("of").alias("source"), "budget"))
    return table.join(cut, F.col("of").eqNullSafe(F.col("source")), "left").drop("source")


def _times():
    """How often a document with columns place, whole, budget and threshold is taken."""
    once_more = F.when(F.col("threshold").isNull(), F.col("budget") > 0).otherwise(F.col("place") < F.col("threshold"))
    return F.col("whole") + once_more.cast("int")


def plan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """Per document row: key, size, source_size, target (of the source) and taken (tokens, repeats counted)."""
    rows = storage.materialize(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), place(key, text).alias("place"), size(text).alias("size")))
    limits = _limits(rows, weights, share, repeats)
    joined = rows.join(F.broadcast(limits), F.col("source").eqNullSafe(F.col("of")), "left")
    return joined.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """The documents of the mix, same columns, each as many times as it is taken."""
    whole = docs.select(F.struct("*").alias("doc"), F.col(source).cast("string").alias("source"), place(key, text).alias("place"), F.col(text).alias("text"))
    limits = _limits(storage.materialize(whole.select("source", "place", size("text").alias("size"))), weights, share, repeats)
    joined = whole.join(F.broadcast(limits), F.col("source").eqNullSafe(F.col("of")), "left")
    times = F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), _times()).otherwise(0)
    return joined.select("doc", F.explode(F.array_repeat(F.lit(1), times)).alias("n")).select("doc.*")
