"""Quality rules whose cutoffs adapt to the data.

Per document a few ratios are computed over the whole text. Per language and
source a mergeable quantile sketch of every ratio is kept: the counts of values
rounded down to 6 significant bits, at most 1/32 off, which add up across
tasks, days and groups. From its quartiles come the cutoffs (Tukey's fences
with a least slack); a group of too few documents takes the sketch of its
language, then of all. The cutoffs are joined to the documents, which are
filtered by them.

Cases: null text counts as empty and fails the base rules; null languages or
sources are groups of their own; repeated rows count each; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage, textbatch

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratio (in thousandths of the words): least slack below and above the quartiles, None where that side has no cutoff.
SLACK = {"symbol_ratio": (None, 60), "word_length": (1500, 1500), "dup_line_ratio": (None, 30), "repeat_ratio": (None, 400)}
#: Fences lie so many interquartile ranges outside the quartiles.
FENCE = 3
#: Documents that a group needs for a sketch of its own.
LEAST_GROUP = 200

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def text_counts(column: pa.Array) -> list[np.ndarray]:
    """COUNTS of every text, in that order."""
    out: list[list[np.ndarray]] = [[] for _ in COUNTS]
    for w in textbatch.words(column, lower=False):
        n = len(w.data)
        rows = np.repeat(np.arange(w.rows), np.diff(w.offsets))
        inside = textbatch.WORD[w.data]
        chars = np.bincount(rows[inside & ((w.data & 0xC0) != 0x80)], minlength=w.rows)
        symbols = np.bincount(rows[_SYMBOL[w.data]], minlength=w.rows)
        # lines: from a row's start or after a line feed, up to the next
        feed = np.flatnonzero(w.data == 10)
        start = np.unique(np.concatenate((w.offsets[:-1], feed + 1)))
        start = start[start < n]
        end = np.append(start[1:], n)
        end = np.where((end > start) & (w.data[end - 1] == 10), end - 1, end) if n else end
        worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
        start, end = start[worded], end[worded]
        line_row = rows[start] if n else start
        own = textbatch.with_row(textbatch.spans_hash(w.data, start, end), line_row)
        first = np.unique(own, return_index=True)[1]
        dup = np.bincount(line_row, minlength=w.rows) - np.bincount(line_row[first], minlength=w.rows)
        # words in three-word windows that occur again
        found, at = textbatch.windows(w.hashes(), w.bounds, 3)
        own = textbatch.with_row(found, w.row[at])
        order = np.argsort(own)
        same = own[order][1:] == own[order][:-1]
        again = np.zeros(len(own), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        covered = np.zeros(len(w.start), dtype=bool)
        for k in range(3):
            covered[at[again] + k] = True
        repeat = np.bincount(w.row[covered], minlength=w.rows)
        for k, x in enumerate((w.counts(), chars, symbols, dup, repeat)):
            out[k].append(x)
    return [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in out]


def document_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Per document row: key, the groups and COUNTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = text_counts(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, counts)], [*names, *COUNTS])

    names = ["key", *(f"g{i}" for i in range(len(groups)))]
    kept = docs.select(F.col(key).alias("key"), *(F.col(g).alias(f"g{i}") for i, g in enumerate(groups)), F.col(text).alias("text"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema[:-1]), *(f"{c} long" for c in COUNTS)])
    return kept.mapInArrow(run, schema)


def _ratio(count: str):
    return F.expr(f"({count} * 1000) div greatest(n_words, 1)")


RATIOS = {"symbol_ratio": "n_symbols", "word_length": "word_chars", "dup_line_ratio": "n_dup_lines", "repeat_ratio": "n_repeat_words"}


def rounded(value):
    """The value rounded down to 6 significant bits."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0)).cast("int")
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return (value - value % unit).cast("long")


def sketches(counts: DataFrame) -> DataFrame:
    """Sketch rows of every level (2: language and source, 1: language, 0: all): level, g0, g1, ratio, value, n."""
    values = F.explode(F.array(*(F.struct(F.lit(r).alias("ratio"), rounded(_ratio(c)).alias("value")) for r, c in RATIOS.items())))
    finest = counts.where(~F.col("base_failed")).select("g0", "g1", values.alias("x")).groupBy("g0", "g1", "x.ratio", "x.value").agg(F.count("*").alias("n"))
    cube = finest.select(F.explode(F.array(
        F.struct(F.lit(2).alias("level"), F.col("g0"), F.col("g1")),
        F.struct(F.lit(1).alias("level"), F.col("g0"), F.lit(None).cast("string").alias("g1")),
        F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("g0"), F.lit(None).cast("string").alias("g1")),
    )).alias("k"), "ratio", "value", "n")
    return cube.groupBy("k.level", "k.g0", "k.g1", "ratio", "value").agg(F.sum("n").alias("n"))


def cutoffs(sketch: DataFrame) -> DataFrame:
    """Per level, group and ratio: total, low and high (null: no cutoff), from the sketch's quartiles."""
    group = Window.partitionBy("level", "g0", "g1", "ratio")
    ranked = sketch.withColumn("upto", F.sum("n").over(group.orderBy("value"))).withColumn("total", F.sum("n").over(group))
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("value")))
    out = ranked.groupBy("level", "g0", "g1", "ratio").agg(F.max("total").alias("total"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    slack = lambda side: F.coalesce(*(F.when(F.col("ratio") == r, F.lit(s[side]).cast("long")) for r, s in SLACK.items()))
    spread = FENCE * (F.col("q3") - F.col("q1"))
    # greatest() skips nulls, so that a side without slack is left out by hand
    return out.select("level", "g0", "g1", "ratio", "total",
        F.when(slack(0).isNotNull(), F.col("q1") - F.greatest(spread, slack(0))).alias("low"),
        F.when(slack(1).isNotNull(), F.col("q3") + F.greatest(spread, slack(1))).alias("high"))


def judge(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per document row: key, COUNTS, base_failed and kept."""
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    counts = storage.materialize(
        document_counts(docs.withColumns({lang: F.col(lang).cast("string"), source: F.col(source).cast("string")}), key=key, text=text, groups=(lang, source)).withColumn("base_failed", base)
    )
    limits = storage.materialize(cutoffs(sketches(counts)))
    # one row a group: the finest level with enough documents, ratio by ratio
    own = limits.where("level = 2").alias("a")
    wide = own.join(limits.where("level = 1").alias("b"), F.col("a.g0").eqNullSafe(F.col("b.g0")) & (F.col("a.ratio") == F.col("b.ratio")), "left").join(limits.where("level = 0").alias("c"), F.col("a.ratio") == F.col("c.ratio"), "left")
    pick = lambda side: F.when(F.col("a.total") >= LEAST_GROUP, F.col(f"a.{side}")).when(F.col("b.total") >= LEAST_GROUP, F.col(f"b.{side}")).otherwise(F.col(f"c.{side}"))
    chosen = wide.groupBy(F.col("a.g0").alias("l0"), F.col("a.g1").alias("l1")).agg(
        *(F.max(F.when(F.col("a.ratio") == r, pick(side))).alias(f"{side}_{r}") for r in RATIOS for side in ("low", "high"))
    )
    joined = counts.join(chosen, F.col("g0").eqNullSafe(F.col("l0")) & F.col("g1").eqNullSafe(F.col("l1")), "left")
    bad = F.lit(False)
    for r, c in RATIOS.items():
        value = rounded(_ratio(c))
        bad = bad | F.coalesce(value > F.col(f"high_{r}"), F.lit(False)) | F.coalesce(value < F.col(f"low_{r}"), F.lit(False))
    return joined.select(F.col("key").alias(key), *COUNTS, "base_failed", (~F.col("base_failed") & ~bad).alias("kept"))
