"""Records of delimited text with their positions, found in parallel.

A line feed within quotes does not end a record, so that whether a line begins
a record depends on all lines before it. Each line is a function of that state
(within quotes or not) to the state behind it, and so is each block of a file;
such functions are put together by windows: first within blocks, then over the
blocks of a file, of which there are few. No file passes one task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Grammar:
    """Patterns of fields for a separator and a quote. A field that begins with a quote runs to the next single one; what then stands before the separator belongs to it."""

    def __init__(self, sep: str = ",") -> None:
        if len(sep) != 1 or sep in '"\r\n':
            raise ValueError("the separator is one character, no quote and no line end")
        s, quoted = re.escape(sep), '"[^"]*+(?:""[^"]*+)*+'
        other = f"[^{s}]*+"
        before = f'(?:(?:{quoted}"{other}|(?!"){other}){s})*+'
        #: A line, begun outside quotes, that ends within them.
        self.opens = f"^{before}{quoted}\\z"
        #: A line, begun within quotes, that ends within them: without an end of them, or with new ones.
        self.stays = f'^[^"]*+(?:""[^"]*+)*+(?:"{other}{s}{before}{quoted})?+\\z'
        #: A record of which each quoted field is whole and the others have no quote.
        strict = f'(?:{quoted}"|[^{s}"]*+)'
        self.strict = f"^{strict}(?:{s}{strict})*+\\z"
        self.field, self.sep = f"{s}({quoted}\"{other}|{quoted}|{other})", sep
        self.inner = f'(?s)^"([^"]*+(?:""[^"]*+)*+)"?(.*)\\z'

    def fields(self, record: Column) -> Column:
        """The fields of a record; quotes are taken off, doubled ones within them are one."""
        parts = F.regexp_extract_all(F.concat(F.lit(self.sep), record), F.lit(self.field), F.lit(1))
        plain = lambda f: F.concat(F.replace(F.regexp_extract(f, self.inner, 1), F.lit('""'), F.lit('"')), F.regexp_extract(f, self.inner, 2))
        return F.transform(parts, lambda f: F.when(F.startswith(f, F.lit('"')), plain(f)).otherwise(f))

    def problem(self, record: Column) -> Column:
        """What strict quoting finds wrong with a record, null for nothing."""
        return F.when(record.rlike(self.opens), "a quote is not closed").when(~record.rlike(self.strict), "a quote within a field that is not quoted, or text behind a closing quote")


def _lines(spark: SparkSession, path: str, grammar: Grammar, comment: str | None) -> DataFrame:
    """Lines by file, block and their order, with what they make of a state: to which it goes from outside, and whether it is turned or set."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    noted = F.startswith("value", F.lit(comment)) if comment else F.lit(False)
    outside, inside = (F.col("value").rlike(grammar.opens) & ~noted).cast("int"), F.col("value").rlike(grammar.stays).cast("int")
    found = read.withColumns({"outside": outside, "inside": inside, "begins": F.col("value").rlike(r"[^\x00-\x20]") & ~noted})
    w = Window.partitionBy("file", "block").orderBy("id")
    turned = found.withColumn("turns", F.sum(F.when(F.col("outside") > F.col("inside"), 1).otherwise(0)).over(w))
    # the state behind a line: what the last line that sets it has set, or what it was before the block, turned as often since
    held = turned.withColumn("held", F.last(F.when(F.col("outside") == F.col("inside"), F.pmod(F.col("outside") + F.col("turns"), F.lit(2))), ignorenulls=True).over(w))
    return held.withColumns({"line": F.row_number().over(w), "turns_before": F.coalesce(F.lag("turns").over(w), F.lit(0)), "held_before": F.lag("held").over(w)})


def _within(entry: Column) -> Column:
    """Whether a line begins within quotes, from the state before its block."""
    return F.pmod(F.coalesce("held_before", entry) + F.col("turns_before"), F.lit(2)) == 1


def _blocks(lines: DataFrame) -> DataFrame:
    """Per block: the state before it, and the lines and records before it in its file."""
    begun = lambda entry: F.count_if(~_within(F.lit(entry)) & F.col("begins"))
    each = lines.groupBy("file", "block").agg(F.count("*").alias("lines"), F.max("turns").alias("turns"), F.max_by("held", "id").alias("held"), begun(0).alias("records0"), begun(1).alias("records1"))
    w = Window.partitionBy("file").orderBy("block")
    turned = each.withColumn("all_turns", F.sum("turns").over(w))
    held = F.last(F.when(F.col("held").isNotNull(), F.pmod(F.col("held") + F.col("turns") + F.col("all_turns"), F.lit(2))), ignorenulls=True).over(w)
    behind = turned.withColumn("behind", F.pmod(F.coalesce(held, F.lit(0)) + F.col("all_turns"), F.lit(2)))
    entered = behind.withColumn("entry", F.coalesce(F.lag("behind").over(w), F.lit(0)))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    records = F.when(F.col("entry") == 0, F.col("records0")).otherwise(F.col("records1"))
    return entered.select("file", "block", "entry", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("lines_before"), F.coalesce(F.sum(records).over(before), F.lit(0)).alias("records_before"))


def records(spark: SparkSession, path: str, *, sep: str = ",", strict: bool = False, on_error: str = "keep", comment: str | None = None, skip: int = 0) -> DataFrame:
    """The records of files: file, record_number (from 1, in the file), start_line, end_line, record, fields and problem.

    Blank lines and, if a prefix is given, comment lines are no records, nor are
    the first `skip` of a file. Line ends within quotes are line feeds in the
    record. strict: a record that quotes wrongly has a problem, and on_error is keep,
    skip or fail; without it, such a record is read as well as can be and
    problem is null.
    """
    if on_error not in ("keep", "skip", "fail"):
        raise ValueError("on_error: keep, skip or fail")
    grammar = Grammar(sep)
    lines = _lines(spark, path, grammar, comment)
    placed = lines.join(_blocks(lines), ["file", "block"])
    starts = ~_within(F.col("entry")) & F.col("begins")
    number = F.col("records_before") + F.sum(starts.cast("long")).over(Window.partitionBy("file", "block").orderBy("id"))
    belongs = starts | _within(F.col("entry"))
    kept = placed.withColumns({"number": number, "line": F.col("line") + F.col("lines_before")}).where(belongs)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n")
    found = kept.groupBy("file", "number").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), text.alias("record")).where(F.col("number") > skip)
    out = found.select("file", (F.col("number") - skip).alias("record_number"), "start_line", "end_line", "record", grammar.fields(F.col("record")).alias("fields"), (grammar.problem(F.col("record")) if strict else F.lit(None).cast("string")).alias("problem"))
    if on_error == "skip":
        return out.where("problem is null")
    if on_error == "fail":
        told = F.concat(F.col("file"), F.lit(", line "), F.col("start_line").cast("string"), F.lit(": "), F.col("problem"))
        return out.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(told)).cast("string")).where("problem is null")
    return out


def rows(found: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records as (rows of the schema; those that do not fit it: file, record_number, start_line, end_line, record and message).

    Every column must have its field and be of its kind. An empty field is null, but for text.
    """
    wanted = found.sparkSession.createDataFrame([], schema).schema
    n = len(wanted)
    cell = lambda i: F.try_element_at("fields", F.lit(i + 1))
    value = [F.coalesce(cell(i), F.lit("")) if f.dataType.simpleString() == "string" else F.nullif(F.trim(cell(i)), F.lit("")).try_cast(f.dataType) for i, f in enumerate(wanted)]
    message = F.coalesce(
        F.col("problem"),
        F.when(F.size("fields") < n, F.concat(F.lit(f"too few fields: {n} are wanted, there are "), F.size("fields").cast("string"))),
        F.when(F.size("fields") > n, F.concat(F.lit(f"too many fields: {n} are wanted, there are "), F.size("fields").cast("string"))),
        *(F.when((F.trim(cell(i)) != "") & v.isNull(), f"{f.name}: no {f.dataType.simpleString()}") for i, (f, v) in enumerate(zip(wanted, value, strict=True))),
    )
    judged = found.withColumn("message", message)
    return judged.where("message is null").select(*(v.alias(f.name) for v, f in zip(value, wanted, strict=True))), judged.where("message is not null").select("file", "record_number", "start_line", "end_line", "record", "message")
