"""Delimited files: header rules, delimiter sniffing, ragged rows, and writing with the escape of formulas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import delimited

DELIMITERS = (",", ";", "\t", "|")


def unique_headers(names: list[str | None]) -> list[str]:
    """Blank names become H and their position, or the next number that is free; a repeated name gets the next free _n, from 2."""
    plain: list[str] = []
    given = {(n or "").strip() for n in names}
    for i, n in enumerate(names, 1):
        name = (n or "").strip()
        while not name or (not (n or "").strip() and (name in given or name in plain)):
            name, i = f"H{i}", i + 1
        plain.append(name)
    taken, used, out = set(plain), set(), []
    for n in plain:
        name, k = n, 2
        while name in used or (name != n and name in taken):
            name, k = f"{n}_{k}", k + 1
        used.add(name)
        out.append(name)
    return out


def detect_delimiter(lines: list[str]) -> str:
    """The delimiter with the most even, non-zero count outside quotes over the first lines."""
    bare = [re.sub(r'"[^"]*"?', "", x) for x in lines]

    def weight(d: str) -> tuple[int, int]:
        counts = [b.count(d) for b, x in zip(bare, lines, strict=True) if x.strip()]
        return (0, 0) if not counts or not min(counts) else (sum(c == counts[0] for c in counts), counts[0])

    return max(DELIMITERS, key=weight)


def read(spark: SparkSession, path: str, *, schema: T.StructType | None = None, sep: str | None = None, header: bool = True, strict: bool = False, null_value: str | None = None, constants: dict[str, object] | None = None, names: list[str] | None = None, multiline: bool = False) -> DataFrame:
    """A CSV table: all columns text unless a schema is given; missing trailing fields are empty texts, extra ones are left out; strict fails on either.

    multiline: line feeds within quotes, at the cost of one task for each file. names: column names of a file without a header.
    """
    sep = sep or detect_delimiter([r.value for r in spark.read.text(path).limit(20).collect()])
    options = {"sep": sep, "escape": '"', "multiLine": multiline, "mode": "FAILFAST" if strict else "PERMISSIVE", "enforceSchema": True}
    if null_value is not None:
        options["nullValue"] = null_value
    if schema is None and names is not None:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in unique_headers(names)])
    if schema is None:
        first = spark.read.options(**(options | {"mode": "PERMISSIVE"})).csv(path).first()
        names = unique_headers(list(first)) if header and first else [f"H{i}" for i in range(1, len(first or []) + 1)]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.options(header=header, **options).schema(schema).csv(path)
    if null_value is None:
        df = df.withColumns({f.name: F.coalesce(F.col(f.name), F.lit("")) for f in schema if isinstance(f.dataType, T.StringType)})
    for name, value in (constants or {}).items():
        df = df.withColumn(name, F.lit(value))
    return df


def read_with_errors(spark: SparkSession, path: str, schema: str, *, sep: str = ",", header: bool = True, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows that fit the schema, records that do not: file, record_number, start_line, end_line, record, message). Of every file with a header the first record is left out."""
    return delimited.rows(delimited.records(spark, path, sep=sep, strict=strict, skip=int(header)), schema)


def read_w3c(spark: SparkSession, path: str) -> DataFrame:
    """A log whose comment line `#Fields: a b c` names the space-delimited columns; all text, - is null."""
    lines = spark.read.text(path)
    header = lines.where(F.col("value").startswith("#Fields:")).first()
    if header is None:
        raise ValueError("no line #Fields:")
    names = unique_headers(header["value"][8:].split())
    parts = F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(len(names)))), {"sep": " ", "nullValue": "-"})
    return lines.where(~F.col("value").startswith("#")).select(parts.alias("f")).select(*(F.col(f"f.c{i}").alias(n) for i, n in enumerate(names)))


def escape_formulas(column: Column) -> Column:
    """A text that a spreadsheet would run as a formula, with an apostrophe before it."""
    return F.when(column.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), column)).otherwise(column)


def write(df: DataFrame, path: str, *, sep: str = ",", quote_all: bool = False, escape: bool = False, mode: str = "errorifexists", compression: str = "none", null_value: str = "") -> None:
    if escape:
        df = df.withColumns({f.name: escape_formulas(F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.StringType)})
    df.write.mode(mode).options(sep=sep, header=True, quoteAll=quote_all, escape='"', compression=compression, nullValue=null_value, emptyValue="").csv(path)


def line(df: DataFrame, *, sep: str = ",", quote: str = "needed", quote_fields: tuple[str, ...] = (), null_value: str = "", date_format: str | None = None, escape: bool = False) -> Column:
    """A row as a line of text. quote: needed (a separator, quote or line end in the field's text, of whatever type), always or never; quote_fields are quoted in any case."""
    if quote not in ("needed", "always", "never"):
        raise ValueError("quote: needed, always or never")

    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        text = F.date_format(c, date_format) if date_format and isinstance(f.dataType, (T.DateType, T.TimestampType)) else c.cast("string")
        text = escape_formulas(text) if escape and isinstance(f.dataType, T.StringType) else text
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        must = F.lit(True) if quote == "always" or f.name in quote_fields else text.rlike(f"[{re.escape(sep)}\"\r\n]") if quote == "needed" else F.lit(False)
        return F.when(c.isNull(), null_value).when(must, quoted).otherwise(text)

    return F.array_join(F.array(*map(one, df.schema)), sep)


def write_lines(df: DataFrame, path: str, *, header: bool = True, order: list[str] | None = None, mode: str = "errorifexists", **options) -> None:
    """Write lines as line() makes them, each file with a header, the only line of an empty table. With an order, files by their names and lines in them are in that order, written by as many tasks as there are ranges."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    top = options.get("sep", ",").join(df.columns)
    made = df.select(line(df, **options).alias("value"))
    if header:
        # the first row of a task begins its file
        first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
        made = made.select(F.when(first, F.concat(F.lit(top + "\n"), "value")).otherwise(F.col("value")).alias("value"))
        if df.isEmpty():
            made = df.sparkSession.createDataFrame([(top,)], "value string").coalesce(1)
    made.write.mode(mode).text(path)
