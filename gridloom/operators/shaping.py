"""Shapes of tables: projections, schema rows, appending, types found in text, candidates attached, and mail as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import documents, rows


def project(df: DataFrame, *, include: list[str] | None = None, exclude: tuple[str, ...] = (), first: tuple[str, ...] = (), rename: dict[str, str] | None = None, formats: dict[str, str] | None = None) -> DataFrame:
    """Columns that are included and not excluded, `first` ones first, renamed, and numbers and times as text by a format (#,##0.00 or yyyy-MM-dd). Names that are not there, or would stand twice, are rejected."""
    taken = [c for c in include or df.columns if c not in exclude]
    asked = [*(include or ()), *exclude, *first, *(rename or {}), *(formats or {})]
    if lacking := [c for c in asked if c not in df.columns]:
        raise ValueError(f"no columns {', '.join(lacking)}")
    ordered = [*(c for c in first if c in taken), *(c for c in taken if c not in first)]
    names = [(rename or {}).get(c, c) for c in ordered]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("column names would stand twice")

    def shown(c: str) -> Column:
        pattern = (formats or {}).get(c)
        if not pattern:
            return F.col(f"`{c}`")
        timed = isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        return F.date_format(F.col(f"`{c}`"), pattern) if timed else F.call_function("format_number", F.col(f"`{c}`"), F.lit(pattern))

    return df.select(*(shown(c).alias(n) for c, n in zip(ordered, names, strict=True)))


def schema_rows(df: DataFrame) -> DataFrame:
    """A row for each column: name, ordinal (from 0), type, size (-1: no bound), nullable and is_unique (not known, so false)."""
    told = [(f.name, k, f.dataType.simpleString(), -1, f.nullable, False) for k, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(told, "name string, ordinal int, type string, size int, nullable boolean, is_unique boolean")


def merge_sheets(sheets: dict[str, DataFrame], *, only: list[str] | None = None, prefix: str = "", label: str = "sheet") -> DataFrame:
    """Sheets, or those that are named, as one table by header, in the order given, with each row's sheet under a prefix. A name that is not there is rejected."""
    names = only if only is not None else list(sheets)
    if lacking := [n for n in names if n not in sheets]:
        raise ValueError(f"no sheets {', '.join(lacking)}")
    return rows.merge_by_header(*(sheets[n] for n in names), label=label, names=tuple(prefix + n for n in names))


def append_rows(table: DataFrame, more: DataFrame) -> DataFrame:
    """Rows behind a table's, by header in any case, with its types; columns that they lack are null. Columns that the table has not, or text that fits no type of it, are rejected."""
    have = {c.lower(): c for c in more.columns}
    if extra := [c for c in more.columns if c.lower() not in {n.lower() for n in table.columns}]:
        raise ValueError(f"the table has no columns {', '.join(extra)}")

    def cell(f: T.StructField) -> Column:
        if f.name.lower() not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f"`{have[f.name.lower()]}`")
        fits = c.try_cast(f.dataType)
        told = F.concat(F.lit(f"{f.name}: no {f.dataType.simpleString()}: "), c.cast("string"))
        return F.when(c.isNotNull() & fits.isNull(), F.raise_error(told).cast(f.dataType)).otherwise(fits).alias(f.name)

    return table.union(more.select(*map(cell, table.schema)))


def typed(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text columns as the narrowest type that all of their values fit: boolean, int, long, decimal-free double, date, timestamp, else text. All rows are looked at, in one pass; blank cells are null, a column of blanks stays text. Numbers with a zero before other digits stay text."""
    asked = [c for c in columns or df.columns if isinstance(df.schema[c].dataType, T.StringType)]
    if not asked:
        return df
    cell = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    whole, number, date = r"^[+-]?(0|[1-9]\d*)$", r"^[+-]?(0|[1-9]\d*)?(\.\d+)?([eE][+-]?\d+)?$", r"^\d{4}-\d{2}-\d{2}$"
    tests = {
        "boolean": lambda x: F.lower(x).isin("true", "false"), "int": lambda x: x.rlike(whole) & x.try_cast("int").isNotNull(), "bigint": lambda x: x.rlike(whole) & x.try_cast("bigint").isNotNull(), "double": lambda x: x.rlike(number) & x.rlike(r"\d") & x.try_cast("double").isNotNull(),
        "date": lambda x: x.rlike(date) & x.try_cast("date").isNotNull(), "timestamp": lambda x: x.rlike(date[:-1]) & x.try_cast("timestamp").isNotNull(),
    }
    counted = df.agg(*(F.count(cell(c)).alias(f"{k}") for k, c in enumerate(asked)), *(F.count_if(test(cell(c))).alias(f"{k}:{kind}") for k, c in enumerate(asked) for kind, test in tests.items())).first()
    kinds = {c: next((kind for kind in tests if counted[f"{k}"] and counted[f"{k}:{kind}"] == counted[f"{k}"]), "string") for k, c in enumerate(asked)}
    return df.withColumns({c: cell(c).cast(kind) for c, kind in kinds.items() if kind != "string"})


def attach(df: DataFrame, candidates: DataFrame, on: list[str], order: list[str], name: str = "candidates") -> DataFrame:
    """Rows with the candidates of the same container (columns `on`, of which null meets nothing), in order, as an array of structs; empty where there is none."""
    rest = [c for c in candidates.columns if c not in on]
    key = F.struct(*(F.col(c) for c in order), *(F.col(c) for c in rest if c not in order))
    listed = candidates.groupBy(*on).agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: F.struct(*(x[c].alias(c) for c in rest))).alias(name))
    none = F.array().cast(listed.schema[name].dataType)
    return df.join(listed, on, "left").withColumn(name, F.coalesce(name, none))


def content_search(df: DataFrame, key: str, fields: list[str], terms: list[str], *, match_all: bool = False, where: Column | None = None, width: int = 60) -> DataFrame:
    """Rows where any term, or each in whatever field, occurs, ignoring case: key, matched (fields with a term), field (the first of them) and snippet (of it, around its earliest term). `where` is judged first. 1 to 32 terms of 1,024 letters at most."""
    wanted = list(dict.fromkeys(documents.folded(t.strip()) for t in terms if t and t.strip()))
    if not 1 <= len(wanted) <= 32 or any(len(t) > 1024 for t in wanted):
        raise ValueError("1 to 32 terms, of 1,024 letters at most")
    has = lambda f, t: F.coalesce(F.rlike(f, F.lit(documents.in_any_case(t))), F.lit(False))
    either = lambda conditions: reduce(lambda a, b: a | b, conditions)
    each = [either([has(f, t) for f in fields]) for t in wanted]
    found = (df.where(where) if where is not None else df).where(reduce(lambda a, b: a & b, each) if match_all else either(each))
    matched = F.array_compact(F.array(*(F.when(either([has(f, t) for t in wanted]), F.lit(f)) for f in fields)))
    picked = found.withColumn("matched", matched).withColumn("field", F.get("matched", F.lit(0)))
    text = F.coalesce(*(F.when(F.col("field") == f, F.col(f)) for f in fields))
    told = picked.select(key, "matched", "field", text.alias("_text"))
    return documents.search(told, ["_text"], terms, False, width).select(key, "matched", "field", "snippet")


def mbox_lines(messages: DataFrame, order: str) -> DataFrame:
    """Messages (folder, sender, sent, subject, body) as the text of mailboxes: folder, order and text, each a `From ` line, headers, a blank line and the body, in which lines such as `From ` and `>From ` have one > more."""
    clean = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " ")
    body = F.regexp_replace(F.regexp_replace(F.coalesce("body", F.lit("")), r"\r\n?", "\n"), r"(?m)^(>*From )", ">$1")
    sent = F.date_format(F.coalesce("sent", F.lit(0).cast("timestamp")), "EEE MMM dd HH:mm:ss yyyy")
    who = F.coalesce(F.nullif(F.regexp_replace(clean("sender"), " ", ""), F.lit("")), F.lit("MAILER-DAEMON"))
    text = F.concat(F.lit("From "), who, F.lit(" "), sent, F.lit("\nFrom: "), clean("sender"), F.lit("\nSubject: "), clean("subject"), F.lit("\n\n"), body, F.lit("\n"))
    return messages.select("folder", order, text.alias("text"))


def write_mbox(messages: DataFrame, path: str, order: str) -> None:
    """One folder of files for each mail folder, each file in order; a mail folder of very many messages has several files."""
    made = mbox_lines(messages, order)
    made.repartitionByRange("folder", order).sortWithinPartitions("folder", order).select("folder", F.col("text").alias("value")).write.partitionBy("folder").text(path)
