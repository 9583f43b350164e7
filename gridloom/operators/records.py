"""Record queries: pages with tokens, scan limits, flattening, transposing, consolidation, validation rules, splits by size."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ranges, rows


def _signature(df: DataFrame, keys: list[tuple[str, bool]], query: str) -> str:
    return hashlib.sha256(json.dumps([query, df.schema.simpleString(), keys]).encode()).hexdigest()[:16]


def token(df: DataFrame, keys: list[tuple[str, bool]], query: str, last: tuple) -> str:
    """A continuation token: the query's signature and the key values of a page's last row."""
    return base64.urlsafe_b64encode(json.dumps([_signature(df, keys, query), list(last)], default=str).encode()).decode().rstrip("=")


def page(df: DataFrame, keys: list[tuple[str, bool]], size: int, query: str = "", after: str | None = None) -> DataFrame:
    """The page after a token, or the first one. A token of another query, order or table is rejected. query: text that names the filter."""
    values = None
    if after is not None:
        try:
            signature, values = json.loads(base64.urlsafe_b64decode(after + "=" * (-len(after) % 4)))
        except ValueError as e:
            raise ValueError("not a continuation token") from e
        if signature != _signature(df, keys, query):
            raise ValueError("the token is of another query")
        kinds = {f.name: f.dataType for f in df.schema}
        values = tuple(F.lit(v).cast(kinds[c]) for (c, _), v in zip(keys, values, strict=True))
    return rows.keyset_page(df, keys, size, values)


def scan(df: DataFrame, order: list[tuple[str, bool]], most: int, condition: Column) -> DataFrame:
    """Rows that meet the condition among the first `most` rows of an order: the limit is on what is looked at."""
    return df.orderBy(*(rows.sort_key(c, d) for c, d in order)).limit(most).where(condition)


def top_percent(df: DataFrame, column: str, percent: float, bottom: bool = False) -> DataFrame:
    """The rows with the largest (smallest) values that make up the given part of the rows with a value, at least one; ties of the last stay."""
    if not 0 < percent <= 100:
        raise ValueError("percent: more than 0, 100 at most")
    known = df.where(F.col(column).isNotNull()).count()
    return rows.top_n(df, column, max(1, int(known * percent / 100)), bottom) if known else df.limit(0)


def flatten(df: DataFrame, depth: int = 32) -> DataFrame:
    """Structs as columns with dotted names, down to `depth` levels; arrays and maps stay as they are."""

    def fields(schema: T.StructType, path: tuple[str, ...]):
        for f in schema:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType) and len(here) <= depth:
                yield from fields(f.dataType, here)
            else:
                yield reduce(lambda c, n: c.getField(n), here[1:], F.col(f"`{here[0]}`")).alias(".".join(here))

    return df.select(*fields(df.schema, ()))


def transpose(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One row for each other column, with a column for each of the given key values; cells are text."""
    columns = [c for c in df.columns if c != key]
    cells = rows.unpivot_cells(df.withColumn(key, F.col(key).cast("string")), key, columns)
    return cells.groupBy("column").pivot(key, names).agg(F.first("value", ignorenulls=True))


def consolidate(tables: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """The functions of a data consolidation over the tables' rows: sum, count, average, max, min, product, count_numbers, std_dev, std_dev_p, var, var_p."""
    v = F.col(value)
    return reduce(DataFrame.unionByName, (t.select(*keys, value) for t in tables)).groupBy(*keys).agg(
        F.sum(v).alias("sum"), F.count(v).alias("count"), F.avg(v).alias("average"), F.max(v).alias("max"), F.min(v).alias("min"), F.product(v).alias("product"),
        F.count_if(v.cast("double").isNotNull()).alias("count_numbers"), F.stddev_samp(v).alias("std_dev"), F.stddev_pop(v).alias("std_dev_p"), F.var_samp(v).alias("var"), F.var_pop(v).alias("var_p"))


def criterion(column: str, text: str) -> Column:
    """A criterion such as >=10, <>x or Bran*: an operator, then a number, or text with ? and * as wildcards (~ before one takes it as it is) in any case.

    Without an operand, = is blank and <> is not blank. A blank cell is unequal to any other operand, and neither smaller nor larger.
    """
    sign, operand = re.match(r"(>=|<=|<>|>|<|=)?(.*)", text, re.S).groups()
    blank = rows.is_blank(column)
    if not operand:
        return {"<>": ~blank, "=": blank, None: blank}.get(sign, F.lit(False))
    plain = r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*"
    number = re.fullmatch(plain, operand)
    left, right = (F.when(F.col(column).cast("string").rlike(f"^{plain}$"), F.col(column).try_cast("double")), F.lit(float(operand))) if number else (F.lower(F.col(column).cast("string")), F.lit(operand.lower()))
    if sign in (None, "=", "<>"):
        same = F.coalesce(left == right if number else rows.wildcard(column, operand), F.lit(False)) & ~blank
        return ~same if sign == "<>" else same
    found = {"<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[sign]
    return F.coalesce(found, F.lit(False)) & ~blank


def subtotals_by_field(df: DataFrame, fields: list[str], measures: dict[str, Column]) -> DataFrame:
    """Measures for every combination of the fields, a subtotal for each leading part of them, and the grand total; level: fields that are set."""
    level = sum((F.lit(1) - F.grouping(f).cast("int") for f in fields), F.lit(0))
    return df.rollup(*fields).agg(level.alias("level"), *(m.alias(n) for n, m in measures.items()))


def keep_valid(column: Column, kind: str, low=None, high=None, choices: list | None = None, allow_blank: bool = True) -> Column:
    """Whether a value meets a data validation rule. kind: list, whole, decimal, date or length; low and high bound it."""
    text = F.trim(column.cast("string"))
    value = {"list": text, "whole": text.try_cast("double"), "decimal": text.try_cast("double"), "date": text.try_cast("date"), "length": F.length(column.cast("string"))}[kind]
    met = value.isin(choices or []) if kind == "list" else value.isNotNull()
    if kind == "whole":
        met = met & (value == F.floor(value))
    if kind != "list":
        bound = (lambda x: F.lit(x).cast("date")) if kind == "date" else F.lit
        met = met & (value >= bound(low) if low is not None else F.lit(True)) & (value <= bound(high) if high is not None else F.lit(True))
    blank = column.isNull() | (text == "")
    return F.when(blank, allow_blank).otherwise(F.coalesce(met, F.lit(False)))


def page_ranges(text: str) -> list[tuple[int, int]]:
    """Pages such as 1-3,5 as ranges, in order, overlapping ones joined."""
    found = []
    for part in text.split(","):
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        if not m or int(m[1]) < 1 or int(m[2] or m[1]) < int(m[1]):
            raise ValueError(f"pages: {part.strip()}")
        found.append((int(m[1]), int(m[2] or m[1])))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def select_pages(df: DataFrame, column: str, pages: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, (F.col(column).between(a, b) for a, b in page_ranges(pages))))


def find_text(df: DataFrame, key: str, columns: list[str], text: str) -> DataFrame:
    """One row with the key and column of the first cell, by key then column order, that holds the text in any case; null where none does."""
    at = F.coalesce(*(F.when(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(c)) for c in columns))
    return df.select(F.col(key).alias("key"), at.alias("column")).where("column is not null").agg(F.min(F.struct("key", "column")).alias("x")).select("x.*")


def split_by_size(df: DataFrame, order: str, size: Column, most: int, overhead: int = 0) -> DataFrame:
    """A part number for each row: sizes with overhead are added up along the order (nulls first), and a part ends with each `most` of the sum.

    The sum runs within ranges of the order, to which the totals of those before are added; a null size counts as 1 MiB.
    """
    keys = [F.col(order).asc_nulls_first(), "_tie"]
    sized = df.withColumns({"_size": (F.coalesce(size, F.lit(1 << 20)) + overhead).cast("long"), "_tie": F.monotonically_increasing_id()})
    table, before, starts = ranges.ranged(sized, *keys), 0, []
    for r in ranges.per_range(table, F.sum("_size").alias("total")):
        starts.append((r["_p"], before))
        before += r["total"]
    joined = table.join(df.sparkSession.createDataFrame(starts, "_p int, _before long"), "_p")
    upto = F.sum("_size").over(Window.partitionBy("_p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    return joined.withColumn("part", F.floor((F.col("_before") + F.coalesce(upto, F.lit(0))) / most).cast("long")).drop("_size", "_tie", "_p", "_before")


def json_rows(df: DataFrame, key: str, column: str, depth: int = 8) -> DataFrame:
    """Values of a JSON text as rows: key, path ($.a.b or $[0]), type (object, array, string, number, boolean, null, or json below `depth`) and value (text; null for objects, arrays and null). Text that is no JSON has no rows."""

    def kind(c: Column) -> Column:
        first = F.substring(F.ltrim(c), 1, 1)
        return F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number")

    row = lambda path, json, open_: F.struct(path.alias("path"), F.coalesce(json, F.lit("null")).alias("json"), F.lit(open_).alias("open"))
    level = df.select(F.col(key).alias("key"), F.lit("$").alias("path"), F.to_json(F.try_parse_json(column)).alias("json"), F.lit(True).alias("open")).where("json is not null")
    for _ in range(depth):
        members = F.transform(F.map_entries(F.from_json("json", "map<string,variant>")), lambda e: row(F.concat("path", F.lit("."), e["key"]), F.to_json(e["value"]), True))
        items = F.transform(F.from_json("json", "array<variant>"), lambda v, i: row(F.concat("path", F.lit("["), i.cast("string"), F.lit("]")), F.to_json(v), True))
        own, first = F.array(row(F.col("path"), F.col("json"), False)), kind(F.col("json"))
        within = F.when(F.col("open") & (first == "object"), F.concat(own, members)).when(F.col("open") & (first == "array"), F.concat(own, items)).otherwise(own)
        level = level.select("key", F.explode(within).alias("x")).select("key", "x.*")
    found = F.when(F.col("open") & kind(F.col("json")).isin("object", "array"), "json").otherwise(kind(F.col("json")))
    text = F.when(F.col("type") == "string", F.get_json_object(F.concat(F.lit('{"v":'), "json", F.lit("}")), "$.v")).when(~F.col("type").isin("object", "array", "null"), F.col("json"))
    return level.withColumn("type", found).select("key", "path", "type", text.alias("value"))


def reminder_state(active: Column, signal: Column, as_of: Column) -> Column:
    """Disabled, ActiveWithoutSignalTime, Overdue (the signal time is reached) or Pending."""
    return F.when(~F.coalesce(active, F.lit(False)), "Disabled").when(signal.isNull(), "ActiveWithoutSignalTime").when(signal <= as_of, "Overdue").otherwise("Pending")


def validation_rule(column: Column, kind: str, operator: str = "between", first=None, second=None, *, choices: list | None = None, ignore_case: bool = True, custom: Column | None = None, allow_blank: bool = True) -> Column:
    """Whether a cell meets a rule of data validation. kind: any, list, whole, decimal, date, time, length or custom (a condition); operator: between, not_between, eq, ne, gt, lt, ge or le, with one or two operands."""
    text = F.trim(column.cast("string"))
    blank = column.isNull() | (text == "")
    if kind == "any":
        return F.lit(True)
    if kind == "custom":
        met = custom
    elif kind == "list":
        met = F.upper(text).isin([str(c).strip().upper() for c in choices or []]) if ignore_case else text.isin([str(c).strip() for c in choices or []])
    else:
        plain = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
        clock = F.concat(F.lit("1970-01-01 "), text)
        value = {
            "whole": F.when(text.rlike(plain), text.try_cast("double")), "decimal": F.when(text.rlike(plain), text.try_cast("double")), "date": text.try_cast("timestamp"),
            "time": F.when(text.rlike(r"^\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?$"), clock.try_cast("timestamp")), "length": F.length(column.cast("string")),
        }[kind]
        operand = {"date": lambda x: F.lit(x).cast("timestamp"), "time": lambda x: F.lit(f"1970-01-01 {x}").cast("timestamp")}.get(kind, F.lit)
        if first is None or (second is None) == operator.endswith("between"):
            raise ValueError(f"operands of {operator}")
        a = operand(first)
        b = operand(second) if second is not None else None
        met = {
            "between": lambda: (value >= a) & (value <= b), "not_between": lambda: (value < a) | (value > b), "eq": lambda: value == a, "ne": lambda: value != a, "gt": lambda: value > a, "lt": lambda: value < a, "ge": lambda: value >= a, "le": lambda: value <= a,
        }[operator]()
        if kind == "whole":
            met = met & (value == F.floor(value))
    return F.when(blank, allow_blank).otherwise(F.coalesce(met, F.lit(False)))
