"""Row operators: validation, filters by spreadsheet rules, sorting, paging, top-N and merging."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def validate(df: DataFrame, key: str, rules: dict[str, list[tuple[str, Column]]], required: tuple[str, ...] = (), defaults: dict[str, object] | None = None) -> DataFrame:
    """One row per failed check: key, column, message. Defaults fill in before the required check; nulls pass other rules."""
    for name, value in (defaults or {}).items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    checks = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.struct(F.lit(c).alias("column"), F.lit("required").alias("message"))) for c in required]
    checks += [F.when(F.col(c).isNotNull() & ~ok, F.struct(F.lit(c).alias("column"), F.lit(message).alias("message"))) for c, own in rules.items() for message, ok in own]
    return df.select(F.col(key), F.explode(F.array_compact(F.array(*checks))).alias("e")).select(key, "e.column", "e.message")


def is_blank(column: str) -> Column:
    return F.col(column).isNull() | (F.trim(F.col(column).cast("string")) == "")


def blank_or(column: str, value) -> Column:
    """Blank, or equal to one value."""
    return is_blank(column) | (F.col(column) == F.lit(value))


def custom(conditions: list[Column], match_all: bool) -> Column:
    """One or two conditions, joined by and or by or."""
    return reduce(lambda a, b: (a & b) if match_all else (a | b), conditions)


def compare(column: str, operator: str, *values) -> Column:
    """A typed comparison that is never null: eq, ne, lt, le, gt, ge, in, between, null or not_null. A null value only meets null and ne."""
    c, v = F.col(column), [F.lit(x) for x in values]
    found = {
        "eq": lambda: c == v[0], "ne": lambda: ~c.eqNullSafe(v[0]), "lt": lambda: c < v[0], "le": lambda: c <= v[0], "gt": lambda: c > v[0], "ge": lambda: c >= v[0],
        "in": lambda: c.isin(list(values)), "between": lambda: c.between(v[0], v[1]), "null": lambda: c.isNull(), "not_null": lambda: c.isNotNull(),
    }[operator]()
    return F.coalesce(found, F.lit(False))


def map_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns (name: type), each from the column whose name is the same but for case, spaces and punctuation; null where there is none or the text does not fit the type."""
    plain = lambda n: "".join(x for x in n.lower() if x.isalnum())
    have: dict[str, str] = {}
    for c in df.columns:
        have.setdefault(plain(c), c)
    found = {n: have.get(plain(n)) for n in wanted}
    return df.select(*((F.col(f"`{found[n]}`").cast("string").try_cast(kind) if found[n] else F.lit(None).cast(kind)).alias(n) for n, kind in wanted.items()))


def map_explicit(df: DataFrame, mapping: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns (target: (source, type)) by the sources' exact names, or else their names in any case. A source that is not there, or that several columns could be, is rejected; so is text that does not fit its type, when it is read."""
    out, placed = [], df.toDF(*(f"_{k}" for k in range(len(df.columns))))  # by place, as names may differ in case alone
    for target, (source, kind) in mapping.items():
        found = [c for c in df.columns if c == source] or [c for c in df.columns if c.lower() == source.lower()]
        if not found:
            raise ValueError(f"no column {source}; there are {', '.join(df.columns)}")
        if len(found) > 1:
            raise ValueError(f"column {source} is ambiguous: {', '.join(found)}")
        c = F.col(f"_{df.columns.index(found[0])}")
        fits = F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast(kind) if kind != "string" else c.cast("string")
        bad = F.coalesce(F.trim(c.cast("string")) != "", F.lit(False)) & fits.isNull()
        out.append(F.when(bad, F.raise_error(F.concat(F.lit(f"{target}: no {kind}: "), c.cast("string"))).cast(kind)).otherwise(fits).alias(target))
    return placed.select(*out)


def convert(df: DataFrame, key: str, converters: dict[str, tuple[str, Callable[[Column], Column]]], *, defaults: dict[str, object] | None = None, redact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with converted columns; failures: key, column, kind, value). A converter (kind, function) fails where it makes null of a value that is not blank; such rows are among the failures only. Blank values take their default, or null. redact: failures tell no values."""
    made = {n: f(F.col(n)).cast(kind) for n, (kind, f) in converters.items()}
    lacks = {n: is_blank(n) for n in converters}
    failed = F.array_compact(F.array(*(F.when(~lacks[n] & made[n].isNull(), F.struct(F.lit(n).alias("column"), F.lit(converters[n][0]).alias("kind"), (F.lit("(redacted)") if redact else F.col(n).cast("string")).alias("value"))) for n in converters)))
    judged = df.withColumn("_failed", failed)
    filled = {n: F.when(lacks[n], F.lit((defaults or {}).get(n)).cast(converters[n][0])).otherwise(made[n]) for n in converters}
    bad = judged.where(F.size("_failed") > 0).select(key, F.explode("_failed").alias("x")).select(key, "x.*")
    return judged.where(F.size("_failed") == 0).drop("_failed").withColumns(filled), bad


def change_columns(df: DataFrame, renames: dict[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """Columns renamed and dropped; a name that would stand twice, in any case, is rejected."""
    names = [renames.get(c, c) for c in df.columns if c not in drop]
    if len({n.lower() for n in names}) < len(names) or not set(renames) | set(drop) <= set(df.columns):
        raise ValueError("column names must be there, and be unique after the change")
    return df.select(*(F.col(f"`{c}`").alias(renames.get(c, c)) for c in df.columns if c not in drop))


def append_by_position(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of tables of one width, under the first one's names."""
    if any(len(o.columns) != len(first.columns) for o in others):
        raise ValueError("tables of different widths")
    return reduce(DataFrame.union, others, first)


def in_timeline(column: str, level: str, year: int, part: int = 1) -> Column:
    """Whether a time is in the year, or in its quarter, month or day (of the year) `part`."""
    if level == "day":
        start = F.date_add(F.make_date(F.lit(year), F.lit(1), F.lit(1)), part - 1)
        return (F.col(column) >= start) & (F.col(column) < F.date_add(start, 1))
    months = {"year": 12, "quarter": 3, "month": 1}[level]
    start = F.add_months(F.make_date(F.lit(year), F.lit(1), F.lit(1)), months * (part - 1))
    return (F.col(column) >= start) & (F.col(column) < F.add_months(start, months))


def wildcard(column: str, pattern: str) -> Column:
    """Whole-text match of * and ?, with ~ as escape, ignoring case."""
    out, escaped = "", False
    for c in pattern.upper():
        if c == "~" and not escaped:
            escaped = True
            continue
        out += "\\" + c if c in "%_\\" else c if escaped else {"*": "%", "?": "_"}.get(c, c)
        escaped = False
    return F.upper(F.col(column)).like(out)


def text_rule(column: str, kind: str, text: str) -> Column:
    """contains, not_contains, begins or ends, ignoring case; an empty text matches nothing."""
    if not text:
        return F.lit(False)
    c, t = F.upper(F.coalesce(F.col(column), F.lit(""))), F.lit(text.upper())
    return {"contains": c.contains(t), "not_contains": ~c.contains(t), "begins": c.startswith(t), "ends": c.endswith(t)}[kind]


def date_group(column: str, year: int, month: int | None = None, day: int | None = None) -> Column:
    """A half-open range of a year, month or day."""
    start = F.make_date(F.lit(year), F.lit(month or 1), F.lit(day or 1))
    end = F.date_add(start, 1) if day else F.add_months(start, 1 if month else 12)
    c = F.col(column)
    return (c >= start.cast("timestamp")) & (c < end.cast("timestamp"))


def time_period(column: str, as_of: str, period: str) -> Column:
    """yesterday, today, tomorrow, last7days and last_, this_ or next_ week (from Monday) or month, as of a date."""
    day = F.to_date(F.lit(as_of))
    week, month = F.trunc(day, "WEEK"), F.trunc(day, "MONTH")
    start, end = {
        "yesterday": (F.date_sub(day, 1), day), "today": (day, F.date_add(day, 1)), "tomorrow": (F.date_add(day, 1), F.date_add(day, 2)), "last7days": (F.date_sub(day, 6), F.date_add(day, 1)),
        "last_week": (F.date_sub(week, 7), week), "this_week": (week, F.date_add(week, 7)), "next_week": (F.date_add(week, 7), F.date_add(week, 14)),
        "last_month": (F.add_months(month, -1), month), "this_month": (month, F.add_months(month, 1)), "next_month": (F.add_months(month, 1), F.add_months(month, 2)),
    }[period]
    return (F.col(column) >= start) & (F.col(column) < end)  # half-open bounds of the column itself, which a scan can use


def first_match(rules: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for name, condition in reversed(rules):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def sort_key(column: str, descending: bool = False, nulls_last: bool | None = None, ignore_case: bool = False) -> Column:
    """Nulls are least, as in a sheet, unless their place is given independently of the direction."""
    c = F.upper(column) if ignore_case else F.col(column)
    last = descending if nulls_last is None else nulls_last
    return (c.desc_nulls_last() if last else c.desc_nulls_first()) if descending else (c.asc_nulls_last() if last else c.asc_nulls_first())


def sort_cells(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Sort by a column of cells as text: as numbers where all cells are, as dates where all are, else as text in any case. Empty cells are nulls, which are least; a column that is not there changes nothing."""
    if column not in df.columns:
        return df
    cell = F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
    number = F.when(cell.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), cell.try_cast("double"))
    kinds = df.agg(F.count(cell).alias("all"), F.count(number).alias("numbers"), F.count(cell.try_cast("timestamp")).alias("dates")).first()
    key = number if kinds["numbers"] == kinds["all"] else cell.try_cast("timestamp") if kinds["dates"] == kinds["all"] else F.upper(cell)
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first())


def sort_by(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """Sort by (column, descending); unknown columns are left out."""
    known = [(c, d) for c, d in keys if c in df.columns]
    return df.orderBy(*(sort_key(c, d) for c, d in known)) if known else df


def keyset_page(df: DataFrame, keys: list[tuple[str, bool]], size: int, after: tuple | None = None) -> DataFrame:
    """The page of rows strictly after the given key values, with has_more; one row beyond the page is looked at. Keys must be unique and not null."""
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for (c, descending), value in zip(keys, after, strict=True):
            beyond = beyond | (equal & ((F.col(c) < F.lit(value)) if descending else (F.col(c) > F.lit(value))))
            equal = equal & (F.col(c) == F.lit(value))
        df = df.where(beyond)
    order = [F.col(c).desc() if d else F.col(c).asc() for c, d in keys]
    taken = df.orderBy(*order).limit(size + 1)
    ranked = taken.withColumn("_rn", F.row_number().over(Window.orderBy(*order))).withColumn("has_more", F.count("*").over(Window.partitionBy()) > size)
    return ranked.where(F.col("_rn") <= size).drop("_rn")


def top_n(df: DataFrame, column: str, n: int, bottom: bool = False) -> DataFrame:
    """Rows not beyond the n-th largest (smallest) value; ties stay. Only the bound passes one task, not the rows."""
    order = F.col(column).asc() if bottom else F.col(column).desc()
    edge = df.where(F.col(column).isNotNull()).select(column).orderBy(order).limit(n).agg((F.max if bottom else F.min)(column).alias("_edge"))
    kept = F.col(column) <= F.col("_edge") if bottom else F.col(column) >= F.col("_edge")
    return df.join(F.broadcast(edge), kept).drop("_edge")


def merge_by_header(*tables: DataFrame, label: str = "sheet", names: tuple[str, ...] = ()) -> DataFrame:
    """Append by column name; columns that a table lacks are null."""
    named = [t.withColumn(label, F.lit(n)) for t, n in zip(tables, names or [str(i) for i in range(len(tables))], strict=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def first_by_id(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each id; rows with a blank id all stay."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    # blank ids apart: they would all meet in one window
    return df.where(~is_blank(key)).withColumn("_rn", first).where("_rn = 1").drop("_rn").unionByName(df.where(is_blank(key)))


def unpivot_cells(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Cells: key, column and value as text."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(key, cells.alias("x")).select(key, "x.column", "x.value")


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: total, non_empty, numeric, kind and confidence (the larger of the shares of numbers and of other text)."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("value")) for c in columns)))
    full = F.coalesce(F.col("x.value") != "", F.lit(False))
    out = df.select(cells.alias("x")).groupBy(F.col("x.column").alias("column")).agg(
        F.count("*").alias("total"), F.count_if(full).alias("non_empty"), F.count_if(full & F.col("x.value").rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$")).alias("numeric"))
    share = F.col("numeric") / F.col("non_empty")
    return out.select("*", F.when(F.col("non_empty") == 0, "Empty").when(F.col("numeric") == F.col("non_empty"), "Numeric").when(F.col("numeric") == 0, "Text").otherwise("Mixed").alias("kind"),
        F.when(F.col("non_empty") == 0, 0.0).otherwise(F.round(F.greatest(share, 1 - share), 6)).alias("confidence"))
