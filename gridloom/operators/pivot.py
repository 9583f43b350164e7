"""Subtotals, pivots and show-as calculations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges

#: The pivot functions over a column.
FUNCTIONS = {
    "sum": F.sum, "count": F.count, "average": F.avg, "max": F.max, "min": F.min, "product": F.product, "count_numbers": lambda c: F.count(F.col(c).try_cast("double") if isinstance(c, str) else c.try_cast("double")),
    "stddev": F.stddev_samp, "stddevp": F.stddev_pop, "var": F.var_samp, "varp": F.var_pop,
}


def aggregate(df: DataFrame, rows: list[str], column: str, functions: list[str] | None = None) -> DataFrame:
    return df.groupBy(*rows).agg(*(FUNCTIONS[f](column).alias(f) for f in functions or FUNCTIONS))


def table(df: DataFrame, rows: list[str], column: str, items: list, value: Column) -> DataFrame:
    """Rows by items of a column; the items are given, so that no pass is needed to find them."""
    return df.groupBy(*rows).pivot(column, items).agg(value)


def run_ids(df: DataFrame, group: str, order: list[str], partition: list[str]) -> DataFrame:
    """Numbers contiguous runs of equal values in the given order, within each partition."""
    w = Window.partitionBy(*partition).orderBy(*order)
    begins = (~F.col(group).eqNullSafe(F.lag(group).over(w)) | (F.row_number().over(w) == 1)).cast("long")
    return df.withColumn("run_id", F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def subtotals(df: DataFrame, group: str, values: dict[str, Column]) -> DataFrame:
    """Per group its aggregates under `<group> Total`, `(blank)` for no value, and one grand total row."""
    out = df.rollup(group).agg(F.grouping(group).alias("_g"), *(v.alias(n) for n, v in values.items()))
    label = F.when(F.col("_g") == 1, "Grand Total").otherwise(F.concat(F.coalesce(F.when(F.trim(group) != "", F.col(group)), F.lit("(blank)")), F.lit(" Total")))
    return out.select(label.alias("label"), *values)


def number_range(column: str, start: float, interval: float) -> Column:
    """The lower bound of the range that a number falls in."""
    return F.floor((F.col(column) - start) / interval) * interval + start


def show_as(df: DataFrame, row: str, column: str, value: str, base: object) -> DataFrame:
    """All show-as calculations of a cell table; `base` is the base item of `column`.

    A row's cells, one for each item of the column, share a window; totals of
    columns and of all cells are aggregates, joined back.
    """
    by_row = Window.partitionBy(row)
    x, of_base = F.col(value), F.max(F.when(F.col(column) == F.lit(base), F.col(value))).over(by_row)
    totals = df.groupBy(F.col(column).alias("_c")).agg(F.sum(value).alias("_column"))
    grand, total_row, total_column = df.agg(F.sum(value)).scalar(), F.sum(value).over(by_row), F.col("_column")
    running = F.sum(value).over(Window.partitionBy(row).orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    joined = df.join(totals, F.col(column).eqNullSafe(F.col("_c"))).withColumn("_grand", grand)
    return joined.select(row, column, value,
        (x - of_base).alias("difference_from"), F.round(x / of_base, 6).alias("percent_of"), F.round((x - of_base) / of_base, 6).alias("percent_difference_from"), running.alias("running_total"),
        F.round(x / total_row, 6).alias("percent_of_row"), F.round(x / total_column, 6).alias("percent_of_column"), F.round(x / F.col("_grand"), 6).alias("percent_of_grand_total"), F.round((x * F.col("_grand")) / (total_row.cast("double") * total_column), 6).alias("index"))


def run_subtotals(df: DataFrame, group: str, order: str, values: dict[str, Column], *, label: str = "Total", total: str | None = "Grand Total") -> DataFrame:
    """Subtotals of a sheet: for each run of equal values of `group` along `order`, which is unique, its label, aggregates, and first and last place; then the grand total.

    run_id counts from 1, and is null for the grand total; a blank group is (blank).
    Runs are found within ranges of the order; whether a range goes on with the
    run of the one before is told by one row for each range.
    """
    table = ranges.ranged(df, F.col(order).asc_nulls_first())
    w = Window.partitionBy("_p").orderBy(F.col(order).asc_nulls_first())
    own = F.struct(F.col(group).alias("v"))
    begins = (~own.eqNullSafe(F.lag(own).over(w)) & (F.row_number().over(w) > 1)).cast("long")
    counted = table.withColumn("_b", F.sum(begins).over(w))
    at = F.struct(F.col(order).isNotNull(), F.col(order))
    ends = ranges.per_range(counted, F.min_by(own, at).alias("first"), F.max_by(own, at).alias("last"), F.max("_b").alias("more"))
    offsets, run, before = [], 0, None
    for e in ends:
        run += before is None or before != e["first"]
        offsets.append((e["_p"], run))
        run, before = run + e["more"], e["last"]
    started = df.sparkSession.createDataFrame(offsets, "_p int, _run long")
    numbered = counted.join(started, "_p").withColumn("run_id", F.col("_run") + F.col("_b"))
    name = F.concat(F.coalesce(F.when(F.trim(F.col(group).cast("string")) != "", F.col(group).cast("string")), F.lit("(blank)")), F.lit(f" {label}"))
    places = [F.min(order).alias("first"), F.max(order).alias("last")]
    out = numbered.groupBy("run_id").agg(F.first(name).alias("label"), *(v.alias(n) for n, v in values.items()), *places)
    if total is None:
        return out
    whole = df.agg(F.lit(None).cast("long").alias("run_id"), F.lit(total).alias("label"), *(v.alias(n) for n, v in values.items()), *places)
    return out.unionByName(whole)


def first_of_field(df: DataFrame, field: str, keys: list[tuple[str, bool]], n: int) -> DataFrame:
    """The first n rows of each item of a field, by (column, descending) keys."""
    order = Window.partitionBy(field).orderBy(*(F.col(c).desc() if d else F.col(c).asc() for c, d in keys))
    return df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


def number_groups(df: DataFrame, column: str, interval: float, *, start: float | None = None, end: float | None = None) -> DataFrame:
    """Adds lower and label of the range of `interval` that a number falls in, from `start` to `end`; without them, from the least and to the largest number.

    A number below start is in `<start`, one beyond end in `>end`, no number in
    (blank). The last range ends at `end`, which is within it.
    """
    if interval <= 0:
        raise ValueError("interval: more than 0")
    x = F.col(column).cast("double")
    edges = df.agg(F.min(x).alias("least"), F.max(x).alias("most")).first()
    low = start if start is not None else edges["least"]
    high = end if end is not None else edges["most"]
    if low is None or high is None:
        return df.withColumns({"lower": F.lit(None).cast("double"), "label": F.lit("(blank)")})
    if high < low:
        raise ValueError("end: not before start")
    last = max(0, -int(-(high - low) // interval) - 1)  # ranges that begin before the end, less one
    step = F.least(F.floor((x - low) / interval), F.lit(last))
    lower, upper = step * interval + low, F.least((step + 1) * interval + low, F.lit(float(high)))
    number = lambda c: F.regexp_replace(c.cast("decimal(38,6)").cast("string"), r"\.?0+$", "")
    label = F.when(x.isNull(), "(blank)").when(x < low, F.concat(F.lit("<"), number(F.lit(float(low))))).when(x > high, F.concat(F.lit(">"), number(F.lit(float(high))))).otherwise(F.concat(number(lower), F.lit("-"), number(upper)))
    return df.withColumns({"lower": F.when((x >= low) & (x <= high), lower), "label": label})


def field_filter(df: DataFrame, field: str, *, hidden: list | None = None, visible: list | None = None, label: tuple[str, ...] | None = None) -> DataFrame:
    """Rows whose item of a field is shown: not hidden, among the visible ones if any are named, and meeting a label filter (operator, value, value) of rows.compare; blank is the item None."""
    from . import rows

    item = F.col(field)
    named = lambda items: F.coalesce(item.isin([i for i in items if i is not None]), F.lit(False)) | (item.isNull() if None in items else F.lit(False))
    out = df
    if hidden:
        out = out.where(~named(hidden))
    if visible is not None:
        out = out.where(named(visible))
    return out.where(rows.compare(field, *label)) if label else out


def manual_order(df: DataFrame, field: str, items: list, *more: str) -> DataFrame:
    """Rows in a given order of a field's items; other items come behind, ascending, then blanks; then by further columns."""
    at = F.coalesce(*(F.when(F.col(field).eqNullSafe(F.lit(i)), F.lit(k)) for k, i in enumerate(items)), F.lit(len(items))) if items else F.lit(0)
    return df.orderBy(at, F.col(field).asc_nulls_last(), *more)
