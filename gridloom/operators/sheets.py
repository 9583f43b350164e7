"""Sheets as cells: rows of (row, column, value, formula), numbered from 1. Structural edits move cells and the references in formulas alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The last row and column of a sheet. Fixed values.
ROWS, COLUMNS = 1_048_576, 16_384
_PART = r"""(?:"[^"]*+")+|'[^']*+'!|\$?[A-Za-z]{1,3}\$?[0-9]{1,DIGITS}(?![A-Za-z0-9_(])|[A-Za-z_][A-Za-z0-9_.]*+\(?|[^"'$A-Za-z_]++|(?s:.)"""
_REFERENCE = r"^(\$?)([A-Za-z]{1,3})(\$?)([0-9]{1,DIGITS})$"


def column_number(letters: Column) -> Column:
    """A, B, ... AA as 1, 2, ... 27."""
    return F.aggregate(F.split(F.upper(letters), "(?<=.)(?=.)"), F.lit(0), lambda s, c: (s * 26 + F.ascii(c) - 64).cast("int"))


def column_letters(number: Column) -> Column:
    """1, 2, ... 27 as A, B, ... AA."""
    one = lambda n: F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ((n - 1) % 26 + 1).cast("int"), F.lit(1))
    over = lambda n: F.floor((n - 1) / 26).cast("int")
    second, third = over(number), over(over(number))
    return F.concat(F.when(third > 0, one(third)).otherwise(""), F.when(second > 0, one(second)).otherwise(""), one(number))


def _moved(at: Column, first: int, count: int) -> Column:
    """Where a place goes if `count` (less than 0: so many are deleted) come in at `first`; null for a deleted one."""
    if count >= 0:
        return F.when(at >= first, at + count).otherwise(at)
    return F.when(at < first, at).when(at >= first - count, at + count)


def moved_references(formula: Column, *, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None, last_row: int | None = ROWS) -> Column:
    """A formula whose references to this sheet follow an insertion or deletion (first, count); what is deleted or runs off the sheet becomes #REF!. Texts in quotes, names and references to other sheets stay. last_row: None for a table of any length."""
    part, reference = (x.replace("DIGITS", "7" if last_row is not None else "18") for x in (_PART, _REFERENCE))
    group = lambda p, k: F.regexp_extract(p, reference, k)
    beyond = lambda row: row > last_row if last_row is not None else F.lit(False)

    # a transform for each step, so that a reference is taken apart once
    place = lambda p: F.struct(group(p, 4).try_cast("long").alias("row"), column_number(group(p, 2)).alias("column"))
    read = F.transform(F.regexp_extract_all(formula, F.lit(part), F.lit(0)), lambda p: F.struct(p.alias("text"), F.when(p.rlike(reference), place(p)).alias("at")))
    valid = lambda at: (at["row"] >= 1) & ~beyond(at["row"]) & at["column"].between(1, COLUMNS)
    to = lambda at: F.struct((_moved(at["row"], *rows) if rows else at["row"]).alias("row"), (_moved(at["column"], *columns) if columns else at["column"]).alias("column"))
    placed = F.transform(read, lambda p: F.struct(p["text"].alias("text"), F.when(valid(p["at"]), to(p["at"])).alias("to")))
    lost = lambda to: to["row"].isNull() | to["column"].isNull() | beyond(to["row"]) | (to["column"] > COLUMNS)
    made = lambda p: F.when(lost(p["to"]), "#REF!").otherwise(F.concat(group(p["text"], 1), column_letters(p["to"]["column"]), group(p["text"], 3), p["to"]["row"].cast("string")))

    def step(s: Column, p: Column) -> Column:
        own = p["to"].isNotNull() & ~F.endswith(s["last"], F.lit("!"))
        return F.struct(F.concat(s["out"], F.when(own, made(p)).otherwise(p["text"])).alias("out"), p["text"].alias("last"))

    return F.when(formula.isNotNull(), F.aggregate(placed, F.struct(F.lit("").alias("out"), F.lit("").alias("last")), step, lambda s: s["out"]))


def _edit(cells: DataFrame, axis: str, first: int, count: int, last_row: int | None) -> DataFrame:
    if first < 1 or count == 0:
        raise ValueError("from the first place on, one at least")
    last, change = (last_row, {"rows": (first, count)}) if axis == "row" else (COLUMNS, {"columns": (first, count)})
    to = _moved(F.col(axis), first, count)
    if last is not None:
        to = F.when(to > last, F.raise_error(F.concat(F.lit(f"a cell would leave the sheet: {axis} "), F.col(axis).cast("string"))).cast("int")).otherwise(to)
    out = cells.withColumn(axis, to.cast(cells.schema[axis].dataType)).where(F.col(axis).isNotNull())
    return out.withColumn("formula", moved_references(F.col("formula"), **change, last_row=last_row)) if "formula" in cells.columns else out


def insert_rows(cells: DataFrame, first: int, count: int = 1, *, last_row: int | None = ROWS) -> DataFrame:
    """Cells after empty rows come in before row `first`. A cell that would leave the sheet is an error; last_row: None for a table of any length, which none leaves at its end."""
    return _edit(cells, "row", first, abs(count), last_row)


def delete_rows(cells: DataFrame, first: int, count: int = 1, *, last_row: int | None = ROWS) -> DataFrame:
    """Cells without the rows from `first` on, those below moved up; references to them are #REF!. last_row: as in insert_rows."""
    return _edit(cells, "row", first, -abs(count), last_row)


def insert_columns(cells: DataFrame, first: int, count: int = 1, *, last_row: int | None = ROWS) -> DataFrame:
    return _edit(cells, "column", first, abs(count), last_row)


def delete_columns(cells: DataFrame, first: int, count: int = 1, *, last_row: int | None = ROWS) -> DataFrame:
    return _edit(cells, "column", first, -abs(count), last_row)


def move_cells(cells: DataFrame, area: tuple[int, int, int, int], row: int, column: int, *, copy: bool = False, overwrite: bool = False) -> DataFrame:
    """Cells of an area (first row, first column, last row, last column) moved or copied so that it begins at a place. Cells that stand there are replaced if overwrite is set, else an error. Formulas stay as they are."""
    top, left, bottom, right = area
    if not (1 <= top <= bottom <= ROWS and 1 <= left <= right <= COLUMNS and row >= 1 and column >= 1 and row + bottom - top <= ROWS and column + right - left <= COLUMNS):
        raise ValueError("an area that is on the sheet, before and after")
    inside = F.col("row").between(top, bottom) & F.col("column").between(left, right)
    under = F.col("row").between(row, row + bottom - top) & F.col("column").between(column, column + right - left)
    kinds = {c: cells.schema[c].dataType for c in ("row", "column")}
    moved = cells.where(inside).withColumns({"row": (F.col("row") + row - top).cast(kinds["row"]), "column": (F.col("column") + column - left).cast(kinds["column"])})
    rest = cells if copy else cells.where(~inside)
    if overwrite:
        return rest.where(~under).unionByName(moved)
    told = F.raise_error(F.concat(F.lit("a cell is in the way: row "), F.col("row").cast("string"), F.lit(", column "), F.col("column").cast("string"))).cast("boolean")
    return rest.where(F.when(under, told).otherwise(True)).unionByName(moved)


def find_formulas(cells: DataFrame, text: str) -> DataFrame:
    """Cells whose formula holds a text, in any case."""
    return cells.where(F.contains(F.upper("formula"), F.lit(text.upper())))


def typed_rows(cells: DataFrame, types: dict[int, tuple[str, str]], *, first_row: int = 1, defaults: dict[str, object] | None = None, blank_rows: str = "keep") -> DataFrame:
    """Cells as rows: row, and for each column number a named, typed column (name, type); blank or unfit cells are the default, or null. blank_rows: rows without a value in these columns are kept, skipped or an error (fail)."""
    if blank_rows not in ("keep", "skip", "fail"):
        raise ValueError("blank_rows: keep, skip or fail")
    of = lambda k: F.max(F.when(F.col("column") == k, F.col("value").cast("string")))
    wide = cells.where(F.col("row") >= first_row).groupBy("row").agg(*(of(k).alias(n) for k, (n, _) in types.items()))
    full = F.greatest(F.lit(False), *(F.coalesce(F.trim(n) != "", F.lit(False)) for n, _ in types.values()))
    if blank_rows == "skip":
        wide = wide.where(full)
    elif blank_rows == "fail":
        wide = wide.where(F.when(full, True).otherwise(F.raise_error(F.concat(F.lit("an empty row: "), F.col("row").cast("string"))).cast("boolean")))
    typed = {n: F.coalesce((F.nullif(F.trim(n), F.lit("")) if kind != "string" else F.nullif(n, F.lit(""))).try_cast(kind), F.lit((defaults or {}).get(n)).cast(kind)) for n, kind in types.values()}
    return wide.withColumns(typed)


def column_by_header(cells: DataFrame, header: str, *, header_row: int = 1) -> DataFrame:
    """The cells below the header of that name (in any case, trimmed), the leftmost if there are several; none if there is none."""
    found = cells.where((F.col("row") == header_row) & (F.lower(F.trim("value")) == header.strip().lower())).agg(F.min("column")).scalar()
    return cells.where((F.col("row") > header_row) & (F.col("column") == found))
