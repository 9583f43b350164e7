"""Lookup-shaped joins and comparisons of two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, order: list[str], *, last: bool = False, default: object | None = None, name: str = "found") -> DataFrame:
    """The value of the table's first (or last) row with the key, in the given order; `default` where there is none."""
    position = F.struct(*order)
    pick = (F.max_by if last else F.min_by)(F.struct(F.col(value).alias("v")), position)
    one = table.where(F.col(table_key).isNotNull()).groupBy(F.col(table_key).alias("_k")).agg(pick.alias("_p"))
    joined = df.join(one, F.col(key) == F.col("_k"), "left")
    found = F.col("_p.v") if default is None else F.when(F.col("_p").isNull(), F.lit(default)).otherwise(F.col("_p.v"))
    return joined.withColumn(name, found).drop("_k", "_p")


def hlookup(df: DataFrame, on: str, table: DataFrame, key: str, row: str, *, name: str = "found") -> DataFrame:
    """Adds the cell of the table's row whose key is `row`, from the column that `on` names; cells are text."""
    from . import rows

    cells = rows.unpivot_cells(table.where(F.col(key).cast("string") == row), key, [c for c in table.columns if c != key])
    return df.join(cells.select(F.col("column").alias("_c"), F.col("value").alias(name)), F.col(on).cast("string") == F.col("_c"), "left").drop("_c")


def nearest(df: DataFrame, on: str, table: DataFrame, table_on: str, value: str, *, by: str, larger: bool = False, name: str = "found") -> DataFrame:
    """Exact match or the next smaller (larger) one within `by`; null where `by` or `on` is null, or there is none.

    Both tables are put in ranges of one order, and the last value of a range is
    carried to the next ones of the same `by`: a `by` of very many rows spans many
    ranges. Of rows of the table with equal keys the smallest value counts.
    """
    one = table.where(F.col(by).isNotNull() & F.col(table_on).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(table_on).alias("_on")).agg(F.min(F.struct(F.col(value).alias("v"))).alias("_v"))
    row, kind = df.select(F.struct("*").alias("_row")).schema["_row"].dataType, one.schema["_v"].dataType
    known = F.col(by).isNotNull() & F.col(on).isNotNull()
    left = df.where(known).select(F.struct("*").alias("_row"), F.col(by).alias("_by"), F.col(on).alias("_on"), F.lit(None).cast(kind).alias("_v"), F.lit(1).alias("_side"), F.monotonically_increasing_id().alias("_tie"))
    right = one.select(F.lit(None).cast(row).alias("_row"), "_by", "_on", "_v", F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_tie"))
    order = [F.col("_on").desc() if larger else F.col("_on").asc(), F.col("_side")]
    both = ranges.ranged(left.unionByName(right), F.col("_by"), *order, F.col("_tie"))
    within = F.last("_v", ignorenulls=True).over(Window.partitionBy("_p", "_by").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # the last value of each range, and for each range that of those before it
    ends = both.groupBy("_by", "_p").agg((F.min_by if larger else F.max_by)("_v", F.when(F.col("_side") == 0, F.col("_on"))).alias("_e"))
    carried = ends.select("_by", "_p", F.last("_e", ignorenulls=True).over(Window.partitionBy("_by").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_c")).where("_c is not null")
    found = both.withColumn("_f", within).where("_side = 1").join(carried, ["_by", "_p"], "left").select("_row.*", F.coalesce("_f.v", F.when(F.col("_f").isNull(), F.col("_c.v"))).alias(name))
    return found.unionByName(df.where(~known).withColumn(name, F.lit(None).cast(table.schema[value].dataType)))


def compare_rows(left: DataFrame, right: DataFrame, key: str, columns: list[str], *, trim: bool = True, ignore_case: bool = True, null_is_empty: bool = True) -> DataFrame:
    """Cells in which two tables differ: key, column, kind (MissingFromLeft, MissingFromRight or ValueMismatch), left_value and right_value as text.

    Rows are joined by their key, unique on each side, and only cells that differ become rows.
    """

    def plain(c: Column) -> Column:
        c = F.trim(c) if trim else c
        c = F.upper(c) if ignore_case else c
        return F.coalesce(c, F.lit("")) if null_is_empty else c

    side = lambda df, n: df.select(F.col(key).alias("_k"), F.struct(*(F.col(c).cast("string").alias(c) for c in columns)).alias(n))
    both = side(left, "l").join(side(right, "r"), "_k", "full_outer")

    def cell(c: str) -> Column:
        a, b = F.col(f"l.`{c}`"), F.col(f"r.`{c}`")
        kind = F.when(F.col("l").isNull(), "MissingFromLeft").when(F.col("r").isNull(), "MissingFromRight").when(~plain(a).eqNullSafe(plain(b)), "ValueMismatch")
        return F.when(kind.isNotNull(), F.struct(F.lit(c).alias("column"), kind.alias("kind"), a.alias("left_value"), b.alias("right_value")))

    return both.select(F.col("_k").alias(key), F.explode(F.array_compact(F.array(*map(cell, columns)))).alias("x")).select(key, "x.*")


def three_way(base: DataFrame, source: DataFrame, remote: DataFrame, key: str, value: str) -> DataFrame:
    """Sync plan by key: unchanged, source_change, remote_change, same_change or conflict."""
    side = lambda t, n: t.select(key, F.struct(F.col(value).alias("v")).alias(n))
    joined = side(base, "b").join(side(source, "s"), key, "full_outer").join(side(remote, "r"), key, "full_outer")
    moved_s, moved_r = ~F.col("s").eqNullSafe(F.col("b")), ~F.col("r").eqNullSafe(F.col("b"))
    action = F.when(~moved_s & ~moved_r, "unchanged").when(moved_s & ~moved_r, "source_change").when(~moved_s, "remote_change").when(F.col("s").eqNullSafe(F.col("r")), "same_change").otherwise("conflict")
    return joined.select(key, action.alias("action"))


def resolve(df: DataFrame, identity: str, entries: DataFrame, entry_identity: str, entry: str) -> DataFrame:
    """Resolved (one entry), Ambiguous (several; none is guessed) or NotFound, by identities ignoring case and outer spaces."""
    plain = lambda c: F.lower(F.trim(F.col(c)))
    one = entries.where(F.col(entry_identity).isNotNull()).groupBy(plain(entry_identity).alias("_i")).agg(F.count_distinct(entry).alias("n_entries"), F.min(entry).alias("_e"))
    joined = df.join(one, plain(identity) == F.col("_i"), "left")
    n = F.coalesce("n_entries", F.lit(0).cast("long"))
    return joined.withColumn("n_entries", n).withColumn("status", F.when(F.col("n_entries") == 1, "Resolved").when(F.col("n_entries") > 1, "Ambiguous").otherwise("NotFound")).withColumn("entry", F.when(F.col("n_entries") == 1, F.col("_e"))).drop("_i", "_e")


def resolve_by_sources(df: DataFrame, identity: str, entries: DataFrame, entry: str, sources: list[str], *, most: int = 32, complete: bool = True) -> DataFrame:
    """Identities by the first of several sources (columns of entries, texts or arrays of them) in which one is found: adds status, source, n_entries, entry and candidates (the `most` smallest).

    Resolved: that source has exactly one entry. Ambiguous: it has several; none is
    guessed, nor is a later source asked. NotFound: no source has it; Incomplete in its
    place if `complete` is false, as the entries are not all there. Identities
    meet ignoring case and outer spaces.
    """
    plain = lambda c: F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))
    kinds = dict(entries.dtypes)

    def of(rank: int, c: str) -> Column:
        one = lambda x: F.struct(F.lit(rank).alias("rank"), plain(x).alias("i"))
        return F.transform(F.col(c), one) if kinds[c].startswith("array") else F.array(one(F.col(c)))

    names = [of(k, c) for k, c in enumerate(sources)]
    none = F.array().cast("array<struct<rank:int,i:string>>")
    each = entries.select(F.col(entry).alias("_e"), F.explode(F.flatten(F.array(*(F.coalesce(n, none) for n in names)))).alias("x")).select("_e", "x.*").where("i is not null").distinct()
    counted = each.groupBy("i", "rank").agg(F.count("*").alias("n"), F.min("_e").alias("least"))
    first = counted.groupBy("i").agg(F.min(F.struct("rank", "n", "least")).alias("f"))
    # of very common names no more than `most` entries are kept for each
    ranked = each.join(first.select("i", F.col("f.rank").alias("rank")), ["i", "rank"]).withColumn("_n", F.row_number().over(Window.partitionBy("i").orderBy("_e"))).where(F.col("_n") <= most)
    listed = ranked.groupBy("i").agg(F.array_sort(F.collect_list("_e")).alias("candidates"))
    joined = df.join(first.join(listed, "i"), plain(F.col(identity)) == F.col("i"), "left")
    status = F.when(F.col("f").isNull(), "NotFound" if complete else "Incomplete").when(F.col("f.n") == 1, "Resolved").otherwise("Ambiguous")
    source = F.get(F.array(*map(F.lit, sources)), F.col("f.rank"))
    return joined.select(*df.columns, status.alias("status"), source.alias("source"), F.coalesce("f.n", F.lit(0)).alias("n_entries"), F.when(F.col("f.n") == 1, F.col("f.least")).alias("entry"), F.coalesce("candidates", F.array().cast(f"array<{kinds[entry]}>")).alias("candidates"))


def sync_plan(base: DataFrame, source: DataFrame, remote: DataFrame, key: str, value: str, revision: str) -> DataFrame:
    """Actions by key: create, update or delete on the remote, or on the source, none, or conflict; with the revision that the remote must have for it.

    base has the value and the remote's revision at the last sync, remote its
    present value and revision. A remote row changed if its revision did. Both sides
    changed is a conflict, unless they agree.
    """
    side = lambda t, n, *more: t.select(key, F.struct(F.col(value).alias("v"), *(F.col(m).alias("r") for m in more)).alias(n))
    joined = side(base, "b", revision).join(side(source, "s"), key, "full_outer").join(side(remote, "r", revision), key, "full_outer")
    b, s, r = (F.col(n) for n in "bsr")
    moved_s = s.isNull() != b.isNull()
    moved_s = moved_s | (s.isNotNull() & b.isNotNull() & ~s["v"].eqNullSafe(b["v"]))
    moved_r = (r.isNull() != b.isNull()) | (r.isNotNull() & b.isNotNull() & ~r["r"].eqNullSafe(b["r"]))
    agree = (s.isNull() & r.isNull()) | (s.isNotNull() & r.isNotNull() & s["v"].eqNullSafe(r["v"]))
    to = lambda mine, other, name: F.when(mine.isNull(), f"delete_{name}").when(other.isNull(), f"create_{name}").otherwise(f"update_{name}")
    action = F.when(agree | (~moved_s & ~moved_r), "none").when(moved_s & moved_r, "conflict").when(moved_s, to(s, r, "remote")).otherwise(to(r, s, "source"))
    return joined.select(key, action.alias("action"), F.when(F.endswith(action, F.lit("_remote")), F.col("b.r")).alias("expected_revision"))
