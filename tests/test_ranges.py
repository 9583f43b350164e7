"""Operators along an order of all rows, against plain Python, with few rows a range."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import lookup, pivot, records, rows


@pytest.fixture(autouse=True)
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("larger", [False, True])
def test_nearest(spark, larger):
    r = random.Random(3)
    maybe = lambda n: r.choice([None, *range(n)])
    left = [(k, r.choice([0, 0, 0, 1, 2, None]), maybe(60)) for k in range(300)]
    right = [(r.choice([0, 0, 1, 3, None]), maybe(60), r.choice([None, *range(9)])) for _ in range(60)]
    table = spark.createDataFrame(right, "g int, at int, v int")
    got = {x["id"]: x["found"] for x in lookup.nearest(spark.createDataFrame(left, "id int, g int, at int"), "at", table, "at", "v", by="g", larger=larger).collect()}

    def plain(g, at):
        ok = [x for x in right if g is not None and at is not None and x[0] == g and x[1] is not None and (x[1] >= at if larger else x[1] <= at)]
        if not ok:
            return None
        edge = (min if larger else max)(x[1] for x in ok)
        same = [x[2] for x in ok if x[1] == edge]
        return None if None in same else min(same)  # nulls are least

    assert got == {k: plain(g, at) for k, g, at in left}


def test_subtotals_of_runs(spark):
    r = random.Random(4)
    cells = [(k, r.choice(["a", "a", "a", "b", "", None]), r.randrange(9)) for k in range(200)] + [(k, "z", 1) for k in range(200, 400)]
    want, run = [], 0
    for k, (at, g, v) in enumerate(cells):
        if k == 0 or g != cells[k - 1][1]:
            run += 1
            want.append([run, f"{g or '(blank)'} Total", 0, 0, at, at])
        want[-1][2:] = [want[-1][2] + 1, want[-1][3] + v, want[-1][4], at]
    want.append([None, "Grand Total", 400, sum(c[2] for c in cells), 0, 399])
    df = spark.createDataFrame(cells, "at int, g string, v int").repartition(5)
    got = pivot.run_subtotals(df, "g", "at", {"n": F.count("*"), "s": F.sum("v")}).collect()
    assert sorted((list(x) for x in got), key=str) == sorted(want, key=str)
    assert [list(x) for x in pivot.run_subtotals(df.limit(0), "g", "at", {"n": F.count("*")}).collect()] == [[None, "Grand Total", 0, None, None]]


def test_split_by_size(spark):
    r = random.Random(5)
    sizes = [(k, r.choice([None, *range(100)])) for k in range(150)] + [(None, 10), (None, 20)]
    got = {}
    for x in records.split_by_size(spark.createDataFrame(sizes, "id int, size int").repartition(3), "id", F.col("size"), 1 << 20, 5).collect():
        got.setdefault(x["id"], []).append(x["part"])
    assert sorted(got.pop(None)) == [0, 0]
    before, want = 40, {}
    for k, size in sizes[:150]:
        want[k] = [before // (1 << 20)]
        before += (1 << 20 if size is None else size) + 5
    assert got == want


def test_show_as_with_nulls(spark):
    cells = [("r", "a", 1), ("r", "b", 3), (None, "a", 4), ("q", None, 2)]
    got = {(x["r"], x["c"]): (x["percent_of_column"], x["percent_of_grand_total"], x["difference_from"], x["running_total"]) for x in pivot.show_as(spark.createDataFrame(cells, "r string, c string, v int"), "r", "c", "v", "a").collect()}
    assert got == {("r", "a"): (0.2, 0.1, 0, 1), ("r", "b"): (1.0, 0.3, 2, 4), (None, "a"): (0.8, 0.4, 0, 4), ("q", None): (1.0, 0.2, None, 2)}


@pytest.mark.parametrize(("cells", "want"), [
    (["10", "9", None, " ", "1e1"], ["9", "10", "1e1"]), (["10", "9", "b", "A"], ["10", "9", "A", "b"]), (["2024-10-01", "2024-09-01 10:00", ""], ["2024-09-01 10:00", "2024-10-01"]),
])
def test_sort_cells(spark, cells, want):
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, c string")
    full = lambda t: [x["c"] for x in t.collect() if x["c"] and x["c"].strip()]
    up, down = rows.sort_cells(df, "c"), rows.sort_cells(df, "c", descending=True)
    assert [x.upper() for x in full(up)] == [x.upper() for x in want] and sorted(full(down)) == sorted(want) and full(down)[0] in (want[-1], want[-2])
    blanks = sum(not (c or "").strip() for c in cells)
    assert all(not (x["c"] or "").strip() for x in up.collect()[:blanks]) and all(not (x["c"] or "").strip() for x in down.collect()[len(cells) - blanks :])
    assert rows.sort_cells(df, "none") is df


def test_null_order_is_independent_of_direction(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "c int")
    order = lambda **k: [x["c"] for x in df.orderBy(rows.sort_key("c", **k)).collect()]
    assert order() == [None, 1, 3] and order(descending=True) == [3, 1, None]
    assert order(nulls_last=True) == [1, 3, None] and order(descending=True, nulls_last=False) == [None, 3, 1]


def test_compare_rows(spark):
    a = spark.createDataFrame([(1, " x", None), (2, "y", 1), (None, "n", 1)], "k int, t string, n int")
    b = spark.createDataFrame([(1, "X", 5), (3, "y", 1)], "k int, t string, n int")
    got = sorted(tuple(x) for x in lookup.compare_rows(a.where("k is not null"), b, "k", ["t", "n"]).collect())
    assert got == [(1, "n", "ValueMismatch", None, "5"), (2, "n", "MissingFromRight", "1", None), (2, "t", "MissingFromRight", "y", None), (3, "n", "MissingFromLeft", None, "1"), (3, "t", "MissingFromLeft", None, "y")]
    assert ("t", " x") in [(x["column"], x["left_value"]) for x in lookup.compare_rows(a, b, "k", ["t"], trim=False).where("k = 1").collect()]
