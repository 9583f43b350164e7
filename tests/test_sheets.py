"""Cells, their references and normalised documents on small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom import plans
from gridloom.operators import normalize, sheets

SCHEMA = "row int, column int, value string, formula string"


def _sheet(spark, *cells):
    return spark.createDataFrame([(*c, *[None] * (4 - len(c))) for c in cells], SCHEMA)


def _got(df):
    return sorted((r["row"], r["column"], r["value"], r["formula"]) for r in df.collect())


@pytest.mark.parametrize(("formula", "rows", "columns", "want"), [
    ("A1+$B$5:c10", (5, 2), None, "A1+$B$7:C12"), ("A4+A5+A6+A7", (5, -2), None, "A4+#REF!+#REF!+A5"), ("A1+Z1+AZ9+XFD1", None, (2, 1), "A1+AA1+BA9+#REF!"), ("B1+C1", None, (2, -1), "#REF!+B1"),
    ("LOG10(A9)&\"A9 \"\"A9\"&Sheet2!A9&'A 9'!A9&A9_x&x.A9", (1, 1), None, "LOG10(A10)&\"A9 \"\"A9\"&Sheet2!A9&'A 9'!A9&A9_x&x.A9"), ("A1048576+A0+A1048577+XFE1", (1, 1), None, "#REF!+A0+A1048577+XFE1"), ("", (1, 1), None, ""), (None, (1, 1), None, None),
])
def test_references(spark, formula, rows, columns, want):
    assert spark.createDataFrame([(formula,)], "f string").select(sheets.moved_references(F.col("f"), rows=rows, columns=columns).alias("x")).first()["x"] == want


def test_letters(spark):
    numbers = [1, 26, 27, 52, 53, 702, 703, 16384]
    got = spark.createDataFrame([(n,) for n in numbers], "n int").select(sheets.column_letters(F.col("n")).alias("a")).withColumn("b", sheets.column_number(F.col("a"))).collect()
    assert [(r["a"], r["b"]) for r in got] == list(zip(["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "XFD"], numbers))


def test_cells_that_would_leave_the_sheet(spark):
    with pytest.raises(Exception, match="leave the sheet: row 1048576"):
        sheets.insert_rows(_sheet(spark, (1048576, 1, "x")), 3).collect()
    with pytest.raises(Exception, match="leave the sheet: column 16384"):
        sheets.insert_columns(_sheet(spark, (1, 16384, "x")), 3).collect()
    assert _got(sheets.delete_rows(_sheet(spark, (1, 1, "a"), (2, 1, "b"), (1048576, 1, "x")), 2)) == [(1, 1, "a", None), (1048575, 1, "x", None)]
    assert _got(sheets.delete_columns(_sheet(spark, (1, 1, "a"), (1, 2, "b"), (1, 3, "c", "B1+C1")), 2)) == [(1, 1, "a", None), (1, 2, "c", "#REF!+B1")]
    with pytest.raises(ValueError):
        sheets.insert_rows(_sheet(spark), 0)


def test_tables_longer_than_a_sheet(spark):
    df = _sheet(spark, (99, 1, "a"), (1048570, 1, "b"), (12345678, 4, None, "A1048577+$B$12345678&Other!A1048577&A9"))
    assert _got(sheets.insert_rows(df, 100, 7, last_row=None)) == [(99, 1, "a", None), (1048577, 1, "b", None), (12345685, 4, None, "A1048584+$B$12345685&Other!A1048577&A9")]
    assert _got(sheets.delete_rows(df, 100, 7, last_row=None)) == [(99, 1, "a", None), (1048563, 1, "b", None), (12345671, 4, None, "A1048570+$B$12345671&Other!A1048577&A9")]
    assert _got(sheets.insert_columns(df, 2, 25, last_row=None)) == [(99, 1, "a", None), (1048570, 1, "b", None), (12345678, 29, None, "A1048577+$AA$12345678&Other!A1048577&A9")]


@pytest.mark.parametrize("name", ["sheet_insert_rows", "sheet_delete_rows", "sheet_insert_columns"])
def test_queries_over_more_parts_than_a_sheet_has_rows(spark, tmp_path, name):
    keys = "(VALUES (0), (98), (99), (105), (106), (1048568), (1048569), (1048575), (9999997)) AS p (p_partkey)"
    spark.sql(f"SELECT CAST(p_partkey AS long) AS p_partkey, concat('n', p_partkey) AS p_name FROM {keys}").write.parquet(f"{tmp_path}/part.parquet")
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
        rel = c.sql(plans.oracle_sql()[name])
        want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    assert _got(plans.queries()[name](spark, str(tmp_path))) == sorted((r["row"], r["column"], r["value"], r["formula"]) for r in want)


def test_moves_and_copies(spark):
    df = _sheet(spark, (1, 1, "a"), (1, 2, "b", "A1"), (5, 2, "c"))
    assert _got(sheets.move_cells(df, (1, 1, 1, 2), 2, 2)) == [(2, 2, "a", None), (2, 3, "b", "A1"), (5, 2, "c", None)]
    assert len(_got(sheets.move_cells(df, (1, 1, 1, 2), 2, 2, copy=True))) == 5
    assert _got(sheets.move_cells(df, (1, 1, 1, 2), 5, 1, overwrite=True)) == [(5, 1, "a", None), (5, 2, "b", "A1")]
    assert _got(sheets.move_cells(df, (1, 1, 1, 2), 1, 2)) == [(1, 2, "a", None), (1, 3, "b", "A1"), (5, 2, "c", None)]  # onto itself
    with pytest.raises(Exception, match="in the way: row 5, column 2"):
        sheets.move_cells(df, (1, 1, 1, 2), 5, 1).collect()
    with pytest.raises(ValueError):
        sheets.move_cells(df, (1, 1, 1, 2), 1, 16384)


def test_typed_rows(spark):
    df = _sheet(spark, (1, 1, "n"), (1, 2, "Name "), (2, 1, "5"), (2, 2, "x"), (3, 1, "bad"), (4, 1, " "), (4, 3, "other"), (5, 2, "y"))
    read = lambda **k: sorted(tuple(r) for r in sheets.typed_rows(df, {1: ("n", "int"), 2: ("name", "string")}, first_row=2, **k).collect())
    assert read() == [(2, 5, "x"), (3, None, None), (4, None, None), (5, None, "y")]
    assert read(defaults={"n": 0, "name": "?"}, blank_rows="skip") == [(2, 5, "x"), (3, 0, "?"), (5, 0, "y")]
    with pytest.raises(Exception, match="an empty row: 4"):
        read(blank_rows="fail")
    assert [r["value"] for r in sheets.column_by_header(df, "NAME").orderBy("row").collect()] == ["x", "y"]
    assert sheets.column_by_header(df, "none").count() == 0
    assert sheets.find_formulas(_sheet(spark, (1, 1, None, "Sum(A1)"), (1, 2, "sum")), "SUM(").count() == 1


def test_blocks_and_links(spark):
    df = spark.createDataFrame([(" Heading", " a ", 9, " - "), ("HEADING", None, 0, None), ("List-Item", "b", -1, ""), ("para", "c", -1, None), (None, "d", None, None)], "kind string, text string, level int, marker string")
    assert [tuple(r) for r in normalize.blocks(df).collect()] == [("heading", "a", 6, "-"), ("heading", "", 1, None), ("list-item", "b", 1, ""), ("para", "c", -1, None), ("", "d", None, None)]
    links = spark.createDataFrame([(" 1 ", "URL ", " "), (None, None, " x")], "id string, kind string, target string")
    assert [tuple(r) for r in normalize.links(links).collect()] == [("1", "url", None), (None, None, "x")]


def test_tables_of_no_rows_or_columns(spark):
    df = spark.createDataFrame([(None, None), ([], [[]]), (["a"], None), ([" "], [["1", "2"], None])], "c array<string>, r array<array<string>>")
    got = [r["t"] for r in df.select(normalize.table(F.col("c"), F.col("r")).alias("t")).collect()]
    assert [(t["columns"], t["rows"], t["total"]) for t in got] == [([], [], 0), ([], [[]], 1), (["a"], [], 0), (["Column1", "Column2"], [["1", "2"], ["", ""]], 2)]
    assert [(p["name"], p["non_empty"], p["kind"]) for p in got[3]["profiles"]] == [("Column1", 1, "Numeric"), ("Column2", 1, "Numeric")]


def test_phrases(spark):
    df = spark.createDataFrame([(1, 1, "a.b A.B\n a.b"), (1, 2, "x A.B  a.b y"), (2, 1, None)], "id int, page int, text string")
    got = [tuple(r) for r in normalize.phrase_hits(df, "id", "page", "text", "a.b").orderBy("place", "offset").collect()]
    assert [(x[1], x[2], x[3]) for x in got] == [(1, 0, "a.b"), (1, 4, "A.B"), (1, 9, "a.b"), (2, 2, "A.B"), (2, 7, "a.b")]
    assert [x["offset"] for x in normalize.phrase_hits(df, "id", "page", "text", " A.b  a.B ").orderBy("place").collect()] == [0, 2]
    with pytest.raises(ValueError):
        normalize.phrase_hits(df, "id", "page", "text", "  ")


def test_counts_and_scores(spark):
    df = spark.range(3)
    assert sorted(tuple(r) for r in normalize.counts({"a": df, "b": df.limit(0)}).collect()) == [("a", 3), ("b", 0)]
    empty = spark.createDataFrame([], "k int, m string")
    assert {tuple(r) for r in normalize.round_trip_score(empty, empty, "k", ["m"]).collect()} <= {(None, 0, 0, 1.0)}
