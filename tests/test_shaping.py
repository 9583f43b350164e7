"""Shapes of tables on the cases that tables do not hold."""

import datetime

import pytest
from pyspark.sql import functions as F

from gridloom.operators import documents, shaping


def test_projections_that_are_refused(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert [tuple(r) for r in shaping.project(df, exclude=("a",), rename={"b": "A"}).collect()] == [("x",)]
    for bad in ({"include": ["c"]}, {"rename": {"a": "B"}}, {"first": ("z",)}, {"formats": {"q": "0"}}):
        with pytest.raises(ValueError):
            shaping.project(df, **bad)


def test_schema_rows(spark):
    got = shaping.schema_rows(spark.createDataFrame([], "a int not null, b array<string>")).orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [("a", 0, "int", -1, False, False), ("b", 1, "array<string>", -1, True, False)]


def test_merge_and_append(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, t string"), spark.createDataFrame([(2,)], "id int")
    assert sorted(tuple(r) for r in shaping.merge_sheets({"a": a, "b": b}, prefix="p-").select("sheet", "id", "t").collect()) == [("p-a", 1, "x"), ("p-b", 2, None)]
    with pytest.raises(ValueError, match="no sheets c"):
        shaping.merge_sheets({"a": a}, only=["c"])
    with pytest.raises(ValueError, match="has no columns z"):
        shaping.append_rows(a, b.withColumn("z", F.lit(1)))
    with pytest.raises(Exception, match="id: no int: q"):
        shaping.append_rows(a, spark.createDataFrame([("q",)], "ID string")).collect()


def test_types_found_in_text(spark):
    rows = [("1", "true", "1.5", "2024-01-02", "007", "1e3", "3000000000", None, "1", "2024-13-01"), (" ", "FALSE ", "-.5", None, "1", "2", "1", " ", "x", "2024-01-01"), ("-20", None, "3", "2024-02-29", "2", ".", "2", "", "2", "2024-01-01")]
    names = [f"c{k}" for k in range(10)]
    got = shaping.typed(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)))
    assert [t for _, t in got.dtypes] == ["int", "boolean", "double", "date", "string", "string", "bigint", "string", "string", "string"]
    assert tuple(got.select("c0", "c1", "c2", "c3").collect()[2]) == (-20, None, 3.0, datetime.date(2024, 2, 29))
    assert shaping.typed(got.select("c0")).dtypes == [("c0", "int")]
    assert shaping.typed(spark.createDataFrame([], "a string")).dtypes == [("a", "string")]


def test_attached_candidates(spark):
    pages = spark.createDataFrame([("d", 1), ("d", 2), (None, 1)], "doc string, page int")
    found = spark.createDataFrame([("d", 1, 2, "b"), ("d", 1, 1, "a"), (None, 1, 1, "z")], "doc string, page int, n int, text string")
    got = {(r["doc"], r["page"]): [tuple(c) for c in r["candidates"]] for r in shaping.attach(pages, found, ["doc", "page"], ["n"]).collect()}
    assert got == {("d", 1): [(1, "a"), (2, "b")], ("d", 2): [], (None, 1): []}


def test_content_search(spark):
    df = spark.createDataFrame([(1, "red fox", None), (2, "a", "RED and blue"), (3, "blue", "red"), (4, None, None)], "id int, t string, u string")
    find = lambda terms, **k: sorted((r["id"], r["matched"], r["snippet"]) for r in shaping.content_search(df, "id", ["t", "u"], terms, **k).collect())
    assert find(["Red", "blue"]) == [(1, ["t"], "red fox"), (2, ["u"], "RED and blue"), (3, ["t", "u"], "blue")]
    assert [x[0] for x in find(["red", "blue"], match_all=True)] == [2, 3]
    assert [x[0] for x in find(["red"], where=F.col("id") > 2)] == [3]
    for bad in ([], [" "], [str(k) for k in range(33)], ["x" * 1025]):
        with pytest.raises(ValueError):
            find(bad)


def test_case_of_single_letters(spark):
    text = "ßﬁŉ" * 30 + "Straße 😀 İ. " + "x" * 60
    df = spark.createDataFrame([(1, text), (2, "ſtraẞe (i)"), (3, "strasse"), (4, None)], "id int, t string")
    find = lambda *terms: {r["id"]: r["snippet"] for r in documents.search(df, ["t"], list(terms)).collect()}
    assert find("STRAẞE") == {1: f"…{text[60:120]}…", 2: "ſtraẞe (i)"} == find("straße", "none")
    assert find("😀") == {1: f"…{text[67:127]}…"} and find("(I)") == {2: "ſtraẞe (i)"} and find("STRASSE", "x.x") == {3: "strasse"}
    assert sorted(r["id"] for r in shaping.content_search(df, "id", ["t"], ["Straße"]).collect()) == [1, 2]


def test_mail_as_text(spark):
    sent = datetime.datetime(2024, 2, 3, 4, 5, 6)
    df = spark.createDataFrame([("f", "a b", sent, "s\nt", "From x\n>From y\nFromage", 1), ("f", None, None, None, None, 2)], "folder string, sender string, sent timestamp, subject string, body string, id int")
    got = [r["text"] for r in shaping.mbox_lines(df, "id").orderBy("id").collect()]
    assert got == ["From ab Sat Feb 03 04:05:06 2024\nFrom: a b\nSubject: s t\n\n>From x\n>>From y\nFromage\n", "From MAILER-DAEMON Thu Jan 01 00:00:00 1970\nFrom: \nSubject: \n\n\n"]
