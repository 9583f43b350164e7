"""Record queries, explicit mappings and texts that are lists, on the cases that tables do not hold."""

import datetime

import pytest
from pyspark.sql import functions as F

from gridloom.operators import cells, query, rows


def _walk(asked, df):
    out, token = [], None
    while True:
        page = asked.run(df, token)
        out.append([tuple(r) for r in page.rows.collect()])
        token = page.token
        assert page.has_more == (token is not None)
        if token is None:
            return out


@pytest.mark.parametrize("descending", [False, True])
def test_pages_with_nulls_and_times(spark, descending):
    day = lambda k: datetime.datetime(2024, 1, k, 12, 30, 0, 5)
    data = [(1, day(3), "b"), (2, None, "a"), (3, day(3), None), (4, day(1), "b"), (5, None, None), (6, day(2), "é"), (7, None, "a")]
    df = spark.createDataFrame(data, "id int, at timestamp, name string")
    asked = query.RecordQuery(None, [("at", descending), ("name", True), ("id", False)], ["id"], size=2)
    order = {False: [4, 6, 1, 3, 2, 7, 5], True: [1, 3, 6, 4, 2, 7, 5]}[descending]
    assert _walk(asked, df) == [[(i,) for i in order[k : k + 2]] for k in range(0, 7, 2)]


def test_limits_and_flags(spark):
    df = spark.range(20)
    asked = query.RecordQuery(F.col("id") % 2 == 0, [("id", True)], ["id"], size=3, most_scanned=10, scan_order=["id"])
    assert _walk(asked, df) == [[(8,), (6,), (4,)], [(2,), (0,)]]
    assert asked.run(df).scan_limit_reached and not asked.run(df.limit(10)).scan_limit_reached
    assert not asked.run(df.where("id < 0")).has_more


def test_tokens_of_another_query_are_rejected(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    df, key = spark.read.parquet(str(tmp_path / "t")), [("id", False)]
    token = query.RecordQuery(F.col("id") > 1, key, ["id"], size=3).run(df).token
    assert query.RecordQuery(F.col("id") > 1, key, ["id"], size=4).run(df, token).rows.first()["id"] == 5  # a page may be of another size
    for other in (query.RecordQuery(F.col("id") > 2, key, ["id"]), query.RecordQuery(F.col("id") > 1, [("id", True)], ["id"]), query.RecordQuery(F.col("id") > 1, key, ["id"], most_scanned=5, scan_order=["id"])):
        with pytest.raises(ValueError, match="another query or source"):
            other.run(df, token)
    spark.range(3).write.mode("append").parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="another query or source"):
        query.RecordQuery(F.col("id") > 1, key, ["id"]).run(spark.read.parquet(str(tmp_path / "t")), token)
    with pytest.raises(ValueError, match="not a continuation token"):
        query.RecordQuery(None, key, ["id"]).run(df, "%%%")


@pytest.mark.parametrize("bad", [{"columns": []}, {"columns": ["a", "A "]}, {"columns": [" "]}, {"size": 0}, {"most_scanned": 5}, {"keys": []}])
def test_queries_that_are_refused(bad):
    with pytest.raises(ValueError):
        query.RecordQuery(**({"where": None, "keys": [("id", False)], "columns": ["id"]} | bad))
    with pytest.raises(ValueError, match="since"):
        query.message_filter([], since=2, before=1)
    assert query.RecordQuery(None, [("id", False)]).columns == query.MESSAGE_FIELDS


def test_explicit_mapping(spark):
    df = spark.createDataFrame([("1", "x", " "), ("a", "y", "z")], "Id string, name string, NAME string")
    assert [tuple(r) for r in rows.map_explicit(df.where("Id = '1'"), {"n": ("ID", "int"), "t": ("name", "string")}).collect()] == [(1, "x")]
    with pytest.raises(ValueError, match="no column size; there are Id"):
        rows.map_explicit(df, {"n": ("size", "int")})
    with pytest.raises(ValueError, match="ambiguous: name, NAME"):
        rows.map_explicit(df, {"n": ("Name", "string")})
    with pytest.raises(Exception, match="n: no int: a"):
        rows.map_explicit(df, {"n": ("Id", "int")}).collect()


def test_converters(spark):
    df = spark.createDataFrame([(1, "yes", "3"), (2, "maybe", "x"), (3, None, " ")], "k int, a string, b string")
    yes = lambda c: F.when(c == "yes", True).when(c == "no", False)
    good, bad = rows.convert(df, "k", {"a": ("boolean", yes), "b": ("int", lambda c: c.try_cast("int"))}, defaults={"b": 7})
    assert sorted(tuple(r) for r in good.collect()) == [(1, True, 3), (3, None, 7)]
    assert sorted(tuple(r) for r in bad.collect()) == [(2, "a", "boolean", "maybe"), (2, "b", "int", "x")]
    assert {r["value"] for r in rows.convert(df, "k", {"a": ("boolean", yes)}, redact=True)[1].collect()} == {"(redacted)"}


def test_notebooks(spark):
    book = '{"cells": [{"cell_type": "raw", "source": "a\\n\\"b\\""}, {"cell_type": "code", "source": ["x = 1\\n", "y"], "outputs": [{"text": ["1\\n", "2"]}, {"data": {"text/plain": "p", "image/png": "A"}}, {"data": {"image/png": "A"}}, {"ename": "E", "evalue": "v"}]}, {"cell_type": "markdown", "source": []}]}'
    got = cells.notebook_cells(spark.createDataFrame([(1, book), (2, "[1]"), (3, None), (4, "no json"), (5, '{"cells": []}')], "id int, body string"), "id", "body", most_outputs=3).orderBy("cell").collect()
    assert [(r["id"], r["cell"], r["kind"], r["source"], r["outputs"], r["n_outputs"]) for r in got] == [(1, 0, "raw", 'a\n"b"', [], 0), (1, 1, "code", "x = 1\ny", ["1\n2", "p", ""], 4), (1, 2, "markdown", "", [], 0)]


def test_subtitles(spark):
    text = "WEBVTT\n\nNOTE no cue\n\n00:01.500 --> 00:02.000 line:0\n- <v Ann>Hi</v>\n- there\n\n\n\nname\n01:00:00,001-->01:00:00,002\n{\\an8}<i>x</i>  y\n\n7\n00:00:01,000 --> oops\nno\n\n8\n00:00:03,000 --> 00:00:04,000"
    got = cells.subtitle_cues(spark.createDataFrame([(1, text), (2, None)], "id int, body string"), "id", "body").orderBy("cue").collect()
    assert [(r["cue"], r["start_ms"], r["end_ms"], r["text"]) for r in got] == [(0, 1500, 2000, "- Hi\n- there"), (1, 3600001, 3600002, "x y"), (2, 3000, 4000, "")]


def test_templates(spark):
    df = spark.createDataFrame([(1234.5, "2024-02-03", None, "{{a}}")], "n double, d string, z string, m string")
    text = "{{A}}|{{a:#,##0.0}}|{{d:yyyy}}|{{d:0.0}}|{{z}}|{{m}}|{{q:1}}|{{|}}{{ a }}"
    got = df.select(cells.fill(F.lit(text), {"a": F.col("n"), "d": F.col("d"), "z": F.col("z"), "m": F.col("m")})).first()[0]
    assert got == "1234.5|1,234.5|2024|2024-02-03||{{a}}|{{q:1}}|{{|}}1234.5"


def test_first_rows(spark):
    got = spark.createDataFrame([([1, 2, 3],), ([],)], "r array<int>").select(cells.first_rows(F.col("r"), 2).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [([1, 2], 3, True), ([], 0, False)]
