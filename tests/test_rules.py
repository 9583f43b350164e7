"""Readers by kind, folder lists, CSV lines and rules on the cases that tables do not hold."""

import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import documents, lookup, pivot, readers, records
from gridloom.sources import csv, folders


def test_readers(spark):
    files = spark.createDataFrame([("a.md", "﻿# A\n\n## B\nx".encode()), ("b.txt", b""), ("c.bin", b"\x00\x01"), ("d.txt", b"\xff"), ("e.srt", b"1\n00:00:01,000 --> 00:00:02,000\nHi"), ("f.json", None), ("g.txt", b"x" * 99), ("h.ipynb", b'{"cells": [{"cell_type": "code", "source": "1"}]}')], "name string, body binary")
    chunks, outcomes = readers.Readers().read(files, "name", "body", most_bytes=60)
    assert sorted((r["key"], r["status"], r["message"], r["n_chunks"]) for r in outcomes.collect()) == [
        ("a.md", "Read", None, 2), ("b.txt", "Read", None, 1), ("c.bin", "Unsupported", "no reader of Unknown", 0), ("d.txt", "Refused", "no UTF-8 text", 0), ("e.srt", "Read", None, 1), ("f.json", "Read", None, 1), ("g.txt", "Refused", "too-many-bytes", 0), ("h.ipynb", "Read", None, 1)]
    assert sorted((r["key"], r["ordinal"], r["title"], r["text"]) for r in chunks.where("key in ('a.md', 'e.srt')").collect()) == [("a.md", 1, "A", "# A\n"), ("a.md", 2, "A > B", "## B\nx"), ("e.srt", 0, None, "Hi")]


def test_a_reader_of_ones_own(spark):
    mine = lambda df: df.select("key", F.lit(0).cast("long").alias("ordinal"), F.lit("x").alias("location"), F.lit(None).cast("string").alias("title"), F.upper("text").alias("text"))
    with pytest.raises(ValueError, match="there is a reader of Text"):
        readers.Readers().register("Text", mine)
    files = spark.createDataFrame([("a.txt", b"abc"), ("b.yml", b"a: b")], "name string, body binary")
    chunks, _ = readers.Readers().register("Text", mine, replace=True).register("Yaml", mine).read(files, "name", "body")
    assert sorted((r["key"], r["kind"], r["text"]) for r in chunks.collect()) == [("a.txt", "Text", "ABC"), ("b.yml", "Yaml", "A: B")]


def test_folders(spark, tmp_path):
    for name, size in (("b.csv", 5), ("a.CSV", 10), ("c.txt", 1), ("d/e.csv", 3), ("f.csv", 20), ("g.csv", 2)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    names = lambda **k: [(r["path"].rpartition("/")[2], r["size"], r["kind"]) for r in folders.list_files(spark, str(tmp_path), **k).orderBy("path").collect()]
    assert names(extensions=(".csv",)) == [("a.CSV", 10, "Csv"), ("b.csv", 5, "Csv"), ("e.csv", 3, "Csv"), ("f.csv", 20, "Csv"), ("g.csv", 2, "Csv")]
    assert [n[0] for n in names(most_bytes=20)] == ["a.CSV", "b.csv", "c.txt", "e.csv"] and [n[0] for n in names(recurse=False, most_files=2)] == ["a.CSV", "b.csv"]
    assert [n[0] for n in names(extensions=("csv",), most_bytes=17, recurse=False)] == ["a.CSV", "b.csv", "g.csv"]  # a file too large is passed over


def _lines(spark, path):
    return [r.value for r in spark.read.text(path).collect()]


def test_csv_lines(spark, tmp_path):
    df = spark.createDataFrame([("=a", True, None), ('q"', False, 1.5), ("s;t", None, 2.0)], "t string, b boolean, n double").coalesce(1)
    write = lambda name, **k: csv.write_lines(df, str(tmp_path / name), **k) or _lines(spark, str(tmp_path / name))
    assert write("a", sep=";", escape=True) == ["t;b;n", "'=a;true;", '"q""";false;1.5', '"s;t";;2.0']
    assert write("b", quote="always", null_value="-") == ["t,b,n", '"=a","true",-', '"q""","false","1.5"', '"s;t",-,"2.0"']
    assert write("c", quote="never", header=False) == ["=a,true,", 'q",false,1.5', "s;t,,2.0"]
    assert write("d", sep="t", quote_fields=("n",))[1] == '=at"true"t'  # a separator within a literal
    csv.write_lines(df.limit(0), str(tmp_path / "e"))
    assert _lines(spark, str(tmp_path / "e")) == ["t,b,n"]
    with pytest.raises(ValueError):
        csv.line(df, quote="some")


def test_ordered_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    csv.write_lines(spark.range(1000).repartition(5), str(tmp_path / "o"), order=["id"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "o").glob("part-*"))
    text = [f.read_text().splitlines() for f in files]
    assert len(files) > 1 and all(t[0] == "id" for t in text) and [int(x) for t in text for x in t[1:]] == list(range(1000))


def test_compressed_files_and_constants(spark, tmp_path):
    csv.write(spark.createDataFrame([("=x", 1)], "a string, b int"), str(tmp_path / "z"), compression="gzip", escape=True)
    assert list((tmp_path / "z").glob("*.gz"))
    got = csv.read(spark, str(tmp_path / "z"), sep=",", constants={"batch": "b1", "n": 7}).collect()
    assert [tuple(r) for r in got] == [("'=x", "1", "b1", 7)]


def test_small_document_functions(spark):
    df = spark.createDataFrame([(["a", None], [["1", "2"], ["3"]], [" A > B ", "", None, "c\\d"], "x/y.TAR")], "h array<string>, r array<array<string>>, p array<string>, f string")
    row = df.select(documents.table_text(F.col("h"), F.col("r")), documents.heading_path(F.col("p")), documents.kind_by_extension(F.col("f"), {"tar": "Archive"}), documents.kind_by_extension(F.lit("a.b/c"), {"b/c": "No"})).first()
    assert tuple(row) == ("a | \n1 | 2\n3", "A \\> B > c\\\\d", "Archive", "unknown")


@pytest.mark.parametrize(("text", "seconds"), [("P1Y", 31536000.0), ("P1M", 2592000.0), ("PT1M", 60.0), ("PT0.1234567S", 0.123456), ("-P1W", -604800.0), ("P", None), ("PT", None), ("P1D2H", None), ("", None), (None, None)])
def test_durations(spark, text, seconds):
    assert spark.createDataFrame([(text,)], "t string").select(scalars.iso_duration(F.col("t"))).first()[0] == seconds


def test_numbers_as_text(spark):
    got = spark.createDataFrame([(1.0,), (-0.5,), (1e15,), (1234567.0,), (None,)], "n double").select(scalars.number_text(F.col("n"))).collect()
    assert [r[0] for r in got] == ["1", "-0.5", "1.0E15", "1234567", None]


def test_number_groups_and_orders(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (25.0,), (None,)], "x double")
    assert [r["label"] for r in pivot.number_groups(df, "x", 10).collect()] == ["0-10", "10-20", "20-25", "(blank)"]
    assert [r["label"] for r in pivot.number_groups(df, "x", 10, start=5, end=15).collect()] == ["<5", "5-15", ">15", "(blank)"]
    assert pivot.number_groups(df.where("x is null"), "x", 1).first()["label"] == "(blank)"
    for bad in ({"interval": 0}, {"interval": 1, "start": 2, "end": 1}):
        with pytest.raises(ValueError):
            pivot.number_groups(df, "x", **bad)
    items = spark.createDataFrame([(i,) for i in ("a", "b", "c", None, "d")], "i string")
    assert [r["i"] for r in pivot.manual_order(items, "i", ["c", "a"]).collect()] == ["c", "a", "b", "d", None]
    assert sorted((r["i"] or "-") for r in pivot.field_filter(items, "i", visible=["a", None, "b"], hidden=["b"]).collect()) == ["-", "a"]


def test_rules_that_lack_operands():
    for k in ({"operator": "between", "first": 1}, {"operator": "gt", "first": 1, "second": 2}, {"operator": "eq"}):
        with pytest.raises(ValueError):
            records.validation_rule(F.lit(1), "whole", **k)


def test_a_common_name_keeps_few_candidates(spark):
    entries = spark.createDataFrame([(k, "Ann", [f"a{k}", None]) for k in range(50)], "e int, name string, more array<string>")
    got = lookup.resolve_by_sources(spark.createDataFrame([("ann ",), ("A7",), ("x",), (None,)], "who string"), "who", entries, "e", ["name", "more"], most=3).collect()
    assert sorted(((r["who"] or ""), r["status"], r["n_entries"], r["entry"], r["candidates"]) for r in got) == [("", "NotFound", 0, None, []), ("A7", "Resolved", 1, 7, [7]), ("ann ", "Ambiguous", 50, None, [0, 1, 2]), ("x", "NotFound", 0, None, [])]
