"""Resumable search, processors, kinds of content, semantic records and links of messages on small tables."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import processors, resume, semantic, threads
from gridloom.sources import kinds


def _docs(spark, n=40, extra=()):
    return spark.createDataFrame([(k // 2, f"text {'needle' if k % 5 == 0 else 'hay'} {k}") for k in range(n)] + [(None, "Needle of no key"), *extra], "id long, body string").repartition(3)


def test_a_stopped_search_is_taken_up(spark, tmp_path):
    make = lambda df, terms=("needle",), **k: resume.ResumableSearch(df, "id", ["body"], list(terms), str(tmp_path / "s"), ranges=4, **k)
    first = make(_docs(spark))
    assert first.ranges == 4 and first.position() == 0 and first.results().count() == 0 and not first.run(1)
    at = first.checkpoint()
    again = make(_docs(spark))  # the rows stand otherwise, but are the same
    assert again.position() == 1 and again.check(at) == 1 and again.run() and again.position() == 4
    whole = sorted((r["id"] is not None, r["id"], r["body"]) for r in again.find(_docs(spark)).collect())
    assert sorted((r["id"] is not None, r["id"], r["body"]) for r in again.results().collect()) == whole and len(whole) == 9
    with pytest.raises(ValueError, match="another query"):
        make(_docs(spark), ("hay",))
    with pytest.raises(ValueError, match="changed or different source"):
        make(_docs(spark, extra=[(3, "more")]))
    with pytest.raises(ValueError, match="not a checkpoint"):
        again.check("!")
    other = resume.ResumableSearch(_docs(spark), "id", ["body"], ["hay"], str(tmp_path / "o"), ranges=1)
    with pytest.raises(ValueError, match="another query"):
        other.check(at)
    assert other.ranges == 1 and other.run()


def test_a_search_finds_places_behind_letters_of_a_longer_upper_case(spark, tmp_path):
    body = "ß" * 50 + "needle" + "y" * 50
    search = resume.ResumableSearch(_docs(spark, 0, [(1, body)]), "id", ["body"], ["Needle", "nEEDLe "], str(tmp_path / "s"), ranges=2)
    assert search.run() and [r["snippet"] for r in search.results().where("id = 1").collect()] == [f"…{body[20:80]}…"]


def test_an_unended_range_is_done_again(spark, tmp_path):
    search = resume.ResumableSearch(_docs(spark), "id", ["body"], ["needle"], str(tmp_path / "s"), ranges=4)
    search.run(2)
    (tmp_path / "s" / "range-000001" / "_SUCCESS").unlink()
    assert search.position() == 1 and search.run() and search.results().count() == 9


STEPS = [
    processors.Processor("a", lambda t: {"x": F.col("x") + 1}, lambda t: F.when(F.col("x") == 2, "two")),
    processors.Processor("b", lambda t: {"y": F.col("x") * 10}, lambda t: F.when(F.col("x") == 4, "four")),
]


@pytest.mark.parametrize(("policy", "want"), [
    ("continue", [(2, 20, "CC"), (2, 20, "FC"), (4, None, "CF"), (5, 50, "CC")]), ("stop", [(2, 20, "CC"), (2, None, "FS"), (4, None, "CF"), (5, 50, "CC")]),
])
def test_processors(spark, policy, want):
    table = spark.createDataFrame([(1,), (2,), (3,), (4,)], "x int")
    got = processors.process(table, STEPS, policy).collect()
    assert sorted(((r["x"], r["y"], "".join(s["status"][0] for s in r["steps"])) for r in got), key=str) == sorted(want, key=str)


def test_processors_throw_and_ids(spark):
    table = spark.createDataFrame([(1,), (2,)], "x int")
    with pytest.raises(Exception, match=r"processor a \(0\): two"):
        processors.process(table, STEPS).collect()
    assert processors.process(table.where("x = 1"), STEPS).select("y").first()[0] == 20
    assert processors.process(table, []).first()["steps"] == []
    for bad in ([STEPS[0], processors.Processor(" A", lambda t: {})], [processors.Processor(" ", lambda t: {})]):
        with pytest.raises(ValueError, match="unique ids"):
            processors.process(table, bad)


def test_kinds(spark):
    cases = [
        ("a.docx", b"PK\x03\x04..word/document.xml", "Word", False), ("a.doc", bytes.fromhex("D0CF11E0A1B11AE1"), "Word", False), ("a.pdf", b"plain text", "Pdf", False), ("a.csv", b"%PDF-1.4", "Pdf", True), ("a", b"", "Unknown", False), ("a.txt", None, "Text", False),
        ("x", b"1\n00:00:01,000 --> 00:00:02,000\nHi", "Subtitle", False), ("x", b"WEBVTT\n", "Subtitle", False), ("x.ipynb", b'{"cells": []}', "Notebook", False), ("x", b"[1, 2]", "Json", False), ("x", b"---\na: 1\n---\n# H", "Markdown", False), ("x", b"\x00\x01", "Unknown", False), ("x", "é Ω".encode(), "Text", False), ("x.html", b"<?xml version='1.0'?>", "Html", False),
    ]
    got = kinds.detect(spark.createDataFrame([(k, n, c) for k, (n, c, _, _) in enumerate(cases)], "id int, name string, body binary"), "name", "body").orderBy("id").collect()
    assert [(r["kind"], r["mismatch"]) for r in got] == [c[2:] for c in cases]
    by_name = kinds.detect(spark.createDataFrame([("a.csv", b"%PDF-1.4"), ("a", b"%PDF-1.4")], "name string, body binary"), "name", "body", mode="content_when_unknown").orderBy("name").collect()
    assert [(r["kind"], r["inspected_bytes"]) for r in by_name] == [("Pdf", 8), ("Csv", 0)]
    assert [r["kind"] for r in kinds.detect(spark.createDataFrame([("a", b"%PDF-1.4")], "name string, body binary"), "name", "body", mode="extension_only").collect()] == ["Unknown"]


def test_the_order_of_parts_does_not_matter(spark):
    rows = [(1, ["x", "y"], "s", None), (2, ["y", "x"], "s", None), (3, ["x", "y", "y"], "s", None), (4, ["xy"], "s", None), (5, None, "s", ""), (6, None, "s", None)]
    df = spark.createDataFrame(rows, "id int, parts array<string>, subject string, note string")
    got = {r["id"]: r["f"] for r in df.select("id", semantic.fingerprint(semantic.entries(df, profile="migration")).alias("f")).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 5


def test_runs_over_halves_equal_one_over_the_whole(spark, tmp_path):
    df = spark.createDataFrame([(k, str(k % 7) if k % 10 else None) for k in range(40)], "id int, digest string")
    index = semantic.DedupIndex(spark, str(tmp_path / "i"))
    halves = [index.add(df.where(f"id {c}"), "digest", ["id"], run) for run, c in (("1", "< 20"), ("2", ">= 20"))]
    ids = lambda t: sorted(r["id"] for r in t.collect())
    whole = ids(semantic.DedupIndex(spark, str(tmp_path / "w")).add(df, "digest", ["id"], "1"))
    assert ids(halves[0]) + ids(halves[1]) == whole and len(whole) == 7 + 4
    assert ids(index.add(df.where("id < 20"), "digest", ["id"], "1")) == ids(halves[0])  # a run that is repeated
    assert index.digests().count() == 7


def test_differences_of_repeated_and_missing_parts(spark):
    schema = "id int, parts array<string>, note string"
    a = spark.createDataFrame([(1, ["x", "y"], "n"), (2, None, None), (3, ["q"], "n")], schema)
    b = spark.createDataFrame([(1, ["y", "x"], "N"), (2, ["z"], None), (4, None, "n")], schema)
    got = [tuple(r) for r in semantic.differences(a, b, "id").orderBy("id", "path").collect()]
    assert got == [(1, "note", "Changed", 1, 1, False), (2, "parts/00000000", "UnexpectedInDestination", None, 1, False), (3, "note", "MissingFromDestination", 1, None, False), (3, "parts/00000000", "MissingFromDestination", 1, None, False), (4, "note", "UnexpectedInDestination", None, 1, False)]
    capped = semantic.differences(a, b, "id", most=5).collect()
    assert len(capped) == 5 and not any(r["truncated"] for r in capped)
    assert {r["truncated"] for r in semantic.differences(a, b, "id", most=4).collect()} == {True}


def test_links_of_messages(spark):
    t = lambda h: f"2024-01-01 00:00:00 +{h}"  # noqa: E731, F841
    day = 86400
    rows = [
        (1, "<a>", [], "Plan", 0, []), (2, "<b>", ["<a>"], "Re: Plan", 100, []), (3, "<c>", ["<x>", " b "], "other", 200, []), (4, None, None, "RE[3]: plan", 300, None), (5, "<b>", [], "copy", 400, []),
        (6, "<f>", [], "Plan", 20 * day, ["m1"]), (7, "<g>", [], "no", 5, ["m1", "m1", ""]), (8, "<h>", [], "fwd: FW:  Plan", 33 * day, []), (9, "<i>", [], "Re:", 7, []), (10, "<j>", [], None, 8, []), (11, "<k>", ["<k>"], "self", 9, []),
    ]
    df = spark.createDataFrame(rows, "id int, message_id string, references array<string>, subject string, at long, related array<string>").withColumn("sent", F.timestamp_seconds("at"))
    got = sorted(tuple(r) for r in threads.links(df).collect())
    assert got == [(2, 1, "reference"), (3, 2, "reference"), (4, 2, "subject"), (5, 2, "reference"), (7, 6, "related"), (8, 6, "subject")]
    parts = {r["id"]: (r["conversation"], r["heuristic"]) for r in threads.conversations(df).collect()}
    assert parts == {**{k: (1, True) for k in (1, 2, 3, 4, 5)}, **{k: (6, True) for k in (6, 7, 8)}, 9: (9, False), 10: (10, False), 11: (11, False)}
    assert threads.links(df, subjects=False).where("kind = 'subject'").count() == 0
