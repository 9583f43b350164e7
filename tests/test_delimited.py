"""Records of delimited text against a parser that reads letter by letter, over files cut into small blocks."""

import random

import pytest

from gridloom.sources import csv, delimited


def _plain(text, comment=None):
    """(start line, end line, fields) of each record of a text."""
    out, line = [], 1
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    k = 0
    while k < len(lines):
        start, record, k = k, lines[k], k + 1
        while _open(record, comment) and k < len(lines):
            record, k = record + "\n" + lines[k], k + 1
        first = lines[start]
        if not (_blank(first) and k == start + 1) and not (comment and first.startswith(comment)):
            out.append((start + 1, k, record))
        line = k
    return [(a, b, r, _fields(r)) for a, b, r in out]


def _blank(line):
    return all(c <= " " for c in line)


def _open(record, comment):
    return not (comment and record.startswith(comment)) and _scan(record)[1]


def _fields(record):
    return _scan(record)[0]


def _scan(record):
    fields, i, n = [], 0, len(record)
    while True:
        out = ""
        if i < n and record[i] == '"':
            i += 1
            while True:
                if i == n:
                    return [*fields, out], True
                if record[i] == '"':
                    if record[i + 1 : i + 2] == '"':
                        out, i = out + '"', i + 2
                        continue
                    i += 1
                    break
                out, i = out + record[i], i + 1
        while i < n and record[i] != ",":
            out, i = out + record[i], i + 1
        fields.append(out)
        if i == n:
            return fields, False
        i += 1


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "37b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _write(folder, texts):
    folder.mkdir()
    for k, text in enumerate(texts):
        (folder / f"{k}.csv").write_bytes(text.encode())


@pytest.mark.parametrize("comment", [None, "#"])
def test_records(spark, small_blocks, tmp_path, comment):
    r = random.Random(4)
    texts = ["".join(r.choice('ab,,""\n\n x#é') for _ in range(r.randrange(30, 500))) for _ in range(12)] + ['a,"b', "", "\n\n", '"x\n\n#y"\nz', '#"\na']
    _write(tmp_path / "in", texts)
    got = {}
    for x in delimited.records(spark, str(tmp_path / "in"), comment=comment).collect():
        got.setdefault(int(x["file"].rpartition("/")[2][:-4]), []).append((x["record_number"], x["start_line"], x["end_line"], x["record"], x["fields"]))
    want = {k: [(n, *x) for n, x in enumerate(_plain(t, comment), 1)] for k, t in enumerate(texts)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_strict_quotes(spark, tmp_path):
    _write(tmp_path / "in", ['id,text\n1,"a ""b"""\n2,a"b\n3,"a"b\n4,plain\n5,"open\n'])
    read = lambda **k: sorted(delimited.records(spark, str(tmp_path / "in"), skip=1, **k).collect(), key=lambda x: x["record_number"])
    assert [x["fields"][1] for x in read()] == ['a "b"', 'a"b', "ab", "plain", "open"]
    assert [x["problem"] for x in read()] == [None] * 5
    stray = "a quote within a field that is not quoted, or text behind a closing quote"
    assert [x["problem"] for x in read(strict=True)] == [None, stray, stray, None, "a quote is not closed"]
    assert [x["record_number"] for x in read(strict=True, on_error="skip")] == [1, 4]
    with pytest.raises(Exception, match="0.csv, line 3: a quote within"):
        read(strict=True, on_error="fail")
    with pytest.raises(ValueError):
        read(on_error="ask")
    with pytest.raises(ValueError):
        delimited.Grammar('"')


def test_separators(spark, tmp_path):
    for k, sep in enumerate("\t|;^"):
        _write(tmp_path / str(k), [f'a{sep}"b{sep}""c"{sep}\n\nx{sep}\n'])
        got = delimited.records(spark, str(tmp_path / str(k)), sep=sep).orderBy("record_number").collect()
        assert [x["fields"] for x in got] == [["a", f"b{sep}\"c", ""], ["x", ""]]


def test_rows_with_errors(spark, tmp_path):
    _write(tmp_path / "in", ['id,size\n5,\n6,7,\n8\nid,size\n9,x\n10,"1\n2"\n11,12\n', "id,size\n1,2\n"])
    good, bad = csv.read_with_errors(spark, str(tmp_path / "in"), "id long, size int")
    assert sorted(tuple(x) for x in good.collect()) == [(1, 2), (5, None), (11, 12)]
    got = [(x["record_number"], x["start_line"], x["end_line"], x["message"]) for x in bad.orderBy("record_number").collect()]
    assert got == [(2, 3, 3, "too many fields: 2 are wanted, there are 3"), (3, 4, 4, "too few fields: 2 are wanted, there are 1"), (4, 5, 5, "id: no bigint"), (5, 6, 6, "size: no int"), (6, 7, 8, "size: no int")]


def test_an_empty_table_has_its_header(spark, tmp_path):
    path = str(tmp_path / "out")
    csv.write(spark.createDataFrame([], "name string, value int"), path)
    assert [r.value for r in spark.read.text(path).collect()] == ["name,value"]
    assert csv.read(spark, path, sep=",").columns == ["name", "value"]


def test_headers():
    assert csv.unique_headers(["Name", "Name", "Value"]) == ["Name", "Name_2", "Value"]
    assert csv.unique_headers(["Name", "Name", "Name_2"]) == ["Name", "Name_3", "Name_2"]
    assert csv.unique_headers(["", "H1", None, "H2"]) == ["H3", "H1", "H4", "H2"]


def test_delimiters():
    assert csv.detect_delimiter(['"a;b;c",1']) == ","
    assert csv.detect_delimiter(["a;b,c", "d;e"]) == ";"
    assert csv.detect_delimiter(['a\t"b,c', "d\te"]) == "\t"
