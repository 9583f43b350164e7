"""Markdown lines, front matter, headings, tables and sections on small texts."""

from pyspark.sql import functions as F

from gridloom.operators import markdown


def _table(spark, *texts):
    return spark.createDataFrame([(k, t, "other") for k, t in enumerate(texts)], "id long, body string, line string")


FENCED = "# A\n```py\n# no\n~~~\n``\n```` \n# B\n~~~ x\n```\n# no\n~~~\n## C ##\n```` a`b\n### D\n   # E\n    # no\n#F\n#"


def test_headings_and_fences(spark):
    got = markdown.headings(_table(spark, FENCED), "id", "body").orderBy("index").collect()
    assert [(r["index"], r["line"], r["level"], r["title"]) for r in got] == [(0, 1, 1, "A"), (1, 7, 1, "B"), (2, 12, 2, "C"), (3, 14, 3, "D"), (4, 15, 1, "E"), (5, 18, 1, "")]
    assert [r["path"] for r in got] == [["A"], ["B"], ["B", "C"], ["B", "C", "D"], ["E"], [""]]


def test_anchors_are_unique(spark):
    text = "# One two\n# One-two\n# One two 1\n# One two\n# ?\n# ?\n"
    got = markdown.headings(_table(spark, text), "id", "body").orderBy("index").collect()
    assert [r["anchor"] for r in got] == ["one-two", "one-two-1", "one-two-1-1", "one-two-2", "section", "section-1"]


def test_an_open_fence_runs_to_the_end(spark):
    assert markdown.headings(_table(spark, "```\n# a\n# b", "", None, "\r\n# x\r# y"), "id", "body").select("id", "line").orderBy("line").collect() == [(3, 2), (3, 3)]


def test_front_matter(spark):
    texts = ["---\ntitle: \"A: b\"\ntags : x, y\n# note\ntitle: again\nempty:\n---\n# H\n", "---\r\na: 1\r\n...\r\n", "# H\n---\na: 1\n---", "---\na: 1\n", "---\n---\n# H", None]
    got = _table(spark, *texts).select(markdown.front_matter(F.col("body")).alias("m"), markdown.front_lines(F.col("body")).alias("n")).collect()
    assert [r["m"] for r in got] == [{"title": "A: b", "tags": "x, y", "empty": ""}, {"a": "1"}, None, None, {}, None]
    assert [r["n"] for r in got] == [7, 3, 0, 0, 2, 0]
    heads = markdown.headings(_table(spark, *texts), "id", "body").select("id", "line", "title").orderBy("id").collect()
    assert heads == [(0, 8, "H"), (2, 1, "H"), (4, 3, "H")]


def _tables(spark, text, **k):
    return [(r["table"], r["start_line"], r["end_line"], r["columns"], r["rows"]) for r in markdown.tables(_table(spark, text), "id", "body", **k).orderBy("table").collect()]


def test_tables(spark):
    text = "x\n| a | | c\\|d |\n|:---|---:|:---:|\n| 1 | 2 |\n1 | 2 | 3 | 4\n\nno | table\n--|---\n\np|q\n---|---\n```\nr|s\n---|---\n```\nn|m\na|b\n----|----\nlast|"
    assert _tables(spark, text) == [(0, 2, 5, ["a", "Column2", "c|d"], [["1", "2", ""], ["1", "2", "3"]]), (1, 10, 11, ["p", "q"], []), (2, 17, 19, ["a", "b"], [["last", ""]])]
    assert _tables(spark, "no pipes\n---\n") == [] == _tables(spark, "")


def test_tables_without_a_header(spark):
    text = "|a|b|\n|c|d|\n\na|b\nc|d\n\n|a|b|\n|c|\n"
    assert _tables(spark, text) == []
    assert _tables(spark, text, headerless=True) == [(0, 1, 2, ["Column1", "Column2"], [["a", "b"], ["c", "d"]])]


def test_sections(spark):
    got = markdown.sections(_table(spark, "---\na: 1\n---\nintro\n# A\ntext\n\n## B\n```\n# c\n```\n# D", "\n\n# only"), "id", "body").orderBy("id", "section").collect()
    assert [(r["id"], r["section"], r["start_line"], r["end_line"], r["level"], r["path"], r["text"]) for r in got] == [
        (0, 0, 4, 4, None, [], "intro"), (0, 1, 5, 7, 1, ["A"], "# A\ntext\n"), (0, 2, 8, 11, 2, ["A", "B"], "## B\n```\n# c\n```"), (0, 3, 12, 12, 1, ["D"], "# D"), (1, 1, 3, 3, 1, ["only"], "# only")]


def _packed(sizes, most, overlap):
    """Runs by trying, one block after another."""
    runs, first, i = [], 0, 0
    while i < len(sizes):
        last = i
        while last + 1 < len(sizes) and sum(sizes[first : last + 2]) <= most:
            last += 1
        runs.append((first, i, last))
        i = last + 1
        if i < len(sizes):
            first = next(f for f in range(first + 1, i + 1) if f == i or (sum(sizes[f:i]) <= overlap and sum(sizes[f : i + 1]) <= most))
    return runs


def test_packing(spark):
    import random

    from gridloom.operators import hierarchy

    r = random.Random(8)
    cases = [[r.randrange(1, 40) for _ in range(r.randrange(1, 30))] for _ in range(60)] + [[100], [5, 200, 5], [30] * 5]
    sums = [[sum(c[:k]) for k in range(len(c) + 1)] for c in cases]
    for most, overlap in ((50, 0), (50, 20), (64, 63)):
        got = spark.createDataFrame(list(enumerate(sums)), "id int, s array<long>").select("id", hierarchy.pack(F.col("s"), most, overlap).alias("r")).collect()
        for row in got:
            assert [tuple(x) for x in row["r"]] == _packed(cases[row["id"]], most, overlap)


def test_chunks_stay_in_their_section(spark):
    from gridloom.operators import hierarchy

    text = "# A\n\none two three four five six seven eight\n\nnine ten\n\n## B\n\n" + "x" * 400 + "\n\nend\n\n# C\n"
    sections = markdown.sections(_table(spark, text, None), "id", "body")
    got = hierarchy.chunks(sections, "id", most=12, overlap=4).orderBy("chunk").collect()
    assert [(r["chunk"], r["section"], r["path"], r["first_block"], r["last_block"], r["n_overlap"], r["tokens"]) for r in got] == [
        (0, 1, ["A"], 0, 1, 0, 11), (1, 1, ["A"], 2, 2, 0, 2), (2, 2, ["A", "B"], 0, 0, 0, 1), (3, 2, ["A", "B"], 1, 1, 0, 100), (4, 2, ["A", "B"], 2, 2, 0, 1), (5, 3, ["C"], 0, 0, 0, 1)]
    assert got[3]["text"] == "x" * 400
    plain = hierarchy.chunks(sections, "id", most=12, overlap=4, tokens=lambda c: F.size(F.split(c, " "))).orderBy("chunk").first()
    assert (plain["last_block"], plain["tokens"]) == (2, 12)


def test_rewriting_leaves_code_alone(spark):
    got = markdown.rewrite(_table(spark, "---\na: x\n---\nx y\n```\nx\n```\nxx\r\n", None), "id", "body", [("one", "x", "z"), ("two", "^zz$", "w"), ("none", "q", "")]).orderBy("id").collect()
    assert [(r["text"], r["changes"]) for r in got] == [("---\na: x\n---\nz y\n```\nx\n```\nw\n", {"one": 2, "two": 1, "none": 0}), ("", {"one": 0, "two": 0, "none": 0})]


def test_structured_documents_are_cut(spark):
    import json

    df = _table(spark, "# A\nab\n# B\ncdef\n\na|b\n---|---\n1|2", "")
    whole = [json.loads(r["document"]) for r in markdown.structured(df, "id", "body").orderBy("id").collect()]
    assert [s["id"] for s in whole[0]["sections"]] == ["section-0000", "section-0001"] and whole[0]["tables"][0]["rows"] == [["1", "2"]] and not whole[0]["truncated"]
    assert whole[1] == {"sections": [], "tables": [], "truncated": False}
    few = json.loads(markdown.structured(df, "id", "body", most_sections=1).orderBy("id").first()["document"])
    assert (len(few["sections"]), few["truncated"]) == (1, True)
    short = json.loads(markdown.structured(df, "id", "body", most_chars=9).orderBy("id").first()["document"])
    assert [s["text"] for s in short["sections"]] == ["# A\nab", "# B"] and short["truncated"]
