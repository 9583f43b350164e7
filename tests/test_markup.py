"""XML rows against the standard library's parser, and HTML sections of small pages."""

import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from gridloom.operators import markup


def _plain(text):
    out = []

    def walk(e, path):
        own = "".join([e.text or "", *((c.tail or "") for c in e)]).strip()
        out.append((path, "element", own or None))
        out.extend((f"{path}/@{k}", "attribute", v) for k, v in e.attrib.items())
        seen = {}
        for c in e:
            seen[c.tag] = seen.get(c.tag, 0) + 1
            walk(c, f"{path}/{c.tag}[{seen[c.tag]}]")

    root = ET.fromstring(text)
    walk(root, f"{root.tag}[1]")
    return sorted(out, key=str)


def _made(r, depth=0):
    name = r.choice(["a", "b", "c-d"])
    attributes = "".join(f' {n}={q}{r.choice(["1", "x &gt; y", "&#233;&#x20AC;"])}{q}' for n, q in zip(r.sample("pqr", r.randrange(3)), "\"'"))
    if r.random() < 0.2:
        return f"<{name}{attributes}/>"
    inner = "".join(r.choice([" text ", "&amp;&lt;", "<![CDATA[<b>&amp;]]>", "<!-- <a> -->", "<?go <b>?>", "é\n", _made(r, depth + 1) if depth < 5 else ""]) for _ in range(r.randrange(6)))
    return f"<{name}{attributes}>{inner}</{name} >"


def _rows(spark, texts):
    got = {}
    for x in markup.xml_rows(spark.createDataFrame(list(enumerate(texts)), "id int, body string"), "id", "body").collect():
        got.setdefault(x["id"], []).append((x["path"], x["type"], x["value"]))
    return {k: sorted(v, key=str) for k, v in got.items()}


def test_xml_rows(spark):
    r = random.Random(6)
    texts = [_made(r) for _ in range(150)]
    texts[0] = '<?xml version="1.0"?>\n<!DOCTYPE catalog [<!ELEMENT a (b)>]>\n<catalog><book id="b1"><title>One</title></book><book id="b2" n=\'>\'><title>Two</title></book></catalog>\n'
    assert _rows(spark, texts) == {k: _plain(t) for k, t in enumerate(texts)}


def test_what_is_no_xml_has_no_rows(spark):
    assert _rows(spark, ["<a><b></a></b>", "<a>", "</a>", "text", "", None, "<a></a>x", "<a>1 < 2</a>", "<a/>"]) == {8: [("a[1]", "element", None)]}


def test_deep_xml_is_an_error(spark):
    assert len(_rows(spark, ["<a>" * 32 + "</a>" * 32])[0]) == 32
    with pytest.raises(Exception, match="more than 32 elements"):
        _rows(spark, ["<a>" * 33 + "</a>" * 33])


def test_html_sections(spark):
    page = '<html><head><title>T</title><script>var a = "<h1>no</h1>";</script></head><body>Menu<h1 class="a>b">One <b>&amp; two</b></h1><p>a<br>b &nbsp; c</p><!-- <h2>no</h2> --><H2>Sub</H2><ul><li>x<li>y</ul><h1>End'
    got = markup.html_sections(spark.createDataFrame([(1, page), (2, ""), (3, None), (4, "a &copy; &#8364; &unknown; <")], "id int, body string"), "id", "body").orderBy("id", "section").collect()
    assert [(r["id"], r["section"], r["level"], r["title"], r["path"], r["text"]) for r in got] == [
        (1, 0, None, None, [], "T\nMenu"), (1, 1, 1, "One & two", ["One & two"], "One & two\na\nb c"), (1, 2, 2, "Sub", ["One & two", "Sub"], "Sub\nx\ny"), (1, 3, 1, "End", ["End"], "End"), (4, 0, None, None, [], "a © € &unknown; <")]


def test_html_nodes(spark):
    page = '<ul><li>a<ol><li>b<li>c</ol><li><a href="x?a=1&amp;b=2">d</a></ul><ul><li>e</ul><!-- <p> --><img SRC=\'i.png\'><form action=go><input name="n"></form></ul><p>'
    got = markup.html_nodes(spark.createDataFrame([(1, page), (2, None)], "id int, body string"), "id", "body").orderBy("node").collect()
    assert [(r["kind"], r["depth"], r["ordinal"], r["target"]) for r in got] == [
        ("list", 1, None, None), ("item", 1, 1, None), ("list", 2, None, None), ("item", 2, 1, None), ("item", 2, 2, None), ("item", 1, 2, None), ("link", 1, None, "x?a=1&b=2"), ("list", 1, None, None), ("item", 1, 1, None),
        ("image", 0, None, "i.png"), ("form", 0, None, "go"), ("field", 0, None, "n"), ("paragraph", 0, None, None)]


def test_xml_rows_are_read_where_the_text_stands(spark):
    rows = markup.xml_rows(spark.createDataFrame([(1, "<a x='1'>b<c/></a>"), (1, "<a>d</a>"), (None, "<a>e"), (2, None)], "id int, body string"), "id", "body")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "a[1]", "element", "b"), (1, "a[1]", "element", "d"), (1, "a[1]/@x", "attribute", "1"), (1, "a[1]/c[1]", "element", None)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
    # more letters than are handed over at once
    piece = "<b k='2'>" + "x" * 1000 + "</b>"
    long = spark.range(2).select("id", F.concat(F.lit("<a>"), F.repeat(F.lit(piece), 20_000), F.lit("</a>")).alias("body"))
    got = markup.xml_rows(long, "id", "body").groupBy("type").agg(F.count("*"), F.countDistinct("id", "path"), F.sum(F.length("value"))).collect()
    assert sorted(tuple(r) for r in got) == [("attribute", 40_000, 40_000, 40_000), ("element", 40_002, 40_002, 40_000_000)]
