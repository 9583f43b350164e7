"""XML and HTML texts as rows: tags are tokens. What is open around them is carried by a stack in XML, and by windows over a document's tokens in HTML."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Comments, character data, instructions, declarations, tags (a > within quotes does not end one), and text.
TOKEN = r"""<!--(?s:.*?)-->|<!\[CDATA\[(?s:.*?)\]\]>|<\?(?s:.*?)\?>|<![A-Za-z][^>\[]*+(?:\[[^\]]*+\])?+[^>]*+>|</[^>]*+>|<(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++|<"""
ATTRIBUTE = r"""([^\s=<>"'/]++)\s*+=\s*+("[^"]*+"|'[^']*+')"""
# Names of characters in texts. Fixed values.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
NAMED_HTML = NAMED | {"nbsp": " ", "copy": "©", "reg": "®", "middot": "·", "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "bull": "•", "trade": "™", "euro": "€"}
#: Tags that break a line of text.
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"


def characters(text: Column, named: dict[str, str] = NAMED) -> Column:
    """Text with its character references decoded; unknown names and numbers stay."""
    parts = F.regexp_extract_all(text, F.lit(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*+);|[^&]++|&"), F.lit(0))
    names = F.create_map(*(F.lit(x) for pair in named.items() for x in pair))

    def one(p: Column) -> Column:
        digits = F.regexp_extract(p, "^&#[xX]?([0-9A-Fa-f]+);$", 1)
        code = F.when(p.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        name = F.try_element_at(names, F.regexp_extract(p, "^&([A-Za-z][A-Za-z0-9]*);$", 1))
        return F.when(~F.startswith(p, F.lit("&")), p).when(F.startswith(p, F.lit("&#")) & valid, letter).otherwise(F.coalesce(name, p))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(text)


_TOKEN, _NAME, _ATTRIBUTE = (re.compile(x, re.ASCII) for x in (TOKEN, r"</?([^\s/>]+)", ATTRIBUTE))
_REFERENCE = re.compile(r"&(?:#(\d{1,7})|#[xX]([0-9A-Fa-f]{1,6})|([A-Za-z][A-Za-z0-9]*+));")
_SPACE = " \t\n\v\f\r"
#: Letters of values and paths, about, that are handed over at once.
_BATCH = 16_000_000


def _decoded(text: str) -> str:
    """As `characters`, of one text."""

    def one(m: re.Match) -> str:
        if m[3]:
            return NAMED.get(m[3], m[0])
        code = int(m[1]) if m[1] else int(m[2], 16)
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]

    return _REFERENCE.sub(one, text) if "&" in text else text


@lru_cache(4096)
def _tag(token: str) -> tuple[str, str, list[tuple[str, str]]]:
    """Kind (close, lone, open or bad), name and attributes of a tag."""
    m = _NAME.match(token)
    if not m:
        return "bad", "", []
    kind = "close" if token.startswith("</") else "lone" if token.endswith("/>") else "open"
    return kind, m[1], [(f"/@{name}", _decoded(quoted[1:-1])) for name, quoted in _ATTRIBUTE.findall(token)] if "=" in token else []


def _elements(xml: str, depth: int) -> list[tuple[str, list[tuple[str, str]], list[str]]]:
    """(path, attributes, pieces of its own text) of the elements of a text; none if its tags do not close in order."""
    out, deepest = [], 0
    open_ = [("", "", {}, None)]  # of what is open: name, path, numbers given to its children by name, and pieces of text
    for token in _TOKEN.findall(xml):
        if token[0] != "<" or token.startswith("<![CDATA["):
            pieces = open_[-1][3]
            if pieces is not None:
                pieces.append(_decoded(token) if token[0] != "<" else token[9:-3])
            elif token.strip(_SPACE):
                return []
        elif not token.startswith(("<!", "<?")):
            # long tags are read, but not kept in memory
            kind, name, attributes = _tag(token) if len(token) < 256 else _tag.__wrapped__(token)
            if kind == "bad":
                return []
            if kind == "close":
                if len(open_) == 1 or open_.pop()[0] != name:
                    return []
                continue
            _, path, numbers, _ = open_[-1]
            number = numbers[name] = numbers.get(name, 0) + 1
            path, pieces = f"{path}/{name}[{number}]" if path else f"{name}[{number}]", []
            out.append((path, attributes, pieces))
            if len(open_) > deepest:
                deepest = len(open_)
            if kind == "open":
                open_.append((name, path, {}, pieces))
    if len(open_) > 1:
        return []
    if deepest > depth:
        raise ValueError(f"more than {depth} elements within each other: {deepest}")
    return out


def xml_rows(df: DataFrame, key: str, xml: str, depth: int = 32) -> DataFrame:
    """Elements and attributes of XML texts as rows: key, path (catalog[1]/book[2]/@id, numbered among siblings of a name), type (element or attribute) and value (an element's own text, trimmed; null for none).

    A text whose tags do not close in order has no rows. More than `depth`
    elements within each other are an error, not a loss. Each text is read where it
    stands, token by token, so that nothing is shuffled.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.array(["element", "attribute"], pa.string())
        for batch in batches:
            at, paths, kind, values, size = [], [], [], [], 0
            made = lambda: pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(paths, pa.string()), kinds.take(pa.array(kind, pa.int8())), pa.array(values, pa.string())], names=[key, "path", "type", "value"])  # noqa: B023, E731
            for k, text in enumerate(batch.column(1)):
                for path, attributes, pieces in _elements(text.as_py() or "", depth):
                    value = "".join(pieces).strip(_SPACE) or None
                    at.append(k)
                    paths.append(path)
                    kind.append(0)
                    values.append(value)
                    size += len(path) + len(value or "")
                    for name, held in attributes:
                        at.append(k)
                        paths.append(path + name)
                        kind.append(1)
                        values.append(held)
                        size += len(path) + len(name) + len(held)
                    if size > _BATCH:
                        yield made()
                        at, paths, kind, values, size = [], [], [], [], 0
            yield made()

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(c, T.StringType()) for c in ("path", "type", "value"))])
    return df.select(key, F.col(xml).cast("string").alias("_xml")).mapInArrow(rows, schema)


def html_sections(df: DataFrame, key: str, html: str) -> DataFrame:
    """HTML texts by headings: key, section (0 before the first), level, title, path and text (lines of blocks, the title first), without scripts, styles, templates and comments. Sections without text are left out; keys are unique."""
    bare = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<!--.*?-->|<(script|style|template|noscript)\b[^>]*+>.*?(?:</\1\s*>|\z)", " ")
    each = df.select(F.col(key).alias(key), F.posexplode(F.regexp_extract_all(bare, F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    name = F.lower(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    heading = name.rlike("^h[1-6]$")
    begins = heading & ~F.startswith("token", F.lit("</"))
    w = Window.partitionBy(key).orderBy("pos")
    tag = F.startswith("token", F.lit("<")) & (F.col("token") != "<")
    piece = F.when(~tag, characters(F.regexp_replace("token", r"\s+", " "), NAMED_HTML)).when(name.rlike(f"^(?:{BLOCKS})$"), "\n").otherwise("")
    told = each.select(key, "pos", piece.alias("piece"), F.when(begins, F.substring(name, 2, 1).cast("int")).alias("level"), (heading & ~begins).alias("ends"))
    numbered = told.withColumns({"section": F.count("level").over(w), "closed": F.count_if("ends").over(w)})
    parts = F.array_sort(F.collect_list(F.struct("pos", "piece", "closed")))
    joined = numbered.groupBy(key, "section").agg(F.max("level").alias("level"), F.min("closed").alias("_c"), parts.alias("_p"))
    lines = lambda c: F.array_join(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s\u00A0]+", " "))), lambda x: x != ""), "\n")
    text = lines(F.array_join(F.transform("_p", lambda x: x["piece"]), ""))
    title = lines(F.array_join(F.transform(F.filter("_p", lambda x: x["closed"] == F.col("_c")), lambda x: x["piece"]), ""))
    # an end tag that is missing leaves the whole section for a title; its first line then is
    found = joined.select(key, "section", "level", F.when(F.col("level").isNotNull(), F.split(title, "\n")[0]).alias("title"), text.alias("text"))
    v = Window.partitionBy(key).orderBy("section")
    last = {f"_{k}": F.last(F.when(F.col("level") <= k, F.struct("level", "title")), ignorenulls=True).over(v) for k in range(1, 7)}
    path = F.array_compact(F.array(*(F.when(F.col(f"_{k}.level") == k, F.col(f"_{k}.title")) for k in range(1, 7))))
    return found.withColumns(last).withColumn("path", path).drop(*last).where("text <> ''")


# The kinds of nodes by their tags. Fixed values.
NODES = {
    **{f"h{k}": "heading" for k in range(1, 7)}, "p": "paragraph", "ul": "list", "ol": "list", "li": "item", "a": "link", "img": "image", "table": "table", "tr": "row", "td": "cell", "th": "cell", "form": "form", "input": "field", "select": "field", "textarea": "field", "button": "field", "blockquote": "quote", "pre": "code",
}


def html_nodes(df: DataFrame, key: str, html: str) -> DataFrame:
    """Logical nodes of HTML texts: key, node (from 0), kind, tag, depth (of the lists around it), ordinal (of an item in its list) and target (href, src, action or name). Scripts, styles and comments have none."""
    bare = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<!--.*?-->|<(script|style|template|noscript)\b[^>]*+>.*?(?:</\1\s*>|\z)", " ")
    each = df.select(F.col(key).alias(key), F.posexplode(F.regexp_extract_all(bare, F.lit(TOKEN), F.lit(0))).alias("pos", "token")).where(F.col("token").rlike("^</?[A-Za-z]"))
    kinds = F.create_map(*(F.lit(x) for pair in NODES.items() for x in pair))
    tagged = each.withColumns({"tag": F.lower(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9]*)", 1)), "ends": F.startswith("token", F.lit("</"))}).withColumn("kind", F.try_element_at(kinds, F.col("tag"))).where("kind is not null")
    w = Window.partitionBy(key).orderBy("pos")
    is_list = F.col("kind") == "list"
    depth = F.sum(F.when(is_list, F.when(F.col("ends"), -1).otherwise(1)).otherwise(0)).over(w)
    levelled = tagged.withColumn("depth", F.greatest(F.lit(0), depth)).where("not ends")
    # an item counts since the list that was opened last at its depth
    at = Window.partitionBy(key, "depth").orderBy("pos")
    begun = F.count_if(is_list).over(at)
    listed = levelled.withColumn("_l", begun)
    number = F.count_if(F.col("kind") == "item").over(Window.partitionBy(key, "depth", "_l").orderBy("pos"))
    target = F.nullif(characters(F.regexp_replace(F.regexp_extract("token", r"""(?i)\s(?:href|src|action|name)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1), "^[\"']|[\"']$", ""), NAMED_HTML), F.lit(""))
    return listed.select(key, (F.row_number().over(w) - 1).cast("long").alias("node"), "kind", "tag", F.col("depth").cast("int").alias("depth"), F.when(F.col("kind") == "item", number).alias("ordinal"), target.alias("target"))
