"""Queries over Markdown and other marked-up texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy, markdown, markup
from .tables import _query, _t

# Every document's text within Markdown: front matter, headings, code that looks like one, and a table.
_MARKED = """m AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, 1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS n FROM documents)"""


def _marked(s, d):
    docs = _t(s, d, "documents").select("doc_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return docs.select("doc_id", F.concat(
        F.lit("---\nlang: \""), "lang", F.lit("\"\nsource:  "), "source", F.lit("\n---\n# "), "source", F.lit("\n"), "text",
        F.lit("\n\n## Part\n```md\n# code\n|a|\n|---|\n```\n| id | |\n|---|:---:|\n| "), F.col("doc_id").cast("string"), F.lit(" |\n\n### Part ##\nend\n")).alias("body"))


_SLUG = "trim(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '-')"


@_query(f"""WITH {_MARKED} SELECT doc_id, index, 5 + CASE index WHEN 0 THEN 0 WHEN 1 THEN n + 2 ELSE n + 12 END AS line, index::INT + 1 AS level, CASE index WHEN 0 THEN trim(source) ELSE 'Part' END AS title,
  CASE index WHEN 0 THEN trim(source) WHEN 1 THEN trim(source) || ' > Part' ELSE trim(source) || ' > Part > Part' END AS path, CASE index WHEN 0 THEN coalesce(nullif({_SLUG}, ''), 'section') WHEN 1 THEN 'part' ELSE 'part-1' END AS anchor FROM m, (SELECT unnest([0, 1, 2])::BIGINT AS index)""")
def markdown_headings(s, d):
    return markdown.headings(_marked(s, d), "doc_id", "body").withColumn("path", F.array_join("path", " > "))


@_query(f"""WITH {_MARKED} SELECT doc_id, lang, source, 2::INT AS n_keys, 4::INT AS n_lines FROM m""")
def markdown_front_matter(s, d):
    found = _marked(s, d).select("doc_id", markdown.front_matter(F.col("body")).alias("m"), markdown.front_lines(F.col("body")).alias("n_lines"))
    return found.select("doc_id", F.col("m")["lang"].alias("lang"), F.col("m")["source"].alias("source"), F.size("m").alias("n_keys"), "n_lines")


@_query(f"""WITH {_MARKED} SELECT doc_id, 0::BIGINT AS "table", n + 13 AS start_line, n + 15 AS end_line, 'id,Column2' AS columns, doc_id::VARCHAR || ',' AS cells FROM m""")
def markdown_tables(s, d):
    found = markdown.tables(_marked(s, d), "doc_id", "body")
    return found.select("doc_id", "table", "start_line", "end_line", F.array_join("columns", ",").alias("columns"), F.array_join(F.flatten("rows"), ",").alias("cells"))


@_query(f"""WITH {_MARKED} SELECT doc_id, section, CASE section WHEN 1 THEN 5 WHEN 2 THEN n + 7 ELSE n + 17 END AS start_line, CASE section WHEN 1 THEN n + 6 WHEN 2 THEN n + 16 ELSE n + 19 END AS end_line, nullif(section - 1, 0) AS parent,
  md5(CASE section WHEN 1 THEN '# ' || source || chr(10) || text || chr(10) WHEN 2 THEN '## Part' || chr(10) || '```md' || chr(10) || '# code' || chr(10) || '|a|' || chr(10) || '|---|' || chr(10) || '```' || chr(10) || '| id | |' || chr(10) || '|---|:---:|' || chr(10) || '| ' || doc_id || ' |' || chr(10)
    ELSE '### Part ##' || chr(10) || 'end' || chr(10) END) AS text FROM m, (SELECT unnest([1, 2, 3])::BIGINT AS section)""")
def markdown_sections(s, d):
    return markdown.sections(_marked(s, d), "doc_id", "body").select("doc_id", "section", "start_line", "end_line", "parent", F.md5(F.col("text").cast("binary")).alias("text"))


@_query("""WITH RECURSIVE b AS (SELECT doc_id, source, list_filter(string_split('# ' || coalesce(source, '') || chr(10) || coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x09-\\x0D\\x20]')) AS b FROM documents),
  t AS (SELECT *, list_transform(b, lambda x: greatest(1, (length(x) + 3) // 4)) AS t FROM b), s AS (SELECT *, list_transform(range(len(t) + 1), lambda k: coalesce(list_sum(t[1:k]), 0)::BIGINT) AS s FROM t),
  r AS (SELECT doc_id, b, s, 0::BIGINT AS f, 0::BIGINT AS i, coalesce(list_max(list_filter(range(len(b)), lambda j: s[j + 2] <= 128)), 0) AS e, 0::BIGINT AS chunk FROM s
    UNION ALL SELECT doc_id, b, s, g, i, greatest(i, coalesce(list_max(list_filter(range(i, len(b)), lambda j: s[j + 2] - s[g + 1] <= 128)), i)) AS e, chunk FROM
      (SELECT doc_id, b, s, e + 1 AS i, coalesce(list_min(list_filter(range(f + 1, e + 2), lambda g: s[e + 2] - s[g + 1] <= 24 AND s[e + 3] - s[g + 1] <= 128)), e + 1) AS g, chunk + 1 AS chunk FROM r WHERE e + 1 < len(b)))
  SELECT doc_id, chunk, f AS first_block, e AS last_block, i - f AS n_overlap, s[e + 2] - s[f + 1] AS tokens, md5(array_to_string(b[f + 1:e + 1], chr(10) || chr(10))) AS text FROM r""")
def hierarchical_chunks(s, d):
    docs = _t(s, d, "documents").select("doc_id", F.concat(F.lit("# "), F.coalesce("source", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("body"))
    found = hierarchy.chunks(markdown.sections(docs, "doc_id", "body"), "doc_id", most=128, overlap=24, split="\n")
    return found.select("doc_id", "chunk", "first_block", "last_block", "n_overlap", "tokens", F.md5(F.col("text").cast("binary")).alias("text"))


@_query("""WITH l AS (SELECT l_orderkey AS k, l_quantity::INT AS quantity, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_quantity::INT) AS n, 'order[1]/item[' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_quantity::INT) || ']' AS item FROM lineitem)
  SELECT o_orderkey AS k, 'order[1]' AS path, 'element' AS type, 'by <' || trim(o_orderpriority) || '>' AS value FROM orders UNION ALL SELECT o_orderkey, 'order[1]/@id', 'attribute', o_orderkey::VARCHAR FROM orders UNION ALL SELECT o_orderkey, 'order[1]/@note', 'attribute', 'a > "b" & c' FROM orders
  UNION ALL SELECT o_orderkey, 'order[1]/status[1]', 'element', o_orderstatus FROM orders UNION ALL SELECT o_orderkey, 'order[1]/status[2]', 'element', NULL FROM orders
  UNION ALL SELECT k, item, 'element', NULL FROM l JOIN orders ON k = o_orderkey UNION ALL SELECT k, item || '/@flag', 'attribute', l_returnflag FROM l JOIN orders ON k = o_orderkey UNION ALL SELECT k, item || '/quantity[1]', 'element', quantity::VARCHAR FROM l JOIN orders ON k = o_orderkey""")
def xml_path_rows(s, d):
    item = F.concat(F.lit("<item flag='"), "l_returnflag", F.lit("'>\n <quantity><!-- <x> -->"), F.col("l_quantity").cast("int").cast("string"), F.lit("</quantity></item>"))
    items = _t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", F.col("l_quantity").cast("int"), item.alias("x")))), lambda x: x["x"]), "").alias("items"))
    whole = F.concat(
        F.lit("<?xml version='1.0'?><!DOCTYPE order>\n<order id=\""), F.col("o_orderkey").cast("string"), F.lit("\" note='a > \"b\" &amp; c'>by <status>"), "o_orderstatus", F.lit("</status><status/><![CDATA[<]]>"),
        F.trim("o_orderpriority"), F.lit("&#62;"), F.coalesce("items", F.lit("")), F.lit("</order>"))
    return markup.xml_rows(_t(s, d, "orders").join(items, "o_orderkey", "left").select(F.col("o_orderkey").alias("k"), whole.alias("body")), "k", "body")


# An order of steps: hidden parts go, tags become line ends or nothing, characters are decoded, white space is one space, and blank lines go.
_BLOCK = f"(?i)</?(?:{markup.BLOCKS})(?:[^a-z0-9>][^>]*)?>"
_LINES = lambda c: f"array_to_string(list_filter(list_transform(string_split(translate(replace(replace(replace(regexp_replace(regexp_replace(replace(replace({c}, chr(10), ' '), chr(13), ' '), '{_BLOCK}', chr(10), 'g'), '<[A-Za-z/!][^>]*>', '', 'g'), '&quot;', chr(34)), '&amp;', '&'), '&nbsp;', ' '), chr(9) || chr(160), '  '), chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> ''), chr(10))"


@_query(f"""WITH p AS (SELECT page_id, replace(replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->', ' ', 'g'), '(?is)<(?:script|style|template|noscript)\\b[^>]*>.*?</(?:script|style|template|noscript)\\s*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·') AS html FROM pages),
  s AS (SELECT page_id, string_split(regexp_replace(html, '(?i)<(h[1-6])([ >])', chr(1) || '<\\1\\2', 'g'), chr(1)) AS s FROM p), x AS (SELECT page_id, i AS section, s[i + 1] AS part FROM (SELECT page_id, s, unnest(range(len(s))) AS i FROM s)),
  y AS (SELECT page_id, section, CASE WHEN section > 0 THEN part[3:3]::INT END AS level, CASE WHEN section > 0 THEN {_LINES("regexp_extract(part, '(?is)^(.*?)</h[1-6]', 1)")} END AS title, {_LINES("part")} AS text FROM x)
  SELECT page_id, section::BIGINT AS section, level, title, text FROM y WHERE text <> ''""")
def html_sections(s, d):
    return markup.html_sections(_t(s, d, "pages"), "page_id", "html").select("page_id", "section", "level", "title", "text")


@_query("""WITH t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g'), '<(?:h[1-6]|p|ul|ol|li|a|img|table|tr|td|th|form|input|select|textarea|button|blockquote|pre)(?:\\s[^>]*)?>')) AS t FROM pages), x AS (SELECT page_id, t, regexp_extract(t, '<([a-z0-9]+)', 1) AS tag FROM t)
  SELECT page_id, CASE tag WHEN 'h1' THEN 'heading' WHEN 'p' THEN 'paragraph' WHEN 'ul' THEN 'list' WHEN 'li' THEN 'item' WHEN 'a' THEN 'link' ELSE tag END AS kind, count(*) AS n, CASE WHEN tag IN ('ul', 'li', 'a') THEN 1 ELSE 0 END AS depth, CASE WHEN tag = 'li' THEN count(*) END AS last, max(CASE WHEN tag = 'a' THEN replace(regexp_extract(t, 'href="([^"]*)"', 1), '&amp;', '&') END) AS target FROM x GROUP BY page_id, tag""")
def html_nodes(s, d):
    found = markup.html_nodes(_t(s, d, "pages"), "page_id", "html")
    return found.groupBy("page_id", "kind", "tag").agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.max("ordinal").alias("last"), F.max("target").alias("target")).drop("tag")


@_query(f"""WITH {_MARKED} SELECT doc_id, md5('---' || chr(10) || 'lang: "' || lang || '"' || chr(10) || 'source:  ' || source || chr(10) || '---' || chr(10) || '## ' || source || chr(10) || replace(text, 'the', 'THE') || chr(10) || chr(10) || '### Part' || chr(10) || '```md' || chr(10) || '# code' || chr(10) || '|a|' || chr(10) || '|---|' || chr(10) || '```' || chr(10) || '| id | |' || chr(10) || '|---|:---:|' || chr(10) || '| ' || doc_id || ' |' || chr(10) || chr(10) || '#### Part ##' || chr(10) || 'end' || chr(10)) AS text,
  3 AS headings, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'the'))) AS articles FROM m""")
def markdown_rewrite(s, d):
    found = markdown.rewrite(_marked(s, d), "doc_id", "body", [("deeper", "^(#{1,5}) ", "#$1 "), ("articles", "the", "THE")])
    return found.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"), F.col("changes")["deeper"].alias("headings"), F.col("changes")["articles"].alias("articles"))


@_query(f"""WITH {_MARKED} SELECT doc_id, lang, 2 AS n_sections, 'section-0001' AS last_id, trim(source) || ',Part' AS last_path, doc_id::VARCHAR AS cell, true AS truncated FROM m""")
def structured_json(s, d):
    found = markdown.structured(_marked(s, d), "doc_id", "body", most_sections=2)
    field = lambda path: F.get_json_object("document", path)
    return found.select(
        "doc_id", field("$.front_matter.lang").alias("lang"), F.json_array_length(field("$.sections")).alias("n_sections"), field("$.sections[1].id").alias("last_id"), F.array_join(F.from_json(field("$.sections[1].path"), "array<string>"), ",").alias("last_path"),
        field("$.tables[0].rows[0][0]").alias("cell"), field("$.truncated").cast("boolean").alias("truncated"))
