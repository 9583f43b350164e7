"""Queries over rules, identities, sync plans, groups of numbers, lines of CSV and readers by kind, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import graph, lookup, pivot, readers, records
from ..sources import csv
from .tables import _query, _t


@_query("""SELECT event_id, (CASE WHEN event_id % 2 = 1 THEN -1 ELSE 1 END * ((event_id % 3) * 365 * 86400 + (event_id % 7) * 30 * 86400 + (event_id % 5) * 86400 + (event_id % 24) * 3600 + (event_id % 60) * 60 + (event_id % 10) + 0.25))::DOUBLE AS seconds, NULL::DOUBLE AS bad FROM events""")
def iso_durations(s, d):
    n = lambda k: (F.col("event_id") % k).cast("string")
    text = F.concat(F.when(F.col("event_id") % 2 == 1, "-").otherwise(""), F.lit("P"), n(3), F.lit("Y"), n(7), F.lit("M"), n(5), F.lit("DT"), n(24), F.lit("H"), n(60), F.lit("M"), n(10), F.lit(".25S"))
    return _t(s, d, "events").select("event_id", scalars.iso_duration(text).alias("seconds"), scalars.iso_duration(F.concat(text, F.lit("T"))).alias("bad"))


_URLS = ["https://a.example.org/x", "HTTP://example.org", "//b.org/x", "java\tscript:alert(1)", "data:image/png;base64,A", "data:text/html,x", "mailto:a@b.org", "ftp://example.org", "a/b?c#d", "", "https://user@example.org.evil.com/"]


@_query(f"""WITH p AS (SELECT page_id, page_id % {len(_URLS)} AS k FROM pages) SELECT page_id, k IN (0, 1, 2, 6, 8, 10) AS plain, k IN (0, 1, 4, 6) AS strict FROM p""")
def url_policy(s, d):
    url = F.get(F.array(*map(F.lit, _URLS)), (F.col("page_id") % len(_URLS)).cast("int"))
    return _t(s, d, "pages").select("page_id", scalars.allowed_url(url).alias("plain"), scalars.allowed_url(url, relative=False, data=("image/",), hosts=("example.org",)).alias("strict"))


@_query("""SELECT p_partkey, p_partkey || ',"' || p_name || CASE p_size % 3 WHEN 0 THEN ', x' WHEN 1 THEN '""' ELSE '' END || '",' || CASE p_size % 3 WHEN 0 THEN '' ELSE '''=1+' || p_size END || ',01/02/1996' AS line FROM part""")
def csv_lines(s, d):
    path, kind = f"{graph.shared_folder(s)}/{uuid.uuid4().hex}", F.col("p_size") % 3
    table = _t(s, d, "part").select("p_partkey", F.concat("p_name", F.when(kind == 0, ", x").when(kind == 1, '"').otherwise("")).alias("name"), F.when(kind > 0, F.concat(F.lit("=1+"), "p_size")).alias("formula"), F.lit("1996-02-01").cast("date").alias("day"))
    csv.write_lines(table, path, order=["p_partkey"], quote_fields=("name",), escape=True, date_format="dd/MM/yyyy")
    return s.read.text(path).where("value <> 'p_partkey,name,formula,day'").select(F.regexp_extract("value", r"^\d+", 0).cast("long").alias("p_partkey"), F.col("value").alias("line"))


@_query("""WITH e AS (SELECT c_custkey, lower(trim(c_name)) AS name, 'seg ' || lower(c_mktsegment) AS alias, 'c' || (c_custkey % 50) AS other FROM customer), q AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'customer#' || lpad(s_suppkey::VARCHAR, 9, '0') WHEN 1 THEN 'seg building' WHEN 2 THEN 'c' || (s_suppkey % 60) ELSE 'none' END AS i FROM supplier),
  h AS (SELECT name AS i, 0 AS rank, c_custkey FROM e UNION SELECT alias, 1, c_custkey FROM e UNION SELECT other, 1, c_custkey FROM e), g AS (SELECT i, rank, count(*) AS n, min(c_custkey) AS least FROM h GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY i ORDER BY rank) = 1)
  SELECT s_suppkey, CASE WHEN n IS NULL THEN 'Incomplete' WHEN n = 1 THEN 'Resolved' ELSE 'Ambiguous' END AS status, CASE rank WHEN 0 THEN 'name' WHEN 1 THEN 'aliases' END AS source, coalesce(n, 0) AS n_entries, CASE WHEN n = 1 THEN least END AS entry, least(coalesce(n, 0), 4)::INT AS n_candidates FROM q LEFT JOIN g USING (i)""")
def identity_sources(s, d):
    entries = _t(s, d, "customer").select("c_custkey", "c_name", F.array(F.concat(F.lit("SEG "), "c_mktsegment"), F.concat(F.lit("c"), (F.col("c_custkey") % 50).cast("string"))).alias("aliases")).withColumnRenamed("c_name", "name")
    k = F.col("s_suppkey")
    who = F.when(k % 4 == 0, F.concat(F.lit(" CUSTOMER#"), F.lpad(k.cast("string"), 9, "0"))).when(k % 4 == 1, "Seg Building ").when(k % 4 == 2, F.concat(F.lit("C"), (k % 60).cast("string"))).otherwise("none")
    found = lookup.resolve_by_sources(_t(s, d, "supplier").select("s_suppkey", who.alias("who")), "who", entries, "c_custkey", ["name", "aliases"], most=4, complete=False)
    return found.select("s_suppkey", "status", "source", "n_entries", "entry", F.size("candidates").alias("n_candidates"))


@_query("""WITH k AS (SELECT o_orderkey AS k, o_orderkey % 9 AS c FROM orders) SELECT k, CASE c WHEN 0 THEN 'none' WHEN 1 THEN 'update_remote' WHEN 2 THEN 'update_source' WHEN 3 THEN 'conflict' WHEN 4 THEN 'create_remote' WHEN 5 THEN 'create_source' WHEN 6 THEN 'delete_remote' WHEN 7 THEN 'delete_source' ELSE 'none' END AS action, CASE WHEN c IN (1, 6) THEN k * 10 END AS expected_revision FROM k""")
def sync_revisions(s, d):
    rows = _t(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), (F.col("o_orderkey") * 10).alias("r"))
    c = F.col("k") % 9
    base = rows.where(~c.isin(4, 5))
    source = rows.where(~c.isin(5, 6)).select("k", F.when(c.isin(1, 3), "S").when(c == 8, "N").otherwise(F.col("v")).alias("v"))
    remote = rows.where(~c.isin(4, 7)).select("k", F.when(c.isin(2, 3), "R").when(c == 8, "N").otherwise(F.col("v")).alias("v"), F.when(c.isin(2, 3, 8), F.col("r") + 1).otherwise(F.col("r")).alias("r"))
    return lookup.sync_plan(base, source, remote, "k", "v", "r")


@_query("""SELECT p_partkey, p_size NOT BETWEEN 5 AND 30 AS outside, p_size <> 7 AS unequal, p_retailprice > 1000 AS dear, p_partkey % 24 < 8 OR p_partkey % 24 = 8 AND p_partkey % 60 = 0 AS early, p_partkey % 3 = 0 OR upper(p_brand) = 'BRAND#1' AS listed, p_size % 2 = 0 AS even, p_partkey % 5 > 0 AS blank FROM part""")
def validation_rules(s, d):
    v, n = records.validation_rule, lambda k: F.lpad((F.col("p_partkey") % k).cast("string"), 2, "0")
    brand = F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.concat(F.lit(" "), "p_brand"))
    return _t(s, d, "part").select(
        "p_partkey", v(F.col("p_size"), "whole", "not_between", 5, 30).alias("outside"), v(F.col("p_size"), "decimal", "ne", 7).alias("unequal"), v(F.col("p_retailprice"), "decimal", "gt", 1000).alias("dear"), v(F.concat(n(24), F.lit(":"), n(60)), "time", "le", "08:00").alias("early"),
        v(brand, "list", choices=["brand#1"]).alias("listed"), v(F.col("p_size"), "custom", custom=F.col("p_size") % 2 == 0).alias("even"), v(F.when(F.col("p_partkey") % 5 > 0, "x").otherwise(""), "length", "ge", 1, allow_blank=False).alias("blank"))


@_query("""WITH o AS (SELECT CASE WHEN o_orderkey % 50 > 0 THEN o_totalprice END AS x FROM orders), g AS (SELECT CASE WHEN x IS NULL THEN '(blank)' WHEN x < 50000 THEN '<50000' WHEN x > 210000 THEN '>210000' ELSE (50000 + least(floor((x - 50000) / 40000), 3) * 40000)::BIGINT || '-' || (50000 + (least(floor((x - 50000) / 40000), 3) + 1) * 40000)::BIGINT END AS label, x FROM o) SELECT label, count(*) AS n, max(x) AS largest FROM g GROUP BY 1""")
def number_groups(s, d):
    price = _t(s, d, "orders").select(F.when(F.col("o_orderkey") % 50 > 0, F.col("o_totalprice")).alias("x"))
    return pivot.number_groups(price, "x", 40000, start=50000, end=210000).groupBy("label").agg(F.count("*").alias("n"), F.max("x").alias("largest"))


@_query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT') AND o_orderpriority >= '2' AND o_orderpriority < '5' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '4-NOT SPECIFIED', '5-LOW') GROUP BY 1")
def pivot_field_filter(s, d):
    shown = pivot.field_filter(_t(s, d, "orders"), "o_orderpriority", hidden=["1-URGENT"], visible=["1-URGENT", "2-HIGH", "4-NOT SPECIFIED", "5-LOW"], label=("between", "2", "4~"))
    return shown.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def _files(s, d):
    """Documents' texts as files of five kinds, one of them of no reader and one of bytes that are no text."""
    k = F.col("doc_id") % 5
    text = F.coalesce("text", F.lit(""))
    body = (
        F.when(k == 0, F.concat(F.lit("# Title\n"), text).cast("binary")).when(k == 1, F.concat(F.lit("<!doctype html><html><h1>Title</h1><p>"), F.regexp_replace(text, "[&<]", " "), F.lit("</p></html>")).cast("binary"))
        .when(k == 2, F.concat(F.lit(b"%PDF-1.4"), text.cast("binary"))).when(k == 3, F.concat(F.lit(b"\xff\xfe "), text.cast("binary"))).otherwise(F.concat(F.lit("<?xml version='1.0'?><d>"), F.regexp_replace(text, "[&<]", " "), F.lit("</d>")).cast("binary"))
    )
    name = F.concat(F.lit("f/"), F.col("doc_id").cast("string"), F.get(F.array(*map(F.lit, (".md", ".html", ".pdf", ".txt", ".xml"))), k.cast("int")))
    return _t(s, d, "documents").select(name.alias("name"), body.alias("content"))


_FILE = "'f/' || doc_id || ['.md', '.html', '.pdf', '.txt', '.xml'][doc_id % 5 + 1] AS key, ['Markdown', 'Html', 'Pdf', 'Text', 'Xml'][doc_id % 5 + 1] AS kind"


@_query(f"""SELECT {_FILE}, ['Read', 'Read', 'Unsupported', 'Refused', 'Read'][doc_id % 5 + 1] AS status, CASE doc_id % 5 WHEN 2 THEN 'no reader of Pdf' WHEN 3 THEN 'no UTF-8 text' END AS message, CASE WHEN doc_id % 5 IN (2, 3) THEN 0 ELSE 1 END::BIGINT AS n_chunks FROM documents""")
def file_outcomes(s, d):
    return readers.Readers().read(_files(s, d), "name", "content")[1]


@_query(f"""SELECT {_FILE}, CASE WHEN doc_id % 5 = 4 THEN 0 ELSE 1 END::BIGINT AS ordinal, ['line 1', 'section 1', '', '', 'line 1'][doc_id % 5 + 1] AS location, CASE WHEN doc_id % 5 < 2 THEN 'Title' END AS title FROM documents WHERE doc_id % 5 IN (0, 1, 4)""")
def file_chunks(s, d):
    return readers.Readers().read(_files(s, d), "name", "content")[0].drop("text")
