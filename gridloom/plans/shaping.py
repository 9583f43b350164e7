"""Queries over shapes of tables and mail as text, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph, shaping
from .tables import _query, _t


@_query("SELECT printf('%.2f', o_totalprice) AS price, o_orderkey AS id, strftime(o_orderdate, '%d.%m.%Y') AS day FROM orders")
def projection(s, d):
    return shaping.project(_t(s, d, "orders"), include=["o_orderkey", "o_totalprice", "o_orderdate"], first=("o_totalprice",), rename={"o_orderkey": "id", "o_totalprice": "price", "o_orderdate": "day"}, formats={"o_totalprice": "0.00", "o_orderdate": "dd.MM.yyyy"})


@_query("SELECT name, ordinal, type, count(*) AS n FROM customer, (VALUES ('c_custkey', 0, 'bigint'), ('blank', 1, 'string'), ('whole', 2, 'int'), ('truth', 3, 'boolean'), ('price', 4, 'double'), ('day', 5, 'date'), ('time', 6, 'timestamp'), ('code', 7, 'string'), ('big', 8, 'bigint')) v(name, ordinal, type) GROUP BY ALL")
def inferred_types(s, d):
    k = F.col("c_custkey")
    text = _t(s, d, "customer").select(
        k, F.when(k % 2 == 0, " ").alias("blank"), F.concat(F.lit(" "), k.cast("string")).alias("whole"), F.when(k % 3 == 0, "TRUE").when(k % 3 == 1, "false").alias("truth"), F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(k.cast("string"), F.lit(".5"))).alias("price"),
        F.date_add(F.lit("2020-01-01").cast("date"), (k % 900).cast("int")).cast("string").alias("day"), F.when(k % 2 == 0, "2020-01-01").otherwise("2020-01-01 10:00:00").alias("time"), F.concat(F.lit("0"), k.cast("string")).alias("code"), (k + 5_000_000_000).cast("string").alias("big"))
    return shaping.schema_rows(shaping.typed(text)).select("name", "ordinal", "type").withColumn("n", text.agg(F.count("*")).scalar())


@_query("SELECT 'in-b' AS sheet, s_suppkey AS id, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT 'in-a', c_custkey, c_name, c_mktsegment FROM customer")
def merged_sheets(s, d):
    sheets = {"a": _t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), "b": _t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "c": _t(s, d, "nation")}
    return shaping.merge_sheets(sheets, only=["b", "a"], prefix="in-")


@_query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def appended_rows(s, d):
    table = _t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return shaping.append_rows(table, _t(s, d, "supplier").select(F.col("s_acctbal").cast("string").alias("BALANCE"), F.col("s_suppkey").cast("string").alias("Id")))


@_query("SELECT o_orderkey, count(l_orderkey) AS n, coalesce(string_agg(l_linenumber || '/' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS parts FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def attached_candidates(s, d):
    parts = _t(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    found = shaping.attach(_t(s, d, "orders").select("o_orderkey"), parts, ["o_orderkey"], ["l_linenumber", "l_partkey"])
    return found.select("o_orderkey", F.size("candidates").cast("long").alias("n"), F.array_join(F.transform("candidates", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit("/"), x["l_partkey"].cast("string"))), ",").alias("parts"))


@_query("""WITH h AS (SELECT *, [x FOR x IN [CASE WHEN contains(upper(p_name), 'WIDGET') OR contains(upper(p_name), 'BRAND#1') THEN 'p_name' END, CASE WHEN contains(upper(p_brand), 'WIDGET') OR contains(upper(p_brand), 'BRAND#1') THEN 'p_brand' END] IF x IS NOT NULL] AS m FROM part WHERE p_size > 10), f AS (SELECT *, m[1] AS field, CASE m[1] WHEN 'p_name' THEN p_name ELSE p_brand END AS t FROM h WHERE len(m) > 0),
  q AS (SELECT *, greatest(1, coalesce(least(nullif(instr(upper(t), 'WIDGET'), 0), nullif(instr(upper(t), 'BRAND#1'), 0)), 1) - 4) AS st FROM f) SELECT p_partkey, array_to_string(m, ',') AS matched, field, CASE WHEN st > 1 THEN '…' ELSE '' END || substr(t, st, 8) || CASE WHEN length(t) >= st + 8 THEN '…' ELSE '' END AS snippet FROM q""")
def content_search_fields(s, d):
    found = shaping.content_search(_t(s, d, "part"), "p_partkey", ["p_name", "p_brand"], ["widget", "brand#1"], where=F.col("p_size") > 10, width=8)
    return found.withColumn("matched", F.array_join("matched", ","))


@_query("""WITH m AS (SELECT conv_id % 5 AS folder, role || '@x' AS who, 'S ' || turn AS subject, string_split('From ' || conv_id || chr(10) || '>From' || chr(10) || replace(coalesce(text, ''), chr(13), chr(10)), chr(10)) AS b FROM conversations), l AS (SELECT folder, unnest(['From ' || who || ' Thu Jan 01 00:00:00 1970', 'From: ' || who, 'Subject: ' || subject, ''] || list_transform(b, lambda x: CASE WHEN starts_with(x, 'From ') THEN '>' || x ELSE x END) || ['']) AS line FROM m)
  SELECT folder::VARCHAR AS folder, line, count(*) AS n FROM l GROUP BY ALL""")
def mail_export(s, d):
    path = f"{graph.shared_folder(s)}/{uuid.uuid4().hex}"
    mail = _t(s, d, "conversations").select(
        (F.col("conv_id") % 5).cast("string").alias("folder"), F.concat("role", F.lit("@x")).alias("sender"), F.lit(None).cast("timestamp").alias("sent"), F.concat(F.lit("S "), F.col("turn").cast("string")).alias("subject"),
        F.concat(F.lit("From "), F.col("conv_id").cast("string"), F.lit("\r\n>From\n"), F.coalesce("text", F.lit(""))).alias("body"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"))
    shaping.write_mbox(mail, path, "id")
    return s.read.text(path).select(F.regexp_extract("_metadata.file_path", r"folder=(\d+)", 1).alias("folder"), F.col("value").alias("line")).groupBy("folder", "line").agg(F.count("*").alias("n"))
