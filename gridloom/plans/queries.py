"""Queries over record queries, mappings, and texts that are lists, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import cells, graph, query, rows
from ..sources import delimited
from .tables import _query, _t


@_query("SELECT o_orderkey, o_orderdate, true AS has_more, false AS scan_limit_reached FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey LIMIT 30 OFFSET 60")
def record_query_pages(s, d):
    table = _t(s, d, "orders")
    asked = query.RecordQuery(F.col("o_orderstatus") == "O", [("o_orderpriority", True), ("o_orderdate", False), ("o_orderkey", False)], ["o_orderkey", "o_orderdate"], size=30)
    page = asked.run(table)
    for _ in range(2):
        page = asked.run(table, page.token)
    return page.rows.withColumns({"has_more": F.lit(page.has_more), "scan_limit_reached": F.lit(page.scan_limit_reached)})


_MAIL = "m AS (SELECT conv_id * 100 + turn AS id, CASE WHEN turn % 2 = 0 THEN 'Inbox' ELSE 'Inbox/Sent' END AS folder, role AS kind, left(text, 40) AS subject, role || '@x' AS sender, CASE WHEN turn % 3 > 0 THEN conv_id * 10 + turn END AS received, conv_id * 10 AS sent, turn % 4 = 0 AS has_attachments, turn < 4 AS is_read FROM conversations)"


@_query(f"""WITH {_MAIL}, n AS (SELECT * FROM m ORDER BY id LIMIT 250) SELECT id, folder, subject, false AS has_more, (SELECT count(*) > 250 FROM m) AS scan_limit_reached FROM n WHERE (folder = 'Inbox' OR starts_with(folder, 'Inbox/')) AND contains(upper(subject), 'E') AND sender ILIKE '%ANT@%' AND coalesce(received, sent) >= 100 AND coalesce(received, sent) < 400 AND is_read AND NOT has_attachments""")
def message_query(s, d):
    turns, t = _t(s, d, "conversations"), F.col("turn")
    mail = turns.select(
        (F.col("conv_id") * 100 + t).alias("id"), F.when(t % 2 == 0, "Inbox").otherwise("Inbox/Sent").alias("folder"), F.col("role").alias("kind"), F.left("text", F.lit(40)).alias("subject"), F.concat("role", F.lit("@x")).alias("sender"),
        F.when(t % 3 > 0, F.col("conv_id") * 10 + t).alias("received"), (F.col("conv_id") * 10).alias("sent"), (t % 4 == 0).alias("has_attachments"), (t < 4).alias("is_read"))
    where = query.message_filter(mail.columns, folder="Inbox", descendants=True, subject="e", sender="ANT@", since=100, before=400, read=True, attachments=False)
    page = query.RecordQuery(where, [("id", False)], ["id", "folder", "subject"], most_scanned=250, scan_order=["id"]).run(mail)
    return page.rows.withColumns({"has_more": F.lit(page.has_more), "scan_limit_reached": F.lit(page.scan_limit_reached)})


@_query("SELECT o_orderkey AS id, o_orderdate::DATE AS day, left(o_orderpriority, 1)::INT AS urgency FROM orders")
def explicit_mapping(s, d):
    table = _t(s, d, "orders").select(F.col("o_orderkey").alias("Order Key"), F.col("o_orderdate").cast("date").cast("string").alias("Day"), F.substring("o_orderpriority", 1, 1).alias("urgency"))
    return rows.map_explicit(table, {"id": ("Order Key", "long"), "day": ("DAY", "date"), "urgency": ("urgency", "int")})


@_query("""SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN NULL ELSE p_size END AS size, CASE WHEN p_size % 4 = 3 THEN 'size' END AS failed, CASE WHEN p_size % 4 = 3 THEN 'about ' || p_size END AS value FROM part""")
def converters(s, d):
    kind = F.col("p_size") % 4
    said = F.when(kind == 3, F.concat(F.lit("about "), "p_size")).otherwise(F.concat("p_size", F.lit(" cm")))
    good, bad = rows.convert(_t(s, d, "part").select("p_partkey", said.alias("size")), "p_partkey", {"size": ("int", lambda c: F.nullif(F.regexp_extract(c, r"^(\d+) cm$", 1), F.lit("")))})
    none = F.lit(None).cast("string")
    return good.select("p_partkey", "size", none.alias("failed"), none.alias("value")).unionByName(bad.select("p_partkey", F.lit(None).cast("int").alias("size"), F.col("column").alias("failed"), "value"))


@_query("""WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS cell, turn, role, text FROM conversations) SELECT conv_id, cell, CASE role WHEN 'assistant' THEN 'code' ELSE 'markdown' END AS kind, coalesce(text, '') || chr(10) || '"é"' AS source,
  CASE WHEN role = 'assistant' THEN 'out ' || turn || '|E: ' || role ELSE '' END AS outputs, CASE WHEN role = 'assistant' THEN 2 ELSE 0 END::BIGINT AS n_outputs FROM c""")
def notebook_cells(s, d):
    c, code = F.col, F.col("role") == "assistant"
    output = F.array(F.to_json(F.struct(F.struct(F.array(F.concat(F.lit("out "), c("turn").cast("string"))).alias("text/plain")).alias("data"))), F.to_json(F.struct(F.lit("E").alias("ename"), c("role").alias("evalue"))))
    source = F.to_json(F.array(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")), F.lit('"é"')))
    cell = F.concat(F.lit('{"cell_type":"'), F.when(code, "code").otherwise("markdown"), F.lit('","source":'), source, F.when(code, F.concat(F.lit(',"outputs":['), F.array_join(output, ","), F.lit("]"))).otherwise(""), F.lit("}"))
    made = _t(s, d, "conversations").groupBy("conv_id").agg(F.concat(F.lit('{"nbformat":4,"cells":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cell.alias("x")))), lambda x: x["x"]), ","), F.lit("]}")).alias("body"))
    return cells.notebook_cells(made, "conv_id", "body").withColumn("outputs", F.array_join("outputs", "|"))


@_query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS cue, (3600000 + turn * 61000 + 5)::BIGINT AS start_ms, (3600000 + turn * 61000 + 1005)::BIGINT AS end_ms, role || ' & ' || turn || chr(10) || 'line' AS text FROM conversations""")
def subtitle_cues(s, d):
    t = F.col("turn")
    time = lambda n: F.concat(F.lit("01:"), F.format_string("%02d:%02d,%03d", F.floor(t * 61 / 60).cast("int"), (t * 61 % 60 + n).cast("int"), F.lit(5)))
    cue = F.concat((t + 1).cast("string"), F.lit("\r\n"), time(0), F.lit(" --> "), time(1), F.lit(" X1:40\r\n{\\an8}<i>"), "role", F.lit(" & "), t.cast("string"), F.lit("</i>\r\n<b>line</b>"))
    made = _t(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cue.alias("x")))), lambda x: x["x"]), "\r\n\r\n").alias("body"))
    return cells.subtitle_cues(made, "conv_id", "body")


@_query("""WITH x AS (SELECT p_partkey, p_name, p_partkey % 8 AS p, row_number() OVER (PARTITION BY p_partkey % 8 ORDER BY p_partkey) - 1 AS n FROM part) SELECT p::BIGINT AS file, n // 50 AS chunk, min(n) + 2 AS first_record, min(n) + 2 AS start_line, max(n) + 2 AS end_line, count(*) AS n_rows,
  md5('id | name' || chr(10) || string_agg(p_partkey || ' | ' || trim(regexp_replace(p_name, '\\s+', ' ', 'g')), chr(10) ORDER BY n)) AS text FROM x GROUP BY 1, 2""")
def csv_chunks(s, d):
    path = f"{graph.shared_folder(s)}/{uuid.uuid4().hex}"
    part = _t(s, d, "part").select((F.col("p_partkey") % 8).alias("p"), F.col("p_partkey").alias("k"), F.concat(F.col("p_partkey").cast("string"), F.lit(","), "p_name").alias("value"))
    heads = part.select("p").distinct().select("p", F.lit(-1).cast("long").alias("k"), F.lit("id,name").alias("value"))
    heads.unionByName(part).repartition(8, "p").sortWithinPartitions("p", "k").select("p", "value").write.partitionBy("p").text(path)
    found = cells.record_chunks(delimited.records(s, path), 50)
    return found.select(F.regexp_extract("file", r"p=(\d+)", 1).cast("long").alias("file"), "chunk", "first_record", "start_line", "end_line", "n_rows", F.md5(F.col("text").cast("binary")).alias("text"))


@_query("""SELECT conv_id, string_agg('<!-- page ' || turn || ' -->' || chr(10) || trim(text, chr(10) || ' '), chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS n_pages FROM conversations WHERE regexp_matches(text, '\\S') GROUP BY 1""")
def page_marked_text(s, d):
    return cells.page_text(_t(s, d, "conversations"), "conv_id", "turn", "text")


@_query("""SELECT o_orderkey, 'No. ' || o_orderkey || ': ' || printf('%.2f', o_totalprice) || ' on ' || strftime(o_orderdate, '%d/%m/%Y') || ' {{x}} {{other}} ' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'odd' END || '}' AS text FROM orders""")
def template_fill(s, d):
    values = {"key": F.col("o_orderkey"), "price": F.col("o_totalprice"), "day": F.col("o_orderdate"), "mark": F.lit("{{x}}"), "odd": F.when(F.col("o_orderkey") % 2 == 1, "odd")}
    template = F.lit("No. {{Key}}: {{ price : 0.00 }} on {{DAY:dd/MM/yyyy}} {{mark}} {{other}} {{odd}}}")
    return _t(s, d, "orders").select("o_orderkey", cells.fill(template, values).alias("text"))
