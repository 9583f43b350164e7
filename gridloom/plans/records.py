"""Queries over record operators, column functions and delimited files, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import lookup, pivot, records, rows
from ..sources import csv
from .tables import _money, _query, _t


@_query("SELECT o_orderkey, o_totalprice, o_orderdate, true AS has_more FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 25")
def continuation_page(s, d):
    found, keys, name = _t(s, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice", "o_orderdate"), [("o_totalprice", True), ("o_orderkey", False)], "open orders"
    last = records.page(found, keys, 25, name).orderBy("o_totalprice", F.desc("o_orderkey")).first()
    return records.page(found, keys, 25, name, records.token(found, keys, name, (last["o_totalprice"], last["o_orderkey"])))


@_query("SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500) WHERE o_totalprice > 100000")
def scan_limit(s, d):
    return records.scan(_t(s, d, "orders"), [("o_orderdate", True), ("o_orderkey", False)], 500, F.col("o_totalprice") > 100000).select("o_orderkey")


@_query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal <= (SELECT c_acctbal FROM customer ORDER BY c_acctbal LIMIT 1 OFFSET (SELECT (count(*) * 5 // 100 - 1)::BIGINT FROM customer))")
def bottom_percent(s, d):
    return records.top_percent(_t(s, d, "customer"), "c_acctbal", 5, bottom=True).select("c_custkey", "c_acctbal")


@_query("""SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name ILIKE '%00007%' AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderpriority IN ('1-URGENT', '3-MEDIUM')""")
def record_query(s, d):
    found = _t(s, d, "orders").where((F.col("o_orderdate") >= "1995-01-01") & (F.col("o_orderdate") < "1997-01-01") & F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM"))
    return found.join(_t(s, d, "customer").where(F.lower("c_name").contains("00007")), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@_query("SELECT n_nationkey, n_name AS \"n.name\", r_name AS \"n.region.name\", r_regionkey AS \"n.region.key\" FROM nation JOIN region ON n_regionkey = r_regionkey")
def nested_flatten(s, d):
    region = F.struct(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key"))
    nested = _t(s, d, "nation").join(_t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.struct(F.col("n_name").alias("name"), region.alias("region")).alias("n"))
    return records.flatten(nested)


@_query("""SELECT 'r_name' AS "column", max(CASE r_regionkey WHEN 0 THEN r_name END) AS "0", max(CASE r_regionkey WHEN 1 THEN r_name END) AS "1", max(CASE r_regionkey WHEN 2 THEN r_name END) AS "2" FROM region""")
def transposed(s, d):
    return records.transpose(_t(s, d, "region"), "r_regionkey", ["0", "1", "2"])


@_query("""SELECT n_nationkey AS k, sum(b)::DOUBLE AS sum, count(b) AS count, round(avg(b)::DOUBLE, 4) AS average, max(b)::DOUBLE AS max, min(b)::DOUBLE AS min, count(b) AS count_numbers, round(stddev_samp(b), 4) AS std_dev, round(stddev_pop(b), 4) AS std_dev_p
  FROM (SELECT c_nationkey AS n_nationkey, c_acctbal::DECIMAL(18,2) AS b FROM customer UNION ALL SELECT s_nationkey, s_acctbal::DECIMAL(18,2) FROM supplier) GROUP BY 1""")
def consolidation(s, d):
    sides = [_t(s, d, t).select(F.col(f"{p}_nationkey").alias("k"), _money(f"{p}_acctbal").alias("b")) for t, p in (("customer", "c"), ("supplier", "s"))]
    out = records.consolidate(sides, ["k"], "b")
    return out.select("k", *(F.col(c).cast("double").alias(c) for c in ("sum", "max", "min")), "count", "count_numbers", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in ("average", "std_dev", "std_dev_p")))


@_query("""WITH o AS (SELECT *, CASE o_orderkey % 5 WHEN 1 THEN ' ' WHEN 2 THEN '*a?' WHEN 3 THEN 'NaN' WHEN 4 THEN 'x*' END AS marked FROM orders)
  SELECT o_orderstatus, count(*) FILTER (o_totalprice >= 150000) AS large, count(*) FILTER (o_orderpriority ILIKE '2-%') AS high, count(*) FILTER (o_orderpriority NOT ILIKE '_-low') AS not_low, count(*) FILTER (trim(marked) <> '') AS not_blank, count(*) FILTER (coalesce(trim(marked), '') = '') AS blank,
  count(*) FILTER (marked = '*a?') AS literal, count(*) FILTER (coalesce(marked, '') NOT LIKE '*%') AS no_star, count(*) FILTER (marked = 'NaN') AS nan, sum(CASE WHEN o_orderpriority ILIKE '1-urgent' THEN o_totalprice::DECIMAL(18,2) END)::DOUBLE AS urgent FROM o GROUP BY 1""")
def criteria_aggregates(s, d):
    c = records.criterion
    kind = F.col("o_orderkey") % 5
    marked = F.when(kind == 1, " ").when(kind == 2, "*a?").when(kind == 3, "NaN").when(kind == 4, "x*")
    return _t(s, d, "orders").withColumn("marked", marked).groupBy("o_orderstatus").agg(
        F.count_if(c("o_totalprice", ">=150000")).alias("large"), F.count_if(c("o_orderpriority", "2-*")).alias("high"), F.count_if(c("o_orderpriority", "<>?-low")).alias("not_low"),
        F.count_if(c("marked", "<>")).alias("not_blank"), F.count_if(c("marked", "=")).alias("blank"), F.count_if(c("marked", "~*?~?")).alias("literal"), F.count_if(c("marked", "<>~**")).alias("no_star"), F.count_if(c("marked", "nan")).alias("nan"),
        F.sum(F.when(c("o_orderpriority", "=1-URGENT"), _money("o_totalprice"))).cast("double").alias("urgent"))


@_query("""SELECT l_returnflag, l_linestatus, (2 - grouping(l_returnflag) - grouping(l_linestatus))::INT AS level, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity, count(*) AS n, max(l_extendedprice) AS largest FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def field_subtotals(s, d):
    return records.subtotals_by_field(_t(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"quantity": F.sum(_money("l_quantity")).cast("double"), "n": F.count("*"), "largest": F.max("l_extendedprice")})


@_query("""SELECT p_partkey, p_size BETWEEN 5 AND 30 AS size_ok, p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AS brand_ok, length(p_name) <= 10 AS name_ok, p_retailprice >= 950 AS price_ok FROM part""")
def data_validation(s, d):
    v = records.keep_valid
    return _t(s, d, "part").select("p_partkey", v(F.col("p_size"), "whole", 5, 30).alias("size_ok"), v(F.col("p_brand"), "list", choices=["Brand#1", "Brand#2", "Brand#3"]).alias("brand_ok"), v(F.col("p_name"), "length", 0, 10).alias("name_ok"), v(F.col("p_retailprice"), "decimal", 950).alias("price_ok"))


@_query("SELECT conv_id, turn FROM conversations WHERE turn BETWEEN 1 AND 3 OR turn = 5")
def page_selection(s, d):
    return records.select_pages(_t(s, d, "conversations"), "turn", "1-2,5,3").select("conv_id", "turn")


@_query("""SELECT p_partkey AS key, CASE WHEN p_name ILIKE '%widget%' THEN 'p_name' WHEN p_brand ILIKE '%widget%' THEN 'p_brand' ELSE 'p_type' END AS "column" FROM part WHERE p_name ILIKE '%widget%' OR p_brand ILIKE '%widget%' OR p_type ILIKE '%widget%' ORDER BY p_partkey LIMIT 1""")
def find_text(s, d):
    return records.find_text(_t(s, d, "part"), "p_partkey", ["p_name", "p_brand", "p_type"], "WIDGET")


@_query("""WITH x AS (SELECT doc_id, sum(coalesce(strlen(text), 1048576) + 64) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM documents) SELECT doc_id, (coalesce(b, 0) // 100000)::BIGINT AS part FROM x""")
def size_bounded_split(s, d):
    return records.split_by_size(_t(s, d, "documents"), "doc_id", F.octet_length("text"), 100_000, 64).select("doc_id", "part")


@_query("""WITH e AS (SELECT event_id AS key, json_extract_string(props, '$.k') AS k FROM events) SELECT key, path, type, CASE value WHEN 'K' THEN k ELSE value END AS value FROM e, (VALUES ('$', 'object', NULL), ('$.k', 'number', 'K'), ('$.a', 'array', NULL), ('$.a[0]', 'boolean', 'true'), ('$.a[1]', 'null', NULL), ('$.a[2]', 'string', 'x"é'), ('$.a[3]', 'array', NULL), ('$.a[3][0]', 'object', NULL), ('$.o', 'object', NULL), ('$.o.b', 'number', '1.5'), ('$.o.e', 'string', '')) v(path, type, value)""")
def json_path_rows(s, d):
    text = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(', "a": [true, null, "x\\"é", [{}]], "o": {"b": 1.5, "e": ""}}'))
    return records.json_rows(_t(s, d, "events").select("event_id", text.alias("text")), "event_id", "text")


@_query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Disabled' WHEN o_totalprice < 20000 THEN 'ActiveWithoutSignalTime' WHEN o_orderdate <= TIMESTAMP '1997-01-01' THEN 'Overdue' ELSE 'Pending' END AS state FROM orders""")
def reminder_queue(s, d):
    signal = F.when(F.col("o_totalprice") >= 20000, F.col("o_orderdate"))
    return _t(s, d, "orders").select("o_orderkey", records.reminder_state(F.col("o_orderstatus") != "F", signal, F.lit("1997-01-01").cast("timestamp")).alias("state"))


@_query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN left(o_orderpriority, 1)::DOUBLE WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN -150 WHEN 6 THEN 0 END AS number, CASE o_orderkey % 7 WHEN 0 THEN o_orderpriority NOT LIKE '0%' WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN true WHEN 6 THEN false END AS truth FROM orders""")
def coercions(s, d):
    k = F.col("o_orderkey") % 7
    text = F.when(k == 0, F.substring("o_orderpriority", 1, 1)).when(k == 1, " True").when(k == 2, "FALSE").when(k == 3, "  ").when(k == 4, "-1.5e2").when(k == 5, F.col("o_orderpriority"))
    return _t(s, d, "orders").select("o_orderkey", scalars.to_number(text).alias("number"), scalars.to_boolean(text).alias("truth"))


@_query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE ELSE DATE '1900-01-01' + (o_orderkey % 120)::INT END AS day FROM orders) SELECT o_orderkey, (day - CASE WHEN day < DATE '1900-03-01' THEN DATE '1899-12-31' ELSE DATE '1899-12-30' END)::INT AS serial, (day - DATE '1904-01-01')::INT AS serial_1904, day, day AS day_1904 FROM o""")
def date_serials(s, d):
    k = F.col("o_orderkey")
    day = F.when(k % 2 == 0, F.col("o_orderdate").cast("date")).otherwise(F.date_add(F.lit("1900-01-01").cast("date"), (k % 120).cast("int")))
    return _t(s, d, "orders").select("o_orderkey", scalars.date_serial(day).alias("serial"), scalars.date_serial(day, 1904).alias("serial_1904"), scalars.serial_date(scalars.date_serial(day)).alias("day"), scalars.serial_date(scalars.date_serial(day, 1904), 1904).alias("day_1904"))


@_query("""SELECT page_id, ['web', 'script', 'data', 'file', 'mailto', 'other', 'relative', 'empty', 'web'][page_id % 9 + 1] AS kind, CASE page_id % 9 WHEN 7 THEN 'asset' WHEN 8 THEN trim(regexp_replace(lower(url), '[^a-z0-9_]+', '-', 'g'), '-') ELSE ['a-org', 'java-script-x', 'data-x', 'file-c', 'mailto-a', 'x-y', 'c_d'][page_id % 9 + 1] END AS name FROM pages""")
def url_kinds(s, d):
    k = (F.col("page_id") % 9).cast("int")
    url = F.coalesce(F.get(F.array(*map(F.lit, ("http://a.org", " java\tscript:X", "DATA:,x", "file:///c", "mailto:a", "x-y:", "C_d?", "  "))), k), F.col("url"))
    name = F.when(k == 0, "a.org").otherwise(url)
    return _t(s, d, "pages").select("page_id", scalars.url_kind(url).alias("kind"), scalars.file_name(name).alias("name"))


_SIGNALS = " || ".join(f"CASE WHEN {' OR '.join(f'contains(t, {chr(39)}{p}{chr(39)})' for p in phrases)} THEN '{name},' ELSE '' END" for name, phrases in scalars.INSTRUCTION_SIGNALS.items())


@_query(f"""WITH d AS (SELECT doc_id, lower(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0E-\\x1F\\x7F-\\x84\\x86-\\x9F]|\\p{{Cf}}', '', 'g'), '[\\x09-\\x0D\\x85\\p{{Z}}\\p{{P}}]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, rtrim({_SIGNALS}, ',') AS signals FROM d""")
def instruction_signals(s, d):
    return _t(s, d, "documents").select("doc_id", F.array_join(scalars.instruction_signals(F.col("text")), ",").alias("signals"))


@_query("SELECT r_regionkey AS \"R Regionkey\", r_name AS \"R Name\" FROM region")
def header_case(s, d):
    table = _t(s, d, "region")
    return table.toDF(*(scalars.header_case(c) for c in table.columns))


@_query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(s, d):
    return _t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 1")


@_query("SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) ORDER BY k")
def key_union(s, d):
    return _t(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(_t(s, d, "supplier").select("s_nationkey")).distinct().orderBy("k")


@_query("SELECT lang, count(*) AS scanned, count(text) AS parsed, count(*) - count(text) AS skipped, sum(strlen(coalesce(text, '')))::BIGINT AS bytes, sum(CASE WHEN text IS NULL OR text = '' THEN 0 ELSE (strlen(text) + 3) // 4 END)::BIGINT AS tokens FROM documents GROUP BY 1")
def ingest_summary(s, d):
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return _t(s, d, "documents").groupBy("lang").agg(F.count("*").alias("scanned"), F.count("text").alias("parsed"), F.count_if(F.col("text").isNull()).alias("skipped"), F.sum(size).cast("long").alias("bytes"), F.sum(F.expr("(octet_length(coalesce(text, '')) + 3) div 4")).cast("long").alias("tokens"))


@_query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip(s, d):
    path = f"{_shared(s)}/{uuid.uuid4().hex}"
    table = _t(s, d, "customer")
    csv.write(table, path, sep=";", quote_all=True)
    return csv.read(s, path, schema=table.schema, sep=";")


@_query("SELECT doc_id, replace(text, chr(13), '') AS text, strlen(text) AS size FROM documents WHERE text IS NOT NULL AND text <> ''")
def csv_text_roundtrip(s, d):
    path = f"{_shared(s)}/{uuid.uuid4().hex}"
    table = _t(s, d, "documents").where("text is not null and text <> ''").select("doc_id", F.replace("text", F.lit("\r"), F.lit("")).alias("text"), F.octet_length("text").alias("size"))
    csv.write(table, path)
    return csv.read(s, path, schema=table.schema, sep=",", multiline=True)


@_query("""SELECT p_partkey::VARCHAR AS id, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS name, CASE WHEN p_size % 3 = 2 THEN p_brand ELSE '' END AS brand FROM part""")
def csv_ragged(s, d):
    path = f"{_shared(s)}/{uuid.uuid4().hex}"
    size = F.col("p_size") % 3
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), F.when(size > 0, F.col("p_name")), F.when(size == 2, F.col("p_brand")), F.when(size == 2, F.lit("extra")))
    _t(s, d, "part").select(line.alias("value")).write.text(path)
    return csv.read(s, path, header=False, names=["id", "name", "brand"], sep=",")


@_query("SELECT event_id, event_type, round(value, 6) AS value FROM events")
def w3c_log(s, d):
    path = f"{_shared(s)}/{uuid.uuid4().hex}"
    head = s.createDataFrame([("#Version: 1.0",), ("#Fields: id kind x",)], "value string")
    head.coalesce(1).write.text(path)
    _t(s, d, "events").select(F.concat_ws(" ", F.col("event_id").cast("string"), "event_type", F.col("value").cast("string")).alias("value")).write.mode("append").text(path)
    return csv.read_w3c(s, path).select(F.col("id").cast("long").alias("event_id"), F.col("kind").alias("event_type"), F.round(F.col("x").cast("double"), 6).alias("value"))


@_query("SELECT n_name, o_orderkey, o_totalprice FROM (SELECT n_name, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY n_name ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) WHERE r <= 3")
def pivot_field_sort(s, d):
    joined = _t(s, d, "orders").join(_t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return pivot.first_of_field(joined, "n_name", [("o_totalprice", True), ("o_orderkey", False)], 3).select("n_name", "o_orderkey", "o_totalprice")


@_query("""SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus IN ('O', 'P') OR o_totalprice BETWEEN 10000 AND 100000) AND (o_orderpriority <> '5-LOW' OR o_totalprice > 300000)""")
def typed_comparisons(s, d):
    c = rows.compare
    return _t(s, d, "orders").where(~(c("o_orderstatus", "in", "O", "P") | c("o_totalprice", "between", 10000.0, 100000.0)) & (c("o_orderpriority", "ne", "5-LOW") | c("o_totalprice", "gt", 300000.0))).select("o_orderkey")


@_query("SELECT o_orderkey AS \"orderKey\", o_orderdate::DATE AS \"ORDER DATE\", left(o_orderpriority, 1)::INT AS urgency, NULL::DOUBLE AS missing FROM orders")
def column_mapping(s, d):
    table = _t(s, d, "orders").select(F.col("o_orderkey").alias("Order Key"), F.col("o_orderdate").alias("order_date"), F.substring("o_orderpriority", 1, 1).alias("Urgency!"))
    return rows.map_columns(table, {"orderKey": "long", "ORDER DATE": "date", "urgency": "int", "missing": "double"})


@_query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def column_change(s, d):
    return rows.change_columns(_t(s, d, "nation"), {"n_nationkey": "id", "n_name": "name"}, drop=("n_regionkey",))


@_query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def append_by_position(s, d):
    return rows.append_by_position(_t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), _t(s, d, "supplier").select("s_suppkey", "s_name"))


@_query("SELECT o_orderkey, quarter(o_orderdate) = 2 AND year(o_orderdate) = 1996 AS in_quarter, year(o_orderdate) = 1996 AND month(o_orderdate) = 7 AS in_month FROM orders WHERE year(o_orderdate) = 1996")
def timeline_scope(s, d):
    return _t(s, d, "orders").where(rows.in_timeline("o_orderdate", "year", 1996)).select("o_orderkey", rows.in_timeline("o_orderdate", "quarter", 1996, 2).alias("in_quarter"), rows.in_timeline("o_orderdate", "month", 1996, 7).alias("in_month"))


@_query("SELECT n_nationkey, r_name AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def hlookup(s, d):
    wide = _t(s, d, "region").groupBy(F.lit("name").alias("row")).pivot("r_regionkey", [0, 1, 2, 3, 4]).agg(F.first("r_name"))
    return lookup.hlookup(_t(s, d, "nation"), "n_regionkey", wide, "row", "name", name="region").select("n_nationkey", "region")


@_query("SELECT hour(ts) AS hour, minute(ts) // 15 AS quarter_hour, dayofweek(ts) + 1 AS weekday, count(*) AS n, max(value) AS largest FROM events GROUP BY 1, 2, 3")
def date_units(s, d):
    return _t(s, d, "events").groupBy(F.hour("ts").cast("long").alias("hour"), F.floor(F.minute("ts") / 15).alias("quarter_hour"), F.dayofweek("ts").cast("long").alias("weekday")).agg(F.count("*").alias("n"), F.max("value").alias("largest"))


@_query("SELECT page_id, CASE WHEN length(url) > 20 THEN left(url, 19) || '…' ELSE url END AS short, CASE WHEN url LIKE '%.com%' THEN '.com' ELSE '' END AS ending FROM pages")
def text_limits(s, d):
    url = F.col("url")
    return _t(s, d, "pages").select("page_id", scalars.truncate(url, 20).alias("short"), scalars.extension(F.when(url.contains(".com"), " COM ")).alias("ending"))


def _shared(s) -> str:
    from ..operators import graph

    return graph.shared_folder(s)
