"""Queries over the table operators, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, graph, lookup, pivot, rows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(c: str):
    return F.col(c).cast("decimal(18,2)")


@_query("""SELECT CASE WHEN grouping(c_mktsegment) = 1 THEN 'Grand Total' ELSE coalesce(nullif(trim(c_mktsegment), ''), '(blank)') || ' Total' END AS label,
  sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue, count(*) AS n_orders, max(o_totalprice) AS largest
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment)""")
def subtotal_grand_total(s, d):
    joined = _t(s, d, "orders").join(_t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return pivot.subtotals(joined, "c_mktsegment", {"revenue": F.sum(_money("o_totalprice")).cast("double"), "n_orders": F.count("*"), "largest": F.max("o_totalprice")})


@_query("""SELECT o_orderkey, o_totalprice, o_totalprice >= 100000 AS large FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey""")
def add_filter_sort(s, d):
    out = _t(s, d, "orders").withColumn("large", F.col("o_totalprice") >= 100000).where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", "large")
    return rows.sort_by(out, [("o_totalprice", True), ("o_orderkey", False), ("missing", False)])


@_query("""SELECT c_custkey, 'c_acctbal' AS "column", 'not negative' AS message FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT c_custkey, 'c_mktsegment', 'known' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
  UNION ALL SELECT c_custkey, 'c_name', 'required' FROM customer WHERE c_name IS NULL OR trim(c_name) = ''""")
def schema_validate_errors(s, d):
    return rows.validate(_t(s, d, "customer"), "c_custkey", {"c_acctbal": [("not negative", F.col("c_acctbal") >= 0)], "c_mktsegment": [("known", F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))]}, required=("c_name",))


@_query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def autofilter_values(s, d):
    return _t(s, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@_query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20")
def autofilter_custom_and(s, d):
    return _t(s, d, "lineitem").where(rows.custom([F.col("l_quantity") >= 10, F.col("l_quantity") <= 20], True)).select("l_orderkey", "l_linenumber", "l_quantity")


@_query("SELECT p_partkey, p_name, p_brand FROM part WHERE upper(p_name) LIKE '%A%E%' OR upper(p_brand) LIKE 'BRAND#_3'")
def autofilter_custom_or_wildcard(s, d):
    return _t(s, d, "part").where(rows.custom([rows.wildcard("p_name", "*a*e*"), rows.wildcard("p_brand", "Brand#?3")], False)).select("p_partkey", "p_name", "p_brand")


@_query("SELECT doc_id, lang FROM documents WHERE lang IS NULL OR trim(lang) = '' OR lang = 'de'")
def autofilter_blank_or_value(s, d):
    return _t(s, d, "documents").where(rows.blank_or("lang", "de")).select("doc_id", "lang")


@_query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-04-01'")
def autofilter_date_group(s, d):
    return _t(s, d, "orders").where(rows.date_group("o_orderdate", 1995, 3)).select("o_orderkey")


@_query("""SELECT o_orderkey, CASE WHEN o_orderdate::DATE = DATE '1995-06-15' THEN 'today'
  WHEN o_orderdate::DATE >= DATE '1995-06-09' AND o_orderdate::DATE < DATE '1995-06-16' THEN 'last7days'
  WHEN o_orderdate::DATE >= DATE '1995-06-12' AND o_orderdate::DATE < DATE '1995-06-19' THEN 'this_week'
  WHEN o_orderdate::DATE >= DATE '1995-05-01' AND o_orderdate::DATE < DATE '1995-06-01' THEN 'last_month'
  WHEN o_orderdate::DATE >= DATE '1995-06-01' AND o_orderdate::DATE < DATE '1995-07-01' THEN 'this_month' ELSE 'other' END AS period FROM orders""")
def time_period_rules(s, d):
    period = rows.first_match([(p, rows.time_period("o_orderdate", "1995-06-15", p)) for p in ("today", "last7days", "this_week", "last_month", "this_month")], "other")
    return _t(s, d, "orders").select("o_orderkey", period.alias("period"))


@_query("""SELECT p_partkey, contains(upper(p_name), 'IN') AS has, NOT contains(upper(p_name), 'IN') AS has_not, starts_with(upper(p_type), 'S') AS begins, ends_with(upper(p_type), 'EL') AS ends FROM part""")
def text_rules(s, d):
    return _t(s, d, "part").select("p_partkey", rows.text_rule("p_name", "contains", "in").alias("has"), rows.text_rule("p_name", "not_contains", "in").alias("has_not"), rows.text_rule("p_type", "begins", "s").alias("begins"), rows.text_rule("p_type", "ends", "el").alias("ends"))


@_query("SELECT p_partkey, p_retailprice FROM (SELECT *, rank() OVER (ORDER BY p_retailprice DESC) AS r FROM part) WHERE r <= 25")
def top_n_with_ties(s, d):
    return rows.top_n(_t(s, d, "part"), "p_retailprice", 25).select("p_partkey", "p_retailprice")


@_query("""SELECT *, (SELECT count(*) FROM orders WHERE o_totalprice < 150000 OR (o_totalprice = 150000 AND o_orderkey > 100)) > 50 AS has_more FROM
  (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 150000 OR (o_totalprice = 150000 AND o_orderkey > 100) ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)""")
def keyset_page(s, d):
    return rows.keyset_page(_t(s, d, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", False)], 50, (150000.0, 100))


@_query("""SELECT n_nationkey, (SELECT s_name FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_suppkey LIMIT 1) AS found FROM nation""")
def vlookup_first(s, d):
    return lookup.lookup(_t(s, d, "nation").select("n_nationkey"), "n_nationkey", _t(s, d, "supplier"), "s_nationkey", "s_name", ["s_suppkey"])


@_query("""SELECT n_nationkey, (SELECT s_name FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_suppkey DESC LIMIT 1) AS found FROM nation""")
def xlookup_last(s, d):
    return lookup.lookup(_t(s, d, "nation").select("n_nationkey"), "n_nationkey", _t(s, d, "supplier"), "s_nationkey", "s_name", ["s_suppkey"], last=True)


@_query("""SELECT c_custkey, coalesce((SELECT min(o_orderkey)::VARCHAR FROM orders WHERE o_custkey = c_custkey), 'none') AS found FROM customer""")
def xlookup_default(s, d):
    orders = _t(s, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").cast("string").alias("order_text"))
    return lookup.lookup(_t(s, d, "customer").select("c_custkey"), "c_custkey", orders, "o_custkey", "order_text", ["o_orderkey"], default="none")


@_query("""WITH p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL), v AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase')
  SELECT event_id, value AS last_purchase FROM v ASOF LEFT JOIN p ON v.user_id = p.user_id AND v.ts >= p.ts""")
def xlookup_nearest(s, d):
    events = _t(s, d, "events")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    other = events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return lookup.nearest(other, "ts", bought, "ts", "value", by="user_id", name="last_purchase").select("event_id", "last_purchase")


@_query("""WITH p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL), v AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase')
  SELECT event_id, value AS next_purchase FROM v ASOF LEFT JOIN p ON v.user_id = p.user_id AND v.ts <= p.ts""")
def xlookup_next_larger(s, d):
    events = _t(s, d, "events")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return lookup.nearest(events.where("event_type <> 'purchase'"), "ts", bought, "ts", "value", by="user_id", larger=True, name="next_purchase").select("event_id", "next_purchase")



@_query("""WITH l AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS m FROM customer WHERE c_custkey % 7 <> 0), r AS (SELECT c_custkey AS k, lower(c_name) AS n, CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE c_mktsegment END AS m FROM customer WHERE c_custkey % 11 <> 0),
  a AS (SELECT k, 'n' AS "column", n AS value FROM l UNION ALL SELECT k, 'm', m FROM l), b AS (SELECT k, 'n' AS "column", n AS value FROM r UNION ALL SELECT k, 'm', m FROM r)
  SELECT * FROM (SELECT coalesce(a.k, b.k) AS k, coalesce(a."column", b."column") AS "column", CASE WHEN a.k IS NULL THEN 'MissingFromLeft' WHEN b.k IS NULL THEN 'MissingFromRight' WHEN upper(trim(coalesce(a.value, ''))) <> upper(trim(coalesce(b.value, ''))) THEN 'ValueMismatch' END AS kind,
  a.value AS left_value, b.value AS right_value FROM a FULL JOIN b ON a.k = b.k AND a."column" = b."column") WHERE kind IS NOT NULL""")
def range_compare(s, d):
    c = _t(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"), F.col("c_mktsegment").alias("m"))
    right = c.where("k % 11 <> 0").select("k", F.lower("n").alias("n"), F.when(F.expr("k % 5 = 0"), "X").otherwise(F.col("m")).alias("m"))
    return lookup.compare_rows(c.where("k % 7 <> 0"), right, "k", ["n", "m"])


@_query("""WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 5 <> 0), s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'S' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 7 <> 0),
  r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'R' ELSE o_orderstatus END AS v FROM orders), j AS (SELECT coalesce(b.k, s.k, r.k) AS k, b.v AS bv, s.v AS sv, r.v AS rv FROM b FULL JOIN s ON b.k = s.k FULL JOIN r ON coalesce(b.k, s.k) = r.k)
  SELECT k, CASE WHEN sv IS NOT DISTINCT FROM bv AND rv IS NOT DISTINCT FROM bv THEN 'unchanged' WHEN rv IS NOT DISTINCT FROM bv THEN 'source_change' WHEN sv IS NOT DISTINCT FROM bv THEN 'remote_change' WHEN sv IS NOT DISTINCT FROM rv THEN 'same_change' ELSE 'conflict' END AS action FROM j""")
def sync_plan(s, d):
    o = _t(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    change = lambda n, to: o.select("k", F.when(F.col("k") % n == 0, to).otherwise(F.col("v")).alias("v"))
    return lookup.three_way(o.where("k % 5 <> 0"), change(3, "S").where("k % 7 <> 0"), change(4, "R"), "k", "v")


@_query("""WITH e AS (SELECT lower(trim(p_brand)) AS i, count(DISTINCT p_type) AS n, min(p_type) AS e FROM part GROUP BY 1), q AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_brand ELSE p_name END AS identity FROM part)
  SELECT p_partkey, identity, coalesce(n, 0) AS n_entries, CASE WHEN n = 1 THEN 'Resolved' WHEN n > 1 THEN 'Ambiguous' ELSE 'NotFound' END AS status, CASE WHEN n = 1 THEN e END AS entry FROM q LEFT JOIN e ON lower(trim(identity)) = i""")
def identity_resolution(s, d):
    part = _t(s, d, "part")
    asked = part.select("p_partkey", F.when(F.expr("p_partkey % 3 = 0"), F.concat(F.lit(" "), "p_brand")).otherwise(F.col("p_name")).alias("identity"))
    return lookup.resolve(asked, "identity", part, "p_brand", "p_type")


@_query("""SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum, count(l_quantity) AS count, round(avg(l_quantity), 4) AS average, max(l_quantity) AS max, min(l_quantity) AS min, count(l_quantity) AS count_numbers,
  round(stddev_samp(l_quantity), 4) AS stddev, round(stddev_pop(l_quantity), 4) AS stddevp, round(var_samp(l_quantity), 4) AS var, round(var_pop(l_quantity), 4) AS varp FROM lineitem GROUP BY 1, 2""")
def pivot_aggregates(s, d):
    out = pivot.aggregate(_t(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", [f for f in pivot.FUNCTIONS if f != "product"])
    return out.select(*(F.round(c, 4).alias(c) if c in ("average", "stddev", "stddevp", "var", "varp") else c for c in out.columns))


@_query("SELECT o_orderkey, product(l_linenumber)::DOUBLE AS product FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def pivot_product(s, d):
    joined = _t(s, d, "lineitem").join(_t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return pivot.aggregate(joined, ["o_orderkey"], "l_linenumber", ["product"])


@_query("""SELECT year(o_orderdate)::INT AS year, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice::DECIMAL(18,2) END)::DOUBLE AS "F", sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice::DECIMAL(18,2) END)::DOUBLE AS "O", sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice::DECIMAL(18,2) END)::DOUBLE AS "P" FROM orders GROUP BY 1""")
def pivot_wide(s, d):
    return pivot.table(_t(s, d, "orders").withColumn("year", F.year("o_orderdate")), ["year"], "o_orderstatus", ["F", "O", "P"], F.sum(_money("o_totalprice")).cast("double"))


@_query("""SELECT year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter, month(o_orderdate)::INT AS month, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY ROLLUP (1, 2, 3)""")
def pivot_date_hierarchy(s, d):
    o = _t(s, d, "orders").select(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"), F.month("o_orderdate").alias("month"), "o_totalprice")
    return o.rollup("year", "quarter", "month").agg(F.count("*").alias("n"), F.sum(_money("o_totalprice")).cast("double").alias("total"))


@_query("SELECT (floor((p_retailprice - 900) / 5) * 5 + 900)::DOUBLE AS price_from, count(*) AS n, min(p_size) AS least_size FROM part GROUP BY 1")
def pivot_number_range(s, d):
    return _t(s, d, "part").groupBy(pivot.number_range("p_retailprice", 900, 5).cast("double").alias("price_from")).agg(F.count("*").alias("n"), F.min("p_size").alias("least_size"))


@_query("""SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS finished, count(*) AS n, round(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*), 6) AS share FROM orders GROUP BY 1""")
def pivot_calculated_field(s, d):
    out = _t(s, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count("*").alias("n"))
    return out.withColumn("share", F.round(F.col("finished") / F.col("n"), 6))


@_query("""WITH c AS (SELECT o_orderpriority AS pri, year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY 1, 2), b AS (SELECT *, max(CASE WHEN year = 1995 THEN n END) OVER (PARTITION BY pri) AS base, sum(n) OVER (PARTITION BY pri) AS tr, sum(n) OVER (PARTITION BY year) AS tc, sum(n) OVER () AS g FROM c)
  SELECT pri, year, n, n - base AS difference_from, round(n / base, 6) AS percent_of, round((n - base) / base, 6) AS percent_difference_from, (sum(n) OVER (PARTITION BY pri ORDER BY year ROWS UNBOUNDED PRECEDING))::BIGINT AS running_total, round(n / tr, 6) AS percent_of_row, round(n / tc, 6) AS percent_of_column, round(n / g, 6) AS percent_of_grand_total, round((n * g) / (tr::DOUBLE * tc), 6) AS "index" FROM b""")
def show_as_calculations(s, d):
    cells = _t(s, d, "orders").groupBy(F.col("o_orderpriority").alias("pri"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return pivot.show_as(cells, "pri", "year", "n", 1995)


@_query("""WITH f AS (SELECT *, CASE WHEN l_returnflag IS DISTINCT FROM lag(l_returnflag) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)), r AS (SELECT *, sum(b) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)::BIGINT AS run_id FROM f)
  SELECT l_orderkey, run_id, l_returnflag, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM r GROUP BY 1, 2, 3""")
def subtotal_runs(s, d):
    out = pivot.run_ids(_t(s, d, "lineitem"), "l_returnflag", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], ["l_orderkey"])
    return out.groupBy("l_orderkey", "run_id", "l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@_query("""WITH f AS (SELECT *, (o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w OR row_number() OVER w = 1)::INT AS b FROM orders WINDOW w AS (ORDER BY o_orderkey)), r AS (SELECT *, sum(b) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS run_id FROM f)
  SELECT run_id, o_orderstatus || ' Total' AS label, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS price, max(o_custkey) AS largest, min(o_orderkey) AS first, max(o_orderkey) AS last FROM r GROUP BY 1, 2 UNION ALL SELECT NULL, 'Grand Total', count(*), sum(o_totalprice::DECIMAL(18,2))::DOUBLE, max(o_custkey), min(o_orderkey), max(o_orderkey) FROM orders""")
def subtotals_of_runs(s, d):
    return pivot.run_subtotals(_t(s, d, "orders"), "o_orderstatus", "o_orderkey", {"n": F.count("*"), "price": F.sum(_money("o_totalprice")).cast("double"), "largest": F.max("o_custkey")})


@_query("""SELECT 'customer' AS sheet, c_nationkey AS nationkey, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_name, NULL FROM supplier""")
def merge_by_header(s, d):
    a = _t(s, d, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = _t(s, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"))
    return rows.merge_by_header(a, b, names=("customer", "supplier"))


@_query("""WITH c AS (SELECT 'c_custkey' AS "column", trim(c_custkey::VARCHAR) AS v FROM customer UNION ALL SELECT 'c_name', trim(c_name) FROM customer UNION ALL SELECT 'c_mktsegment', trim(c_mktsegment) FROM customer UNION ALL SELECT 'mixed', CASE WHEN c_custkey % 3 = 0 THEN c_custkey::VARCHAR ELSE c_name END FROM customer),
  p AS (SELECT "column", count(*) AS total, count(*) FILTER (v <> '') AS non_empty, count(*) FILTER (regexp_full_match(v, '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)')) AS numeric FROM c GROUP BY 1)
  SELECT *, CASE WHEN non_empty = 0 THEN 'Empty' WHEN numeric = non_empty THEN 'Numeric' WHEN numeric = 0 THEN 'Text' ELSE 'Mixed' END AS kind, CASE WHEN non_empty = 0 THEN 0.0 ELSE round(greatest(numeric / non_empty, 1 - numeric / non_empty), 6) END::DOUBLE AS confidence FROM p""")
def column_profile(s, d):
    c = _t(s, d, "customer").withColumn("mixed", F.when(F.expr("c_custkey % 3 = 0"), F.col("c_custkey").cast("string")).otherwise(F.col("c_name")))
    return rows.column_profile(c, ["c_custkey", "c_name", "c_mktsegment", "mixed"])


@_query("SELECT l_orderkey, round(sum(l_quantity * l_linenumber), 4)::DOUBLE AS sumproduct FROM lineitem GROUP BY 1")
def sumproduct(s, d):
    return _t(s, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_linenumber")), 4).alias("sumproduct"))


@_query("SELECT * EXCLUDE rn FROM (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1")
def first_wins_dedup(s, d):
    return rows.first_by_id(_t(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", ["o_orderkey"])


@_query("""WITH t AS (SELECT doc_id, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents), c AS (SELECT doc_id, t, unnest(range(0, greatest(1, ceil(length(t) / 2000))::BIGINT)) AS i FROM t), x AS (SELECT *, substr(t, i * 2000 + 1, 2000) AS body, substr(t, 1, i * 2000) AS before FROM c)
  SELECT doc_id, i AS chunk_index, 'text:' || doc_id || ':' || lpad(i::VARCHAR, 4, '0') AS chunk_id, (length(before) - length(replace(before, chr(10), '')) + 1)::BIGINT AS start_line, body AS text, sha256(body) AS chunk_hash, CASE WHEN length(body) = 0 THEN 0 ELSE greatest(1, (length(body) + 3) // 4) END::BIGINT AS tokens FROM x""")
def text_chunks(s, d):
    return documents.chunks(_t(s, d, "documents"), "doc_id", "text", 2000)


@_query("""WITH h AS (SELECT doc_id, source, text FROM documents WHERE contains(upper(text), 'THEHE') OR contains(upper(text), 'ERNDON')), p AS (SELECT *, least(nullif(instr(upper(text), 'THEHE'), 0), nullif(instr(upper(text), 'ERNDON'), 0)) AS f FROM h), q AS (SELECT *, greatest(1, coalesce(f, 1) - 30) AS st FROM p)
  SELECT doc_id, source, CASE WHEN st > 1 THEN '…' ELSE '' END || substr(text, st, 60) || CASE WHEN length(text) >= st + 60 THEN '…' ELSE '' END AS snippet FROM q""")
def content_search_any(s, d):
    return documents.search(_t(s, d, "documents").select("doc_id", "source", "text"), ["text"], ["thehe", "erndon", "THEHE "]).drop("text")


@_query("SELECT doc_id, source FROM documents WHERE contains(upper(text), 'THAT') AND (contains(upper(text), 'SRC3') OR contains(upper(source), 'SRC3'))")
def content_search_all_fields(s, d):
    return documents.search(_t(s, d, "documents").select("doc_id", "source", "text"), ["text", "source"], ["that", "src3"], match_all=True).select("doc_id", "source")


@_query("""SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM conversations""")
def sections(s, d):
    return documents.sections(_t(s, d, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "section")


@_query("""WITH x AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS g FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p_partkey) - 1 AS k FROM x) SELECT p_partkey, CASE WHEN k = 0 THEN g ELSE g || '-' || k END AS slug FROM n""")
def unique_slugs(s, d):
    return documents.unique_slugs(_t(s, d, "part"), "p_partkey", "p_type").select("p_partkey", "slug")


@_query("""SELECT page_id, 'src:' || sha256(url) AS source_id, trim(regexp_replace(url, '[\\s[:cntrl:]]+', ' ', 'g')) AS url FROM pages""")
def source_ids(s, d):
    return _t(s, d, "pages").select("page_id", documents.source_id(F.col("url")).alias("source_id"), documents.plain_space(F.col("url")).alias("url"))


@_query("""WITH RECURSIVE e AS (SELECT DISTINCT 'c' || conv_id AS a, 't' || md5(array_to_string(string_split(trim(text), ' ')[1:3], ' ')) AS b FROM conversations WHERE text IS NOT NULL),
  u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(a, b) AS (SELECT a, a FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT a AS node, min(b) AS component FROM r GROUP BY a""")
def conversation_components(s, d):
    turns = _t(s, d, "conversations")
    # turns that open with the same words belong together, as do those of one conversation
    topic = F.md5(F.substring_index(F.trim("text"), " ", 3))
    edges = turns.where("text is not null").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("src"), F.concat(F.lit("t"), topic).alias("dst"))
    return graph.connected_components(edges)


@_query("""WITH k AS (SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders), s AS (SELECT o_orderpriority, sum(o_totalprice::DECIMAL(18,2)) AS t FROM k GROUP BY 1) SELECT o_orderpriority, t::DOUBLE AS total FROM s UNION ALL SELECT 'Total', sum(t)::DOUBLE FROM s""")
def table_totals_row(s, d):
    out = _t(s, d, "orders").groupBy("o_orderpriority").agg(F.sum(_money("o_totalprice")).alias("t"))
    return out.select("o_orderpriority", F.col("t").cast("double").alias("total")).unionByName(out.agg(F.sum("t").cast("double").alias("total")).withColumn("o_orderpriority", F.lit("Total")))


@_query("SELECT o_orderstatus, count(*) FILTER (o_totalprice > 200000) AS large, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1")
def conditional_counts(s, d):
    return _t(s, d, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


@_query("SELECT doc_id, regexp_replace(text, 'th(e|at)', '<\\1>', 'g') AS text, len(regexp_extract_all(text, 'th(?:e|at)'))::INT AS n_replaced FROM documents")
def find_and_replace(s, d):
    return _t(s, d, "documents").select("doc_id", F.regexp_replace("text", "th(e|at)", "<$1>").alias("text"), F.regexp_count("text", F.lit("th(?:e|at)")).alias("n_replaced"))
