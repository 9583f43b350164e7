"""Queries over cells, normalised documents and functions of single values, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import normalize, sheets
from .tables import _query, _t


def _cells(s, d):
    """Parts as a sheet, of as many rows as there are parts: key, name and a formula in three columns."""
    part = _t(s, d, "part")
    r = F.col("p_partkey") + 1
    text = lambda *c: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in c))
    formula = text("SUM(A", r.cast("string"), ":$B$", (r + 5).cast("string"), ")&\"A9\"&'Other'!A9+Rate1x*LOG10(AA", r.cast("string"), ")")
    none = F.lit(None).cast("string")
    cell = lambda k, value, made: F.struct(F.lit(k).alias("column"), value.alias("value"), made.alias("formula"))
    three = F.array(cell(1, r.cast("string"), none), cell(2, F.col("p_name"), none), cell(4, none, formula))
    return part.select(r.cast("int").alias("row"), F.explode(three).alias("x")).select("row", "x.*")


_FORMULA = lambda a, b, c: f"""'SUM(' || {a} || ':' || {b} || ')&"A9"&''Other''!A9+Rate1x*LOG10(' || {c} || ')'"""
_ROW = lambda x: f"CASE WHEN {x} < 100 THEN {x} ELSE {x} + 7 END"
_CUT = lambda p, x: f"CASE WHEN {x} BETWEEN 100 AND 106 THEN '#REF!' ELSE '{p}' || CASE WHEN {x} < 100 THEN {x} ELSE {x} - 7 END END"
_THREE = "(SELECT unnest([1, 2, 4])::INT AS c)"


@_query(f"""WITH p AS (SELECT p_partkey + 1 AS r, p_name FROM part) SELECT ({_ROW("r")})::INT AS row, c AS "column", CASE c WHEN 1 THEN r::VARCHAR WHEN 2 THEN p_name END AS value, CASE c WHEN 4 THEN {_FORMULA(f"'A' || {_ROW('r')}", f"'$B$' || {_ROW('(r + 5)')}", f"'AA' || {_ROW('r')}")} END AS formula FROM p, {_THREE}""")
def sheet_insert_rows(s, d):
    return sheets.insert_rows(_cells(s, d), 100, 7, last_row=None)


@_query(f"""WITH p AS (SELECT p_partkey + 1 AS r, p_name FROM part) SELECT (CASE WHEN r < 100 THEN r ELSE r - 7 END)::INT AS row, c AS "column", CASE c WHEN 1 THEN r::VARCHAR WHEN 2 THEN p_name END AS value, CASE c WHEN 4 THEN {_FORMULA(_CUT("A", "r"), _CUT("$B$", "(r + 5)"), _CUT("AA", "r"))} END AS formula FROM p, {_THREE} WHERE r NOT BETWEEN 100 AND 106""")
def sheet_delete_rows(s, d):
    return sheets.delete_rows(_cells(s, d), 100, 7, last_row=None)


@_query(f"""WITH p AS (SELECT p_partkey + 1 AS r, p_name FROM part) SELECT r::INT AS row, CASE WHEN c = 1 THEN 1 ELSE c + 25 END AS "column", CASE c WHEN 1 THEN r::VARCHAR WHEN 2 THEN p_name END AS value, CASE c WHEN 4 THEN {_FORMULA("'A' || r", "'$AA$' || (r + 5)", "'AZ' || r")} END AS formula FROM p, {_THREE}""")
def sheet_insert_columns(s, d):
    return sheets.insert_columns(_cells(s, d), 2, 25, last_row=None)


@_query("""SELECT (p_partkey + 1)::INT AS row, p_partkey + 1 AS id, coalesce(nullif(p_name, ''), 'none') AS name, 7 AS none FROM part""")
def sheet_typed_rows(s, d):
    return sheets.typed_rows(_cells(s, d), {1: ("id", "long"), 2: ("name", "string"), 4: ("none", "int")}, defaults={"name": "none", "none": 7})


@_query("""SELECT p_partkey, 'id,Column2,name,Column4' AS columns, p_partkey || '|||/|' || trim(p_name) || '||x' AS rows, 'Numeric,Text,Empty,Text' AS kinds FROM part""")
def normalized_tables(s, d):
    key = F.col("p_partkey").cast("string")
    made = _t(s, d, "part").select("p_partkey", normalize.table(F.array(F.lit(" id"), F.lit(None), F.lit("name\t")), F.array(F.array(key), F.array(F.lit(None), F.concat(F.lit(" "), "p_name", F.lit(" ")), F.lit(""), F.lit("x")))).alias("t"))
    return made.select("p_partkey", F.array_join("t.columns", ",").alias("columns"), F.array_join(F.transform("t.rows", lambda r: F.array_join(r, "|")), "/").alias("rows"), F.array_join(F.transform("t.profiles", lambda x: x["kind"]), ",").alias("kinds"))


@_query("""SELECT p_partkey, 'id,name' || chr(10) || p_partkey || ',"a, ""b"" | ' || p_name || '"' AS csv, '| id | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_partkey || ' | a, "b" \\| ' || p_name || ' |' AS markdown, '[{"id":"' || p_partkey || '","name":"a, \\"b\\" | ' || p_name || '"}]' AS json FROM part""")
def table_bundle(s, d):
    rows = F.array(F.array(F.col("p_partkey").cast("string"), F.concat(F.lit('a, "b" | '), "p_name")))
    return _t(s, d, "part").select("p_partkey", normalize.bundle(F.array(F.lit("id"), F.lit("name")), rows).alias("b")).select("p_partkey", "b.*")


@_query("""WITH x AS (SELECT 'c_name' AS metric, count(*) AS compared, count(*) FILTER (c_custkey % 3 > 0 AND c_custkey % 5 > 0) AS matched FROM customer UNION ALL SELECT 'c_nationkey', count(*), count(*) FILTER (c_custkey % 3 > 0) FROM customer) SELECT metric, compared, matched, round(matched / compared, 6) AS score FROM x UNION ALL SELECT NULL, sum(compared)::BIGINT, sum(matched)::BIGINT, round(sum(matched) / sum(compared), 6) FROM x""")
def round_trip_score(s, d):
    table = _t(s, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    back = table.where("c_custkey % 3 > 0").withColumn("c_name", F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).otherwise("?"))
    return normalize.round_trip_score(table, back, "c_custkey", ["c_name", "c_nationkey"])


@_query("""WITH d AS (SELECT doc_id, lang, text, unnest(range(length(text))) AS o FROM documents WHERE contains(lower(text), 'thehe')), h AS (SELECT * FROM d WHERE lower(substr(text, o + 1, 5)) = 'thehe'), n AS (SELECT *, greatest(1, o - 9) AS st FROM h QUALIFY o - coalesce(lag(o) OVER (PARTITION BY doc_id ORDER BY o), -5) >= 5)
  SELECT doc_id, lang AS place, o AS "offset", substr(text, o + 1, 5) AS found, CASE WHEN st > 1 THEN '…' ELSE '' END || substr(text, st, 20) || CASE WHEN length(text) >= st + 20 THEN '…' ELSE '' END AS snippet FROM n""")
def phrase_hits(s, d):
    return normalize.phrase_hits(_t(s, d, "documents"), "doc_id", "lang", "text", " theHE ", width=20)


@_query("""SELECT doc_id, CASE WHEN strlen(text) > 3000 THEN 'too-many-bytes' WHEN length(text) > 2000 THEN 'too-many-characters' WHEN length(text) - length(replace(text, chr(10), '')) >= 8 THEN 'too-many-lines' WHEN regexp_matches(text, '[\\x00-\\x08\\x0E-\\x1F\\x7F]') THEN 'control-characters' END AS refused FROM documents""")
def input_guard(s, d):
    return _t(s, d, "documents").select("doc_id", normalize.guard(F.col("text"), most_bytes=3000, most_chars=2000, most_lines=8).alias("refused"))


@_query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'WEEKLY' WHEN 1 THEN 'DAILY' END AS freq, CASE turn % 4 WHEN 0 THEN turn::VARCHAR END AS "interval", CASE turn % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 END::INT AS n_parts, CASE turn % 3 WHEN 0 THEN 'SentItems' WHEN 1 THEN 'JunkEmail' ELSE 'Unknown' END AS folder, role || ' / ' || turn AS joined FROM conversations""")
def mail_functions(s, d):
    t = F.col("turn")
    rule = F.when(t % 4 == 0, F.concat(F.lit("freq=WEEKLY;INTERVAL="), t.cast("string"), F.lit(";Interval=9;BYDAY=MO,TU"))).when(t % 4 == 1, "FREQ=DAILY").when(t % 4 == 2, "FREQ=DAILY;COUNT=").otherwise("INTERVAL=2")
    folder = F.when(t % 3 == 0, " sent ITEMS ").when(t % 3 == 1, "spam").otherwise("Sent mail")
    m = scalars.recurrence(rule)
    return _t(s, d, "conversations").select("conv_id", "turn", m["FREQ"].alias("freq"), m["INTERVAL"].alias("interval"), F.when(m.isNotNull(), F.size(m)).alias("n_parts"), scalars.folder_kind(folder).alias("folder"), scalars.joined(F.array(F.col("role"), F.lit(None), t.cast("string")), " / ").alias("joined"))
