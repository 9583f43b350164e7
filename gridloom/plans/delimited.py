"""Queries over the records of delimited files that Spark has written, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..sources import csv, delimited
from .tables import _query, _t


def _folder(s) -> str:
    return f"{graph.shared_folder(s)}/{uuid.uuid4().hex}"


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def _dealt(df: DataFrame, key: str, line: Column, path: str) -> None:
    """Write lines to eight files by key, each file in order of the key."""
    df.select((F.col(key) % 8).alias("p"), key, line.alias("value")).repartition(8, "p").sortWithinPartitions("p", key).select("p", "value").write.partitionBy("p").text(path)


@_query("""WITH d AS (SELECT doc_id, doc_id % 8 AS p, replace(coalesce(text, ''), chr(13), '') AS text FROM documents), n AS (SELECT *, 1 + length(text) - length(replace(text, chr(10), '')) AS lines FROM d)
  SELECT doc_id, p::BIGINT AS file, row_number() OVER w AS record_number, (sum(lines) OVER w - lines + 1)::BIGINT AS start_line, (sum(lines) OVER w)::BIGINT AS end_line, text FROM n WINDOW w AS (PARTITION BY p ORDER BY doc_id)""")
def csv_positions(s, d):
    path = _folder(s)
    docs = _t(s, d, "documents").withColumn("text", F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")))
    _dealt(docs, "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(","), _quoted(F.col("text"))), path)
    file = F.regexp_extract("file", r"p=(\d+)", 1).cast("long")
    return delimited.records(s, path).select(F.col("fields")[0].cast("long").alias("doc_id"), file.alias("file"), "record_number", "start_line", "end_line", F.col("fields")[1].alias("text"))


@_query("""SELECT p_partkey, CASE p_size % 4 WHEN 3 THEN 'four' ELSE 'three' END AS shape, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ', "x"' WHEN 2 THEN chr(10) || p_name || chr(10) || chr(10) || '#' ELSE '' END AS name, p_brand AS last FROM part""")
def csv_raw_records(s, d):
    path, size = _folder(s), F.col("p_size") % 4
    name = F.when(size == 0, F.col("p_name")).when(size == 1, _quoted(F.concat("p_name", F.lit(', "x"')))).when(size == 2, _quoted(F.concat(F.lit("\n"), "p_name", F.lit("\n\n#")))).otherwise(F.lit(","))
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), name, _quoted(F.col("p_brand")))
    # a comment and a blank line before each third record, which are no records
    _dealt(_t(s, d, "part"), "p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, "# note, \"\n \n").otherwise(""), line), path)
    found = delimited.records(s, path, comment="#")
    n = F.size("fields")
    return found.select(F.col("fields")[0].cast("long").alias("p_partkey"), F.when(n == 3, "three").when(n == 4, "four").otherwise("other").alias("shape"), F.col("fields")[1].alias("name"), F.element_at("fields", -1).alias("last"))


@_query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand || ' "new"' WHEN 1 THEN p_brand || '"x' ELSE p_brand || ' y' END AS lenient, CASE p_size % 3 WHEN 0 THEN NULL ELSE 'a quote within a field that is not quoted, or text behind a closing quote' END AS problem FROM part""")
def csv_quote_modes(s, d):
    path, size = _folder(s), F.col("p_size") % 3
    second = F.when(size == 0, F.concat(F.lit('"'), "p_brand", F.lit(' ""new"""'))).when(size == 1, F.concat("p_brand", F.lit('"x'))).otherwise(F.concat(F.lit('"'), "p_brand", F.lit('" y')))
    _dealt(_t(s, d, "part"), "p_partkey", F.concat_ws(",", F.col("p_partkey").cast("string"), second), path)
    return delimited.records(s, path, strict=True).select(F.col("fields")[0].cast("long").alias("p_partkey"), F.col("fields")[1].alias("lenient"), "problem")


@_query("""WITH x AS (SELECT p_partkey, p_size, p_partkey % 8 AS p, row_number() OVER (PARTITION BY p_partkey % 8 ORDER BY p_partkey) AS n FROM part)
  SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN p_size END AS size, CASE p_size % 5 WHEN 2 THEN 'too many fields: 2 are wanted, there are 3' WHEN 3 THEN 'too few fields: 2 are wanted, there are 1' WHEN 4 THEN 'size: no int' END AS message, CASE WHEN p_size % 5 >= 2 THEN n END AS record_number FROM x""")
def csv_errors(s, d):
    path, size = _folder(s), F.col("p_size") % 5
    line = F.concat(F.col("p_partkey").cast("string"), F.when(size == 0, F.concat(F.lit(","), "p_size")).when(size == 1, ",").when(size == 2, ",1,").when(size == 3, "").otherwise(F.concat(F.lit(",x"), "p_size")))
    _dealt(_t(s, d, "part"), "p_partkey", line, path)
    good, bad = csv.read_with_errors(s, path, "id long, size int", header=False)
    none = F.lit(None)
    return good.select("id", "size", none.cast("string").alias("message"), none.cast("long").alias("record_number")).unionByName(bad.select(F.regexp_extract("record", r"^\d+", 0).cast("long").alias("id"), none.cast("int").alias("size"), "message", "record_number"))
