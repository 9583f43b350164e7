"""Queries that compare, deduplicate and link records and messages, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph, semantic, threads
from .tables import _query, _t

_ENTRY = lambda path, value: f"{path} || ' ' || strlen({value}) || ' ' || sha256({value})"


@_query(f"""WITH c AS (SELECT c_custkey, c_custkey::VARCHAR AS k, c_name, c_nationkey::VARCHAR AS n, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS m, list_sort([sha256(c_name) || ' ' || strlen(c_name), sha256(c_mktsegment) || ' ' || strlen(c_mktsegment)]) AS t FROM customer)
  SELECT c_custkey, sha256({_ENTRY("'c_custkey'", "k")} || chr(10) || CASE WHEN m IS NULL THEN '' ELSE {_ENTRY("'c_mktsegment'", "m")} || chr(10) END || {_ENTRY("'c_name'", "c_name")} || chr(10) || {_ENTRY("'c_nationkey'", "n")} || chr(10)
    || 'tags/00000000 ' || substr(t[1], 66) || ' ' || left(t[1], 64) || chr(10) || 'tags/00000001 ' || substr(t[2], 66) || ' ' || left(t[2], 64)) AS fingerprint FROM c""")
def semantic_fingerprints(s, d):
    table = _t(s, d, "customer").select("c_nationkey", F.array("c_name", "c_mktsegment").alias("tags"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("c_mktsegment"), "c_name", "c_custkey")
    return table.select("c_custkey", semantic.fingerprint(semantic.entries(table)).alias("fingerprint"))


def _changed(s, d):
    table = _t(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_nationkey").alias("modified"))
    kind = F.col("c_custkey") % 10
    other = table.where(kind != 0).withColumns({"c_mktsegment": F.when(kind == 1, F.lower("c_mktsegment")).when(kind != 2, F.col("c_mktsegment")), "c_custkey": F.when(kind == 3, F.col("c_custkey") + 10_000_000).otherwise(F.col("c_custkey")), "modified": F.col("modified") + 1})
    return table, other


_DIFFERENT = """x AS (SELECT c_custkey, 'c_' || c AS path, 'MissingFromDestination' AS kind, strlen(CASE c WHEN 'name' THEN c_name ELSE c_mktsegment END) AS source_length, NULL::BIGINT AS destination_length FROM customer, (SELECT unnest(['name', 'mktsegment']) AS c) WHERE c_custkey % 10 IN (0, 3) OR (c_custkey % 10 = 2 AND c = 'mktsegment')
  UNION ALL SELECT c_custkey + 10000000, 'c_' || c, 'UnexpectedInDestination', NULL, strlen(CASE c WHEN 'name' THEN c_name ELSE c_mktsegment END) FROM customer, (SELECT unnest(['name', 'mktsegment']) AS c) WHERE c_custkey % 10 = 3
  UNION ALL SELECT c_custkey, 'c_mktsegment', 'Changed', strlen(c_mktsegment), strlen(c_mktsegment) FROM customer WHERE c_custkey % 10 = 1)"""


@_query(f"WITH {_DIFFERENT} SELECT *, false AS truncated FROM x")
def semantic_compare(s, d):
    return semantic.differences(*_changed(s, d), "c_custkey", profile="deduplication")


@_query(f"WITH {_DIFFERENT} SELECT *, true AS truncated FROM x ORDER BY c_custkey, path LIMIT 40")
def semantic_compare_capped(s, d):
    return semantic.differences(*_changed(s, d), "c_custkey", profile="deduplication", most=40)


@_query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS run FROM documents QUALIFY row_number() OVER (PARTITION BY lang, text ORDER BY doc_id % 2, doc_id) = 1""")
def semantic_dedup(s, d):
    docs = _t(s, d, "documents")
    told = docs.withColumn("fingerprint", semantic.fingerprint(semantic.entries(docs, ["lang", "text"])))
    index = semantic.DedupIndex(s, f"{graph.shared_folder(s)}/{uuid.uuid4().hex}")
    runs = [index.add(told.where(F.col("doc_id") % 2 == k), "fingerprint", ["doc_id"], name).select("doc_id", F.lit(name).alias("run")) for k, name in enumerate(("even", "odd"))]
    return runs[0].unionByName(runs[1])


@_query("""WITH a AS (SELECT doc_id, text, source, CASE WHEN doc_id % 3 = 0 THEN 'first' ELSE 'second' END AS store FROM documents) SELECT doc_id, store FROM a QUALIFY row_number() OVER (PARTITION BY text, source ORDER BY store, doc_id) = 1""")
def store_merge(s, d):
    docs = _t(s, d, "documents").select("doc_id", "text", "source", F.col("n_chars").alias("modified"))
    stores = {"first": docs.where("doc_id % 3 = 0"), "second": docs.where("doc_id % 3 <> 0").drop("modified")}
    return semantic.merge(stores, ["doc_id"], columns=["text", "source", "modified"]).select("doc_id", "store")


# Messages made of turns: two of three answer the turn before, the others can only be linked by their subject, which every tenth conversation has.
_MESSAGES = """m AS (SELECT conv_id * 100 + turn AS id, conv_id, turn, conv_id % 10 AS topic, conv_id * 174 + turn * 60 AS minute FROM conversations),
  f AS (SELECT b.id AS src, a.id AS dst FROM m b JOIN m a ON a.conv_id = b.conv_id AND a.turn = b.turn - 1 WHERE b.turn % 3 > 0),
  p AS (SELECT id AS src, lag(id) OVER w AS dst, minute - lag(minute) OVER w AS gap FROM m WINDOW w AS (PARTITION BY topic ORDER BY minute, id)),
  l AS (SELECT src, dst, 'reference' AS kind FROM f UNION ALL SELECT src, dst, 'subject' FROM p WHERE gap <= 1440 AND src NOT IN (SELECT src FROM f UNION SELECT dst FROM f))"""


def _messages(s, d):
    turns = _t(s, d, "conversations")
    name = lambda t: F.concat(F.lit("<"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"), F.lit("@x>"))
    mark = F.when(F.col("turn") == 0, "").when(F.col("turn") == 1, "RE:  ").when(F.col("turn") == 2, "Re[2]: Fwd: ").otherwise("Aw : re:")
    return turns.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), name(F.col("turn")).alias("message_id"), F.when(F.col("turn") % 3 > 0, F.array(F.lit(" <lost@x> "), name(F.col("turn") - 1))).alias("references"),
        F.concat(mark, F.lit("Topic\t"), (F.col("conv_id") % 10).cast("string")).alias("subject"), F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("conv_id") * 174 + F.col("turn") * 60) * 60).alias("sent"))


@_query(f"WITH {_MESSAGES} SELECT * FROM l")
def message_links(s, d):
    return threads.links(_messages(s, d), within=86400)


@_query(f"""WITH RECURSIVE {_MESSAGES}, u AS (SELECT src AS x, dst AS y FROM l UNION SELECT dst, src FROM l), r(x, y) AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x), c AS (SELECT x, min(y) AS y FROM r GROUP BY 1),
  z AS (SELECT id, least(id, coalesce(y, id)) AS conversation FROM m LEFT JOIN c ON id = x) SELECT id, conversation, conversation IN (SELECT conversation FROM l JOIN z ON src = id WHERE kind = 'subject') AS heuristic FROM z""")
def linked_conversations(s, d):
    return threads.conversations(_messages(s, d), within=86400)
