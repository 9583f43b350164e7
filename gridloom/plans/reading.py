"""Queries over searches that are taken up again, kinds of content and processors, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph, processors, resume
from ..sources import kinds
from .tables import SQL, _query, _t


@_query(SQL["content_search_any"])
def resumed_search(s, d):
    docs, folder = _t(s, d, "documents").select("doc_id", "source", "text"), f"{graph.shared_folder(s)}/{uuid.uuid4().hex}"
    search = lambda: resume.ResumableSearch(docs, "doc_id", ["text"], ["thehe", "erndon", "THEHE "], folder, ranges=6)
    search().run(2)
    again = search()
    again.check(again.checkpoint())
    again.run()
    return again.results().select("doc_id", "snippet").join(docs.select("doc_id", "source"), "doc_id").select("doc_id", "source", "snippet")


# Files of eight kinds, made of documents' texts, under names that are right, wrong or unknown.
_KINDS = """x AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 8 AS k, (doc_id // 8) % 3 AS named FROM documents), y AS (SELECT *, ['Pdf', 'Excel', 'Html', 'Xml', 'Json', 'Email', 'Image', 'Text'][k + 1] AS content_kind, CASE WHEN k IN (0, 1, 6) THEN 'high' WHEN k = 7 THEN CASE WHEN text = '' THEN 'none' ELSE 'low' END ELSE 'medium' END AS content_confidence,
  CASE named WHEN 0 THEN ['Pdf', 'Excel', 'Html', 'Xml', 'Json', 'Email', 'Image', 'Text'][k + 1] WHEN 1 THEN 'Word' ELSE 'Unknown' END AS extension_kind FROM x)"""


@_query(f"""WITH {_KINDS} SELECT doc_id, extension_kind, CASE WHEN k = 7 AND text = '' THEN 'Unknown' ELSE content_kind END AS content_kind, content_confidence, CASE WHEN k = 7 AND text = '' THEN extension_kind WHEN k = 7 AND named = 1 THEN 'Word' ELSE content_kind END AS kind, named = 1 AND k < 7 AS mismatch,
  CASE named WHEN 0 THEN 'extension:' || ['pdf', 'xlsx', 'html', 'xml', 'json', 'eml', 'png', 'txt'][k + 1] || CASE WHEN k = 7 AND text = '' THEN '' ELSE ',' END WHEN 1 THEN 'extension:docx' || CASE WHEN k = 7 AND text = '' THEN '' ELSE ',' END ELSE '' END
    || CASE WHEN k = 7 AND text = '' THEN '' ELSE ['signature:pdf', 'package:Excel', 'token:html', 'token:xml', 'token:json', 'token:headers', 'signature:png', 'text'][k + 1] END AS evidence FROM y""")
def content_kinds(s, d):
    k, named = F.col("doc_id") % 8, F.floor(F.col("doc_id") / 8) % 3
    heads = [F.lit(b"%PDF-1.7\n\x00"), F.lit(b"PK\x03\x04\x14\x00[Content_Types].xmlPK\x03\x04xl/workbook.xml\x00"), F.lit(b"\xef\xbb\xbf <!-- x --><!DOCTYPE HTML>"), F.lit(b"<?xml version='1.0'?><html>"), F.lit(b' { "a": "'), F.lit(b"From: a@example.org\r\nSubject: b\r\n c\r\n\r\n"), F.lit(b"\x89PNG\r\n\x1a\n"), F.lit(b"")]
    pick = lambda options: F.coalesce(*(F.when(k == i, F.lit(x) if isinstance(x, str) else x) for i, x in enumerate(options)))
    name = F.concat(F.lit("Dir.v1/file"), F.when(named == 0, pick([".pdf", ".XLSX", ".html", ".xml", ".json", ".eml", ".png", ".txt"])).when(named == 1, ".docx").otherwise(""))
    files = _t(s, d, "documents").select("doc_id", name.alias("name"), F.concat(pick(heads), F.coalesce("text", F.lit("")).cast("binary")).alias("content"))
    found = kinds.detect(files, "name", "content")
    return found.select("doc_id", "extension_kind", "content_kind", "content_confidence", "kind", "mismatch", F.array_join("evidence", ",").alias("evidence"))


_SMALL = "abcdefghijklmnopqrstuvwxyz"
_SHORT = "length(trim(coalesce(text, ''))) < 200"


@_query(f"""SELECT doc_id, CASE WHEN lang = 'de' THEN text WHEN {_SHORT} THEN trim(text) ELSE translate(trim(text), '{_SMALL}', '{_SMALL.upper()}') END AS text, CASE WHEN lang = 'de' OR {_SHORT} THEN NULL ELSE length(trim(text)) END::INT AS size,
  CASE WHEN lang = 'de' THEN 'trim:Failed:not in German,upper:Skipped,size:Skipped' WHEN {_SHORT} THEN 'trim:Completed,upper:Failed:too short,size:Skipped' ELSE 'trim:Completed,upper:Completed,size:Completed' END AS steps FROM documents""")
def processors_stop(s, d):
    return _processed(s, d, "stop")


@_query(f"""SELECT doc_id, CASE WHEN lang = 'de' THEN CASE WHEN {_SHORT.replace("trim(coalesce(text, ''))", "coalesce(text, '')")} THEN text ELSE translate(text, '{_SMALL}', '{_SMALL.upper()}') END WHEN {_SHORT} THEN trim(text) ELSE translate(trim(text), '{_SMALL}', '{_SMALL.upper()}') END AS text, length(CASE WHEN lang = 'de' THEN text ELSE trim(text) END)::INT AS size,
  CASE WHEN lang = 'de' THEN 'trim:Failed:not in German' ELSE 'trim:Completed' END || CASE WHEN CASE WHEN lang = 'de' THEN length(text) ELSE length(trim(text)) END >= 200 THEN ',upper:Completed' ELSE ',upper:Failed:too short' END || ',size:Completed' AS steps FROM documents""")
def processors_continue(s, d):
    return _processed(s, d, "continue")


def _processed(s, d, on_failure):
    steps = [
        processors.Processor("trim", lambda t: {"text": F.trim("text")}, lambda t: F.when(F.col("lang") == "de", "not in German")),
        processors.Processor("upper", lambda t: {"text": F.translate("text", _SMALL, _SMALL.upper())}, lambda t: F.when(F.coalesce(F.length("text"), F.lit(0)) < 200, "too short")),
        processors.Processor("size", lambda t: {"size": F.length("text")}),
    ]
    done = processors.process(_t(s, d, "documents").select("doc_id", "lang", "text"), steps, on_failure)
    return done.select("doc_id", "text", "size", F.array_join(F.transform("steps", lambda x: F.concat_ws(":", x["id"], x["status"], x["message"])), ",").alias("steps"))
