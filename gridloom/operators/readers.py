"""Files of several kinds as chunks of one shape: each kind has its reader, and each file its outcome."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import kinds
from . import cells, documents, graph, markdown, markup, normalize

#: What a reader returns besides the file's key.
SHAPE = "ordinal long, location string, title string, text string"
Reader = Callable[[DataFrame], DataFrame]


def _shape(df: DataFrame, ordinal, location, title, text) -> DataFrame:
    return df.select("key", F.col(ordinal).cast("long").alias("ordinal"), location.cast("string").alias("location"), title.cast("string").alias("title"), text.alias("text"))


def read_markdown(files: DataFrame) -> DataFrame:
    found = markdown.sections(files, "key", "text")
    return _shape(found, "section", F.concat(F.lit("line "), F.col("start_line").cast("string")), documents.heading_path(F.col("path")), F.col("text"))


def read_html(files: DataFrame) -> DataFrame:
    found = markup.html_sections(files, "key", "text")
    return _shape(found, "section", F.concat(F.lit("section "), F.col("section").cast("string")), documents.heading_path(F.col("path")), F.col("text"))


def read_xml(files: DataFrame) -> DataFrame:
    found = markup.xml_rows(files, "key", "text")
    listed = found.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "type", "value"))), lambda x: F.concat_ws(" | ", x["path"], x["type"], x["value"])), "\n").alias("text"))
    return _shape(listed.withColumn("ordinal", F.lit(0)), "ordinal", F.lit("line 1"), F.lit(None), F.col("text"))


def read_notebook(files: DataFrame) -> DataFrame:
    found = cells.notebook_cells(files, "key", "text")
    return _shape(found, "cell", F.concat(F.lit("cell "), F.col("cell").cast("string")), F.col("kind"), F.array_join(F.concat(F.array("source"), F.col("outputs")), "\n"))


def read_subtitles(files: DataFrame) -> DataFrame:
    found = cells.subtitle_cues(files, "key", "text")
    return _shape(found, "cue", F.concat(F.col("start_ms").cast("string"), F.lit(" ms")), F.lit(None), F.col("text"))


def read_text(files: DataFrame) -> DataFrame:
    found = documents.chunks(files, "key", "text")
    return _shape(found, "chunk_index", F.concat(F.lit("line "), F.col("start_line").cast("string")), F.lit(None), F.col("text"))


class Readers:
    """Readers by kind. A kind that has one is replaced only if that is said."""

    def __init__(self) -> None:
        self.by_kind: dict[str, Reader] = {"Markdown": read_markdown, "Html": read_html, "Xml": read_xml, "Notebook": read_notebook, "Subtitle": read_subtitles, "Text": read_text, "Csv": read_text, "Json": read_text}

    def register(self, kind: str, reader: Reader, *, replace: bool = False) -> Readers:
        if kind in self.by_kind and not replace:
            raise ValueError(f"there is a reader of {kind}")
        self.by_kind[kind] = reader
        return self

    def read(self, files: DataFrame, name: str, content: str, *, mode: str = "prefer_content", most_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(chunks: key, kind, ordinal, location, title, text; outcomes: key, kind, status, message, n_chunks).

        `name` is unique, `content` binary. Every file has an outcome: Read, Empty (it
        has no chunk), Refused (too large, or no UTF-8 text) or Unsupported (no
        reader of its kind). Each reader sees the files of its kind only.
        """
        told = kinds.detect(files.select(F.col(name).alias("key"), F.col(content).alias("_file")), "key", "_file", mode)
        text = F.regexp_replace(F.try_validate_utf8(F.coalesce(F.col("_file"), F.lit(b"")).cast("string")), "^\\x{FEFF}", "")
        known = F.col("kind").isin(list(self.by_kind))
        why = F.when(~known, F.concat(F.lit("no reader of "), "kind")).when(text.isNull(), "no UTF-8 text")
        refused = normalize.guard(F.col("_file"), most_bytes=most_bytes, controls=True) if most_bytes is not None else F.lit(None).cast("string")
        judged = told.select("key", "kind", F.coalesce(F.when(known, refused), why).alias("message"), known.alias("_known"), text.alias("text"))
        # written once, as each reader looks for the files of its kind
        judged = graph._written(judged)[0]
        fine = judged.where("message is null")
        read = [reader(fine.where(F.col("kind") == kind).select("key", "text")).select("key", F.lit(kind).alias("kind"), "ordinal", "location", "title", "text") for kind, reader in self.by_kind.items()]
        chunks = reduce(DataFrame.unionByName, read)
        n = chunks.groupBy(F.col("key").alias("_k")).agg(F.count("*").alias("n_chunks"))
        status = F.when(~F.col("_known"), "Unsupported").when(F.col("message").isNotNull(), "Refused").when(F.col("n_chunks") == 0, "Empty").otherwise("Read")
        outcomes = judged.join(n, F.col("key") == F.col("_k"), "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
        return chunks, outcomes.select("key", "kind", status.alias("status"), "message", "n_chunks")
