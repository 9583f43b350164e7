"""Texts that are lists: notebooks of cells, subtitles of cues, and records in chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _text(v: Column) -> Column:
    """A text, or an array of its lines, in JSON."""
    lines = F.from_json(v, "array<string>")
    return F.when(F.startswith(F.ltrim(v), F.lit("[")), F.array_join(lines, "")).otherwise(F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v"))


def notebook_cells(df: DataFrame, key: str, notebook: str, *, most_outputs: int = 8) -> DataFrame:
    """Cells of notebooks in JSON: key, cell (from 0), kind (markdown, code, raw), source, outputs (texts of the first `most_outputs`) and n_outputs. Text that is no notebook has no rows."""
    shape = "array<struct<cell_type:string,source:variant,outputs:array<struct<text:variant,data:map<string,variant>,ename:string,evalue:string>>>>"
    parsed = F.from_json(F.get_json_object(notebook, "$.cells"), shape)
    each = df.select(F.col(key).alias(key), F.posexplode(parsed).alias("cell", "c")).where("c is not null")

    def output(o: Column) -> Column:
        said = F.when(o["text"].isNotNull(), _text(F.to_json(o["text"])))
        plain = F.try_element_at(o["data"], F.lit("text/plain"))
        failed = F.when(o["ename"].isNotNull(), F.concat(o["ename"], F.lit(": "), F.coalesce(o["evalue"], F.lit(""))))
        return F.coalesce(said, F.when(plain.isNotNull(), _text(F.to_json(plain))), failed, F.lit(""))

    n = F.coalesce(F.size("c.outputs"), F.lit(0))
    outputs = F.transform(F.slice(F.coalesce("c.outputs", F.array()), F.lit(1), F.lit(most_outputs)), output)
    return each.select(key, F.col("cell").cast("long").alias("cell"), F.col("c.cell_type").alias("kind"), F.coalesce(_text(F.to_json("c.source")), F.lit("")).alias("source"), outputs.alias("outputs"), F.greatest(n, F.lit(0)).cast("long").alias("n_outputs"))


def subtitle_cues(df: DataFrame, key: str, text: str) -> DataFrame:
    """Cues of subtitles (numbered blocks, or those of a WEBVTT text): key, cue (from 0, by place), start_ms, end_ms and text without markup. Blocks without a line of times are no cues."""
    even = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "^\uFEFF", ""), r"\r\n?", "\n")
    time = r"(?:(\d+):)?(\d{1,2}):(\d{2})[,.](\d{3})"
    line = rf"(?m)^[ \t]*{time}[ \t]*-->[ \t]*{time}(?:[ \t][^\n]*)?$"
    blocks = F.filter(F.split(even, r"\n(?:[ \t]*\n)+"), lambda b: b.rlike(line))
    each = df.select(F.col(key).alias(key), F.posexplode(blocks).alias("cue", "b"))
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract("b", line, k), F.lit("")).cast("long"), F.lit(0))
    ms = lambda k: ((part(k) * 60 + part(k + 1)) * 60 + part(k + 2)) * 1000 + part(k + 3)
    said = F.regexp_replace("b", r"(?s)\A.*?-->[^\n]*(?:\n|\z)", "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(said, r"<[^<>]*>|\{\\[^{}]*\}", ""), r"[ \t]+", " "))
    return each.select(key, F.col("cue").cast("long").alias("cue"), ms(1).alias("start_ms"), ms(5).alias("end_ms"), bare.alias("text"))


def record_chunks(found: DataFrame, size: int = 200, *, header: bool = True) -> DataFrame:
    """Records of delimited files in chunks of `size`: file, chunk (from 0), first_record, start_line, end_line, n_rows, columns, and text (lines of cells joined by ` | `, the header first). With a header the first record of a file names the columns."""
    top = found.where("record_number = 1").select(F.col("file").alias("_f"), F.col("fields").alias("columns")) if header else None
    body = found.where("record_number > 1") if header else found
    at = F.floor((F.col("record_number") - (2 if header else 1)) / size).cast("long")
    cells = F.array_join(F.transform("fields", lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")), " | ")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("record_number", cells.alias("x")))), lambda r: r["x"])
    made = body.groupBy("file", at.alias("chunk")).agg(F.min("record_number").alias("first_record"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("n_rows"), F.array_join(lines, "\n").alias("text"))
    if not header:
        return made.withColumn("columns", F.array().cast("array<string>"))
    joined = made.join(top, F.col("file") == F.col("_f")).drop("_f")
    return joined.withColumn("text", F.concat(F.array_join("columns", " | "), F.lit("\n"), "text"))


def first_rows(rows: Column, most: int) -> Column:
    """A table's rows cut to the first `most`: rows, total and truncated."""
    return F.struct(F.slice(rows, F.lit(1), F.lit(most)).alias("rows"), F.size(rows).alias("total"), (F.size(rows) > most).alias("truncated"))


def page_text(df: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """A document's pages as one text: each behind a mark `<!-- page N -->`, in order, blank ones left out."""
    kept = df.where(F.col(text).rlike(r"\S"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.concat(F.lit("<!-- page "), F.col(page).cast("string"), F.lit(" -->\n"), F.regexp_replace(F.col(text), r"^\s+|\s+$", "")).alias("t"))))
    return kept.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("text"), F.count("*").alias("n_pages"))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """A template's marks {{Name}} and {{Name:format}} as the values' texts, names in any case; a format is a pattern of numbers (0.00) or of times (yyyy-MM-dd). Marks of other names stay, nulls are empty; marks within values are not filled."""
    mark = r"\{\{\s*([A-Za-z_][A-Za-z0-9_.]*)\s*(?::([^{}]*))?\}\}"
    parts = F.regexp_extract_all(template, F.lit(rf"(?s){mark}|\{{\{{|(?:(?!\{{\{{).)++"), F.lit(0))

    def one(p: Column) -> Column:
        name, pattern = F.lower(F.regexp_extract(p, f"^{mark}$", 1)), F.trim(F.regexp_extract(p, f"^{mark}$", 2))
        out = p
        for n, v in values.items():
            text = v.cast("string")
            number, time = text.try_cast("double"), text.try_cast("timestamp")
            shaped = (
                F.when(pattern.rlike(r"^[#,]*0+(?:\.[0#]+)?%?$") & number.isNotNull(), F.call_function("format_number", number, pattern))
                .when(pattern.rlike("^[yMdHhmsSaE /:.,T-]+$") & time.isNotNull(), F.call_function("date_format", time, pattern)).otherwise(text)
            )
            out = F.when(name == n.lower(), F.coalesce(shaped, F.lit(""))).otherwise(out)
        return out

    return F.array_join(F.transform(parts, one), "")
