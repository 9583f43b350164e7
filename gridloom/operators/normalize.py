"""Blocks, links and tables of documents in one form; tables as text; counts, scores and guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, WHITE, "")


def blocks(df: DataFrame) -> DataFrame:
    """Blocks (kind, text, level, marker): text and marker trimmed, kind in lower case, levels of headings from 1 to 6, those of lists 1 at least."""
    kind = F.lower(trimmed(F.coalesce("kind", F.lit(""))))
    level = F.when(kind == "heading", F.greatest(F.lit(1), F.least(F.lit(6), "level"))).when(F.contains(kind, F.lit("list")), F.greatest(F.lit(1), "level")).otherwise(F.col("level"))
    found = {"kind": kind, "text": trimmed(F.coalesce("text", F.lit(""))), "level": F.when(F.col("level").isNotNull(), level)}
    return df.withColumns(found | ({"marker": trimmed(F.col("marker"))} if "marker" in df.columns else {}))


def links(df: DataFrame, ids: tuple[str, ...] = ("id", "target", "text")) -> DataFrame:
    """Links: the named columns trimmed, with null for blank, kind in lower case."""
    blank = lambda c: F.nullif(trimmed(F.col(c)), F.lit(""))
    return df.withColumns({c: blank(c) for c in ids if c in df.columns} | ({"kind": F.lower(blank("kind"))} if "kind" in df.columns else {}))


def table(columns: Column, rows: Column, *, trim: bool = True, fill: bool = True, rectangular: bool = True) -> Column:
    """A table of one width, the widest row's or the header's: columns, rows, total and profiles (name, non_empty, numeric, kind). Cells are trimmed, nulls are empty, names that are missing are Column1, ... by position."""
    plain = lambda c: (trimmed(c) if trim else c)
    head, body = F.coalesce(columns, F.array().cast("array<string>")), F.coalesce(rows, F.array().cast("array<array<string>>"))
    width = F.greatest(F.size(head), F.coalesce(F.array_max(F.transform(body, lambda r: F.coalesce(F.size(r), F.lit(0)))), F.lit(0)))
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda i: i < n)
    named = F.transform(upto(width), lambda i: plain(F.coalesce(F.get(head, i), F.lit(""))))
    names = F.transform(named, lambda v, i: F.when(v == "", F.concat(F.lit("Column"), (i + 1).cast("string"))).otherwise(v)) if fill else named
    cells = F.transform(body, lambda r: F.transform(upto(width if rectangular else F.greatest(F.coalesce(F.size(r), F.lit(0)), F.lit(0))), lambda i: plain(F.coalesce(F.get(r, i), F.lit("")))))

    def profile(i: Column, name: Column) -> Column:
        values = F.transform(cells, lambda r: F.trim(F.coalesce(F.get(r, i), F.lit(""))))
        full, numbers = F.size(F.filter(values, lambda v: v != "")), F.size(F.filter(values, lambda v: v.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$")))
        kind = F.when(full == 0, "Empty").when(numbers == full, "Numeric").when(numbers == 0, "Text").otherwise("Mixed")
        return F.struct(name.alias("name"), full.alias("non_empty"), numbers.alias("numeric"), kind.alias("kind"))

    return F.struct(names.alias("columns"), cells.alias("rows"), F.size(cells).alias("total"), F.transform(upto(width), lambda i: profile(i, F.get(names, i))).alias("profiles"))


def bundle(columns: Column, rows: Column) -> Column:
    """A table as CSV, as a Markdown table and as JSON (an array of objects, names as they are)."""
    quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = lambda r: F.array_join(F.transform(r, quoted), ",")
    bar = lambda c: F.replace(F.replace(F.regexp_replace(c, r"\r?\n", "<br>"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    piped = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, bar), " | "), F.lit(" |"))
    body = F.transform(rows, lambda r: F.to_json(F.map_from_arrays(columns, r)))
    return F.struct(
        F.array_join(F.concat(F.array(line(columns)), F.transform(rows, line)), "\n").alias("csv"),
        F.array_join(F.concat(F.array(piped(columns), piped(F.transform(columns, lambda _: F.lit("---")))), F.transform(rows, piped)), "\n").alias("markdown"),
        F.concat(F.lit("["), F.array_join(body, ","), F.lit("]")).alias("json"))


def counts(parts: dict[str, DataFrame]) -> DataFrame:
    """How many rows each part has: name and count, also of parts without a row."""
    each = [df.agg(F.count("*").alias("count")).select(F.lit(name).alias("name"), "count") for name, df in parts.items()]
    return reduce(DataFrame.unionByName, each)


def round_trip_score(source: DataFrame, target: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """How far a table comes back: per metric, and over all (metric null), compared (cells that either side has), matched (equal ones) and score; an empty comparison scores 1."""
    side = lambda df, n: df.select(F.col(key).alias("_k"), F.struct(*(F.col(m).cast("string").alias(m) for m in metrics)).alias(n))
    both = side(source, "s").join(side(target, "t"), F.lit(False) if not metrics else "_k", "full_outer")
    cell = lambda m: F.struct(F.lit(m).alias("metric"), (F.col(f"s.`{m}`").isNotNull() | F.col(f"t.`{m}`").isNotNull()).alias("has"), (F.col(f"s.`{m}`") == F.col(f"t.`{m}`")).alias("same"))
    found = both.select(F.explode(F.array(*map(cell, metrics))).alias("x")).select("x.*")
    out = found.rollup("metric").agg(F.count_if("has").alias("compared"), F.count_if("same").alias("matched"))
    return out.withColumn("score", F.when(F.col("compared") == 0, 1.0).otherwise(F.round(F.col("matched") / F.col("compared"), 6)))


def guard(content: Column, *, most_bytes: int | None = None, most_chars: int | None = None, most_lines: int | None = None, controls: bool = False) -> Column:
    """Why a text is refused: too-many-bytes, too-many-characters, too-many-lines or control-characters; null for a text that is fine, and for null."""
    rules = []
    if most_bytes is not None:
        rules.append(F.when(F.octet_length(content) > most_bytes, "too-many-bytes"))
    if most_chars is not None:
        rules.append(F.when(F.length(content) > most_chars, "too-many-characters"))
    if most_lines is not None:
        rules.append(F.when(F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) >= most_lines, "too-many-lines"))
    if not controls:
        rules.append(F.when(content.rlike(r"[\x00-\x08\x0E-\x1F\x7F]"), "control-characters"))
    return F.coalesce(*rules, F.lit(None).cast("string"))


def phrase_hits(df: DataFrame, key: str, place: str, text: str, phrase: str, *, width: int = 60) -> DataFrame:
    """Every place where a phrase stands in blocks, in any case and with any white space between its words: key, place, offset (of the match, from 0), found (the text as it stands) and snippet."""
    words = [w for w in phrase.split() if w]
    if not words:
        raise ValueError("a phrase has a word")
    import re

    pattern = "(?iu)" + r"\s+".join(f"\\Q{w}\\E" if "\\E" not in w else re.escape(w) for w in words)
    # what stands between the matches tells where they begin
    between, hits = F.split(F.col(text), pattern, -1), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    found = df.where(F.col(text).rlike(pattern)).select(F.col(key).alias(key), F.col(place).alias("place"), F.col(text).alias("_t"), between.alias("_b"), hits.alias("_h"))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    steps = F.aggregate(F.arrays_zip(F.slice("_b", F.lit(1), F.size("_h")), "_h"), state, lambda s, x: F.struct((s["at"] + F.length(x["0"]) + F.length(x["_h"])).alias("at"), F.concat(s["all"], F.array(s["at"] + F.length(x["0"]))).alias("all")), lambda s: s["all"])
    each = found.withColumn("_o", steps).select(key, "place", "_t", F.explode(F.arrays_zip("_o", "_h")).alias("x"))
    start = F.greatest(F.lit(1), F.col("x._o") + 1 - width // 2)
    body = F.col("_t").substr(start, F.lit(width))
    snippet = F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(F.length("_t") >= start + width, "…").otherwise(""))
    return each.select(key, "place", F.col("x._o").cast("long").alias("offset"), F.col("x._h").alias("found"), snippet.alias("snippet"))
