"""Markdown texts: lines, front matter, headings with anchors and paths, pipe tables and sections.

Lines are rows of their document's window, which carries what is open (code, a
heading of each level) from line to line. Only the fences of code, of which the
end depends on how the last one began, are folded within their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import documents

#: Lines that begin or end fenced code, and headings: up to three spaces, one to six #, then a space or nothing.
FENCE, HEADING = r"^ {0,3}(`{3,}|~{3,})(.*)$", r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$"
#: The block of front matter, with its fences.
FRONT = r"^\uFEFF?---[ \t]*\n(?:(?s:.*?)\n)??(?:---|\.\.\.)[ \t]*(?:\n|\z)"


def _even(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")


def _walk(ls: Column) -> Column:
    """The lines that look like fences: at (from 0), and open, the fence that is open behind each or an empty text. A fence ends with one of its kind that is as long and has nothing behind it."""
    marks = F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("at"), F.regexp_extract(x, FENCE, 1).alias("mark"), F.trim(F.regexp_extract(x, FENCE, 2)).alias("more"))), lambda x: x["mark"] != "")

    def step(s: Column, x: Column) -> Column:
        opens = ~(F.startswith(x["mark"], F.lit("`")) & F.contains(x["more"], F.lit("`")))
        closes = F.startswith(x["mark"], s["now"]) & (x["more"] == "")
        now = F.when(s["now"] == "", F.when(opens, x["mark"]).otherwise("")).otherwise(F.when(closes, "").otherwise(s["now"]))
        return F.struct(now.alias("now"), F.concat(s["at"], F.array(x["at"])).alias("at"), F.concat(s["open"], F.array(now)).alias("open"))

    none = F.struct(F.lit("").alias("now"), F.array().cast("array<int>").alias("at"), F.array().cast("array<string>").alias("open"))
    return F.aggregate(marks, none, step)


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every line as a row: key, line (from 1), text, code (within fenced code, or a fence) and front (in the front matter). Keys are unique."""
    split = df.select(F.col(key).alias(key), F.split(_even(F.col(text)), "\n").alias("_l"), front_lines(F.col(text)).alias("_n"))
    # what stands in the front matter is no fence
    walked = split.withColumn("_w", _walk(F.transform("_l", lambda x, i: F.when(i < F.col("_n"), "").otherwise(x))))
    opened = lambda x, i: F.when(x.rlike(FENCE), F.get("_w.open", F.array_position("_w.at", i).cast("int") - 1))
    each = walked.select(key, "_n", F.posexplode(F.transform("_l", lambda x, i: F.struct(x.alias("text"), opened(x, i).alias("open")))).alias("_i", "x"))
    w = Window.partitionBy(key).orderBy("_i")
    behind = F.coalesce(F.last("x.open", ignorenulls=True).over(w), F.lit(""))
    before = F.coalesce(F.last("x.open", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(""))
    return each.select(key, (F.col("_i") + 1).cast("long").alias("line"), F.col("x.text").alias("text"), ((behind != "") | (before != "")).alias("code"), (F.col("_i") < F.col("_n")).alias("front"))


def front_lines(text: Column) -> Column:
    """The number of lines of the front matter, 0 where there is none."""
    block = F.regexp_extract(_even(text), FRONT, 0)
    return F.when(block == "", 0).otherwise(F.size(F.split(F.regexp_replace(block, r"\n\z", ""), "\n")))


def front_matter(text: Column) -> Column:
    """The keys of the block between two lines --- at the very top as a map: `key: value` lines, in quotes or not; the first of a repeated key counts; null where there is no such block."""
    block = F.regexp_extract(_even(text), FRONT, 0)
    inner = F.split(F.regexp_replace(block, r"^\uFEFF?---[ \t]*\n|(?:---|\.\.\.)[ \t]*\n?\z", ""), "\n")
    pattern = r"^([A-Za-z0-9_][A-Za-z0-9_ .-]*?)[ \t]*:(?:[ \t]+(.*?))?[ \t]*$"
    pairs = F.transform(F.filter(inner, lambda x: x.rlike(pattern)), lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("k"), F.regexp_replace(F.regexp_extract(x, pattern, 2), "^([\"'])(.*)\\1$", "$2").alias("v")))
    none = F.array().cast("array<struct<k:string,v:string>>")
    first = F.aggregate(pairs, none, lambda s, x: F.when(F.exists(s, lambda y: y["k"] == x["k"]), s).otherwise(F.concat(s, F.array(x))))
    return F.when(block != "", F.map_from_entries(first))


def _headed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines with level and title where they are headings, and path: the titles of the headings that a line is under, its own last; section and parent."""
    marked = lines(df, key, text).withColumn("_h", ~F.col("code") & ~F.col("front") & F.col("text").rlike(HEADING))
    titled = marked.withColumns({"level": F.when(F.col("_h"), F.length(F.regexp_extract("text", HEADING, 1))), "title": F.when(F.col("_h"), F.trim(F.regexp_extract("text", HEADING, 2)))}).drop("_h")
    w = Window.partitionBy(key).orderBy("line")
    numbered = titled.withColumn("section", F.count("level").over(w))
    # of each level, the last heading that is not deeper: it holds where it is of that very level
    last = {f"_{k}": F.last(F.when(F.col("level") <= k, F.struct("level", "title", "section")), ignorenulls=True).over(w) for k in range(1, 7)}
    above = F.array_compact(F.array(*(F.when(F.col(f"_{k}.level") == k, F.col(f"_{k}")) for k in range(1, 7))))
    held = numbered.withColumns(last).withColumn("_p", above).drop(*last)
    return held.withColumns({"path": F.transform("_p", lambda x: x["title"]), "parent": F.when(F.size("_p") > 1, F.get("_p", F.size("_p") - 2)["section"])}).drop("_p")


def headings(df: DataFrame, key: str, text: str) -> DataFrame:
    """The heading catalog: key, index (from 0), line, level, title, path and anchor (its slug, with -1, -2, ... where another has it).

    A # within fenced code or front matter is no heading. Keys are unique.
    """
    found = _headed(df, key, text).where("level is not null")
    slug = F.coalesce(F.nullif(documents.slug(F.col("title")), F.lit("")), F.lit("section"))
    listed = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "level", "title", "path", slug.alias("slug")))).alias("h"))
    anchored = listed.withColumn("a", _anchors(F.transform("h", lambda x: x["slug"])))
    each = anchored.select(key, F.posexplode(F.arrays_zip("h", "a")).alias("index", "x"))
    return each.select(key, F.col("index").cast("long").alias("index"), "x.h.line", "x.h.level", "x.h.title", "x.h.path", F.col("x.a").alias("anchor"))


def _anchors(slugs: Column) -> Column:
    """Slugs made unique in order: a slug that is taken gets the least number that makes it free."""

    def step(s: Column, x: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(s) + 1), lambda k: F.concat(x, F.lit("-"), k.cast("string")))
        free = F.when(F.array_contains(s, x), F.array_except(tries, s)[0]).otherwise(x)
        return F.concat(s, F.array(free))

    return F.aggregate(slugs, F.array().cast("array<string>"), step)


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """A text by its headings: key, section (0 before the first heading), start_line, end_line, level, title, path, parent (the section of the heading above it) and text (its lines, with the heading's). Nothing but blank lines before the first heading is no section."""
    own = F.array_sort(F.collect_list(F.struct("line", "text")))
    found = _headed(df, key, text).where("not front").groupBy(key, "section").agg(
        F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.max("level").alias("level"), F.max("title").alias("title"), F.max("path").alias("path"), F.max("parent").alias("parent"), F.array_join(F.transform(own, lambda x: x["text"]), "\n").alias("text"))
    return found.where((F.col("section") > 0) | F.col("text").rlike(r"\S"))


def cells(line: Column) -> Column:
    """The cells of a row of a pipe table, trimmed, without the outer pipes; \\| is a pipe in a cell; empty where the line has no pipe."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"(?<!\\)\|$", "")
    split = F.transform(F.split(bare, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))
    return F.when(line.rlike(r"(?<!\\)\|"), split).otherwise(F.array().cast("array<string>"))


def tables(df: DataFrame, key: str, text: str, *, headerless: bool = False) -> DataFrame:
    """Pipe tables: key, table (from 0), start_line, end_line, columns and rows (arrays of cells).

    A header, a line of as many cells of three dashes or more (with : at the ends),
    and rows up to the first line without a pipe. Rows have as many cells as the
    header: others are filled with empty ones or cut; a header's blank cells
    are Column1, Column2, ... by position. headerless: two or more lines of as many
    cells, the first bounded by pipes, without a line of dashes are a table
    too, with such names. Tables in fenced code do not count. Keys are unique.
    """
    w = Window.partitionBy(key).orderBy("line")
    piped = lines(df, key, text).where(~F.col("code") & ~F.col("front") & F.col("text").rlike(r"(?<!\\)\|")).select(key, "line", "text", cells(F.col("text")).alias("c"))
    # lines with pipes that follow each other make an island; a table begins within it and goes to its end
    island = piped.withColumn("_n", F.col("line") - F.row_number().over(w)).groupBy(key, "_n").agg(F.array_sort(F.collect_list(F.struct("line", "c", "text"))).alias("x"))
    dashes = lambda c: F.forall(c, lambda v: v.rlike("^:*-{3,}:*$"))
    at = F.filter(F.sequence(F.lit(0), F.size("x") - 2), lambda i: (F.size(F.get("x", i)["c"]) == F.size(F.get("x", i + 1)["c"])) & dashes(F.get("x", i + 1)["c"]))
    found = island.where("size(x) >= 2").withColumn("_at", F.get(at, F.lit(0)))
    named = lambda c: F.transform(c, lambda v, i: F.when(v == "", F.concat(F.lit("Column"), (i + 1).cast("string"))).otherwise(v))

    def table(first: Column, columns: Column, skipped: int) -> list[Column]:
        body = F.slice("x", first + skipped + 1, F.size("x"))
        n = F.size(columns)
        even = F.transform(body, lambda r: F.slice(F.concat(r["c"], F.array_repeat(F.lit(""), n)), F.lit(1), n))
        return [F.get("x", first)["line"].alias("start_line"), F.element_at("x", -1)["line"].alias("end_line"), columns.alias("columns"), even.alias("rows")]

    out = found.where("_at is not null").select(key, *table(F.col("_at"), named(F.get("x", F.col("_at"))["c"]), 2))
    if headerless:
        width = F.size(F.get("x", F.lit(0))["c"])
        bounded = F.trim(F.get("x", F.lit(0))["text"]).rlike(r"^\|.*\|$")
        numbered = F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("Column"), i.cast("string")))
        bare = found.where("_at is null").where(bounded & F.forall("x", lambda r: F.size(r["c"]) == width))
        out = out.unionByName(bare.select(key, *table(F.lit(0), numbered, 0)))
    return out.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("start_line")) - 1).cast("long").alias("table"), "start_line", "end_line", "columns", "rows")


def rewrite(df: DataFrame, key: str, text: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Texts after rules (id, pattern, replacement) on each line outside code and front matter, one rule after another: key, text, and changes, a map of the lines that each rule has changed. Line ends become line feeds."""
    if len({r[0] for r in rules}) < len(rules):
        raise ValueError("rules need unique ids")
    out = lines(df, key, text).withColumn("_on", ~F.col("code") & ~F.col("front"))
    for k, (_, pattern, replacement) in enumerate(rules):
        new = F.when(F.col("_on"), F.regexp_replace("text", pattern, replacement)).otherwise(F.col("text"))
        out = out.withColumn("_new", new).withColumn(f"_c{k}", F.col("_new") != F.col("text")).withColumn("text", F.col("_new"))
    own = F.array_sort(F.collect_list(F.struct("line", "text")))
    counted = [x for k, (name, _, _) in enumerate(rules) for x in (F.lit(name), F.count_if(f"_c{k}"))]
    changes = F.create_map(*counted) if counted else F.create_map().cast("map<string,bigint>")
    return out.groupBy(key).agg(F.array_join(F.transform(own, lambda x: x["text"]), "\n").alias("text"), changes.alias("changes"))


def structured(df: DataFrame, key: str, text: str, *, most_sections: int = 1000, most_chars: int = 1_000_000) -> DataFrame:
    """Documents as JSON: key and document, an object of front matter, sections (id section-0000, ..., level, title, path, lines, text), tables (columns, rows, lines) and truncated. Sections beyond `most_sections` are left out, and texts cut where all of a document's together reach `most_chars`."""
    parts = sections(df, key, text)
    w = Window.partitionBy(key).orderBy("section")
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumns({"_n": F.row_number().over(w) - 1, "_left": F.greatest(F.lit(0), most_chars - before)})
    cut = placed.withColumns({"_cut": (F.col("_n") >= most_sections) | (F.length("text") > F.col("_left")), "text": F.left("text", F.col("_left").cast("int"))})
    one = F.struct(F.format_string("section-%04d", "_n").alias("id"), "level", "title", "path", "start_line", "end_line", "text")
    listed = cut.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("_n") < most_sections, F.struct("_n", one.alias("s"))))).alias("_s"), F.max("_cut").alias("truncated"))
    found = tables(df, key, text).groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct("table", "start_line", "end_line", "columns", "rows"))).alias("_t"))
    heads = df.select(F.col(key).alias("_h"), front_matter(F.col(text)).alias("front_matter"))
    joined = heads.join(listed, F.col("_h") == F.col(key), "left").join(found, F.col("_h") == F.col("_k"), "left")
    none = F.array().cast(found.schema["_t"].dataType)
    body = F.struct("front_matter", F.coalesce(F.transform("_s", lambda x: x["s"]), F.array().cast(listed.select(F.transform("_s", lambda x: x["s"]).alias("s")).schema["s"].dataType)).alias("sections"), F.coalesce("_t", none).alias("tables"), F.coalesce("truncated", F.lit(False)).alias("truncated"))
    return joined.select(F.col("_h").alias(key), F.to_json(body).alias("document"))
