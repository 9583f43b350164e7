"""Documents as rows: chunks, hashes, token estimates, sections, search and text functions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_estimate(text: Column) -> Column:
    """0 for an empty text, else a token for each four characters begun, one at least."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4))).cast("long")


def chunks(df: DataFrame, key: str, text: str, max_chars: int = 8000) -> DataFrame:
    """Chunks of fixed size (256 characters at least): key, chunk_index, chunk_id, start_line, text, chunk_hash, tokens. Line ends become \\n; an empty text is one empty chunk."""
    width = max(256, max_chars)
    plain = df.select(F.col(key), F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n").alias("_t"))
    # each text is cut and its line feeds are counted once
    bodies = F.when(F.length("_t") == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all("_t", F.lit(f"(?s).{{1,{width}}}"), F.lit(0)))
    cut = plain.select(F.col(key), bodies.alias("_b")).withColumn("_f", F.transform("_b", lambda b: F.length(b) - F.length(F.replace(b, F.lit("\n"), F.lit("")))))
    parts = cut.select(F.col(key), F.posexplode(F.transform("_b", lambda b, i: F.struct(b.alias("text"), (F.aggregate(F.slice("_f", F.lit(1), i), F.lit(1), lambda s, n: s + n)).alias("line")))).alias("chunk_index", "x"))
    out = parts.select(key, F.col("chunk_index").cast("long").alias("chunk_index"), F.format_string("text:%s:%04d", F.col(key).cast("string"), F.col("chunk_index")).alias("chunk_id"), F.col("x.line").cast("long").alias("start_line"), "x.text")
    return out.withColumn("chunk_hash", F.sha2("text", 256)).withColumn("tokens", token_estimate(F.col("text")))


def source_id(key: Column) -> Column:
    return F.concat(F.lit("src:"), F.sha2(key.cast("string"), 256))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def unique_slugs(df: DataFrame, key: str, text: str) -> DataFrame:
    """The slug, with -1, -2, ... from its second use on, in order of the key."""
    n = F.row_number().over(Window.partitionBy("_s").orderBy(key)) - 1
    return df.withColumn("_s", slug(F.col(text))).withColumn("slug", F.when(n == 0, F.col("_s")).otherwise(F.concat("_s", F.lit("-"), n.cast("string")))).drop("_s")


def plain_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\p{Cntrl}]+", " "))


def folded(text: str) -> str:
    """In upper case, letter by letter: a letter whose upper case is of several letters, such as ß, has its title case or itself."""
    one = lambda c: "ẞ" if c == "ß" else next((x for x in (c.upper(), c.title()) if len(x) == 1), c)
    return "".join(map(one, text))


@cache
def _spellings() -> dict[str, list[int]]:
    """By folded letter, the code points of the letters that fold to it. Letters with cases lie in the first two planes."""
    out: dict[str, list[int]] = {}
    for code in range(0x20000):
        if not 0xD800 <= code < 0xE000:
            out.setdefault(folded(chr(code)), []).append(code)
    return out


def in_any_case(term: str) -> str:
    """A regular expression for a folded term in any case, which matches as many letters as the term has."""
    return "".join("[" + "".join(f"\\x{{{code:X}}}" for code in _spellings().get(c, [ord(c)])) + "]" for c in term)


def search(df: DataFrame, fields: list[str], terms: list[str], match_all: bool = False, width: int = 60) -> DataFrame:
    """Rows where any term (or each, in whatever fields) occurs, ignoring case, with a snippet of the first field around the earliest term. Case is of single letters, so that places are those of the text itself."""
    wanted = list(dict.fromkeys(folded(t.strip()) for t in terms if t.strip()))
    if not 1 <= len(wanted) <= 32:
        raise ValueError("1 to 32 terms")
    found = [in_any_case(t) for t in wanted]
    either = "|".join(found)
    in_any = lambda pattern: F.greatest(F.lit(False), *(F.coalesce(F.rlike(f, F.lit(pattern)), F.lit(False)) for f in fields))
    keep = in_any(either)
    if match_all:
        keep = in_any(found[0])
        for pattern in found[1:]:
            keep = keep & in_any(pattern)
    first = F.when(F.rlike(fields[0], F.lit(either)), F.length(F.regexp_extract(fields[0], f"(?s)^(.*?)(?:{either})", 1)) + 1)
    start = F.greatest(F.lit(1), F.coalesce(first, F.lit(1)) - width // 2)
    body = F.col(fields[0]).substr(start, F.lit(width))
    return df.where(keep).withColumn("snippet", F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(F.length(fields[0]) >= start + width, "…").otherwise("")))


def sections(df: DataFrame, document: str, order: str, is_heading: Column) -> DataFrame:
    """Adds section: the number of headings up to the row, 0 before the first."""
    return df.withColumn("section", F.sum(is_heading.cast("long")).over(Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def table_text(header: Column, rows: Column) -> Column:
    """Header and rows (an array of arrays) as lines of cells joined by ` | `."""
    return F.array_join(F.concat(F.array(F.array_join(header, " | ", "")), F.transform(rows, lambda r: F.array_join(r, " | ", ""))), "\n")


def heading_path(parts: Column) -> Column:
    kept = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    return F.array_join(F.transform(kept, lambda p: F.replace(F.replace(p, F.lit("\\"), F.lit("\\\\")), F.lit(">"), F.lit("\\>"))), " > ")


def kind_by_extension(path: Column, kinds: dict[str, str]) -> Column:
    """The kind by the path's extension, `unknown` for any other."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), extension), F.lit("unknown"))
