"""Column functions: coercions, date serials, names, addresses, durations and signals of instructions in text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases, by signal, that mark text as meant for a reading machine. Fixed values.
INSTRUCTION_SIGNALS = {
    "instruction-override": ["ignore previous", "ignore prior", "disregard previous", "override instructions", "forget previous"],
    "prompt-reference": ["system prompt", "developer prompt", "hidden prompt", "reveal prompt", "show prompt"],
    "model-addressing": ["language model", "llm", "ai assistant", "automated reviewer", "resume scanner", "cv scanner"],
    "decision-manipulation": ["approve candidate", "accept candidate", "reject other", "rank me", "highest score", "give me a score", "recommend this candidate", "shortlist this candidate"],
    "concealment-request": ["do not mention", "do not reveal", "hide this", "keep this secret", "without telling the user"],
    "tool-or-data-exfiltration": ["send the password", "send the token", "upload the secret", "exfiltrate", "forward the code", "retrieve the credential"],
    "instruction-directive": ["follow these instructions", "you must", "your task is", "when you summarize", "when you evaluate", "when assessing"],
}


def to_number(text: Column) -> Column:
    """Empty counts as 0, TRUE and FALSE as 1 and 0, numeric text as its number; other text is null."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    return F.when(plain == "", 0.0).when(F.upper(plain) == "TRUE", 1.0).when(F.upper(plain) == "FALSE", 0.0).when(plain.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))


def to_boolean(text: Column) -> Column:
    """A number is true where it is not 0; TRUE and FALSE are read in any case; other text is null."""
    return to_number(text) != 0


def date_serial(date: Column, system: int = 1900) -> Column:
    """Days of a date in the 1900 or 1904 date system. The 1900 system counts a 29 February 1900 that was none: days before 1 March 1900 are one less."""
    if system == 1904:
        return F.date_diff(date, F.lit("1904-01-01").cast("date"))
    days = F.date_diff(date, F.lit("1899-12-30").cast("date"))
    return F.when(days < 61, days - 1).otherwise(days)


def serial_date(serial: Column, system: int = 1900) -> Column:
    if system == 1904:
        return F.date_add(F.lit("1904-01-01").cast("date"), serial.cast("int"))
    return F.date_add(F.lit("1899-12-30").cast("date"), F.when(serial < 60, serial + 1).otherwise(serial).cast("int"))


def extension(name: Column) -> Column:
    """Lower case, without space around, with a dot before; empty for blank."""
    plain = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(plain == "", "").when(plain.startswith("."), plain).otherwise(F.concat(F.lit("."), plain))


def file_name(name: Column, default: str = "asset") -> Column:
    """Lower case, with runs of anything but ASCII letters, digits, - and _ as one -, and none at the ends."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9_-]+|-{2,}", "-"), r"^-+|-+$", "")
    return F.when(plain == "", default).otherwise(plain)


def url_kind(url: Column) -> Column:
    """script, data, file, mailto, web, other (a scheme of another kind), relative or empty. White space and control characters do not hide a scheme."""
    plain = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20]+", ""))
    scheme = F.regexp_extract(plain, r"^([a-z][a-z0-9+.-]*):", 1)
    return (
        F.when(plain == "", "empty").when(scheme.isin("javascript", "vbscript"), "script").when(scheme == "data", "data").when(scheme == "file", "file").when(scheme == "mailto", "mailto")
        .when(scheme.isin("http", "https"), "web").when(scheme != "", "other").otherwise("relative")
    )


def instruction_signals(text: Column, rules: dict[str, list[str]] = INSTRUCTION_SIGNALS) -> Column:
    """The names of the signals of which the text has a phrase, in any case: hidden characters count as nothing, then punctuation and white space as one space."""
    # of white space and punctuation a single space, the most of it, is left as it is
    seen = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0E-\x1F\x7F-\x84\x86-\x9F\p{Cf}]+", "")
    plain = F.lower(F.regexp_replace(seen, r"[\x09-\x0D\x85\p{Z}\p{P}]{2,}|[\x09-\x0D\x85\p{Z}\p{P}&&[^ ]]", " "))
    has = lambda t, phrases: reduce(lambda a, b: a | b, (t.contains(p) for p in phrases))
    named = lambda t: F.array_compact(F.array(*(F.when(has(t, phrases), F.lit(name)) for name, phrases in rules.items())))
    # the text is prepared once, not for each phrase
    return F.get(F.transform(F.array(plain), named), F.lit(0))


def iso_duration(text: Column) -> Column:
    """Seconds of a duration such as P2W, -P1DT2H, P1Y2M or PT5M30.5S, with years of 365 and months of 30 days; null where it is none. Whole seconds unless there is a fraction, which is cut at microseconds."""
    pattern = r"^([+-]?)P(?=.)(?:(\d+)W|(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?=.)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d+))?S)?)?)$"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("decimal(28,0)"), F.lit(0).cast("decimal(28,0)"))
    days = part(2) * 7 + part(3) * 365 + part(4) * 30 + part(5)
    fraction = F.concat(F.lit("0."), F.rpad(F.left(F.regexp_extract(text, pattern, 9), F.lit(6)), 6, "0")).cast("decimal(7,6)")
    seconds = (days * 86400 + part(6) * 3600 + part(7) * 60 + part(8) + fraction).cast("double")
    return F.when(text.rlike(pattern), F.when(F.regexp_extract(text, pattern, 1) == "-", -seconds).otherwise(seconds))


def allowed_url(url: Column, *, schemes: tuple[str, ...] = ("http", "https", "mailto"), relative: bool = True, data: tuple[str, ...] = (), hosts: tuple[str, ...] | None = None) -> Column:
    """Whether a policy lets an address through: by scheme, relative or not, data of media types (image/ for all of them), and hosts with what is below them. Scripts never pass, however they are spelled."""
    plain = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\u200B-\u200F\u2060\uFEFF]+", ""))
    kind, scheme = url_kind(plain), F.regexp_extract(plain, r"^([a-z][a-z0-9+.-]*):", 1)
    media = F.lit(False)
    for m in data:
        media = media | F.startswith(plain, F.lit(f"data:{m.lower()}"))
    host = F.regexp_extract(plain, r"^(?:[a-z][a-z0-9+.-]*:)?[/\\\\]{2}(?:[^/?#@]*@)?([^/?#:\\\\]*)", 1)
    near = F.lit(True)
    if hosts is not None:
        near = F.lit(False)
        for h in hosts:
            near = near | (host == h.lower()) | F.endswith(host, F.lit("." + h.lower()))
    # two slashes without a scheme name a host, too
    bare = F.when(plain.rlike(r"^[/\\\\]{2}"), near & F.lit(relative)).otherwise(F.lit(relative))
    return F.when(kind.isin("script", "empty"), False).when(kind == "relative", bare).when(kind == "data", media).otherwise(scheme.isin(list(schemes)) & (near | (kind == "mailto")))


def number_text(number: Column) -> Column:
    """A number as text that reads back as the same: whole ones without a point, up to 15 digits; others in the shortest form."""
    return F.when((number == F.floor(number)) & (F.abs(number) < 1e15), number.cast("decimal(16,0)").cast("string")).otherwise(number.cast("string"))


def truncate(text: Column, most: int) -> Column:
    """At most so many letters, the last of them an ellipsis where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def header_case(name: str, style: str = "title") -> str:
    """A column name as Pascal (OrderKey) or title (Order Key) words, split at _, -, space and changes of case."""
    import re

    words = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)
    return {"raw": name, "pascal": "".join(w[:1].upper() + w[1:] for w in words), "title": " ".join(w[:1].upper() + w[1:] for w in words)}[style]


# Kinds of mail folders by their names. Fixed values.
FOLDERS = {
    "Inbox": ["Inbox"], "Outbox": ["Outbox"], "SentItems": ["Sent", "Sent Items", "Sent Messages"], "DeletedItems": ["Deleted Items", "Trash", "Deleted Messages"], "Drafts": ["Drafts", "Draft"], "Calendar": ["Calendar"], "Contacts": ["Contacts"], "Tasks": ["Tasks"], "Notes": ["Notes"], "Journal": ["Journal"],
    "JunkEmail": ["Junk", "Junk E-mail", "Spam"], "Archive": ["Archive"], "SyncIssues": ["Sync Issues"], "Conflicts": ["Conflicts"], "LocalFailures": ["Local Failures"], "ServerFailures": ["Server Failures"], "RssFeeds": ["RSS Feeds"], "Reminders": ["Reminders"], "ToDo": ["To-Do", "To Do"],
}


def folder_kind(name: Column) -> Column:
    """The kind of a mail folder by its name, in any case; Unknown for any other."""
    kinds = F.create_map(*(F.lit(x) for kind, names in FOLDERS.items() for n in names for x in (n.lower(), kind)))
    return F.coalesce(F.try_element_at(kinds, F.lower(F.trim(name))), F.lit("Unknown"))


def recurrence(text: Column) -> Column:
    """The parts of a rule such as FREQ=WEEKLY;INTERVAL=2 as a map with names in upper case, the first of a name; null where a part is malformed or FREQ is missing."""
    parts = F.transform(F.split(text, ";"), lambda p: F.struct(F.upper(F.trim(F.regexp_extract(p, "^([^=]+)=", 1))).alias("k"), F.regexp_extract(p, "^[^=]+=(.+)$", 1).alias("v")))
    first = F.aggregate(parts, F.array().cast("array<struct<k:string,v:string>>"), lambda s, x: F.when(F.exists(s, lambda y: y["k"] == x["k"]), s).otherwise(F.concat(s, F.array(x))))
    fine = F.forall(parts, lambda p: p["k"].rlike("^[A-Z0-9-]+$") & (p["v"] != "")) & F.exists(parts, lambda p: (p["k"] == "FREQ") & (F.trim(p["v"]) != ""))
    return F.when(fine, F.map_from_entries(first))


def joined(items: Column, separator: str = ", ") -> Column:
    """The items of a collection as one text; null items are left out."""
    return F.array_join(F.transform(items, lambda x: x.cast("string")), separator)
