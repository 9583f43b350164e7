"""The kind of a file by its name and by its first bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds by extension, leading bytes (hexadecimal), and what names the parts of a package hold. Fixed values.
EXTENSIONS = {
    "pdf": "Pdf", "docx": "Word", "docm": "Word", "doc": "Word", "xlsx": "Excel", "xlsm": "Excel", "xls": "Excel", "pptx": "PowerPoint", "ppt": "PowerPoint", "vsdx": "Visio", "odt": "OpenDocument", "ods": "OpenDocument",
    "epub": "Epub", "zip": "Zip", "rtf": "Rtf", "html": "Html", "htm": "Html", "xml": "Xml", "json": "Json", "csv": "Csv", "tsv": "Csv", "md": "Markdown", "txt": "Text", "log": "Text", "eml": "Email", "mbox": "Mailbox", "msg": "OutlookMessage", "pst": "OutlookStore", "ost": "OutlookStore",
    "png": "Image", "jpg": "Image", "jpeg": "Image", "gif": "Image", "gz": "Gzip", "ipynb": "Notebook", "srt": "Subtitle", "vtt": "Subtitle", "yaml": "Yaml", "yml": "Yaml",
}
SIGNATURES = {"pdf": ("255044462D", "Pdf"), "rtf": ("7B5C727466", "Rtf"), "png": ("89504E470D0A1A0A", "Image"), "jpeg": ("FFD8FF", "Image"), "gif": ("47494638", "Image"), "gzip": ("1F8B08", "Gzip"), "pst": ("2142444E", "OutlookStore"), "ole": ("D0CF11E0A1B11AE1", "OleCompound")}
PARTS = {"word/": "Word", "xl/": "Excel", "ppt/": "PowerPoint", "visio/": "Visio", "mimetypeapplication/epub+zip": "Epub", "mimetypeapplication/vnd.oasis.opendocument": "OpenDocument"}
TOKENS = {
    "html": (r"^\s*(?:<!--(?s:.*?)-->\s*)*<(?i:!doctype\s+html|html[\s>])", "Html", "medium"), "xml": (r"^\s*<\?xml[\s?]", "Xml", "medium"), "subtitle": (r"^(?:WEBVTT\b|\d+\r?\n\d\d:\d\d:\d\d,\d{3} --> )", "Subtitle", "medium"),
    "mbox": (r"^From \S+ .*\r?\n[A-Za-z-]+:", "Mailbox", "medium"), "headers": (r"^(?:(?i:received|from|to|subject|date|message-id|mime-version|return-path):[^\n]*\n(?:[ \t][^\n]*\n)*){2,}", "Email", "medium"),
    "front-matter": (r"^---\r?\n(?s:.*?)\n---\r?\n", "Markdown", "low"), "heading": (r"^#{1,6} \S", "Markdown", "low"), "json": (r"^\s*(?:\{\s*(?:\"|\})|\[\s*(?:[\[{\"\d\]-]|true|false|null))", "Json", "medium"),
}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^./\\]+)$", 1))


def detect(df: DataFrame, name: str, content: str, mode: str = "prefer_content", probe: int = 64 * 1024) -> DataFrame:
    """Adds extension_kind, content_kind, content_confidence (none, low, medium or high), kind, evidence (an array), mismatch and inspected_bytes.

    At most `probe` first bytes of the content are looked at: signatures are high
    evidence, structure at the start of a text is medium, text as such is low. mode:
    extension_only, content_when_unknown (the content counts where the extension
    tells nothing) or prefer_content (evidence of medium or more wins over the extension).
    mismatch: medium or high evidence for another kind than the extension's.
    """
    if mode not in ("extension_only", "content_when_unknown", "prefer_content"):
        raise ValueError("mode: extension_only, content_when_unknown or prefer_content")
    kinds = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    named = df.withColumn("extension_kind", F.coalesce(F.try_element_at(kinds, extension(F.col(name))), F.lit("Unknown")))
    looks = {"extension_only": F.lit(False), "content_when_unknown": F.col("extension_kind") == "Unknown", "prefer_content": F.lit(True)}[mode]
    head = F.when(looks, F.substring(F.coalesce(F.col(content), F.lit(b"")), 1, probe))
    start = F.hex(F.substring("_h", 1, 16))
    # bytes as letters of the same number, so that patterns find ASCII in whatever encoding
    text = F.decode("_h", "ISO-8859-1")
    plain = F.regexp_replace("_t", "^\u00ef\u00bb\u00bf", "")
    probed = named.withColumn("_h", head).withColumns({"_x": start, "_t": text}).withColumn("_t", plain)
    zipped = F.startswith("_x", F.lit("504B0304"))
    found = [(zipped & F.contains("_t", F.lit(part)), f"package:{kind}", kind, "high") for part, kind in PARTS.items()]
    found += [(zipped, "signature:zip", "Zip", "high")]
    found += [(F.startswith("_x", F.lit(bytes_)), f"signature:{n}", kind, "high") for n, (bytes_, kind) in SIGNATURES.items()]
    found += [(F.col("_t").rlike(pattern), f"token:{n}", kind, sure) for n, (pattern, kind, sure) in TOKENS.items()]
    found += [((F.length("_t") > 0) & ~F.col("_t").rlike(r"[\x00-\x08\x0E-\x1A\x1C-\x1F]"), "text", "Text", "low")]
    which = F.coalesce(*(F.when(x[0], F.lit(k)) for k, x in enumerate(found)), F.lit(len(found)))
    told = [*(x[1:] for x in found), (None, "Unknown", "none")]
    evidences, names, sures = (F.array(*(F.lit(t[k]).cast("string") for t in told)) for k in range(3))
    # a compound file can be any of these, and text can be of any kind of text
    allowed = [("OleCompound", ["Word", "Excel", "PowerPoint", "OutlookMessage"]), ("Json", ["Notebook"]), ("Xml", ["Html"])]

    def judge(v: Column) -> Column:
        kind, sure, of_name = F.get(names, v["which"]), F.get(sures, v["which"]), v["extension_kind"]
        known, strong = of_name != "Unknown", sure.isin("medium", "high")
        agrees = reduce(lambda a, b: a | b, [(kind == of_name), *((kind == a) & of_name.isin(b) for a, b in allowed)])
        chosen = F.when(agrees, of_name).when(strong | ~known, kind).otherwise(of_name)
        evidence = F.array_compact(F.array(F.when(known, F.concat(F.lit("extension:"), v["extension"])), F.get(evidences, v["which"])))
        return F.struct(kind.alias("content_kind"), sure.alias("content_confidence"), chosen.alias("kind"), evidence.alias("evidence"), (known & strong & ~agrees).alias("mismatch"))

    # judged within one value, so that what has been found is looked for once
    value = F.struct(which.alias("which"), F.col("extension_kind"), extension(F.col(name)).alias("extension"))
    judged = probed.withColumns({"_r": F.get(F.transform(F.array(value), judge), F.lit(0)), "inspected_bytes": F.coalesce(F.octet_length("_h"), F.lit(0)).cast("long")})
    return judged.withColumns({c: F.col(f"_r.{c}") for c in ("content_kind", "content_confidence", "kind", "evidence", "mismatch")}).drop("_h", "_x", "_t", "_r")
