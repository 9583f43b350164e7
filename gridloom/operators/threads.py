"""Conversations of messages: links by references, by meetings and tasks, and by subject within a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph

#: What stands before a subject that is an answer or is passed on, by language. Fixed values.
ANSWERS = ["re", "fw", "fwd", "aw", "wg", "sv", "vs", "tr", "odp", "pd"]


def plain_subject(subject: Column) -> Column:
    """The subject without marks of answers (also numbered, such as Re[2]:), in lower case and single spaces; null for nothing left."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(subject, F.lit("")), r"[\s\p{Z}]+", " ")), rf"^(?: ?(?:{'|'.join(ANSWERS)})(?:\[\d+\])? ?: ?)+", "")
    return F.nullif(F.trim(bare), F.lit(""))


def plain_id(c: Column) -> Column:
    """A message id without space and angle brackets around; null for nothing left."""
    return F.nullif(F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s<]+|[\s>]+$", ""), F.lit(""))


def links(messages: DataFrame, *, within: int = 14 * 86400, most_references: int | None = None, subjects: bool = True) -> DataFrame:
    """Edges between messages: src, dst and kind (reference, related or subject).

    Needs id (unique), message_id, references (an array, the answered one last), subject and
    sent (a time); related, an array of the ids of meetings and tasks, may be there.
    A reference to a message that several rows have links with each of them by way
    of the first. Messages without a reference link are linked by subject with the
    next earlier message of the same subject, if it is at most `within` seconds
    earlier: one link a message, found by a window over time slices of a subject,
    so that a subject of very many messages is not paired within itself.
    """
    named = messages.withColumn("_m", plain_id(F.col("message_id")))
    targets = named.where("_m is not null").groupBy("_m").agg(F.min("id").alias("_first"))
    # rows of one message id are one message
    same = named.join(targets, "_m").where("id <> _first").select(F.col("id").alias("src"), F.col("_first").alias("dst"))
    refs = F.col("references") if most_references is None else F.slice("references", F.greatest(F.size("references") - most_references + 1, F.lit(1)), F.lit(most_references))
    told = named.select("id", F.explode(F.array_distinct(F.transform(refs, plain_id))).alias("_m")).where("_m is not null")
    by_reference = told.join(targets, "_m").where("id <> _first").select(F.col("id").alias("src"), F.col("_first").alias("dst")).unionByName(same).distinct()
    out = by_reference.withColumn("kind", F.lit("reference"))
    if "related" in messages.columns:
        each = messages.select("id", F.explode(F.array_distinct("related")).alias("_r")).where("trim(_r) <> ''")
        star = each.groupBy("_r").agg(F.min("id").alias("_first"))
        out = out.unionByName(each.join(star, "_r").where("id <> _first").select(F.col("id").alias("src"), F.col("_first").alias("dst"), F.lit("related").alias("kind")).distinct())
    if not subjects:
        return out
    linked = out.select(F.col("src").alias("id")).unionByName(out.select(F.col("dst").alias("id"))).distinct()
    seconds = F.unix_micros(F.col("sent").cast("timestamp"))
    slice_ = F.floor(seconds / (within * 1_000_000)).cast("long") if within else seconds
    titled = messages.select("id", plain_subject(F.col("subject")).alias("s"), seconds.alias("at"), slice_.alias("slice")).where("s is not null and at is not null")
    # the last message of each slice stands for it in the next one
    within_slice = "PARTITION BY s, slice ORDER BY at, id"
    last = titled.groupBy("s", "slice").agg(F.max(F.struct("at", "id")).alias("x")).select("s", (F.col("slice") + 1).alias("slice"), F.col("x.at").alias("_at"), F.col("x.id").alias("_id"))
    before = titled.withColumns({"_b": F.expr(f"lag(struct(at, id)) OVER ({within_slice})")}).join(last, ["s", "slice"], "left")
    near = before.withColumn("_p", F.coalesce("_b", F.when(F.col("_at").isNotNull(), F.struct(F.col("_at").alias("at"), F.col("_id").alias("id")))))
    close = near.where((F.col("at") - F.col("_p.at")) <= within * 1_000_000)
    found = close.join(linked, "id", "left_anti").select(F.col("id").alias("src"), F.col("_p.id").alias("dst"), F.lit("subject").alias("kind"))
    return out.unionByName(found)


def conversations(messages: DataFrame, **options) -> DataFrame:
    """Per message: id, conversation (its smallest id) and heuristic (whether a link by subject belongs to it)."""
    found = links(messages, **options)
    parts = graph.connected_components(found)
    joined = messages.select("id").join(parts, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", F.col("id")).alias("conversation"))
    guessed = found.where("kind = 'subject'").select(F.col("src").alias("_s")).join(parts, F.col("_s") == F.col("node")).select(F.col("component").alias("_c")).distinct()
    return joined.join(guessed, F.col("conversation") == F.col("_c"), "left").select("id", "conversation", F.col("_c").isNotNull().alias("heuristic"))
