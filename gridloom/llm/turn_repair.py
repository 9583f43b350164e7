"""Repair of the structure of conversations at least cost.

Turns have at most one fault: blank, duplicate (role and text as of an earlier
turn) or truncated. Edits, in order of the turns: Keep, Rerole to user or
assistant, Delete (the only one for a blank or duplicate turn) and Insert of an
empty turn. The roles that remain must be an optional system turn and then
user and assistant by turns, or nothing. The cheapest edits are found by
Dijkstra's algorithm on the lattice of (turns consumed, state of the roles),
which is never built: nodes are made when they are met, with the key (cost, audit),
where the audit is the edits' initials; the first accepting end node that
is popped has the least cost and of these the least audit. In any state only one
role is legal for a Rerole or an Insert, so that an audit says all.

Turns are sorted into ranges, so that a conversation is a run of one
task's rows. What may go on in another range, and what is longer than SEGMENT,
is solved in segments, from each state to each: the cheapest paths of
adjoining segments make those of both. So no task holds a conversation whole,
however many of the rows it has; only the final hash reads its segments one
after another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

#: Turns of a segment, and bytes of text after which one ends.
SEGMENT, SEGMENT_BYTES = 1024, 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# States of the roles: 0 nothing, 1 system, 2 user, 3 assistant was last. The state after a turn of an initial:
AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
SPEAKER = {0: "user", 1: "user", 2: "assistant", 3: "user"}  # that is legal next
SPOKEN = {"user": 2, "assistant": 3}
ENDS = (0, 3)
PAIRS = ("su", "ua", "au")
WHITE = r"[\x20\x09-\x0D]"


def paths(turns: list[tuple[str, str]], entry: int = 0) -> Iterator[tuple[int, int, str]]:
    """(state, cost, audit) of the cheapest way from a state before the turns (initial of the role, fault) to each state behind them, cheapest first."""
    heap, done, n = [(0, "", 0, entry)], set(), len(turns)
    while heap:
        cost, audit, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        speaker = SPOKEN[SPEAKER[state]]
        if i == n:
            yield state, cost, audit
        else:
            initial, fault = turns[i]
            heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if fault not in ("blank", "duplicate"):
                more = TRUNCATED if fault else 0
                if state in AFTER.get(initial, ()):
                    heappush(heap, (cost + KEEP + more, audit + "K", i + 1, AFTER[initial][state]))
                heappush(heap, (cost + REROLE + more, audit + "R", i + 1, speaker))
        if (i, speaker) not in done:
            heappush(heap, (cost + INSERT, audit + "I", i, speaker))


def edited(roles: list[str], texts: list[str], audit: str, state: int = 0) -> Iterator[tuple[str, str]]:
    """The turns (role, text) after the edits of an audit, from a state before them."""
    i = 0
    for edit in audit:
        speaker = SPEAKER[state]
        if edit == "I":
            yield speaker, ""
            state = SPOKEN[speaker]
            continue
        if edit == "K":
            yield roles[i], texts[i]
            state = AFTER[roles[i][:1]][state]
        elif edit == "R":
            yield speaker, texts[i]
            state = SPOKEN[speaker]
        i += 1


def damage(convs: DataFrame) -> DataFrame:
    """Turns damaged by the checksum of conversation and turn, for trying the repair: dropped, emptied, cut at signs, repeated or given to the user. Nulls are one space each."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    found = convs.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return found.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _ordered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(Turns with their fault, in ranges of conversation and turn, and sorted; the table they are read from)."""
    named = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("_id"))
    # what conversation, role and text a turn has, as one key; written, so that both readers see the same numbers of rows
    told = F.concat(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")), F.lit("\n"), F.length("role").cast("string"), F.lit("\n"), F.col("role"), F.col("text"))
    named = storage.materialize(named.withColumn("_key", F.sha2(told.cast("binary"), 256)))
    first = named.groupBy("_key").agg(F.min(F.struct("turn", "_id")).alias("_first")).select("_key", F.col("_first._id").alias("_first"))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("_id") != F.col("_first"), "duplicate").when(~F.col("text").rlike(rf"[.!?]{WHITE}*\z"), "truncated").otherwise("")
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", F.left("text", F.lit(64)), F.xxhash64("text"), "_id"]
    found = named.join(first, "_key").select("conv_id", "turn", "role", "text", "_id", fault.alias("fault"))
    return found.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_id"), named


_SEGMENT = {
    "range": ("int", pa.int32()), "place": ("int", pa.int32()), "whole": ("boolean", pa.bool_()), "n": ("long", pa.int64()), "blank": ("long", pa.int64()), "duplicate": ("long", pa.int64()), "truncated": ("long", pa.int64()),
    "illegal": ("long", pa.int64()), "first": ("string", pa.string()), "last": ("string", pa.string()), "least_turn": ("long", pa.int64()), "most_turn": ("long", pa.int64()), "n_turns": ("long", pa.int64()),
    "cost": ("long", pa.int64()), "audit": ("string", pa.string()), "sha256": ("string", pa.string()),
    "paths": ("array<struct<entry:int,exit:int,cost:long,audit:string>>", pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
    "roles": ("array<string>", pa.list_(pa.string())), "texts": ("array<string>", pa.list_(pa.string())),
}


def _digest(turns: Iterator[tuple[str, str]], so_far=None, begun: bool = False):
    """A hash over `role:text` lines, and whether it has any."""
    out = so_far or hashlib.sha256()
    for role, text in turns:
        out.update(f"{chr(10) * begun}{role}:{text}".encode())
        begun = True
    return out, begun


def _segments(ordered: DataFrame, with_turns: bool) -> DataFrame:
    """A row for each segment: its counts and, where it is a whole conversation, its edits, else its paths and turns."""
    kind = ordered.schema["conv_id"].dataType.simpleString()

    def solve(conv_id, range_: int, place: int, rows: list[tuple], whole: bool) -> dict:
        turns = [(r[1][:1], r[3]) for r in rows]
        numbers = [r[0] for r in rows if r[0] is not None]
        counts = {k: sum(f == k for _, f in turns) for k in ("blank", "duplicate", "truncated")}
        out = {"conv_id": conv_id, "range": range_, "place": place, "whole": whole, "n": len(rows), **counts, "illegal": sum(a[0] + b[0] not in PAIRS for a, b in zip(turns, turns[1:], strict=False)), "first": turns[0][0], "last": turns[-1][0],
               "least_turn": numbers[0] if numbers else None, "most_turn": numbers[-1] if numbers else None, "n_turns": len(set(numbers))}
        roles, texts = [r[1] for r in rows], [r[2] for r in rows]
        if whole:
            _, out["cost"], out["audit"] = next(x for x in paths(turns) if x[0] in ENDS)
            out["sha256"] = _digest(edited(roles, texts, out["audit"]))[0].hexdigest()
        else:
            out["paths"] = [{"entry": e, "exit": s, "cost": c, "audit": a} for e in SPEAKER for s, c, a in paths(turns, e)]
        if with_turns or not whole:
            out |= {"roles": roles, "texts": texts}
        return out

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        range_, place, conv, rows, size, out, out_size, open_ = TaskContext.get().partitionId(), 0, None, [], 0, [], 0, True
        names, kinds = ["conv_id", *_SEGMENT], None

        def table() -> pa.RecordBatch:
            return pa.record_batch([pa.array([x.get(n) for x in out], kinds if n == "conv_id" else _SEGMENT[n][1]) for n in names], names)

        for batch in batches:
            kinds = batch.schema.field("conv_id").type
            for conv_id, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")), strict=True):
                ended = conv_id != conv
                if rows and (ended or len(rows) >= SEGMENT or size >= SEGMENT_BYTES):
                    # the first conversation of the range may have begun in the one before
                    out.append(solve(conv, range_, place, rows, ended and not open_))
                    place, out_size, rows, size, open_ = place + 1, out_size + size + 200, [], 0, not ended
                    if out_size > SEGMENT_BYTES:
                        yield table()
                        out, out_size = [], 0
                conv = conv_id
                rows.append(tuple(row))
                size += len(row[2])
        if rows:
            out.append(solve(conv, range_, place, rows, False))
        if out:
            yield table()

    return ordered.mapInArrow(cut, f"conv_id {kind}, " + ", ".join(f"{n} {t[0]}" for n, t in _SEGMENT.items()))


def _by_conversation(segments: DataFrame) -> DataFrame:
    """Segments dealt by conversation, each one's in order."""
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "range", "place")


def _resolve(open_: DataFrame) -> DataFrame:
    """The edits of each segment of conversations that have several, and the conversation's counts so far: those of its last segment are the whole's."""
    kind = open_.schema["conv_id"].dataType.simpleString()
    totals = ("blank", "duplicate", "truncated", "illegal", "gaps", "cost")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, seen, ways, kinds = None, False, [], {}, None
        names = ["conv_id", "range", "place", "entry", "piece", "ended", *totals]

        def result() -> pa.RecordBatch:
            cost, _, chain = min(ways[s] for s in ENDS if s in ways)
            pieces = []
            while chain:
                chain, entry, audit = chain
                pieces.append((entry, audit))
            span = [(x["least_turn"], x["most_turn"], x["n_turns"]) for x in seen if x["least_turn"] is not None]
            distinct = sum(x[2] for x in span) - sum(a[1] == b[0] for a, b in zip(span, span[1:], strict=False))
            sums = {k: sum(x[k] for x in seen) for k in totals[:4]}
            sums["illegal"] += sum(a["last"] + b["first"] not in PAIRS for a, b in zip(seen, seen[1:], strict=False))
            sums |= {"gaps": span[-1][1] - span[0][0] + 1 - distinct if span else 0, "cost": cost}
            rows = [(conv, x["range"], x["place"], *piece, k == len(seen) - 1, *(sums[t] for t in totals)) for k, (x, piece) in enumerate(zip(seen, reversed(pieces), strict=True))]
            types = [kinds, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_()] + [pa.int64()] * len(totals)
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            kinds = batch.schema.field("conv_id").type
            for i in range(batch.num_rows):
                x = batch.slice(i, 1).to_pylist()[0]
                if begun and x["conv_id"] != conv:
                    yield result()
                    begun = False
                if not begun:
                    conv, begun, seen, ways = x["conv_id"], True, [], {0: (0, "", ())}
                # the cheapest way to each state behind the segment, by way of the states before it
                made: dict = {}
                for p in x.pop("paths"):
                    if p["entry"] in ways:
                        cost, audit, chain = ways[p["entry"]]
                        way = (cost + p["cost"], audit + p["audit"], (chain, p["entry"], p["audit"]))
                        if p["exit"] not in made or way[:2] < made[p["exit"]][:2]:
                            made[p["exit"]] = way
                ways = made
                seen.append(x)
        if begun:
            yield result()

    few = [c for c in open_.columns if c not in ("roles", "texts", "audit", "cost", "sha256", "whole")]
    return _by_conversation(open_.select(*few)).mapInArrow(walk, f"conv_id {kind}, range int, place int, entry int, piece string, ended boolean, " + ", ".join(f"{t} long" for t in totals))


def _hashed(pieces: DataFrame) -> DataFrame:
    """A row for each conversation of several segments, its turns hashed in their order."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    totals = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far, begun, audit = None, False, []
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.slice(i, 1).to_pylist()[0]
                so_far, begun = _digest(edited(x["roles"], x["texts"], x["piece"], x["entry"]), so_far, begun)
                audit.append(x["piece"])
                if x["ended"]:
                    row = [x["conv_id"], *(x[t] for t in totals), "".join(audit), so_far.hexdigest()]
                    types = [batch.schema.field("conv_id").type] + [pa.int64()] * len(totals) + [pa.string()] * 2
                    yield pa.record_batch([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["conv_id", *totals, "audit", "repaired_sha256"])
                    so_far, begun, audit = None, False, []

    return _by_conversation(pieces).mapInArrow(walk, f"conv_id {kind}, " + ", ".join(f"{t} long" for t in totals) + ", audit string, repaired_sha256 string")


def _solved(turns: DataFrame, with_turns: bool) -> tuple[DataFrame, DataFrame]:
    """(Segments that are whole conversations, the others with their edits: columns entry, piece and the conversation's counts)."""
    ordered, read = _ordered(turns)
    segments = storage.materialize(_segments(ordered, with_turns))
    storage.discard(read)
    open_ = segments.where("not whole")
    edits = storage.materialize(_resolve(open_))
    return segments.where("whole"), open_.select("range", "place", "roles", "texts").join(storage.broadcast_if_small(edits, 10_000), ["range", "place"])


def report(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps (in turn numbers), blank, duplicate, truncated, illegal (neighbours by role), cost, audit and repaired_sha256.

    Needs conv_id, turn, role and text. Null turns come first and make no gaps;
    turns of one number stand by role, the first 64 letters of the text, and its
    hash; null roles and texts are one
    space; null ids are one conversation; other columns are not looked at.
    """
    whole, several = _solved(turns, False)
    gaps = F.coalesce(F.col("most_turn") - F.col("least_turn") + 1 - F.col("n_turns"), F.lit(0))
    done = whole.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha256").alias("repaired_sha256"))
    return done.unionByName(_hashed(several))


def repaired(turns: DataFrame) -> DataFrame:
    """The turns of all conversations after their edits: conv_id, part and place (which order them), role and text."""
    whole, several = _solved(turns, True)
    columns = ["conv_id", "range", "place", "roles", "texts", "entry", "piece"]
    both = whole.withColumns({"entry": F.lit(0), "piece": F.col("audit")}).select(*columns).unionByName(several.select(*columns))
    kind = both.schema["conv_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.slice(i, 1).to_pylist()[0]
                rows = [(x["conv_id"], (x["range"] << 32) + x["place"], k, *turn) for k, turn in enumerate(edited(x["roles"], x["texts"], x["piece"], x["entry"]))]
                if rows:
                    types = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.string()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv_id", "part", "place", "role", "text"])

    return both.mapInArrow(apply, f"conv_id {kind}, part long, place long, role string, text string")
