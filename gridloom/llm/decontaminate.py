"""Benchmark decontamination by hashed word windows.

Every run of `window` words of a benchmark item (the whole item where it is
shorter) is hashed; the hashes go to the executors as a broadcast set whose
size is bounded by MAX_WINDOWS. A larger benchmark is split by hash into
blocks of at most that size, and the documents pass one block after another.
Documents are scanned where they lie: there is no shuffle.

Cases: a null or empty text has no words and no hits; an item without words
has no window; repeated items hit as each of their ids; repeated document rows
are scanned on their own; other columns of the documents pass through as they
are, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage, textbatch

#: Windows in one broadcast block, some 100 bytes each.
MAX_WINDOWS = 1_000_000
_BITS = 20
_WINDOWS = "item string, size int, hash long, words binary"
_FOUND = "array<struct<from:int,to:int,items:array<string>>>"


def benchmark_windows(benchmark: DataFrame, window: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of all items: item, size (words), hash and the words themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for w in textbatch.words(batch.column(1), textbatch.ALNUM):
                hashes = w.hashes()
                for r in range(w.rows):
                    a, b = int(w.bounds[r]), int(w.bounds[r + 1])
                    size = min(window, b - a)
                    if size:
                        found, at = textbatch.windows(hashes[a:b], np.array([0, b - a]), size)
                        for h, i in zip(found.astype(np.int64).tolist(), at.tolist(), strict=True):
                            rows.append((ids[w.first + r], size, h, b" ".join(w.text(a + i + k) for k in range(size))))
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["item", "size", "hash", "words"])

    return benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(run, _WINDOWS).distinct()


class _Block:
    """Windows of one block: by size, a bit set over hashes, and from the words to the items."""

    def __init__(self, rows):
        self.items: dict[bytes, list[str]] = {}
        by_size: dict[int, set[int]] = {}
        for r in rows:
            self.items.setdefault(bytes(r.words), []).append(r.item if r.item is not None else "")
            by_size.setdefault(r.size, set()).add(r.hash)
        self.sizes = []
        for size, hashes in sorted(by_size.items()):
            known = np.sort(np.array(list(hashes), dtype=np.int64).astype(np.uint64))
            bits = np.zeros(1 << _BITS, dtype=bool)
            bits[known >> np.uint64(64 - _BITS)] = True
            self.sizes.append((size, known, bits))

    def find(self, w: textbatch.Words) -> list[tuple[int, int, int, list[str]]]:
        """Verified hits: row, first word, word after the last (both within the row), items."""
        hashes, out = w.hashes(), []
        for size, known, bits in self.sizes:
            found, at = textbatch.windows(hashes, w.bounds, size)
            maybe = np.flatnonzero(bits[found >> np.uint64(64 - _BITS)])
            if len(maybe):
                place = np.minimum(np.searchsorted(known, found[maybe]), len(known) - 1)
                maybe = maybe[known[place] == found[maybe]]
            for i in at[maybe].tolist():
                items = self.items.get(b" ".join(w.text(i + k) for k in range(size)))
                if items:
                    r = int(w.row[i])
                    out.append((r, i - int(w.bounds[r]), i - int(w.bounds[r]) + size, items))
        return out


def _blocks(benchmark: DataFrame, window: int, item: str, text: str, max_windows: int) -> Iterator[list]:
    table = storage.materialize(benchmark_windows(benchmark, window, item, text))
    n = max(1, math.ceil(table.count() / max_windows * 1.1))
    for k in range(n):
        part = table if n == 1 else table.where(F.pmod(F.xxhash64("words"), F.lit(n)) == k)
        yield part.collect()


def _scan(docs: DataFrame, benchmark: DataFrame, text: str, window: int, item: str, item_text: str, max_windows: int, finish, schema) -> DataFrame:
    """Pass all blocks; `finish` turns a batch, its words and its hits by row into the result."""
    spark, position = docs.sparkSession, docs.columns.index(text)
    blocks = _blocks(benchmark, window, item, item_text, max_windows)
    carried, rows = docs, next(blocks)
    while True:
        following = next(blocks, None)
        block = spark.sparkContext.broadcast(_Block(rows))
        first, last = carried is docs, following is None

        def run(batches, block=block, first=first, last=last):
            for batch in batches:
                hits: dict[int, list] = {}
                if not first:
                    for r, old in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                        if old:
                            hits[r] = [(x["from"], x["to"], x["items"]) for x in old]
                pieces = textbatch.words(batch.column(position), textbatch.ALNUM)
                made = []
                for w in pieces:
                    for r, a, b, items in block.value.find(w):
                        hits.setdefault(w.first + r, []).append((a, b, items))
                    if last:
                        made.append((w.counts(), _cut(w, hits)))
                if last:
                    own = batch if first else pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))
                    yield from finish(own, made, hits)
                else:
                    found = pa.array([[{"from": a, "to": b, "items": i} for a, b, i in hits.get(r, [])] for r in range(batch.num_rows)], pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("items", pa.list_(pa.string()))])))
                    own = batch.columns if first else batch.columns[:-1]
                    yield pa.RecordBatch.from_arrays([*own, found], [*[f"c{i}" for i in range(len(own))], "found"])

        if last:
            return carried.mapInArrow(run, schema)
        kept = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)]
        carried = storage.materialize(carried.mapInArrow(run, ", ".join([*kept, f"found {_FOUND}"])))
        rows = following


def _cut(w: textbatch.Words, hits: dict[int, list]) -> dict[int, tuple[int, bytes]]:
    """By row with hits: the number of hit words, and the text without their spans."""
    out = {}
    for r in range(w.rows):
        if found := hits.get(w.first + r):
            a = int(w.bounds[r])
            mark = np.zeros(int(w.bounds[r + 1]) - a + 1, dtype=np.int32)
            for x, y, _ in found:
                mark[x] += 1
                mark[y] -= 1
            hit = np.cumsum(mark)[:-1] > 0
            edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
            at, kept = int(w.offsets[r]), []
            for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                kept.append(w.raw[at : w.start[a + x]].tobytes())
                at = int(w.end[a + y - 1])
            kept.append(w.raw[at : w.offsets[r + 1]].tobytes())
            out[w.first + r] = (int(hit.sum()), b"".join(kept))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per document row: key, n_words, n_hit (words inside windows), items (ids of the items hit, sorted as strings)."""
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def finish(batch, made, hits):
        n_words = np.concatenate([c for c, _ in made]) if made else np.empty(0, np.int64)
        n_hit = np.zeros(batch.num_rows, dtype=np.int64)
        for _, cut in made:
            for r, (n, _) in cut.items():
                n_hit[r] = n
        items = [sorted({i for _, _, found in hits.get(r, ()) for i in found}) for r in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit), pa.array(items, pa.list_(pa.string()))], ["key", "n_words", "n_hit", "items"])

    schema = f"key {docs.schema[key].dataType.simpleString()}, n_words long, n_hit long, items array<string>"
    return _scan(narrow, benchmark, "text", window, item, item_text, max_windows, finish, schema).withColumnRenamed("key", key)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, remove: str = "documents", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents, same columns, without those that are hit (remove="documents") or without the hit spans ("spans")."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: {remove}")
    position = docs.columns.index(text)

    def finish(batch, made, hits):
        if remove == "documents":
            yield batch.filter(pa.array([r not in hits for r in range(batch.num_rows)], pa.bool_()))
            return
        columns = batch.columns
        if hits:
            texts = batch.column(position).to_pylist()
            for _, cut in made:
                for r, (_, left) in cut.items():
                    texts[r] = left.decode()
            columns[position] = pa.array(texts, batch.schema.field(position).type)
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return _scan(docs, benchmark, text, window, item, item_text, max_windows, finish, docs.schema)


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
