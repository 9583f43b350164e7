"""Token ids as binary files: concatenated ids with Elias-Fano encoded document ends.

Documents are dealt into ranges of ascending id, tokenised in order, and packed
into segments of about `ids` ids (a document is never cut). A segment holds the
ids (two bytes each where the vocabulary permits) and two monotone sequences in
Elias-Fano form: the ends of its documents in the id array, and the documents'
ids less the first. Such a sequence of n values up to u takes about
2 + log2(u / n) bits a value: the low bits as they are, the high bits in unary,
and the place of every 256th one as a 32-bit number, from which select() finds
any value by looking at a few bytes. No table of 64-bit offsets is kept; the
place of a segment in the whole array is in the manifest beside the files.

Files are written and read by Spark's own text and binary sources, so that they
may be in any store that Spark knows, and a lost task is repeated by Spark. The
text writer sets one byte behind every segment; segments state their length.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage, textbatch

#: Ids of a segment, after which the next one begins.
SEGMENT_IDS = 1 << 20
#: Bytes of text of a range, on average.
RANGE_BYTES = 48 << 20
#: Bytes of text that are tokenised at once.
PIECE = 4 << 20
#: Bytes given to the tokenizer as one text.
JOINED = 1 << 17
#: Pieces of text whose ids a worker remembers.
KNOWN = 600_000
#: Ones of the high bits between two stored places.
SAMPLE = 256

MAGIC = b"GLTOKEN1"
# magic, bytes of the segment, range, place in the range, documents, of these without an id, ids, bytes an id, id of the first document that has one
HEADER = struct.Struct("<8sQIIIIQIq")
# values, largest value, low bits of each
SEQUENCE = struct.Struct("<QQI")


def _packed(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest bits of each value, one after another."""
    if not bits or not len(values):
        return np.empty(0, np.uint8)
    out = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(out.astype(np.uint8).ravel(), bitorder="little")


class EliasFano:
    """A sequence of non-decreasing unsigned numbers."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, places: np.ndarray) -> None:
        self.n, self.bits, self.low, self.high, self.places = n, bits, low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) + 8) // 8 if n else 0, np.uint8)
        np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
        return cls(n, bits, _packed(values, bits), high, ones[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th value, by the stored place before it and a look at the bytes from there."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.places[i // SAMPLE]), i % SAMPLE
        byte, size = at >> 3, 64
        window = self.high[byte : byte + size].copy()
        window[0] &= 0xFF << (at & 7) & 0xFF
        while (counts := np.bitwise_count(window).cumsum(dtype=np.int64))[-1] <= left:
            size *= 2
            window = self.high[byte : byte + size].copy()
            window[0] &= 0xFF << (at & 7) & 0xFF
        k = int(np.searchsorted(counts, left, side="right"))
        rest = left - (int(counts[k - 1]) if k else 0)
        bit = int(np.flatnonzero(np.unpackbits(window[k : k + 1], bitorder="little"))[rest])
        return ((byte + k) * 8 + bit - i) << self.bits | self._low(i)

    def _low(self, i: int) -> int:
        first, last = i * self.bits, (i + 1) * self.bits
        found = int.from_bytes(self.low[first >> 3 : (last + 7) >> 3].tobytes(), "little")
        return found >> (first & 7) & ((1 << self.bits) - 1)

    def values(self) -> np.ndarray:
        """All values, as unsigned 64-bit numbers."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.bits)
        if self.bits and self.n:
            low = np.unpackbits(self.low, bitorder="little", count=self.n * self.bits).reshape(self.n, self.bits)
            out |= (low.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def dump(self) -> bytes:
        return SEQUENCE.pack(self.n, len(self.high), self.bits) + self.low.tobytes() + self.high.tobytes() + self.places.tobytes()

    @classmethod
    def load(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, high, bits = SEQUENCE.unpack_from(data, at)
        at += SEQUENCE.size
        parts = []
        for size, kind in (((n * bits + 7) // 8, np.uint8), (high, np.uint8), ((n + SAMPLE - 1) // SAMPLE * 4, np.dtype("<u4"))):
            parts.append(np.frombuffer(data[at : at + size], kind))
            at += size
        return cls(n, bits, *parts), at


class Segment:
    """One segment of a file: `ids`, `ends` of its documents, and their ids."""

    def __init__(self, data: memoryview) -> None:
        _, self.size, self.range, self.place, self.n, self.n_null, n_ids, width, self.first = HEADER.unpack_from(data)
        at = HEADER.size
        self.ids = np.frombuffer(data[at : at + n_ids * width], f"<u{width}")
        self.ends, at = EliasFano.load(data, at + n_ids * width)
        self.names, at = EliasFano.load(data, at)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def segments(content: bytes) -> Iterator[Segment]:
    data, at = memoryview(content), 0
    while at + HEADER.size <= len(data):
        found = Segment(data[at:])
        yield found
        at += found.size + 1  # the byte of the text writer


def segment(range_: int, place: int, names: list, ids: list[np.ndarray], width: int) -> bytes:
    """The bytes of a segment of the documents `names` (None first, then ascending) with their ids."""
    n_null = sum(x is None for x in names)
    known = np.array(names[n_null:], np.int64)
    first = int(known[0]) if len(known) else 0
    flat = np.concatenate(ids) if ids else np.empty(0)
    ends = EliasFano.of(np.cumsum([len(x) for x in ids]))
    # differences of two's complements are right as unsigned numbers whatever the sign
    body = flat.astype(f"<u{width}").tobytes() + ends.dump() + EliasFano.of(known.astype(np.uint64) - np.uint64(first % (1 << 64))).dump()
    return HEADER.pack(MAGIC, HEADER.size + len(body), range_, place, len(names), n_null, len(flat), width, first) + body


# White space as bytes: within ASCII, and the first bytes of letters some of which are white space elsewhere
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.zeros(256, bool)
_ODD[[*range(0x1C, 0x20), 0x85, 0xA0]] = True
_ALNUM, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_SIGN[0x21:0x7F] = ~_ALNUM[0x21:0x7F]
_SPACE_LEAD = np.array([0xE1, 0xE2, 0xE3], np.uint8)


def _upto(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


class Encoder:
    """Texts to ids by a tokenizer file, the same as encoding each text whole.

    A byte-level tokenizer with the usual pattern never joins what stands before
    a white space with it, nor a letter or digit with the sign behind it, so that
    a text may be cut there. Distinct pieces are then encoded once, many in one
    call, and told apart by the lengths of their tokens; those met before, KNOWN
    at most, are remembered. Other tokenizers encode each text by itself.
    """

    def __init__(self, file: str, add_special_tokens: bool = False) -> None:
        import json

        from tokenizers import Tokenizer

        self.tokenizer, self.special = Tokenizer.from_file(file), add_special_tokens
        with open(file, encoding="utf-8") as f:
            made = json.load(f)
        before = made.get("pre_tokenizer") or {}
        self.bytewise = not add_special_tokens and made.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0) + 1
        contents = [x["content"].encode() for x in made.get("added_tokens", [])]
        self.bytewise = self.bytewise and not any(_SPACE[list(x)].any() for x in contents)
        if self.bytewise:
            self.sign = _SIGN.copy()  # but for those that an added token holds behind a letter
            self.sign[[b for x in contents for a, b in zip(x, x[1:], strict=False) if _ALNUM[a]]] = False
            self._forget()
            added = {x["id"]: len(x["content"].encode()) for x in made["added_tokens"]}
            self.lengths = np.zeros(self.size, np.int64)
            for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
                self.lengths[i] = added.get(i, len(token))  # a letter of a byte-level token is a byte

    def _forget(self) -> None:
        self.known, self.begins, self.counts, self.ids = pa.array([], pa.large_binary()), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _learn(self, pieces: pa.LargeBinaryArray) -> None:
        """Remember the ids of these pieces, which are not known."""
        if len(self.known) + len(pieces) > KNOWN:
            self._forget()
        ids, begins, counts = self._pieces(pieces)
        self.begins, self.counts = np.concatenate([self.begins, begins + len(self.ids)]), np.concatenate([self.counts, counts])
        self.ids, self.known = np.concatenate([self.ids, ids.astype(np.int32)]), pa.concat_arrays([self.known, pieces])

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int64) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=self.special)]

    def _pieces(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces, where those of each begin, how many each has)."""
        data, offsets = textbatch.text_buffers(pieces)
        starts, sizes = offsets[:-1], np.diff(offsets)
        first, last = data[starts], data[offsets[1:] - 1]
        # with a white space at the end, or what may be one at either end, a piece would run into its neighbour
        apart = _SPACE[last] | _ODD[last] | (first >= 0x80) | _ODD[first] | ((last >= 0x80) & (sizes > 2) & np.isin(data[np.maximum(offsets[1:] - 3, 0)], _SPACE_LEAD))
        lone = ~_SPACE[first] & ~apart  # of which a line feed before is made
        begins, counts, flat, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), [], 0
        together = np.flatnonzero(~apart)
        lengths = sizes[together] + lone[together]
        ends = np.cumsum(lengths)
        text = np.full(int(ends[-1]) if len(ends) else 0, 0x0A, np.uint8)
        at = np.repeat(ends - sizes[together], sizes[together]) + _upto(sizes[together])
        text[at] = data[np.repeat(starts[together], sizes[together]) + _upto(sizes[together])]
        k = 0
        while k < len(together):
            stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + JOINED)))
            base = int(ends[k - 1]) if k else 0
            ids = self._each([text[base : ends[stop - 1]].tobytes().decode()])[0]
            bounds = np.cumsum(self.lengths[ids])
            stops = np.searchsorted(bounds, ends[k:stop] - base) + 1
            if not np.array_equal(bounds[stops - 1], ends[k:stop] - base):
                raise ValueError("a token across two pieces")
            here = together[k:stop]
            from_ = np.concatenate([[0], stops[:-1]]) + lone[here]
            begins[here], counts[here] = total + from_, stops - from_
            flat.append(ids)
            total, k = total + len(ids), stop
        rest = np.flatnonzero(apart)
        for i, ids in zip(rest, self._each([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in rest]), strict=True):
            begins[i], counts[i] = total, len(ids)
            flat.append(ids)
            total += len(ids)
        return (np.concatenate(flat) if flat else np.empty(0, np.int64)), begins, counts

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; a null is an empty text."""
        if not self.bytewise:
            yield from self._each([x or "" for x in column.to_pylist()])
            return
        data, offsets = textbatch.text_buffers(column)
        row, rows = 0, len(offsets) - 1
        while row < rows:
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
            yield from self._batch(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row])
            row = stop

    def _batch(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        n = len(data)
        cut = np.zeros(n + 1, bool)
        if n > 3:
            before = data[:-1]
            fine = ~_SPACE[before] & ~_ODD[before]
            fine[2:] &= ~((before[2:] >= 0x80) & np.isin(data[:-3], _SPACE_LEAD))  # the letter before may be a white space
            fine[:2] &= before[:2] < 0x80
            cut[1:n] = (fine & _SPACE[data[1:]]) | (_ALNUM[before] & self.sign[data[1:]])
        cut[offsets] = True
        starts = np.flatnonzero(cut)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), max(len(starts) - 1, 0), [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        at = pc.index_in(pieces.dictionary, value_set=self.known)
        if at.null_count:
            self._learn(pieces.dictionary.filter(pc.is_null(at)))
            at = pc.index_in(pieces.dictionary, value_set=self.known)
            if at.null_count:  # what was known is forgotten
                self._forget()
                self._learn(pieces.dictionary)
                at = pc.index_in(pieces.dictionary, value_set=self.known)
        which = at.to_numpy()[pieces.indices.to_numpy(zero_copy_only=False)]
        sizes = self.counts[which]
        ends = np.zeros(len(which) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        flat = self.ids[np.repeat(self.begins[which] - ends[:-1], sizes) + np.arange(ends[-1])]
        at = ends[np.searchsorted(starts, offsets)]
        for first, last in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield flat[first:last]


@lru_cache(maxsize=2)
def _encoder(file: str) -> Encoder:
    return Encoder(file)


def write(docs: DataFrame, path: str, tokenizer: str, *, end: int | None = None, row: tuple[Column, ...] = (), ids: int = SEGMENT_IDS) -> None:
    """Write the ids of each document's text, in ascending doc_id, to files below `path`, and their manifest.

    doc_id is a whole number; rows without one come first; rows of one doc_id
    stand in the order of their texts' hash and of `row`, columns that tell rows
    apart, so that a doc_id with very many rows spans several ranges. A null
    text is empty. `end` is an id appended to each document. Other columns
    are not looked at. `tokenizer` is a file that every executor has at that place.
    """
    spark = docs.sparkSession
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *(c.alias(f"_row{k}") for k, c in enumerate(row)))
    total = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), *(f"_row{k}" for k in range(len(row)))]
    dealt = wanted.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        width, range_, place = 2 if max(encoder.size, (end or 0) + 1) <= 1 << 16 else 4, TaskContext.get().partitionId(), 0
        names: list = []
        held: list[np.ndarray] = []
        size = 0
        last = np.array([] if end is None else [end], f"<u{width}")
        for batch in batches:
            for name, found in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                names.append(name)
                held.append(np.concatenate([found.astype(f"<u{width}"), last]))
                size += len(held[-1])
                if size >= ids:
                    yield pa.record_batch([pa.array([segment(range_, place, names, held, width)], pa.binary())], ["content"])
                    names, held, size, place = [], [], 0, place + 1
            pa.default_memory_pool().release_unused()
        if names:
            yield pa.record_batch([pa.array([segment(range_, place, names, held, width)], pa.binary())], ["content"])

    # a row of text is written as its bytes, whatever they are
    dealt.mapInArrow(pack, "content binary").select(F.col("content").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/ids")
    heads = _files(spark, path).mapInArrow(_heads, "range int, place int, n_documents long, n_ids long")
    heads = storage.materialize(heads)
    # one row a range: as many as there were tasks
    sums = sorted(heads.groupBy("range").agg(F.sum("n_documents"), F.sum("n_ids")).collect())
    bases, documents, tokens = [], 0, 0
    for range_, n_documents, n_ids in sums:
        bases.append((range_, documents, tokens))
        documents, tokens = documents + n_documents, tokens + n_ids
    first = spark.createDataFrame(bases, "range int, _documents long, _ids long")
    before = "sum({}) OVER (PARTITION BY range ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    placed = heads.withColumn("_d", F.coalesce(F.expr(before.format("n_documents")), F.lit(0))).withColumn("_i", F.coalesce(F.expr(before.format("n_ids")), F.lit(0)))
    placed.join(storage.broadcast_if_small(first), "range").select("range", "place", "n_documents", "n_ids", (F.col("_documents") + F.col("_d")).alias("first_document"), (F.col("_ids") + F.col("_i")).alias("first_id")).write.parquet(f"{path}/manifest")
    storage.discard(heads)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/ids").where("length > 0").select("content")


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(s.range, s.place, s.n, len(s.ids)) for x in batch.column(0) for s in segments(x.as_buffer())]
        if found:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["range", "place", "n_documents", "n_ids"])


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of written files: doc_id, start (ids before it), n_tokens, ids_crc32 (of the ids as unsigned 32-bit numbers) and, if asked for, ids."""
    kinds = [("range", pa.int32(), "int"), ("place", pa.int32(), "int"), ("doc_id", pa.int64(), "long"), ("offset", pa.int64(), "long"), ("n_tokens", pa.int64(), "long"), ("ids_crc32", pa.int64(), "long")] + [("ids", pa.list_(pa.int32()), "array<int>")] * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for s in segments(content.as_buffer()):
                    ends = s.ends.values().astype(np.int64)
                    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                    wide = s.ids.astype("<u4")
                    names = [None] * s.n_null + (s.names.values() + np.uint64(s.first % (1 << 64))).astype(np.int64).tolist()
                    sums = [zlib.crc32(wide[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                    columns = [[s.range] * s.n, [s.place] * s.n, names, begins, ends - begins, sums]
                    arrays = [pa.array(c, k[1]) for c, k in zip(columns, kinds, strict=False)]
                    if with_ids:
                        arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([begins, ends[-1:]]), pa.int32()), pa.array(wide.astype(np.int32))))
                    yield pa.record_batch(arrays, [k[0] for k in kinds])

    found = _files(spark, path).mapInArrow(decode, ", ".join(f"{k[0]} {k[2]}" for k in kinds))
    bases = spark.read.parquet(f"{path}/manifest").select("range", "place", "first_id")
    return found.join(storage.broadcast_if_small(bases), ["range", "place"]).select("doc_id", (F.col("first_id") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def document(spark: SparkSession, path: str, number: int) -> list[int]:
    """The ids of the number-th document of all: its segment by the manifest, its bounds by two selects."""
    found = spark.read.parquet(f"{path}/manifest").where((F.col("first_document") <= number) & (F.col("first_document") + F.col("n_documents") > number)).first()
    if found is None:
        raise IndexError(number)
    range_, place, i = found["range"], found["place"], number - found["first_document"]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for s in segments(content.as_buffer()):
                    if (s.range, s.place) == (range_, place):
                        yield pa.record_batch([pa.array([s.document(i).tolist()], pa.list_(pa.int32()))], ["ids"])

    return _files(spark, path).mapInArrow(pick, "ids array<int>").first()["ids"]
