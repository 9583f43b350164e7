"""Vectorised tokenisation of Arrow string batches.

Texts are handled as one UTF-8 byte array with offsets, so that splitting into
words, hashing words and rolling windows over them are numpy operations over a
whole batch. Word separators are ASCII bytes, hence safe to find in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WHITE = tuple([0x20, *range(0x09, 0x0E)])
#: Bytes of text that are tokenised at once; longer texts are pieces of their own.
PIECE = 1 << 18

_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_LETTER = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, PIECE + 64)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 4 * PIECE:
            _powers[int(base)] = have
    return have[:n]


def powers(n: int) -> np.ndarray:
    """The first n powers of the base of rolling hashes."""
    return _power(_BASE, n)


def byte_class(separators) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


WORD = byte_class(WHITE)
ALNUM = byte_class([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """The words of rows first..first+rows of a batch, in order."""

    first: int
    rows: int
    raw: np.ndarray  # the texts' bytes
    data: np.ndarray  # the same in lower case, if so asked
    offsets: np.ndarray  # of rows, in data
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray  # of each word, from 0
    bounds: np.ndarray  # words of row i: bounds[i]:bounds[i + 1]

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return spans_hash(self.data, self.start, self.end)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def words(column: pa.Array, is_word: np.ndarray = WORD, lower: bool = True) -> Iterator[Words]:
    """The words of every text, in pieces of whole texts of about PIECE bytes."""
    data, offsets = text_buffers(column)
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, side="right")) - 1)
        yield _split(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first, is_word, lower)
        first = last


def _split(data, offsets, first, is_word, lower) -> Words:
    raw = data
    if lower:
        data = _LOWER[data]
    inside = is_word[data]
    n = len(data)
    before = np.zeros(n + 1, dtype=bool)  # whether the byte before continues the same row's word
    before[1:] = inside
    before[offsets] = False
    start = np.flatnonzero(inside & ~before[:n])
    after = np.zeros(n + 1, dtype=bool)
    after[:n] = inside
    after[offsets] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    bounds = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Words(first, len(offsets) - 1, raw, data, offsets, start, end, row, bounds)


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of `size` words within a row, position of its first word)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total = total * _BASE + hashes[k : k + n]
    # a window must not cross into the next row
    row_end = np.repeat(bounds[1:], np.diff(bounds))
    at = np.flatnonzero(np.arange(n) + size <= row_end[:n])
    return mix(total[at] + _U(size)), at


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice data[start:end]."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_LETTER[data] * _power(_BASE, n), out=sums[1:], dtype=np.uint64)
    raw = (sums[end] - sums[start]) * _power(_INVERSE, n + 1)[start]
    return mix(raw + (end - start).astype(np.uint64))


def with_row(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within a row."""
    return mix(hashes + row.astype(np.uint64) * _M1)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of values over each row's slice."""
    sums = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def crc_remainder(expression: str, modulus: int):
    """crc32 of a column as text, modulo `modulus`; null for null."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(expression).cast("string").cast("binary")) % modulus
