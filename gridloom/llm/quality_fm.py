"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text is a sparse vector x: its words, hashed into 2**15 places and scaled to
length 1, one indicator for the bin of each structure statistic, and one for
the bin of each metadata column. The score is the logistic function of

    w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2)

whose pairwise part takes time linear in the words.

The model is fitted on a bounded sample of labelled rows (SAMPLE), which is the
only thing that reaches the driver; documents are scored where they lie.

Cases: null and empty texts have no words and are scored from their statistics;
null metadata is a bin of its own; labelled rows with a null label are left
out, and a document labelled more than once takes its least label; without any
labelled row, or with one label only, every score is the share of label 1
(0.5 without rows). Repeated rows are scored each. Other columns pass
through `keep_good` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch

#: Labelled rows to fit on, at most; drawn evenly by a hash of their key.
SAMPLE = 8_000
BITS = 15
RANK = 8
EPOCHS = 4
#: Upper edges of each statistic's bins. Shares are of words, or of letters for `upper`.
BINS = {
    "log_words": (1, 2, 3, 4, 5, 6, 7, 8),
    "word_length": (2, 3, 4, 4.5, 5, 5.5, 6, 7, 8, 10),
    "symbols": (0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 1, 2),
    "upper": (0.02, 0.05, 0.08, 0.12, 0.2, 0.4, 0.6, 0.8),
    "marks": (0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.8, 1.2),
    "digits": (0.01, 0.05, 0.1, 0.3, 1),
    "distinct": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "lines": (0.01, 0.03, 0.06, 0.1, 0.2, 0.5),
    "repeats": (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7),
}
_LOG_BINS = tuple(range(1, 12))

_KIND = np.zeros((4, 256), dtype=bool)
_KIND[0, list(b"#*$%&|<>{}[]\\^~@=_")] = True
_KIND[1, 65:91] = True
_KIND[2, list(b"!?.,;:")] = True
_KIND[3, 48:58] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _size(metadata: int) -> int:
    return (1 << BITS) + 16 * (len(BINS) + metadata)


def features(texts: pa.Array, metadata: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of a batch: first row, rows, and of each feature its row, place and value, in order of rows."""
    for w in textbatch.words(texts):
        rows, n = w.rows, np.maximum(w.counts(), 1)
        byte_row = np.repeat(np.arange(rows), np.diff(w.offsets))
        per = lambda mask: np.bincount(byte_row[mask], minlength=rows)  # noqa: E731, B023
        place = (w.hashes() >> np.uint64(64 - BITS)).astype(np.int64)
        cell, count = np.unique((w.row.astype(np.int64) << BITS) | place, return_counts=True)
        row = cell >> BITS
        value = count / np.sqrt(np.bincount(row, weights=count.astype(float) ** 2, minlength=rows))[row]
        letters = np.maximum(per(_LETTER[w.raw]), 1)
        trigrams, at = textbatch.windows(w.hashes(), w.bounds, 2)
        own = textbatch.with_row(trigrams, w.row[at])
        kinds = np.bincount(w.row[at[np.unique(own, return_index=True)[1]]], minlength=rows)
        chars = per(textbatch.WORD[w.raw] & ((w.raw & 0xC0) != 0x80))
        stats = {
            "log_words": np.log(n), "word_length": chars / n, "symbols": per(_KIND[0][w.raw]) / n, "upper": per(_KIND[1][w.raw]) / letters, "marks": per(_KIND[2][w.raw]) / n,
            "digits": per(_KIND[3][w.raw]) / n, "distinct": np.bincount(row, minlength=rows) / n, "lines": (per(w.raw == 10) + 1) / n, "repeats": 1 - kinds / np.maximum(n - 1, 1),
        }
        places = [(1 << BITS) + 16 * k + np.digitize(stats[s], edges) for k, (s, edges) in enumerate(BINS.items())]
        for k, column in enumerate(metadata, len(BINS)):
            x = column[w.first : w.first + rows]
            bins = np.digitize(np.log1p(np.maximum(np.nan_to_num(x), 0)), _LOG_BINS)
            places.append((1 << BITS) + 16 * k + np.where(np.isnan(x), 15, bins))
        places = np.stack(places, axis=1)
        all_row = np.concatenate((row, np.repeat(np.arange(rows), places.shape[1])))
        order = np.argsort(all_row, kind="stable")
        yield w.first, rows, all_row[order], np.concatenate((cell & ((1 << BITS) - 1), places.ravel()))[order], np.concatenate((value, np.full(places.size, 0.5)))[order]


class Machine:
    """The fitted parameters."""

    def __init__(self, size: int, bias: float = 0.0):
        self.bias, self.linear = bias, np.zeros(size, dtype=np.float32)
        self.factors = np.random.default_rng(7).normal(0, 0.02, (size, RANK)).astype(np.float32)

    def margins(self, row: np.ndarray, place: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        bounds = np.searchsorted(row, np.arange(rows + 1))
        vx = self.factors[place] * value[:, None].astype(np.float32)
        out = self.bias + textbatch.row_sums(self.linear[place] * value, bounds)
        squares = textbatch.row_sums((vx * vx).sum(axis=1), bounds)
        for f in range(RANK):
            out += 0.5 * textbatch.row_sums(vx[:, f], bounds) ** 2
        return out - 0.5 * squares

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        """AdaGrad over single examples, in an order fixed by a seed."""
        share = labels.mean() if len(labels) else 0.5
        if share in (0.0, 1.0) or not len(labels):
            self.factors[:] = 0
            self.bias = float(np.log(share / (1 - share))) if 0 < share < 1 else (20.0 if share == 1 else -20.0)
            return
        self.bias = float(np.log(share / (1 - share)))
        g_w, g_v = np.full(self.linear.shape, 1e-2, np.float32), np.full(self.factors.shape, 1e-2, np.float32)
        order = np.random.default_rng(11)
        for _ in range(EPOCHS):
            for i in order.permutation(len(labels)):
                place, x = examples[i]
                v = self.factors[place]
                s = x @ v
                p = self.bias + self.linear[place] @ x + 0.5 * (s @ s - ((x[:, None] * v) ** 2).sum())
                g = 1 / (1 + np.exp(-np.clip(p, -30, 30))) - labels[i]
                self.bias -= 0.02 * g
                d_w = g * x + 1e-5 * self.linear[place]
                g_w[place] += d_w * d_w
                self.linear[place] -= 0.15 * d_w / np.sqrt(g_w[place])
                d_v = g * x[:, None] * (s - x[:, None] * v) + 1e-5 * v
                g_v[place] += d_v * d_v
                self.factors[place] = v - 0.05 * d_v / np.sqrt(g_v[place])


def _columns(batch: pa.RecordBatch, first: int) -> list[np.ndarray]:
    return [batch.column(k).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False).astype(float) for k in range(first, batch.num_columns)]


def _metadata(metadata: tuple[str, ...]) -> list:
    return [F.col(m).cast("double").alias(f"m{k}") for k, m in enumerate(metadata)]


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", metadata: tuple[str, ...] = ("n_chars",), sample: int = SAMPLE) -> Machine:
    """Fit on at most `sample` labelled rows; docs and labels hold only what may be learned from."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(label).cast("double").alias("label"))
    spread = F.conv(F.substring(F.md5(F.col("key").cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    share = sample / max(known.count(), 1)
    chosen = (known.where(spread < share) if share < 1 else known).limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            for first, rows, row, place, value in features(batch.column(1), _columns(batch, 2)):
                bounds = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(label[first : first + rows]), pa.ListArray.from_arrays(pa.array(bounds), pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(pa.array(bounds), pa.array(value.astype(np.float32)))], ["label", "place", "value"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *_metadata(metadata)).join(F.broadcast(chosen), "key")
    # one row for each document, so that repeated ones do not go beyond the bound
    inputs = ("text", *(f"m{k}" for k in range(len(metadata))))
    once = rows.groupBy("key").agg(F.max(F.struct("label", *inputs)).alias("x")).select("x.*")
    found = once.mapInArrow(run, "label double, place array<int>, value array<float>").toArrow().combine_chunks()
    label, (place, value) = found["label"].to_numpy(), ([x.chunk(0) for x in (found["place"], found["value"])] if len(found) else ((), ()))
    bounds = place.offsets.to_numpy() if len(found) else np.zeros(1, np.int32)
    place, value = (x.values.to_numpy() if len(found) else np.empty(0) for x in (place, value))
    # an order that does not depend on how the rows were dealt
    order = np.lexsort((np.add.reduceat(value, bounds[:-1]) if len(found) else (), label))
    machine = Machine(_size(len(metadata)))
    machine.fit([(place[bounds[i] : bounds[i + 1]], value[bounds[i] : bounds[i + 1]]) for i in order], label[order])
    return machine


def _scores(model, texts: pa.Array, metadata: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(texts))
    for first, rows, row, place, value in features(texts, metadata):
        out[first : first + rows] = 1 / (1 + np.exp(-np.clip(model.margins(row, place, value, rows), -40, 40)))
    return out


def score(docs: DataFrame, machine: Machine, *, key: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """Per document row: key and score."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model.value, batch.column(1), _columns(batch, 2)))], ["key", "score"])

    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *_metadata(metadata))
    return narrow.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def keep_good(docs: DataFrame, machine: Machine, *, text: str = "text", metadata: tuple[str, ...] = ("n_chars",), least: float = 0.7) -> DataFrame:
    """The documents, same columns, with a score of `least` or more."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    at, meta = docs.columns.index(text), [docs.columns.index(m) for m in metadata]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inputs = _columns(pa.RecordBatch.from_arrays([batch.column(k) for k in meta], list(map(str, meta))), 0) if meta else []
            yield batch.filter(pa.array(_scores(model.value, batch.column(at), inputs) >= least))

    return docs.mapInArrow(run, docs.schema)
