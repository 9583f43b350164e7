"""Hard negatives by inner product, found through a table of distances to pivots.

A component more, sqrt(M^2 - |x|^2) with M the largest length, makes all vectors
equally long, so that with an anchor q, which gets a zero there,
d(q, x)^2 = |q|^2 + M^2 - 2 q.x: the inner product is a Euclidean distance. For
every vector its distances to a few pivots are stored. By the triangle
inequality |d(q, p) - d(x, p)| <= d(q, x) <= d(q, p) + d(x, p) they bracket each
score, first for all vectors of a tile, then for each; only those whose bracket
meets what is looked for are scored, in whole numbers.

Vectors are sorted by their nearest pivot and their distance to it, so that the
vectors of a tile have similar distances. Anchors, which are a share of the rows, are
sent to the executors in blocks of BLOCK_BYTES; each task keeps the best of
what it has read for each anchor, and these are put together by anchor. Each
row is scored against each anchor unless a bracket excludes it: no
candidates are capped, and the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

#: Pivots, and rows among which they are chosen (the rows of least hash), each far from the others.
PIVOTS, SAMPLE = 8, 2048
#: Bytes of a block of anchors, vectors and distances.
BLOCK_BYTES = 8 << 20
#: Rows, and anchors, that are bracketed together; found scores that are held before all but the best go.
TILE, ANCHORS, HELD = 512, 1024, 400_000


class Best:
    """The first `k` of each key by falling score, then by rising id."""

    def __init__(self, keys: int, k: int) -> None:
        self.k, self.floor, self.parts, self.size, self.kept = k, np.full(keys, np.iinfo(np.int64).min), [], 0, 0

    def add(self, key: np.ndarray, score: np.ndarray, name: np.ndarray, row: np.ndarray) -> None:
        if len(key):
            self.parts.append(np.stack([key.astype(np.int64), score, name, row]))
            self.size += len(key)
            if self.size > self.kept + HELD:
                self.shrink()

    def shrink(self) -> np.ndarray:
        """Keep the best; afterwards `floor` is the score that a key's next row must reach."""
        if not self.parts:
            return np.empty((4, 0), np.int64)
        all_ = np.concatenate(self.parts, axis=1)
        all_ = all_[:, np.lexsort((all_[3], all_[2], -all_[1], all_[0]))]
        begins = np.flatnonzero(np.r_[True, all_[0, 1:] != all_[0, :-1]])
        place = np.arange(all_.shape[1]) - np.repeat(begins, np.diff(np.r_[begins, all_.shape[1]]))
        full = all_[:, place == self.k - 1]
        self.floor[full[0]] = full[1]
        all_ = all_[:, place < self.k]
        self.parts, self.size, self.kept = [all_], all_.shape[1], all_.shape[1]
        return all_


def _far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the points, each the farthest from those before."""
    if not len(points):
        return points
    chosen = [int(np.argmax(((points - points.mean(axis=0)) ** 2).sum(axis=1)))]
    nearest = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < n and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(((points[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows, with zeros behind shorter ones."""
    offsets, values = np.asarray(column.offsets), np.asarray(column.values)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = values[offsets[0] : offsets[-1]]
    return out


def _augmented(vectors: np.ndarray, squares: float) -> np.ndarray:
    """The vectors, as doubles, with the component that makes all equally long."""
    v = vectors.astype(np.float64)
    return np.hstack([v, np.sqrt(np.maximum(squares - (v * v).sum(axis=1), 0))[:, None]])


class Block:
    """A block of anchors: vectors, distances to pivots, and what is looked for."""

    def __init__(self, anchors: pa.Table, pivots: np.ndarray, width: int, squares: float) -> None:
        self.vectors = _matrix(anchors["vector"].combine_chunks(), width)
        self.squares, self.pivots = squares, pivots
        v = self.vectors.astype(np.float64)
        self.lengths = (v * v).sum(axis=1)
        self.distances = _distances(np.hstack([v, np.zeros((len(v), 1))]), pivots)
        self.labels, self.rows = (np.asarray(anchors[c]) for c in ("label", "row"))
        #: Doubles multiply exactly up to here; the slack is what their distances may be off.
        self.exact, self.slack = squares < 2.0**53, 1 + 4e-6 * squares

    def scores(self, vectors: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        if self.exact:
            return (vectors.astype(np.float64) @ self.vectors[anchors].astype(np.float64).T).astype(np.int64)
        return vectors @ self.vectors[anchors].T

    def search(self, vectors: np.ndarray, distances: np.ndarray, anchors: np.ndarray, least: np.ndarray, most: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, score) where the score may be from `least` to `most` of the anchor; scores outside may be among them."""
        top = (self.lengths[anchors] + self.squares) / 2
        near, far = distances.min(axis=0), distances.max(axis=0)
        d = self.distances[anchors]
        gap = np.maximum(np.maximum(d - far, near - d).max(axis=1), 0)
        meets = top - gap * gap / 2 + self.slack >= least
        if most is not None:
            reach = (d + far).min(axis=1)
            meets &= top - reach * reach / 2 - self.slack <= most
        anchors, top, d, least = anchors[meets], top[meets], d[meets], least[meets]
        gap = np.zeros((len(vectors), len(anchors)))
        for p in range(d.shape[1]):
            np.maximum(gap, np.abs(distances[:, p, None] - d[None, :, p]), out=gap)
        meet = top - gap * gap / 2 + self.slack >= least
        if most is not None:
            reach = np.full(gap.shape, np.inf)
            for p in range(d.shape[1]):
                np.minimum(reach, distances[:, p, None] + d[None, :, p], out=reach)
            meet &= top - reach * reach / 2 - self.slack <= most[meets]
        row, at = np.nonzero(meet)
        if len(row) * 8 > meet.size:  # one product for all is cheaper than picking many pairs
            return row, anchors[at], self.scores(vectors, anchors)[row, at]
        pairs = (vectors[row] * self.vectors[anchors[at]]).sum(axis=1) if len(row) else np.empty(0, np.int64)
        return row, anchors[at], pairs


def _tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        vectors, distances = _matrix(batch.column("vector"), width), np.stack(batch.column("distances").to_numpy(zero_copy_only=False)) if batch.num_rows else None
        names, rows, labels = (batch.column(c).to_numpy() for c in ("vec_id", "row", "label"))
        for k in range(0, batch.num_rows, TILE):
            here = slice(k, k + TILE)
            yield vectors[here], distances[here].astype(np.float64), names[here], rows[here], labels[here]


def _emit(best: Best, first: list[int], slots: int) -> Iterator[pa.RecordBatch]:
    key, score, name, row = best.shrink()
    yield pa.record_batch([pa.array(np.array(first, np.int64)[key // slots]), pa.array((key % slots).astype(np.int32)), pa.array(score), pa.array(name), pa.array(row)], ["anchor_row", "slot", "score", "vec_id", "row"])


_FOUND = "anchor_row long, slot int, score long, vec_id long, row long"


def _near(block: Block, width: int, k: int) -> Callable:
    """Finds the first k other rows of the anchors' labels."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.labels), k)
        of_label = {x: np.flatnonzero(block.labels == x) for x in np.unique(block.labels).tolist()}
        for vectors, distances, names, rows, labels in _tiles(batches, width):
            for label in np.unique(labels).tolist():
                same, wanted = np.flatnonzero(labels == label), of_label.get(label, ())
                for at in range(0, len(wanted), ANCHORS):
                    anchors = wanted[at : at + ANCHORS]
                    row, anchor, score = block.search(vectors[same], distances[same], anchors, best.floor[anchors], None)
                    row = same[row]
                    fine = (score >= best.floor[anchor]) & (rows[row] != block.rows[anchor])
                    best.add(anchor[fine], score[fine], names[row[fine]], rows[row[fine]])
        yield from _emit(best, block.rows.tolist(), 1)

    return find


def _between(block: Block, width: int, k: int, low: np.ndarray, high: np.ndarray) -> Callable:
    """Finds for each anchor and slot the first k rows of other labels that score from low to high."""
    slots = low.shape[1]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.labels) * slots, k)
        for vectors, distances, names, rows, labels in _tiles(batches, width):
            for at in range(0, len(block.labels), ANCHORS):
                anchors = np.arange(at, min(at + ANCHORS, len(block.labels)))
                floor = best.floor.reshape(-1, slots)
                row, anchor, score = block.search(vectors, distances, anchors, np.maximum(low[anchors], floor[anchors]).min(axis=1), high[anchors].max(axis=1))
                other = labels[row] != block.labels[anchor]
                row, anchor, score = row[other], anchor[other], score[other]
                for slot in range(slots):
                    fine = (score >= np.maximum(low[anchor, slot], best.floor[anchor * slots + slot])) & (score <= high[anchor, slot])
                    best.add(anchor[fine] * slots + slot, score[fine], names[row[fine]], rows[row[fine]])
        yield from _emit(best, block.rows.tolist(), slots)

    return find


def build(vectors: DataFrame, scale: int = 256) -> tuple[DataFrame, np.ndarray, int, float]:
    """(The index, its pivots, the number of components, the largest square of a length).

    The index has a row for each row of `vectors` (vec_id, embedding, label)
    without a null or non-finite value: vec_id, label, row (its number), vector
    (components times `scale`, rounded down) and distances to the pivots.
    Shorter vectors have zeros behind.
    """
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    rows = storage.materialize(vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("vector"), F.monotonically_increasing_id().alias("row")))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    most = rows.agg(F.max(F.size("vector")), F.max(square)).first()
    width, squares = int(most[0] or 0), float(most[1] or 0)
    sample = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(SAMPLE).select("vector").toArrow()
    pivots = _far_apart(_augmented(_matrix(sample["vector"].combine_chunks(), width), squares), PIVOTS) if sample.num_rows else np.zeros((1, width + 1))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _distances(_augmented(_matrix(batch.column("vector"), width), squares), pivots)
            near = found.argmin(axis=1)
            more = [pa.FixedSizeListArray.from_arrays(pa.array(found.ravel().astype(np.float32)), found.shape[1]).cast(pa.list_(pa.float32())), pa.array(near.astype(np.int32)), pa.array(found[np.arange(len(near)), near])]
            yield pa.record_batch([batch.column(c) for c in ("vec_id", "label", "row", "vector")] + more, ["vec_id", "label", "row", "vector", "distances", "near", "apart"])

    measured = rows.mapInArrow(measure, "vec_id long, label long, row long, vector array<long>, distances array<float>, near int, apart double")
    # equal vectors, of which there may be very many, are told apart by their number
    dealt = measured.repartitionByRange("near", "apart", "row").sortWithinPartitions("near", "apart").drop("near", "apart")
    index = storage.materialize(dealt)
    storage.discard(rows)
    return index, pivots, width, squares


def _blocks(anchors: DataFrame, width: int) -> tuple[DataFrame, int]:
    """(Anchors with their block, number of blocks), none of more than BLOCK_BYTES."""
    most, n, blocks = max(1, BLOCK_BYTES // (8 * (width + PIVOTS + 16))), anchors.count(), 1
    while n:
        blocks = max(blocks, -(-n // most))
        dealt = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
        if dealt.groupBy("block").count().agg(F.max("count")).first()[0] <= most:
            return dealt, blocks
        blocks += -(-blocks // 8)
    return anchors.withColumn("block", F.lit(0)), 0


def _first(found: DataFrame, n: int, name: str) -> DataFrame:
    """Of what the tasks have found, the first n of each anchor and slot."""
    order = "row_number() OVER (PARTITION BY anchor_row, slot ORDER BY score DESC, vec_id, row)"
    return found.withColumn(name, F.expr(order)).where(F.col(name) <= n)


def mine(vectors: DataFrame, anchor: Column, *, scale: int = 256, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """Per anchor and positive its first hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Needs vec_id, embedding and label; `anchor` says which rows are anchors. An
    anchor's positives are its best other rows of the same label; a negative
    is of another label and scores `least` to `most` percent of the positive.
    Scores are inner products of the components times `scale`, rounded down;
    ties go to the smaller vec_id. Rows with a null or a non-finite component take
    no part; repeated rows are rows of their own; other columns are not looked at.
    """
    index, pivots, width, squares = build(vectors, scale)
    spark = index.sparkSession
    anchors, blocks = _blocks(storage.materialize(index.where(F.coalesce(anchor, F.lit(False))).select("vec_id", "label", "row", "vector")), width)
    tasks = max(4, 2 * spark.sparkContext.defaultParallelism)
    scan = index.coalesce(tasks)  # fewer tasks, each with the best of more rows
    near, between = [], []

    def block(b: int, table: DataFrame, finder: Callable) -> DataFrame:
        """What the tasks find for a block of anchors, written."""
        held = table.where(F.col("block") == b).orderBy("row").toArrow()
        sent = spark.sparkContext.broadcast(Block(held, pivots, width, squares))
        more = [np.asarray(held[c].combine_chunks().values).reshape(-1, positives) for c in ("low", "high")] if "low" in table.columns else []
        found = storage.materialize(scan.mapInArrow(lambda batches: finder(sent.value, *more)(batches), _FOUND))
        sent.unpersist()
        return found

    for b in range(blocks):
        near.append(block(b, anchors, lambda x: _near(x, width, positives)))
    empty = spark.createDataFrame([], _FOUND)
    chosen = storage.materialize(_first(reduce(DataFrame.unionByName, near, empty), positives, "place").select("anchor_row", F.col("place").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    storage.discard(*near)
    # what is looked for, by slot: nothing where there are fewer positives
    score = lambda k: F.max(F.when(F.col("slot") == k + 1, F.col("positive_score")))
    low = F.array(*(F.coalesce(-F.floor(-least * score(k) / 100), F.lit(1)).cast("long") for k in range(positives)))
    high = F.array(*(F.coalesce(F.floor(most * score(k) / 100), F.lit(0)).cast("long") for k in range(positives)))
    sought = chosen.groupBy(F.col("anchor_row").alias("row")).agg(low.alias("low"), high.alias("high"))
    table = storage.materialize(anchors.join(sought, "row"))
    for b in range(blocks):
        between.append(block(b, table, lambda x, lo, hi: _between(x, width, negatives, lo, hi)))
    ranked = _first(reduce(DataFrame.unionByName, between, empty), negatives, "rank").select("anchor_row", (F.col("slot") + 1).alias("slot"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    return ranked.join(chosen, ["anchor_row", "slot"]).join(named, "anchor_row").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
