"""N-gram Jaccard join: a size-aware heavy-light join over word shingles.

Two documents link when their shingle sets have a Jaccard similarity of
THRESHOLD percent or more. All sets are put in one global order, rare shingles
first. By the prefix lemma, two linked sets that need an overlap of at least o
share at least l elements among their first n - o + l ones. Hence:

* small (light) sets, of at most x shingles, are joined on fixed-size subsets:
  all pairs out of their first n - o + 2 shingles (l = 2);
* every pair with a large (heavy) set is found in inverted lists: the first
  n - o + 1 shingles (l = 1) of the large sets, and of those small ones whose
  size allows a link with a large one.

The boundary x is the size with the least estimated cost of both parts.

Documents with equal sets are one class, and one class stands for all of them.
A key that many classes share is not expanded into all pairs: each class is
first held against one other class of its keys; then only classes in different
components are paired, and pairs whose sizes or parity bitmaps rule out a link
are never formed. Every remaining pair is verified on the whole sets, which are
made anew from the texts where these were dealt to: texts take a third of the
space of their hashed shingles.

Cases: a null or empty text, or one without words, has an empty set and links
with nothing; a text of fewer words than a shingle is one shingle; rows with
the same id count as one document in the links; a null id comes before all
others, so that its component has a null id; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from . import storage, textbatch

THRESHOLD = 85
#: Frequent shingles that are ordered by their counts, at most; the order of all others is that of their hashes.
MAX_FREQUENT = 200_000
#: A batch reports shingles that so many of its documents have.
REPORT = 4
#: Texts that are compared with one copy of their partner's text.
LEAVES = 500
#: Times that components are formed before all pairs across them are made.
ROUNDS = 5
_NULL = -(1 << 63)
_U = np.uint64
_BITS = 22


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Pieces of a batch: first row, and each row's distinct shingle hashes, sorted."""
    for w in textbatch.words(column):
        hashes, counts = w.hashes(), w.counts()
        found, at = textbatch.windows(hashes, w.bounds, size)
        bounds = np.searchsorted(at, w.bounds)
        sets = []
        for r in range(w.rows):
            if counts[r] >= size:
                sets.append(np.unique(found[bounds[r] : bounds[r + 1]]))
            elif counts[r]:
                own = hashes[w.bounds[r] : w.bounds[r + 1]]
                sets.append(textbatch.windows(own, np.array([0, len(own)]), len(own))[0])
            else:
                sets.append(found[:0])
        yield w.first, sets


def _print(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of a set."""
    a = textbatch.mix(s)
    return int(a.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(a * _U(0x9E3779B97F4A7C15) >> _U(7)).astype(np.int64)) if len(s) else 0


def _parity(s: np.ndarray) -> np.ndarray:
    """1024 bits: whether an odd number of shingles falls on each. Sets differ in at least as many shingles as parities in bits."""
    return np.packbits(np.bincount((s >> _U(54)).astype(np.int64), minlength=1024).astype(np.uint8) & 1).view(np.int64)


def need(n: int, threshold: int = THRESHOLD) -> int:
    """Least overlap of a set of n with any set that it links with."""
    return (threshold * n + 99) // 100


_FACTS = "kind int, id long, n int, f1 long, f2 long, parity array<long>"


def _facts(docs: DataFrame, size: int) -> DataFrame:
    """Kind 0: every document's set size, fingerprint and parity; kind 1: shingles (id) that n documents of a batch have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, sizes, f1, f2, parities, every = [], [], [], [], [], []
            for _, sets in shingle_sets(batch.column(1), size):
                for s in sets:
                    a, b = _print(s)
                    sizes.append(len(s))
                    f1.append(a)
                    f2.append(b)
                    parities.append(_parity(s))
                every.extend(sets)
            shingles, counts = np.unique(np.concatenate(every), return_counts=True) if every else (np.empty(0, _U), np.empty(0, np.int64))
            often = counts >= REPORT
            shingles, counts = shingles[often], counts[often]
            d, m = len(sizes), len(shingles)
            kinds = np.repeat(np.array([0, 1], np.int32), [d, m])
            flat = np.concatenate(parities) if parities else np.empty(0, np.int64)
            none = np.zeros(m, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(kinds), pa.array(np.concatenate((batch.column(0).to_numpy(zero_copy_only=False), shingles.view(np.int64)))), pa.array(np.concatenate((np.array(sizes, np.int32), counts.astype(np.int32)))),
                pa.array(np.concatenate((np.array(f1, np.int64), none))), pa.array(np.concatenate((np.array(f2, np.int64), none))),
                pa.ListArray.from_arrays(pa.array(np.concatenate((np.arange(d + 1), np.full(m, d))).astype(np.int32) * 16), pa.array(flat)),
            ], ["kind", "id", "n", "f1", "f2", "parity"])

    return docs.mapInArrow(run, _FACTS)


class _Order:
    """The global order: rare shingles by hash, then frequent ones by count."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray):
        order = np.argsort(frequent)
        self.shingles = frequent[order]
        rank = np.empty(len(frequent), np.int64)
        rank[np.lexsort((self.shingles, counts[order]))] = np.arange(len(frequent))
        self.rank = rank
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[self.shingles >> _U(64 - _BITS)] = True

    def first(self, s: np.ndarray, k: int) -> np.ndarray:
        """The first k of a set in the global order."""
        if not len(self.shingles):
            return s[:k]
        maybe = self.bits[s >> _U(64 - _BITS)]
        if not maybe.any():
            return s[:k]
        at = np.flatnonzero(maybe)
        place = np.minimum(np.searchsorted(self.shingles, s[at]), len(self.shingles) - 1)
        sure = self.shingles[place] == s[at]
        rare = np.ones(len(s), dtype=bool)
        rare[at[sure]] = False
        out = s[rare][:k]
        if len(out) < k:
            out = np.concatenate((out, s[at[sure]][np.argsort(self.rank[place[sure]])][: k - len(out)]))
        return out


def boundary(histogram: list[tuple[int, int]], list_length: float, threshold: int = THRESHOLD) -> int:
    """The largest light size: least cost of subsets of light sets and inverted lists of the others. histogram: (size, sets)."""

    def cost(x: int) -> float:
        total = 0.0
        for n, count in histogram:
            prefix = n - need(n, threshold) + 1
            if n <= x:
                total += count * (prefix + 1) * prefix / 2
            if n * 100 > threshold * x:
                total += count * prefix * list_length
        return total

    return min([0, *(n for n, _ in histogram)], key=cost)


def _keys(docs: DataFrame, order, light: int, size: int, threshold: int) -> DataFrame:
    """Join keys of every class, once in a partition: key, f1, f2, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys, rows = [], []
            for _, sets in shingle_sets(batch.column(1), size):
                for s in sets:
                    n = len(s)
                    if not n or (p := _print(s)) in seen:
                        continue
                    seen.add(p)
                    prefix = n - need(n, threshold) + 1
                    first = order.value.first(s, prefix + 1)
                    own = []
                    if n <= light and len(first) > 1:
                        i, j = np.triu_indices(len(first), 1)
                        a, b = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
                        own.append(textbatch.mix(a * _U(3) + textbatch.mix(b)))
                    if n * 100 > threshold * light:
                        own.append(textbatch.mix(first[:prefix] + _U(1)))
                    for k in own:
                        keys.append(k)
                        rows.append((len(k), *p, n))
            times = np.array([r[0] for r in rows], np.int64)
            column = lambda k, t: pa.array(np.repeat(np.array([r[k] for r in rows], t), times))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)), column(1, np.int64), column(2, np.int64), column(3, np.int32)], ["key", "f1", "f2", "n"])

    return docs.mapInArrow(run, "key long, f1 long, f2 long, n int")


def _sizes_allow(n, m, threshold: int):
    return F.least(n, m) * 100 >= F.greatest(n, m) * threshold


def _parities_allow(n, m, p, q, threshold: int):
    """Sets of n and m that overlap enough differ in n + m - 2 o shingles at most."""
    differ = F.aggregate(F.zip_with(p, q, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, b: a + b)
    most = (n + m) - 2 * F.ceil((n + m) * threshold / (100 + threshold) - 1e-9)
    return differ <= most


def _linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common * 100 >= (len(x) + len(y) - common) * threshold


def _similar(rows: DataFrame, size: int, threshold: int) -> DataFrame:
    """Of rows (center, salt, kind, id, text), dealt and sorted by the first three, the leaves (kind 1) whose sets are similar enough to the center's (kind 0) before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, own = None, {}  # its sets by fingerprint: rows of one id may have different texts
        for batch in batches:
            centers, kinds, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            hits = []
            for first, sets in shingle_sets(batch.column(4), size):
                for r, s in enumerate(sets, first):
                    if not len(s):
                        continue
                    if kinds[r] == 0:
                        center, own = centers[r], own if center == centers[r] else {}
                        own[_print(s)] = s
                    elif center == centers[r] and any(_linked(x, s, threshold) for x in own.values()):
                        hits.append(r)
            hits = np.array(hits, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[hits], centers[hits])), pa.array(np.maximum(ids[hits], centers[hits]))], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """Of written pairs (id, other), those whose whole sets are similar enough, as (a, b), a < b.

    Texts are dealt to the partner, `other`, whose own text goes along once for every LEAVES of its partners.
    """
    dealt = pairs.join(pairs.groupBy("other").agg(F.count("*").alias("leaves")), "other")
    dealt = storage.materialize(dealt.select("id", F.col("other").alias("center"), F.pmod(F.xxhash64("id"), F.ceil(F.col("leaves") / LEAVES)).cast("int").alias("salt")))
    texts = docs.select("id", "text")
    leaves = texts.join(storage.broadcast_if_small(dealt), "id").select("center", "salt", F.lit(1).alias("kind"), "id", "text")
    centers = storage.materialize(dealt.select(F.col("center").alias("id"), "salt").distinct())
    ahead = texts.join(storage.broadcast_if_small(centers), "id").select(F.col("id").alias("center"), "salt", F.lit(0).alias("kind"), "id", "text")
    rows = leaves.unionByName(ahead).repartition("center", "salt").sortWithinPartitions("center", "salt", "kind")
    found = storage.materialize(_similar(rows, size, threshold))
    storage.discard(dealt, centers)
    return found


def _parities_allowed(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (id, other and further columns), those whose parities allow a link."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}"))
    return pairs.join(side("id"), "id").join(side("other"), "other").where(_parities_allow(F.col("n_id"), F.col("n_other"), F.col("p_id"), F.col("p_other"), threshold)).select(pairs.columns)


def _parities_checked(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (id, other), each once, those whose parities allow a link, as a written table."""
    once = pairs.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.min("id").alias("id")).select("id", (F.col("a") + F.col("b") - F.col("id")).alias("other"))
    return storage.materialize(_parities_allowed(once, classes, threshold))


def join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 4, threshold: int = THRESHOLD) -> DataFrame:
    """Per document row: key, n_shingles and component_id (the smallest key reachable by links, its own included). Keys are integers."""
    docs = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL)).alias("id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    facts = storage.materialize(_facts(docs, size))
    documents = facts.where("kind = 0")
    # a class: documents with equal sets
    same = ("f1", "f2", "n")
    classes = storage.materialize(documents.where("n > 0").groupBy(*same).agg(F.min(F.struct("id", "parity")).alias("x")).select(*same, "x.id", "x.parity"))

    counted = facts.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(MAX_FREQUENT).toArrow()
    order = spark.sparkContext.broadcast(_Order(counted["id"].to_numpy().astype(np.int64).view(_U), counted["n"].to_numpy().astype(np.int64)))
    bins = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.05)))
    histogram = [(int(r.n), r.sets) for r in classes.groupBy(bins.alias("bin")).agg(F.max("n").alias("n"), F.count("*").alias("sets")).orderBy("n").collect()]
    short = counted["n"].to_numpy().astype(float)
    # lists of more than 50 stand at the end of the order, where few prefixes reach
    length = 1 + (short[short <= 50] ** 2).sum() / max(sum(n * c for n, c in histogram), 1)
    light = boundary(histogram, length, threshold)

    everyone = Window.partitionBy("key")
    keys = _keys(docs, order, light, size, threshold).select("*", F.min("f1").over(everyone).alias("lo"), F.max("f1").over(everyone).alias("hi")).where("lo <> hi").drop("lo", "hi")
    shared = storage.materialize(keys.dropDuplicates(["key", "f1", "f2"]).join(classes.select(*same, "id"), list(same)).select("key", "id", "n"))
    order.unpersist()

    # one other class for each: the key's own choice of a class, of all its keys the one with most keys in common;
    # then again among classes of different components, every choice whose parities allow a link: the keys of a very
    # common passage mostly choose unlike classes, and of pairs looked at here none is looked at below
    links = parts = tried = None
    rest = shared
    for turn in range(ROUNDS):
        chosen = F.min(F.struct(F.xxhash64(F.lit(turn), "key", "id").alias("h"), *(F.col(c) for c in rest.columns if c != "key"))).over(everyone)
        able = F.col("component") != F.col("c.component") if turn else F.col("id") != F.col("c.id")
        stars = rest.select("*", chosen.alias("c")).where(able & _sizes_allow(F.col("n"), F.col("c.n"), threshold)).groupBy("id", F.col("c.id").alias("other")).agg(F.count("*").alias("common"))
        if tried is not None:
            stars = stars.join(tried, ["id", "other"], "left_anti")
        picked = storage.materialize(_parities_allowed(stars.select("id", "other"), classes, threshold) if turn else stars.groupBy("id").agg(F.max(F.struct("common", "other")).alias("x")).select("id", "x.other"))
        best = _parities_checked(picked, classes, threshold)
        more = _verified(best, docs, size, threshold)
        # what was looked at is not looked at again, from either side
        both = picked.unionByName(picked.select(F.col("other").alias("id"), F.col("id").alias("other")))
        seen = storage.materialize(both if tried is None else tried.unionByName(both))
        every = more if links is None else storage.materialize(links.unionByName(more))
        found = storage.materialize(connected_components(every, "a", "b"))
        label = found.withColumnRenamed("node", "id")
        labelled = rest.select("key", "id", "n").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
        still = storage.materialize(labelled.select("*", F.min("component").over(everyone).alias("lo"), F.max("component").over(everyone).alias("hi")).where("lo <> hi").drop("lo", "hi"))
        done = still.isEmpty() or bool(turn and more.isEmpty())
        storage.discard(picked, best, rest, *([] if links is None else [links, more, parts, tried]))
        links, parts, tried, rest = every, found, seen, still
        if done:
            break

    # whatever shares a key across components
    sides = storage.materialize(rest.join(classes.select("id", "parity"), "id"))
    storage.discard(rest)
    x, y = sides.alias("x"), sides.alias("y")
    across = (F.col("x.component") < F.col("y.component")) & _sizes_allow(F.col("x.n"), F.col("y.n"), threshold) & _parities_allow(F.col("x.n"), F.col("y.n"), F.col("x.parity"), F.col("y.parity"), threshold)
    pairs = storage.materialize(x.join(y, (F.col("x.key") == F.col("y.key")) & across).select(F.least("x.id", "y.id").alias("id"), F.greatest("x.id", "y.id").alias("other")).distinct().join(tried, ["id", "other"], "left_anti"))
    # before texts are dealt, which take most space
    storage.discard(sides, tried, parts)
    more = _verified(pairs, docs, size, threshold)
    parts = storage.materialize(connected_components(links.unionByName(more), "a", "b"))
    storage.discard(pairs, links, more)

    labels = classes.select(*same, "id").join(parts.withColumnRenamed("node", "id"), "id", "left").select(*same, F.coalesce("component", "id").alias("component"))
    out = documents.select("id", *same).join(labels, list(same), "left")
    plain = lambda c: F.when(c != _NULL, c)
    return out.select(plain(F.col("id")).alias(key), F.col("n").cast("long").alias("n_shingles"), plain(F.coalesce("component", "id")).alias("component_id"))


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 4, threshold: int = THRESHOLD) -> DataFrame:
    """The documents, same columns, exactly one row of each component: of the smallest key (a null first), then the smallest text hash.

    Rows of one key count as one document, as in `join`. A null key says nothing
    of which document a row is, so that such rows are linked by their texts only.
    """
    # numbered in a written table, so that of equal rows the same one wins in every job
    rows = storage.materialize(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("at")))
    whole = rows.select("at", F.col("doc").getField(key).cast("long").alias("k"), F.col("doc").getField(text).alias("t"))
    found = join(whole, key="at", text="t", size=size, threshold=threshold).select("at", F.col("component_id").alias("component"))
    of = storage.materialize(whole.select("at", "k", F.xxhash64("t").alias("row")).join(found, "at"))
    parts = of.where("k is not null").select("k", "component").distinct()
    same = parts.join(parts.groupBy("k").agg(F.min("component").alias("other")), "k").where("component <> other").select("component", "other")
    merged = connected_components(storage.materialize(same), "component", "other").select(F.col("node").alias("component"), F.col("component").alias("whole"))
    group = F.coalesce("whole", "component").alias("group")
    kept = of.join(merged, "component", "left").groupBy(group).agg(F.min(F.struct("k", "row", "at")).alias("x"))
    kept = storage.materialize(kept.select(F.col("x.at").alias("at")))
    return rows.join(storage.broadcast_if_small(kept), "at", "left_semi").select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))
