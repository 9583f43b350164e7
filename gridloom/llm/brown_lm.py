"""Language-model scoring with Brown classes.

Words are grouped into classes by exchange clustering over bigram counts of the
training documents. The start is found on the driver: every frequent word is a
unit, the other words are units by their ending, and units move between classes
as long as the likelihood of the class bigrams grows. Then each other word of
the training documents, however rare, leaves its ending for the class that its
own neighbours in all these documents make likeliest. A token has the probability

    P(class | class before) * P(word | class)

with transitions smoothed towards the class frequencies, and emissions
(c + 0.1) / (tokens of the class + 0.1 * (its words + its unseen slots)); words
never seen have no neighbours to go by: they stay with their ending, of which
each has one slot for all of them, so that the probabilities of a class add up
to 1. Beside it stands the plain unigram score.

The counts of all words are gathered from the whole corpus. The LOOKUP most
frequent words are broadcast with their counts and classes; occurrences of
every other word are shuffled to the word, which settles its count and class,
and back to their text. The driver holds unit bigrams and the lookup only,
whose sizes are fixed by parameters.

Cases: a null text is empty and has one token, its end; without training
documents all counts are 0; repeated rows are scored each; a null id is not
held out; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage, textbatch

#: Words that are units of their own, endings of other words, classes, rounds of exchange.
TOP, ENDINGS, CLASSES, ROUNDS = 500, 63, 64, 4
#: Words whose counts are broadcast.
LOOKUP = 150_000
ADD = 0.1
#: Weight, in tokens, of the class frequencies in a transition.
PRIOR = 20.0
_U = np.uint64
_BITS = 22


def endings(w: textbatch.Words) -> np.ndarray:
    """The ending (a hash of the last two bytes) of each word."""
    if not len(w.start):
        return np.empty(0, np.int64)
    last = w.data[w.end - 1].astype(np.int64)
    before = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.int64)
    return (last * 31 + before * 7) % ENDINGS


class Lookup:
    """Frequent words by hash; units 0..TOP-1 are the first TOP of them, then come endings, then the end of a text."""

    end = TOP + ENDINGS
    units = TOP + ENDINGS + 1

    def __init__(self, hashes: np.ndarray):
        """hashes: most frequent first."""
        order = np.argsort(hashes)
        self.hashes, self.rank = hashes[order], order
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[self.hashes >> _U(64 - _BITS)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Rank of each word, -1 where it is not here."""
        out = np.full(len(h), -1, np.int64)
        at = np.flatnonzero(self.bits[h >> _U(64 - _BITS)]) if len(self.hashes) else np.empty(0, np.int64)
        if len(at):
            place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            out[at] = np.where(self.hashes[place] == h[at], self.rank[place], -1)
        return out

    def unit(self, rank: np.ndarray, w: textbatch.Words) -> np.ndarray:
        return np.where((rank >= 0) & (rank < TOP), rank, TOP + endings(w))


def _frequent(train: DataFrame, text: str) -> np.ndarray:
    """Hashes of the LOOKUP most frequent words by their exact counts, the same however the texts are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(w.hashes(), return_counts=True) for w in textbatch.words(batch.column(0))]
            if found:
                h, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([c for _, c in found]), minlength=len(h)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["hash", "n"])

    rows = train.select(F.col(text)).mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    return rows.orderBy(F.desc("n"), "hash").limit(LOOKUP).select("hash").toPandas()["hash"].to_numpy(np.int64).view(_U)


def _counts(train: DataFrame, text: str, lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts of the lookup's words by rank, bigram counts of units, endings by rank or -1 for units of their own); exact, over all training texts."""
    units = Lookup.units

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(len(lookup.value.hashes), np.int64)
        pairs = np.zeros(units * units, np.int64)
        ending = np.zeros(len(own), np.int64)
        for batch in batches:
            for w in textbatch.words(batch.column(0)):
                rank = lookup.value.find(w.hashes())
                ending[rank[rank >= 0]] = endings(w)[rank >= 0]
                own += np.bincount(rank[rank >= 0], minlength=len(own))
                sequence = np.insert(lookup.value.unit(rank, w), w.bounds[1:], Lookup.end)
                before = np.concatenate(([Lookup.end], sequence[:-1]))
                pairs += np.bincount(before * units + sequence, minlength=len(pairs))
        for kind, x in enumerate((own, pairs)):
            at = np.flatnonzero(x)
            extra = ending[at] if kind == 0 else np.zeros(len(at), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(x[at]), pa.array(extra)], ["kind", "at", "n", "ending"])

    rows = train.select(F.col(text)).mapInArrow(run, "kind int, at long, n long, ending long").groupBy("kind", "at").agg(F.sum("n").alias("n"), F.max("ending").alias("ending")).toPandas()
    ending = np.full(len(lookup.value.hashes), -1, np.int64)
    own, pairs = np.zeros(len(lookup.value.hashes), np.int64), np.zeros(units * units, np.int64)
    for kind, x in enumerate((own, pairs)):
        part = rows[rows["kind"] == kind]
        x[part["at"].to_numpy(np.int64)] = part["n"].to_numpy(np.int64)
        if kind == 0:
            ending[part["at"].to_numpy(np.int64)] = part["ending"].to_numpy(np.int64)
    ending[:TOP] = -1
    return own, pairs.reshape(units, units), ending


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit: each moves to the class where the likelihood of the class bigrams grows most, round by round."""
    units = len(pairs)
    pairs = pairs.astype(float)
    weight = pairs.sum(axis=0)
    order = np.argsort(-weight, kind="stable")
    of = np.empty(units, np.int64)
    of[order] = np.arange(units) % classes
    member = np.zeros((units, classes))
    member[np.arange(units), of] = 1
    table = member.T @ pairs @ member
    for _ in range(rounds):
        moved = 0
        for u in order:
            self_pairs, g = pairs[u, u], of[u]
            member[u, g] = 0
            out, into = pairs[u] @ member, pairs[:, u] @ member
            table[g, :] -= out
            table[:, g] -= into
            table[g, g] -= self_pairs
            diagonal = np.diag(table)
            gain = (_plogp(table + out) - _plogp(table)).sum(axis=1) + (_plogp(table.T + into) - _plogp(table.T)).sum(axis=1)
            # the diagonal changes once, by all three parts
            gain -= _plogp(diagonal + out) - _plogp(diagonal) + _plogp(diagonal + into) - _plogp(diagonal)
            gain += _plogp(diagonal + out + into + self_pairs) - _plogp(diagonal)
            for sums, n in ((table.sum(axis=1), out.sum() + self_pairs), (table.sum(axis=0), into.sum() + self_pairs)):
                gain -= _plogp(sums + n) - _plogp(sums)
            k = int(np.argmax(gain))
            if gain[k] <= gain[g] + 1e-9:
                k = g
            moved += k != g
            of[u] = k
            member[u, k] = 1
            table[k, :] += out
            table[:, k] += into
            table[k, k] += self_pairs
        if not moved:
            break
    return of


def _log_table(table: np.ndarray) -> np.ndarray:
    return np.log(table + 0.5)


def best_class(table: np.ndarray, before: np.ndarray, after: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of words with counts of the classes before and after them (a row each), the class that makes these likeliest, their own part of their start class left out."""
    table, words = table.astype(float), np.arange(len(start))
    rows, columns = table.sum(axis=1), table.sum(axis=0)
    n_before, n_after = before.sum(axis=1), after.sum(axis=1)
    into, out = _log_table(table) - np.log(columns + 0.5 * len(table)), _log_table(table) - np.log(rows + 0.5 * len(table))[:, None]
    gain = before @ into + after @ out.T
    left = (before * _log_table(np.maximum(table.T[start] - before, 0))).sum(axis=1) - n_before * np.log(np.maximum(columns[start] - n_before, 0) + 0.5 * len(table))
    right = (after * _log_table(np.maximum(table[start] - after, 0))).sum(axis=1) - n_after * np.log(np.maximum(rows[start] - n_after, 0) + 0.5 * len(table))
    gain[words, start] = left + right
    found = gain.argmax(axis=1)
    return np.where(gain[words, found] > gain[words, start] + 1e-9, found, start)


def _whole(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.Table]:
    """Rows sorted by their first columns, cut only where these change."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in range(keys):
            column = batch.column(k).to_numpy(zero_copy_only=False)
            change |= column[1:] != column[:-1]
        cut = np.flatnonzero(change)
        if len(cut):
            yield pa.Table.from_batches([*held, batch.slice(0, cut[-1] + 1)]).combine_chunks()
            held = [batch.slice(cut[-1] + 1)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a row's keys are not those of the row before."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows, bytes of each row) of a binary column."""
    data, at = textbatch.text_buffers(column)
    return np.frombuffer(data.tobytes(), dtype), np.diff(at)


def _around(m: Lookup, w: textbatch.Words, of: np.ndarray, rank: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(start class, class) of every token, ends of texts included; the class is that of the lookup, -1 of words outside."""
    unit = np.insert(m.unit(rank, w), w.bounds[1:], Lookup.end)
    start = of[unit]
    if own is None:
        return start, start
    known = np.where(rank >= 0, own[np.maximum(rank, 0)], -1) if len(own) else np.full(len(rank), -1)
    return start, np.insert(known, w.bounds[1:], of[Lookup.end])


def _classes(train: DataFrame, lookup, of: np.ndarray, table: np.ndarray, endings_of: np.ndarray) -> np.ndarray:
    """The class of each word of the lookup, by rank: of the first TOP that of the exchange, of the others the likeliest by all their neighbours."""
    width = 2 * CLASSES

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lookup.value
        seen = np.zeros((max(len(m.hashes) - TOP, 0), width), np.int32)
        for batch in batches:
            for w in textbatch.words(batch.column(0)):
                rank = m.find(w.hashes())
                start, _ = _around(m, w, of, rank)
                rank = np.insert(rank, w.bounds[1:], -1)
                at = np.flatnonzero(rank >= TOP)
                # the token before the first of a text is the end of another; a word is never the last token
                before = np.concatenate(([of[Lookup.end]], start[:-1]))[at]
                cells = np.concatenate(((rank[at] - TOP) * width + before, (rank[at] - TOP) * width + CLASSES + start[at + 1]))
                cell, n = np.unique(cells, return_counts=True)
                seen.ravel()[cell] += n.astype(np.int32)
        for first in range(0, len(seen), 10_000):
            part = seen[first : first + 10_000]
            word, cell = np.nonzero(part)
            some = np.unique(word)
            bounds = np.append(np.searchsorted(word, some), len(word))
            yield pa.RecordBatch.from_arrays([pa.array(some + first + TOP), _binary(cell.astype(np.uint8), bounds), _binary(part[word, cell], bounds * 4)], ["rank", "cell", "n"])

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches):
            rank = rows["rank"].to_numpy()
            own, at = np.unique(rank, return_inverse=True)
            cell, size = _bytes(rows["cell"], np.uint8)
            n, _ = _bytes(rows["n"], np.int32)
            for first in range(0, len(own), 10_000):
                some = own[first : first + 10_000]
                word = np.repeat(at, size) - first
                inside = (word >= 0) & (word < len(some))
                sums = np.bincount(word[inside] * width + cell[inside], weights=n[inside], minlength=len(some) * width).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(best_class(table, sums[:, :CLASSES], sums[:, CLASSES:], of[TOP + endings_of[some]]))], ["rank", "class"])

    rows = train.select("text").mapInArrow(contexts, "rank long, cell binary, n binary").repartition("rank").sortWithinPartitions("rank").mapInArrow(settled, "rank long, class long").toPandas()
    own = np.concatenate((of[: min(TOP, len(endings_of))], of[TOP + np.maximum(endings_of[TOP:], 0)]))
    own[rows["rank"].to_numpy(np.int64)] = rows["class"].to_numpy(np.int64)
    return own


class Model:
    """What scoring needs of the training corpus, beside the counts and classes of rare words."""

    def __init__(self, lookup: Lookup, counts: np.ndarray, own: np.ndarray, of: np.ndarray, table: np.ndarray, rare_words: np.ndarray, texts: int):
        """own: classes of the lookup's words; of: of units at the start; table: bigrams of classes; rare_words: by class, distinct training words that are not in the lookup."""
        self.lookup, self.own, self.of, self.texts = lookup, own, of, texts
        self.train_tokens = int(table.sum())
        self.log_counts = np.log10(counts + ADD)
        self.words = int((counts > 0).sum()) + int(rare_words.sum()) + (texts > 0)
        frequency = (table.sum(axis=0) + 1) / (table.sum() + CLASSES)
        self.transition = np.log10((table + PRIOR * frequency) / (table.sum(axis=1, keepdims=True) + PRIOR))
        distinct = np.bincount(own[counts > 0], minlength=CLASSES) + rare_words
        slots = np.bincount(of[TOP : TOP + ENDINGS], minlength=CLASSES)
        # the end of a text is a word of its class, seen or not
        slots[of[Lookup.end]] += 1
        self.emission = np.log10(np.maximum(table.sum(axis=0) + ADD * (distinct + slots), ADD))

    def base(self, log_counts: Column, tokens: Column) -> Column:
        return log_counts - tokens * float(np.log10(self.train_tokens + ADD * (self.words + 1)))


def _rare(docs: DataFrame, lookup, own, of: np.ndarray) -> DataFrame:
    """Occurrences of words outside the lookup: hash, file, index, pos, and facts: whether in a training text, the word's start class, start classes before and after, classes before and after (CLASSES: of a word outside, too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lookup.value
        for batch in batches:
            file, index = (batch.column(k).to_numpy() for k in (0, 1))
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = []
            for w in textbatch.words(batch.column(3)):
                h = w.hashes()
                rank = m.find(h)
                start, final = _around(m, w, of, rank, own.value)
                final = np.where(final < 0, CLASSES, final)
                word = np.flatnonzero(rank < 0)
                at = word + w.row[word]
                row = w.row[word] + w.first
                first = of[Lookup.end]
                packed = train[row]
                for x in (start[at], np.concatenate(([first], start[:-1]))[at], start[at + 1], np.concatenate(([first], final[:-1]))[at], final[at + 1]):
                    packed = packed << 7 | x
                parts.append((h[word].view(np.int64), row, at - w.bounds[w.row[word]] - w.row[word], packed))
            if parts:
                h, row, pos, packed = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(file[row]), pa.array(index[row]), pa.array(pos.astype(np.int32)), pa.array(packed)], ["hash", "file", "index", "pos", "facts"])

    return docs.select("file", "index", "train", "text").mapInArrow(run, "hash long, file long, index long, pos int, facts long")


def _settled(rare: DataFrame, table: np.ndarray) -> DataFrame:
    """Of rare words' occurrences: file, index, pos, c (the word's count) and facts: whether the first of a training word, whether in a training text, class, classes before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches):
            h, facts = rows["hash"].to_numpy(), rows["facts"].to_numpy()
            train, (start, before, after) = facts >> 35, ((facts >> k) & 127 for k in (28, 21, 14))
            begin = _starts(h)
            word = np.zeros(len(h), np.int64)
            word[begin[1:]] = 1
            word = np.cumsum(word)
            c = np.add.reduceat(train, begin)
            found = start[begin]
            for first in range(0, len(begin), 10_000):
                n = min(10_000, len(begin) - first)
                inside = np.flatnonzero((word >= first) & (word < first + n) & (train == 1)) if len(begin) > 10_000 else np.flatnonzero(train == 1)
                cells = lambda x: np.bincount((word[inside] - first) * CLASSES + x[inside], minlength=n * CLASSES).reshape(n, CLASSES)  # noqa: E731, B023
                found[first : first + n] = best_class(table, cells(before), cells(after), found[first : first + n])
            lead = np.zeros(len(h), np.int64)
            lead[begin] = c > 0
            packed = ((lead << 1 | train) << 7 | found[word]) << 14 | facts & 0x3FFF
            yield pa.RecordBatch.from_arrays([rows["file"].combine_chunks(), rows["index"].combine_chunks(), rows["pos"].combine_chunks(), pa.array(c[word]), pa.array(packed)], ["file", "index", "pos", "c", "facts"])

    return rare.repartition("hash").sortWithinPartitions("hash").mapInArrow(run, "file long, index long, pos int, c long, facts long")


def _by_text(settled: DataFrame) -> DataFrame:
    """Per text with rare words: file, index, log_counts and known of these, and steps: of each its class before, class, class after (CLASSES where the next counts it) and lead and train as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, keys=2):
            file, index, c, facts = (rows[k].to_numpy() for k in ("file", "index", "c", "facts"))
            begin = _starts(file, index)
            group, before, after = ((facts >> k) & 127 for k in (14, 7, 0))
            # beside another rare word, that word is the row before
            before = np.where(before == CLASSES, np.concatenate(([0], group[:-1])), before)
            steps = np.stack((before, group, after, facts >> 21), axis=1).astype(np.uint8)
            bounds = np.append(begin, len(file))
            yield pa.RecordBatch.from_arrays([
                pa.array(file[begin]), pa.array(index[begin]), pa.array(np.add.reduceat(np.log10(c + ADD), begin)), pa.array(np.add.reduceat((c > 0).astype(np.int64), begin)), _binary(steps, bounds * 4),
            ], ["file", "index", "log_counts", "known", "steps"])

    dealt = settled.repartition("file", "index").sortWithinPartitions("file", "index", "pos")
    return dealt.mapInArrow(run, "file long, index long, log_counts double, known long, steps binary")


def _table(whole: DataFrame, by_text: DataFrame, lookup, own, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bigrams of classes over all training tokens, distinct rare training words by class)."""
    size = CLASSES * CLASSES

    def sums(total: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = lookup.value, np.zeros(size, np.int64)
        for batch in batches:
            for w in textbatch.words(batch.column(0)):
                _, final = _around(m, w, of, m.find(w.hashes()), own.value)
                before = np.concatenate(([of[Lookup.end]], final[:-1]))
                both = (before >= 0) & (final >= 0)
                total += np.bincount(before[both] * CLASSES + final[both], minlength=size)
        yield sums(total)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + CLASSES, np.int64)
        for batch in batches:
            before, group, after, bits = _bytes(batch.column(0), np.uint8)[0].reshape(-1, 4).astype(np.int64).T
            train = (bits & 1) == 1
            total[:size] += np.bincount((before * CLASSES + group)[train], minlength=size)
            closed = train & (after < CLASSES)
            total[:size] += np.bincount((group * CLASSES + after)[closed], minlength=size)
            total[size:] += np.bincount(group[bits >= 2], minlength=CLASSES)
        yield sums(total)

    parts = whole.where("train").select("text").mapInArrow(known, "at long, n long").unionByName(by_text.select("steps").mapInArrow(rare, "at long, n long"))
    found = parts.groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(size + CLASSES, np.int64)
    total[found["at"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return total[:size].reshape(CLASSES, CLASSES), total[size:]


def _rare_scores(by_text: DataFrame, model) -> DataFrame:
    """Per text with rare words: f, i, rare_logs, rare_known and rare_rest: transitions at these words less their emission denominators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        wide = np.hstack((m.transition, np.zeros((CLASSES, 1))))
        for batch in batches:
            data, size = _bytes(batch.column(4), np.uint8)
            before, group, after, _ = data.reshape(-1, 4).astype(np.int64).T
            rest = m.transition[before, group] + wide[group, after] - m.emission[group]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(textbatch.row_sums(rest, np.concatenate(([0], np.cumsum(size // 4)))))], ["f", "i", "rare_logs", "rare_known", "rare_rest"])

    return by_text.mapInArrow(run, "f long, i long, rare_logs double, rare_known long, rare_rest double")


def _known(docs: DataFrame, model) -> DataFrame:
    """Per text: id, file, index, n_tokens, known and log_counts of lookup words and end, and rest: transitions between these less their emission denominators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, parts = model.value, []
            wide = np.zeros((CLASSES + 1, CLASSES + 1))
            wide[:CLASSES, :CLASSES] = m.transition
            less = np.append(m.emission, 0.0)
            for w in textbatch.words(batch.column(3)):
                rank = m.lookup.find(w.hashes())
                starts = w.bounds[:-1] + np.arange(w.rows)
                _, group = _around(m.lookup, w, m.of, rank, m.own)
                steps = wide[np.concatenate(([m.of[Lookup.end]], group[:-1])), group] - less[group]  # -1: the last row, column
                logs = np.where(rank >= 0, m.log_counts[np.maximum(rank, 0)] if len(m.log_counts) else 0.0, 0.0)
                end = float(np.log10(m.texts + ADD))
                parts.append((w.counts() + 1, textbatch.row_sums((rank >= 0).astype(np.int64), w.bounds) + (m.texts > 0), textbatch.row_sums(logs, w.bounds) + end, np.add.reduceat(steps, starts)))
            if parts:
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *(pa.array(np.concatenate(x)) for x in zip(*parts, strict=True))], ["id", "file", "index", "n_tokens", "known", "log_counts", "rest"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "file", "index", "text").mapInArrow(run, f"id {kind}, file long, index long, n_tokens long, known long, log_counts double, rest double")


def score(docs: DataFrame, held_out: Column, *, key: str = "doc_id", text: str = "text", row: tuple[Column, Column] | None = None) -> DataFrame:
    """Per document row: key, held_out, n_tokens, n_known, train_tokens, base_score and score. Learns from rows that are not held out.

    row: two long columns that name a row of docs, such as storage.file_row() of a table that is read; without it, docs are numbered in a written table.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(held_out, F.lit(False))
    file, index = row or (F.lit(0).cast("long"), F.monotonically_increasing_id())
    whole = docs.select(F.col(key).alias("id"), file.alias("file"), index.alias("index"), (~held_out).alias("train"), F.col(text).alias("text"))
    if row is None:
        whole = storage.materialize(whole)
    train = whole.where("train")
    lookup = spark.sparkContext.broadcast(Lookup(_frequent(train, "text")))
    counts, pairs, lookup_endings = _counts(train, "text", lookup)
    of = exchange(pairs)
    member = np.zeros((Lookup.units, CLASSES))
    member[np.arange(Lookup.units), of] = 1
    start = member.T @ pairs @ member

    own = spark.sparkContext.broadcast(_classes(train, lookup, of, start, lookup_endings))
    by_text = storage.materialize(_by_text(_settled(_rare(whole, lookup, own, of), start)))
    table, rare_words = _table(whole, by_text, lookup, own, of)

    model = Model(lookup.value, counts, own.value, of, table, rare_words, int(pairs.sum(axis=0)[Lookup.end]))
    shared = spark.sparkContext.broadcast(model)
    known = _known(whole, shared)
    joined = known.join(_rare_scores(by_text, shared), (F.col("file") == F.col("f")) & (F.col("index") == F.col("i")), "left")
    logs = F.col("log_counts") + F.coalesce("rare_logs", F.lit(0.0))
    return joined.select(
        F.col("id").alias(key), "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        model.base(logs, F.col("n_tokens")).alias("base_score"), (logs + F.col("rest") + F.coalesce("rare_rest", F.lit(0.0))).alias("score"),
    )
