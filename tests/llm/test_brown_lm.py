"""The class model against plain Python: every training word has a class of its own finding, in the lookup or not."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import brown_lm, textbatch


def _texts() -> list[str | None]:
    """Frequent words of two kinds in turn; rare ones, all with the same ending, that stand for one kind or the other, also side by side."""
    r = random.Random(5)
    kinds = [[f"{k}{i:03d}" for i in range(260)] for k in "ab"]
    rare = [[f"{k}rare{i}ing" for i in range(150)] for k in "xy"]
    out: list[str | None] = [None, "", "aonly xunseen0ing bonly"]
    for _ in range(600):
        words = [r.choice((rare if r.random() < 0.12 else kinds)[i % 2]) for i in range(40)]
        out.append(" ".join(words).title())
    return out


def _plain(texts: list[str | None], train: list[bool]) -> tuple[list[float], dict[str, int]]:
    words = [(t or "").lower().split() for t in texts]
    count = Counter(w for ws, own in zip(words, train, strict=True) if own for w in ws)
    hashed = lambda ws: next(textbatch.words(pa.array([" ".join(ws)]))).hashes().view(np.int64).tolist()
    order = sorted(count, key=lambda w: (-count[w], hashed([w])[0]))
    unit = {w: k for k, w in enumerate(order[: brown_lm.TOP])}
    end = brown_lm.TOP + brown_lm.ENDINGS
    of_ending = lambda w: brown_lm.TOP + int(brown_lm.endings(next(textbatch.words(pa.array([w]))))[0])
    units = [[unit[w] if w in unit else of_ending(w) for w in ws] + [end] for ws in words]
    pairs = np.zeros((end + 1, end + 1), np.int64)
    for us, own in zip(units, train, strict=True):
        for x, y in zip([end, *us], us):
            pairs[x, y] += own
    of = brown_lm.exchange(pairs)
    start = np.zeros((brown_lm.CLASSES, brown_lm.CLASSES))
    np.add.at(start, (of[:, None], of[None, :]), pairs)
    around = defaultdict(lambda: np.zeros((2, brown_lm.CLASSES)))
    for ws, us, own in zip(words, units, train, strict=True):
        for i, w in enumerate(ws):
            if own and w not in unit:
                around[w][0, of[us[i - 1] if i else end]] += 1
                around[w][1, of[us[i + 1]]] += 1
    group = {w: int(of[u]) for w, u in unit.items()}
    for w, n in around.items():
        group[w] = int(brown_lm.best_class(start, n[:1], n[1:], of[[of_ending(w)]])[0])
    classes = [[group[w] if w in group else int(of[u]) for w, u in zip(ws, us)] + [int(of[end])] for ws, us in zip(words, units, strict=True)]
    table = np.zeros_like(start)
    for cs, own in zip(classes, train, strict=True):
        for x, y in zip([int(of[end]), *cs], cs):
            table[x, y] += own
    mass = table.sum(axis=0) + brown_lm.ADD * np.bincount([*group.values(), *of[brown_lm.TOP :]], minlength=brown_lm.CLASSES)
    frequency = (table.sum(axis=0) + 1) / (table.sum() + brown_lm.CLASSES)
    transition = (table + brown_lm.PRIOR * frequency) / (table.sum(axis=1, keepdims=True) + brown_lm.PRIOR)
    scores = []
    for ws, cs in zip(words, classes, strict=True):
        counts = [count[w] for w in ws] + [sum(train)]
        scores.append(sum(math.log10(transition[x, y]) + math.log10((c + brown_lm.ADD) / mass[y]) for x, y, c in zip([int(of[end]), *cs], cs, counts)))
    return scores, group


@pytest.mark.parametrize("lookup", [150_000, 560])
def test_every_training_word_finds_its_class_by_its_neighbours(spark, monkeypatch, lookup):
    monkeypatch.setattr(brown_lm, "LOOKUP", lookup)
    texts = _texts()
    train = [k % 10 != 0 for k in range(len(texts))]
    wanted, group = _plain(texts, train)
    x, y = ({c for w, c in group.items() if w.startswith(f"{k}rare")} for k in "xy")
    assert not x & y  # one ending, unlike neighbours
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(5)
    found = {r.doc_id: r for r in brown_lm.score(docs, F.col("doc_id") % 10 == 0).collect()}
    assert sorted(found) == list(range(len(texts)))
    for k, score in enumerate(wanted):
        assert found[k].score == pytest.approx(score, rel=1e-9), k
        assert found[k].n_tokens == len((texts[k] or "").split()) + 1
