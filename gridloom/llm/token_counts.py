"""Token counts under a unigram segmentation, with a trie shared by all pre-tokens of a batch.

A pre-token is a word with the piece model's word mark before it. Its token
count is that of its best segmentation: the one whose pieces' log probabilities
add up to most, then the one of fewest tokens. The forward scores are computed
along a trie of the batch's distinct pre-tokens, so that a prefix that many
words share is scored once; a word's count is kept at its terminal and added
up over the documents.

The pieces come from a public SentencePiece model, whose path is a parameter.
That file orders its pieces by merges; a piece of rank r gets the log
probability -log(r + RANK_SHIFT), Zipf's law up to a constant. A character
that no piece covers takes its UTF-8 bytes as byte tokens.

Cases: null and empty texts have no tokens; a very long word is scored like any
other, in time linear in its length; repeated rows are counted each; other
columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
RANK_SHIFT = 10.0
#: Log probability of one byte of a character that no piece covers.
BYTE_SCORE = -14.0


class Pieces:
    """The pieces with their log probabilities, as a trie of characters; None leads to a piece's score."""

    def __init__(self, score: dict[str, float]):
        self.root: dict = {}
        for piece, value in score.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[None] = value

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        return cls({model.id_to_piece(i): -math.log(rank + RANK_SHIFT) for rank, i in enumerate(normal)})

    def counts(self, pretokens: list[str]) -> list[int]:
        """Token counts of pre-tokens, which must be sorted: each continues at the trie node that it shares with the one before.

        For every prefix on the path: its best score, the tokens of that, and
        the pieces that have begun and may still go on, each with its start.
        """
        root = self.root
        best, tokens, begun, out, before = [0.0], [0], [[(root, 0)]], [], ""
        for word in pretokens:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :], begun[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                c = word[end - 1]
                n = 1 if c < "\x80" else len(c.encode("utf-8", "replace"))
                top, count, going = best[-1] + n * BYTE_SCORE, tokens[-1] + n, []
                for node, start in begun[-1]:
                    if (node := node.get(c)) is not None:
                        going.append((node, start))
                        if (s := node.get(None)) is not None:
                            s += best[start]
                            if s > top or (s == top and tokens[start] + 1 < count):
                                top, count = s, tokens[start] + 1
                going.append((root, end))
                best.append(top)
                tokens.append(count)
                begun.append(going)
            out.append(tokens[-1])
            before = word
        return out


def batch_counts(texts: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, pre-tokens) of every text."""
    rows: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    seen: dict[int, bytes] = {}
    for w in textbatch.words(texts, lower=False):
        h = w.hashes()
        distinct, first = np.unique(h, return_index=True)
        for x, i in zip(distinct.tolist(), first.tolist(), strict=True):
            if x not in seen:
                seen[x] = w.text(i)
        rows.append(w.row + w.first)
        hashes.append(h)
        sizes.append(w.counts())
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = sorted(seen, key=seen.__getitem__)  # byte order is that of code points
    counted = pieces.counts([MARK + seen[x].decode("utf-8", "replace") for x in order])
    keys = np.array(order, dtype=np.uint64)
    by_key = np.argsort(keys)
    keys, values = keys[by_key], np.array(counted, dtype=np.int64)[by_key]
    total = np.zeros(len(texts), dtype=np.int64)
    for row, h in zip(rows, hashes, strict=True):
        total += np.bincount(row, weights=values[np.searchsorted(keys, h)] if len(h) else None, minlength=len(texts)).astype(np.int64)
    return total, np.concatenate(sizes)


def count_tokens(docs: DataFrame, *, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """Per document row: key, n_tokens and n_words (pre-tokens). `model` is a path on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model)
        for batch in batches:
            tokens, sizes = batch_counts(batch.column(1), pieces)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens), pa.array(sizes.astype(np.int64))], ["key", "n_tokens", "n_words"])

    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, n_tokens long, n_words long").withColumnRenamed("key", key)
