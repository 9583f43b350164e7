"""Language identification by compression.

For every language a raw-content dictionary is filled with sample text; a text
is cut into pieces, each is compressed against every dictionary, and the
language with the fewest bytes in total wins. Narrow margins are rejected.

Dictionaries are learned from a bounded sample of labelled texts (SAMPLE_BYTES
a language); only that sample reaches the driver.

Cases: a null text, or one without any letter, is `und` with score 0, as is
every text when nothing was learned; rows without a language are not learned
from; equal sizes go to the language with more rows to learn from; repeated
rows are judged each; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
#: Bytes of sample text a language, documents that are looked at for them, and passages of each, spread evenly over the whole text.
SAMPLE_BYTES = 48_000
SAMPLE_DOCS = 120
PASSAGES = 4
#: Bytes of a text that are compressed at once, so that the dictionary counts throughout a long text.
PIECE = 4096
LEVEL = 12
#: Least difference between best and second language, as a share of the best's bytes.
MARGIN = 0.01
_MAY_BE_LETTER = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    return any(c.isalpha() for found in _MAY_BE_LETTER.finditer(text) for c in found[0])


def _plain(text: str) -> bytes:
    """Lower case, with runs of ASCII that is neither letter nor apostrophe as one space."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() or c == 39 else 32 for c in range(256))


class Dictionaries:
    """Sample text by language, most frequent language first: equal sizes go to the earlier one."""

    def __init__(self, samples: dict[str, bytes]):
        self.samples = samples
        self._made: list = []

    def __getstate__(self):
        return {"samples": self.samples, "_made": []}

    def _compressors(self) -> list:
        if not self._made:
            parameters = zstandard.ZstdCompressionParameters(compression_level=LEVEL, strategy=zstandard.STRATEGY_BTOPT, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=3, window_log=17)
            for sample in self.samples.values():
                content = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                content.precompute_compress(compression_params=parameters)
                self._made.append(zstandard.ZstdCompressor(dict_data=content, compression_params=parameters))
        return self._made

    def sizes(self, data: bytes) -> list[int]:
        """Bytes that the text takes under each language."""
        made = self._compressors()
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return [sum(len(c.compress(p)) for p in pieces) for c in made]

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin)"""
        if not text or not self.samples or not has_letter(text):
            return UNDETERMINED, 0.0, 0.0
        sizes = self.sizes(_plain(text))
        names = list(self.samples)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = [x - sizes[best] for k, x in enumerate(sizes) if k != best]
        # a byte saved counts as a factor of 2, and 16 at most are counted
        score = 1 / (1 + sum(2.0 ** -min(x, 16) for x in others))
        return names[best], score, min(others, default=sizes[best]) / max(sizes[best], 1)


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_bytes: int = SAMPLE_BYTES, sample_docs: int = SAMPLE_DOCS) -> Dictionaries:
    """Dictionaries from docs, which hold only what may be learned from."""
    spread = F.conv(F.substring(F.md5(F.concat(F.lit("lang"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), spread.alias("spread"), F.col(text).alias("text"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    samples = {}
    if counts:
        share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, 2 * sample_docs / n))) for k, n in counts.items()))
        each = max(2000, 2 * sample_bytes // sample_docs) // PASSAGES
        step = F.greatest(F.ceil(F.length("text") / PASSAGES), F.lit(each)).cast("int")
        passages = F.transform(F.sequence(F.lit(0), F.lit(PASSAGES - 1)), lambda i: F.substring(F.col("text"), i * step + 1, F.lit(each)))
        rows = known.where(F.col("spread") < share).select("lang", "spread", F.array_join(passages, " ").alias("text")).limit(4 * sample_docs * len(counts)).collect()
        for k in sorted(counts, key=lambda k: (-counts[k], k)):
            own = [_plain(r.text) for r in sorted((r for r in rows if r.lang == k), key=lambda r: (r.spread, r.text))]
            data = b" ".join(t for t in own if len(t) > 20)[:sample_bytes]
            if len(data) >= 8:
                samples[k] = data
    return Dictionaries(samples)


def identify(docs: DataFrame, dictionaries: Dictionaries, *, key: str = "doc_id", text: str = "text", margin: float = MARGIN) -> DataFrame:
    """Per document row: key, lang_pred, score and rejected (the margin is narrow, or nothing was found)."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.judge(t) for t in batch.column(1).to_pylist()]
            margins = np.array([m for _, _, m in found], dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _, _ in found], pa.string()), pa.array([s for _, s, _ in found], pa.float64()), pa.array(margins < margin)], ["key", "lang_pred", "score", "rejected"])

    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, lang_pred string, score double, rejected boolean").withColumnRenamed("key", key)
