"""Files of token ids: Elias-Fano sequences, the encoder against plain encoding, exact round trips."""

import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import storage, token_file

P = pytest.importorskip("public_tokenizers")
FILE = P.path("byte_bpe_50k.json")
ROWS = "doc_id long, text string, range int, place long, content string, first_id int"


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 3000])
@pytest.mark.parametrize("top", [0, 1, 1000, 10**9, 2**63])
def test_elias_fano(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top + 1, n, dtype=np.uint64))
    made = token_file.EliasFano.of(values)
    dumped = made.dump()
    read, end = token_file.EliasFano.load(memoryview(dumped), 0)
    assert end == len(dumped) and read.values().tolist() == values.tolist()
    assert [read.select(i) for i in range(n)] == values.tolist()
    with pytest.raises(IndexError):
        read.select(n)
    if n > 1000:  # two bits a value, those of the mean distance, one place each 256
        assert 8 * len(dumped) <= n * (3 + np.log2(max(top, n) / n) + 0.25) + 400


def test_select_over_a_long_gap():
    values = np.r_[np.arange(300), [10**7, 10**7 + 1]]
    made = token_file.EliasFano.of(values)
    made.bits = 0
    made = token_file.EliasFano(len(values), 0, np.empty(0, np.uint8), np.packbits(np.isin(np.arange(10**7 + 400), values + np.arange(len(values))), bitorder="little"), (values + np.arange(len(values)))[:: token_file.SAMPLE].astype("<u4"))
    assert [made.select(i) for i in (0, 299, 300, 301)] == [0, 299, 10**7, 10**7 + 1]


def test_encoder_equals_plain_encoding(monkeypatch):
    from tokenizers import Tokenizer

    r, plain = random.Random(7), Tokenizer.from_file(FILE)
    parts = ["a", "The", " ", "  ", "\n", "\t", "\r\n", " ", "　", " ", "\x1c", "\x1f", "é", "日本", "'s", "'ll", "1", "!", ",", "_", "<|endoftext|>", "\x85", "​", "😀", "foo", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(3000)] + ["", "x" * 20000, " y" * 20000, None]
    want = [x.ids for x in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    encoder = token_file.Encoder(FILE)
    for _ in range(2):  # the second time from what is remembered
        assert [x.tolist() for x in encoder.encode(pa.array(texts))] == want
    monkeypatch.setattr(token_file, "KNOWN", 40)
    monkeypatch.setattr(token_file, "JOINED", 50)
    encoder._forget()
    assert [x.tolist() for i in range(0, len(texts), 100) for x in encoder.encode(pa.array(texts[i : i + 100], pa.string()))] == want


def _plain(rows):
    from tokenizers import Tokenizer

    at, out, t = 0, [], Tokenizer.from_file(FILE)
    for ids in [np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4") for text in rows]:
        out.append((at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        at += len(ids)
    return out


def test_round_trip(spark):
    texts = ["One two.", None, "", "word " * 60000, "Öl \n\n x", "same", "same", "a\x00b", "<|endoftext|> end"]
    ids = [7, 3, -9, 12, 2**62, 5, 5, -(2**61), 0]
    docs = spark.createDataFrame([(i, t, 1, 2, "c", 3) for i, t in zip(ids, texts)], ROWS)
    path = f"{storage.shared_dir(spark)}/{uuid.uuid4().hex}"
    token_file.write(docs, path, FILE, end=2, ids=50_000)
    order = sorted(range(len(ids)), key=lambda k: ids[k])
    want = _plain([texts[k] for k in order])
    got = sorted(token_file.read(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [ids[k] for k in order]
    assert [(r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in got] == want
    for k in range(len(ids)):
        assert token_file.document(spark, path, k) == want[k][3]
    with pytest.raises(IndexError):
        token_file.document(spark, path, len(ids))


def test_null_ids_come_first_and_repeated_rows_stay(spark):
    docs = spark.createDataFrame([(None, "b")] * 3 + [(1, "a")] * 40 + [(0, None)], "doc_id long, text string")
    path = f"{storage.shared_dir(spark)}/{uuid.uuid4().hex}"
    token_file.write(docs, path, FILE, ids=3)
    got = sorted(tuple(r) for r in token_file.read(spark, path).select("start", "doc_id", "n_tokens").collect())
    assert got == [(k, None, 1) for k in range(3)] + [(3, 0, 0)] + [(3 + k, 1, 1) for k in range(40)]


def test_empty_table(spark):
    path = f"{storage.shared_dir(spark)}/{uuid.uuid4().hex}"
    token_file.write(spark.createDataFrame([], ROWS), path, FILE, end=2)
    assert token_file.read(spark, path).collect() == []


def test_query_against_plain_encoding(spark, tmp_path):
    from gridloom.llm import queries

    docs = spark.createDataFrame([(k * 37 % 101, f"Text {k} of {k * k} words, and more.\n" * (k % 7)) for k in range(100)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op12_token_file(spark, str(tmp_path)).collect())
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert got == [(i, *x[:3]) for (i, _), x in zip(rows, _plain([t for _, t in rows]), strict=True)]
