"""The stages of the pipeline, and the whole run, over a small corpus with planted cases."""

import random

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("harbour", "window", "meadow", "lantern", "copper", "river", "garden", "marble") for b in ("side", "light", "ing", "works", "stone", "field", "keeper", "smith")]
    good = lambda: "\n".join(" ".join(rng.choice(words) for _ in range(14)) + "." for _ in range(6))
    bad = lambda: " ".join(rng.choice(["BUY###", "$$$", "NOW!!!", "FREE$$", "click>>"]) for _ in range(60))
    texts = {i: good() for i in range(60)} | {100 + i: bad() for i in range(40)}
    item = " ".join(rng.choice(words) for _ in range(25))
    texts[60] = texts[0]  # an exact copy
    texts[61] = good() + "\n" + item  # a benchmark passage
    texts[62] = texts[1].split("\n")[0] + "\n" + good()  # a repeated line
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()] + [(200, None, None, None, None), (201, "", "en", "s0", 0), (None, good(), None, None, 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in texts if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts


def test_stages_and_run(spark, folder, tmp_path):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
    ids = {name: {i for i, _ in rows} for name, rows in kept.items()}
    first, lines, near, clean, mixed = (ids[n] for n, _ in corpus_pipeline.STAGES)
    assert not any(i is not None and 100 <= i < 140 for i in first) and set(range(60)) <= first
    # the copy loses all its lines to the first, and a repeated line goes
    assert 60 not in lines and set(range(60)) <= lines
    assert texts[1].split("\n")[0] not in dict(kept["line dedup"])[62]
    assert near == lines and clean == near - {61}
    assert mixed <= clean and len(kept["mixing sources"]) >= len(clean)


def test_a_settled_stage_leaves_no_other_table(spark):
    import os

    from gridloom.llm import storage

    folder = storage.shared_dir(spark)
    there = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = storage.settle(lambda: storage.materialize(storage.materialize(spark.range(5)).where("id > 1")).where("id > 2"))
    assert sorted(r.id for r in out.collect()) == [3, 4]
    assert set(os.listdir(folder)) - there == {os.path.basename(out._gridloom_path)}
