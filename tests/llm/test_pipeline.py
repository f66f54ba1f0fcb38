"""The pipeline's stages on a small table: what each must keep, and that its decisions take effect."""

from collections import Counter

import corpus_pipeline
from loopwright.llm import minhash, quality

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
    _, good, single, clean, mixed, packed = seen
    assert all(df.columns == docs.columns for df in seen[:-1])
    assert {r["doc_id"] for r in good.collect()} == judged
    classes = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(good).collect()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(classes.values()))
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    changed = [r for r in clean.collect() if r["text"] != texts[r["doc_id"]]]
    assert clean.count() == single.count() and all(r["n_chars"] == len(r["text"]) for r in changed) and all("[" in r["text"] for r in changed)
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert set(times) <= set(texts) and max(times.values()) <= 3
    pieces = Counter(r["doc_id"] for r in packed.where("piece = 0").collect())
    assert pieces == times


def test_run_applies_the_stages_in_order(spark, monkeypatch):
    steps = [corpus_pipeline.STAGES[2], ("halved", lambda s, d, sf: d.where("doc_id % 2 = 0"))]
    monkeypatch.setattr(corpus_pipeline, "STAGES", steps)
    got = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.columns == docs.columns and got.count() == docs.where("doc_id % 2 = 0").count() and got.where("text like '%[EMAIL]%'").count() > 0


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0
