"""The corpus pipeline, stage by stage, on the smallest data."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_run(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.staged(stage(spark, docs, folder), f"test-{k}")
        now = {r[0] for r in docs.select("doc_id").distinct().collect()}
        assert now and now <= ids, name
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        assert k < 3 or now == ids, name  # masking and packing lose no document
        ids = now


def test_near_duplicates_by_five_words(spark):
    w = [f"w{k}" for k in range(95)]
    swapped = lambda x: " ".join([*x[:20], "other", *x[21:]])
    # one word of 50: 41 of 51 five-word shingles are shared (0.804), 43 of 51 four-word ones (0.843); of 45: 36 of 46 (0.783)
    texts = [" ".join(w[:50]), swapped(w[:50]), " ".join(w[50:]), swapped(w[50:])]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3, 4]
