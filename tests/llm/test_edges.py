"""Nulls in any column, repeated rows, empty tables and clashing columns, for every operator and pipeline stage."""

import pytest

pytest.importorskip("lakewright.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lakewright.llm import ann_tree, ngram_join, packing, pii_votes, piece_bpe, quality_bayes, quality_rules, token_rollup, toxicity_fm, warc
from lakewright.llm.queries import tokenizer_file

#: Names that operators use within, give back, or spell in another case.
CLASHING = ["_t", "_c", "_w", "_L", "quality", "_quality", "Score", "spans", "kept", "part", "shift", "to", "n", "sid", "id", "label", "p", "k", "h", "component", "node", "first_id", "n_tokens", "ids", "digest", "salt", "rank"]
TEXT = "mail a.b@c.de about the long river that runs through many quiet towns before it meets the sea"
ROWS = [(1, TEXT), (2, TEXT), (2, TEXT), (None, TEXT), (None, None), (3, None), (4, ""), (5, TEXT + " and more"), (None, "nothing like it: " + " ".join(map(str, range(40))))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, None if k % 2 else "en", None if k % 3 else "web", None if k % 4 else len(t or ""), *[f"own{k}"] * len(CLASHING)) for k, (d, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{c}` string" for c in CLASHING)]))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, None, 0), (None, 1, 1), (5, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")


def pairs(frame, *names):
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


def own_values(frame, but=()):
    return sorted(str([r[c] for c in CLASHING if c not in but]) for r in frame.collect())


def test_columns_that_clash_pass_through(docs):
    everything = own_values(docs)
    for frame, but in ((pii_votes.redact(docs), ()), (toxicity_fm.score(docs, toxicity_fm.fit(docs.selectExpr("doc_id id", "text", "1 label"))), ("Score",)), (piece_bpe.encode(docs, tokenizer_file("piece_bpe_32k.model")), ("n_tokens", "ids"))):
        assert own_values(frame, but) == (own_values(docs, but) if but else everything)
    assert own_values(pii_votes.annotate(docs), ("spans",)) == own_values(docs, ("spans",))
    assert own_values(quality_rules.assess(docs), ("quality",)) == own_values(docs, ("quality",))
    assert own_values(quality_rules.clean(docs)) == own_values(docs.where("length(text) > 0"))


def test_ngram_join(docs):
    got = pairs(ngram_join.similar_groups(docs), "doc_id", "n_shingles", "component_id")
    n = len(TEXT.split()) - 3
    assert got == sorted([(1, n, 1), (2, n, 1), (2, n, 1), (None, n, 1), (None, 0, None), (3, 0, 3), (4, 0, 4), (5, n + 2, 1), (None, 40, None)], key=str)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and pairs(kept, "doc_id") == sorted([(1,), (3,), (4,), (None,), (None,), (None,)], key=str)


def test_packing_and_pieces(docs):
    packed = packing.pack(docs, tokenizer_file("word_bpe_49k.json"))
    assert pairs(packed.where("start = 0"), "doc_id") == sorted(((d,) for d, _ in ROWS), key=str)
    assert pairs(packed.where("doc_tokens = 1"), "doc_id", "length") == sorted([(None, 1), (3, 1), (4, 1)], key=str)
    assert packed.selectExpr("sum(length) = sum(if(start = 0, doc_tokens, 0)) same").first()["same"]
    pieces = piece_bpe.encode(docs, tokenizer_file("piece_bpe_32k.model"))
    assert pairs(pieces.where("text is null or text = ''"), "n_tokens") == [(2,)] * 3


def test_quality_bayes(docs, labels):
    for some in (labels, labels.where("quality = 1"), labels.where("doc_id < 0")):
        got = quality_bayes.classify(docs, some)
        assert pairs(got, "doc_id") == sorted(((d,) for d, _ in ROWS), key=str)
        assert got.where("score between 0 and 1").count() == len(ROWS)


def test_token_rollup(docs, spark, tmp_path):
    counted = token_rollup.count_tokens(docs.select("source", "lang", "text", "n"), {"text": "w"}, counter=lambda t: len(t.split()))
    rollup = token_rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    assert rollup.totals().count() == 0
    assert rollup.commit("none", token_rollup.changes(counted.where("false"), {"v": "w"}, 1)) and rollup.totals().count() == 0
    assert rollup.commit("load", token_rollup.changes(counted, {"v": "w"}, 1))
    assert rollup.totals().selectExpr("sum(docs) d", "sum(tokens) t").first() == (len(ROWS), sum(len((t or "").split()) for _, t in ROWS))
    assert rollup.commit("undo", token_rollup.changes(counted, {"v": "w"}, -1)) and rollup.totals().count() == 0


def test_warc(spark):
    long = "y" * 200
    rows = [(None, "u", long, 1), (None, None, None, 1), (7, "u", long, 1), (8, "u", long, 1), (7, "u", long, 1), (None, "v", "z" * 150, 1), (None, "v", "z" * 150, 1)]
    got = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, digest int")))
    assert pairs(got, "page_id", "payload_bytes", "record_type", "refers_to") == sorted(
        [(None, 200, "response", None), (None, 0, "response", None), (7, 200, "response", None), (7, 200, "response", None), (8, 200, "revisit", 7), (None, 150, "response", None), (None, 150, "response", None)], key=str
    )


def test_ann_without_queries_or_partners(spark):
    schema = "vec_id long, embedding array<float>, rank int"
    assert ann_tree.search(spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)], schema)).count() == 0
    assert ann_tree.search(spark.createDataFrame([(20, [1.0, 0.0], 1)], schema)).count() == 0
    rows = [(20, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (3, [0.5, 0.0], 1), (2, [0.5, 9.0], 1), (None, [1.0, 1.0], 1), (5, [None, 1.0], 1), (6, None, 1)]
    assert pairs(ann_tree.search(spark.createDataFrame(rows, schema)), "query_id", "rank", "vec_id", "score") == [(20, 1, 2, 0.5), (20, 2, 3, 0.5)]


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages(docs, labels, spark, tmp_path, empty):
    folder = f"file://{tmp_path}"
    labels.write.parquet(f"{folder}/labels.parquet")
    docs = docs.where("false") if empty else docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns, name
        assert (out.count() == 0) == empty, name
