"""Rollups that are compacted, and counts whose names clash."""

import pytest

pytest.importorskip("lakewright.llm")

from lakewright.llm import piece_bpe, token_rollup
from lakewright.llm.queries import tokenizer_file


def totals(r):
    return sorted(map(tuple, r.totals().collect()), key=str)


def test_compaction_changes_no_total(spark, tmp_path):
    r = token_rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    assert r.compact() == 0 and totals(r) == []
    rows = lambda *x: spark.createDataFrame(x, "source string, lang string, n int")
    r.commit("a", token_rollup.changes(rows(("s", "en", 3), (None, "de", 4)), {"v": "n"}, 1))
    r.commit("b", token_rollup.changes(rows(("s", "en", 2)), {"v": "n"}, 1))
    before = totals(r)
    assert r.compact() == 2 and r.compact() == 2 and totals(r) == before
    assert not r.commit("a", token_rollup.changes(rows(("s", "en", 3)), {"v": "n"}, 1)) and totals(r) == before
    r.commit("c", token_rollup.changes(rows(("s", "en", 3), (None, "de", 4)), {"v": "n"}, -1))
    expected = [("s", "en", "v", 1, 2)]
    assert totals(r) == expected and r.compact() == 3 and totals(r) == expected
    assert len(r._sums(r.committed(), *r._compacted()).inputFiles()) <= 2  # the batches are not read any more
    assert r.commit("d", token_rollup.changes(rows(("s", "en", 2)), {"v": "n"}, -1)) and totals(r) == []


def test_counts_replace_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "a b", "own", None), (2, None, "own", "x"), (3, "", "own", "c " * 40000), (3, "a b", "own", "a b")], "doc_id long, text string, N string, revised string")
    got = token_rollup.count_tokens(docs, {"text": "n", "revised": "m"}, counter=lambda t: len(t.split()))
    assert got.columns == ["doc_id", "n", "m"] and sorted(map(tuple, got.collect())) == [(1, 2, 0), (2, 0, 1), (3, 0, 40000), (3, 2, 2)]
    assert token_rollup.count_tokens(docs.where("doc_id < 0"), {"text": "n"}, counter=len).count() == 0
    changed = token_rollup.revisions(spark.createDataFrame([("s", "en", 3, None), ("s", "en", 3, 5)], "source string, lang string, a int, b int"), {"v": ("a", "b")})
    assert sorted(r["tokens"] for r in changed.collect()) == [0, 2]


def test_whole_texts_are_verified():
    m = piece_bpe.PieceModel(tokenizer_file("piece_bpe_32k.model"))
    texts = ["Ein Satz, der gut endet.", None, "a.b;c:d, e."]
    ids = m.encode(texts)
    m.verify(texts, ids)
    with pytest.raises(ValueError):
        m.verify(texts, [ids[0][:-4], *ids[1:]])
