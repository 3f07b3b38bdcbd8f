"""Nearest neighbours: equal vectors go by id, lengths keep to themselves, scores are exact."""

import numpy as np
import pytest

pytest.importorskip("lakewright.llm")

from lakewright.llm import ann_tree

SCHEMA = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("width", [16, 48, 64])
def test_equal_vectors_go_by_id(spark, width, monkeypatch):
    monkeypatch.setattr(ann_tree, "BLOCK_ROWS", 64)  # equal rows lie in many blocks
    rng = np.random.default_rng(width)
    x = rng.normal(size=(5, width))
    rows = [(k, x[k % 5].tolist()) for k in range(400)]
    got = ann_tree.search(spark.createDataFrame(rows, SCHEMA).repartition(5)).orderBy("query_id", "rank").collect()
    full = np.array([v for _, v in rows])
    for q in range(0, 400, 20):
        s = ann_tree.exact_scores(np.tile(full[q], (400, 1)), full)
        best = [k for k in np.lexsort((np.arange(400), -s)).tolist() if k != q][:20]
        mine = [r for r in got if r["query_id"] == q]
        assert [r["vec_id"] for r in mine] == best and [r["score"] for r in mine] == s[best].tolist()
        assert [r["rank"] for r in mine] == list(range(1, 21))


def test_each_length_by_itself(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=3 if k % 4 else 5).tolist()) for k in range(200)] + [(1000, [2.0] * 7), (1020, [3.0] * 7)]
    got = ann_tree.search(spark.createDataFrame(rows, SCHEMA), k=3, target=1.0).collect()
    own = dict(rows)
    assert {r["query_id"] for r in got} == {k for k in own if k % 20 == 0}
    for q in {r["query_id"] for r in got}:
        s = sorted((-float(np.dot(v, own[q])), k) for k, v in rows if k != q and len(v) == len(own[q]))[:3]
        mine = [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert [k for _, k in s] == [k for k, _ in mine] and np.allclose([-x for x, _ in s], [x for _, x in mine], rtol=1e-12)


def test_block_products_only_choose(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(3, 48)), 30, axis=0)
    q, i, s = ann_tree._nearest(np.arange(7), x[:7] * 1.0, np.arange(90), x, 20)
    for k in range(7):
        exact = ann_tree.exact_scores(np.tile(x[k], (90, 1)), x)
        best = [j for j in np.lexsort((np.arange(90), -exact)).tolist() if j != k][:20]
        assert i[q == k].tolist() == best and s[q == k].tolist() == exact[best].tolist()
