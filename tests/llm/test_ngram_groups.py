"""The n-gram join where groups are large, ids are missing, hashes are shared, and components are long."""

import random

import pytest

pytest.importorskip("lakewright.llm")

from lakewright.llm import common, ngram_join
from test_operators import brute_groups, near, words


def groups(spark, texts, ids=None, parts=3, **kw):
    ids = list(range(len(texts))) if ids is None else ids
    frame = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(parts)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(frame, **kw).collect()), key=str)


def corpus():
    """One large group of near copies, outsiders that share its words, a chain, and texts of their own."""
    base = words(60, 1)
    texts = [near(base, s, s % 3) for s in range(60)]
    texts += [" ".join(base.split()[: 20 + k]) for k in range(30)] + [base + " " + words(3 * k, 50 + k) for k in range(20)]
    chain = words(80, 2).split()
    texts += [" ".join(chain[k : k + 40]) for k in range(0, 40, 2)]
    return texts + [words(30, 100 + k) for k in range(20)] + [None, "", "one two"]


@pytest.mark.parametrize("block", [512, 8, 3])
def test_large_groups_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(ngram_join, "REPRESENTATIVES", 1)
    texts = corpus()
    assert groups(spark, texts) == sorted(((k, n, c) for k, (n, c) in brute_groups(texts).items()), key=str)


def test_hot_tokens_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 0)
    monkeypatch.setattr(ngram_join, "SALTS", 3)
    texts = corpus()
    assert groups(spark, texts) == sorted(((k, n, c) for k, (n, c) in brute_groups(texts).items()), key=str)


def test_links_through_rows_without_an_id(spark):
    w, x = [f"w{k}" for k in range(60)], [f"x{k}" for k in range(4)]
    # neighbours share 53 of 61 shingles, the outer two 49 of 65
    outer, between, other = " ".join(w), " ".join(x + w[4:]), " ".join(x + w[4:56] + x[::-1])
    assert groups(spark, [outer, other], [5, 9]) == [(5, 57, 5), (9, 57, 9)]
    assert groups(spark, [outer, between, between, other], [5, None, None, 9]) == [(5, 57, 5), (9, 57, 5), (None, 57, 5), (None, 57, 5)]
    assert groups(spark, [outer, between], [None, None]) == [(None, 57, None), (None, 57, None)]


def test_sets_that_share_an_id_are_told_apart(spark, monkeypatch):
    texts = [words(20, 1), words(20, 2), words(20, 3), words(20, 1)]
    real = ngram_join.xxhash.xxh3_128_intdigest
    expected = groups(spark, texts)

    class Colliding:
        @staticmethod
        def xxh3_128_intdigest(raw):
            return real(raw) >> 64 << 64 | 12345

    monkeypatch.setattr(ngram_join, "xxhash", Colliding)
    a, b = ngram_join.set_ids(ngram_join.np.arange(3, dtype="u8")), ngram_join.set_ids(ngram_join.np.arange(4, dtype="u8"))
    assert a[0] == b[0] and a[1] != b[1] and ngram_join.set_id(ngram_join.np.arange(3, dtype="u8"), frozenset([a[0]])) == a[1]
    assert [r[2] for r in expected] == [0, 1, 2, 0]


def test_one_id_and_one_text_many_times(spark):
    texts = [words(25, 1)] * 200 + [near(words(25, 1), 3, 0), words(25, 4)]
    assert groups(spark, texts, [7] * 100 + [None] * 100 + [8, 9]) == sorted([(7, 22, 7)] * 100 + [(None, 22, 7)] * 100 + [(8, 22, 7), (9, 22, 9)], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    nodes = [r.randrange(-(1 << 62), 1 << 62) for _ in range(300)]
    edges = [(nodes[k], nodes[k + 1]) for k in range(100)] + [tuple(r.sample(nodes[120:], 2)) for _ in range(90)]
    up = {n: n for e in edges for n in e}
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in up}
