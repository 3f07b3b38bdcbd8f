"""The factorization machine against an explicit sum over pairs, and the shrinkage of sites against plain Python."""

from itertools import combinations
from math import exp, log

import numpy as np
import pytest

pytest.importorskip("lakewright.llm")

from lakewright.llm import quality_bayes, toxicity_fm


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = toxicity_fm.FactorizationMachine(np.arange(30), 0.3, rng.normal(size=30).astype("f4"), rng.normal(size=(30, 8)).astype("f4"))
    for n in (0, 1, 2, 9, 30):
        at = rng.choice(30, n, replace=False)
        z = m.bias + sum(float(m.w[i]) for i in at) + sum(float(m.v[i].astype("f8") @ m.v[j].astype("f8")) for i, j in combinations(at, 2))
        assert m.score(at) == pytest.approx(1 / (1 + exp(-max(-60, min(60, z)))), abs=1e-6)


def test_one_training_row_an_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, None), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, None), (4, 1), (None, 1)], "doc_id long, toxic int")
    kept = {r["doc_id"] for r in docs.where(~toxicity_fm.held_out()).collect()} - {None}
    got = sorted(map(tuple, toxicity_fm.labelled_rows(docs, labels, "toxic").collect()))
    assert got == [r for r in [(1, "a", 1), (2, None, 0)] if r[0] in kept]


def test_fit_does_not_depend_on_the_order_of_rows(spark):
    rows = [(k, f"{'vile' if k % 3 else 'kind'} folk {k % 7} they are", int(k % 3 > 0)) for k in range(60)]
    schema = "id long, text string, label int"
    a, b = (toxicity_fm.fit(spark.createDataFrame(r, schema).repartition(n)) for r, n in ((rows, 1), (rows[::-1], 5)))
    assert a.bias == b.bias and (a.w == b.w).all() and (a.v == b.v).all()
    long = spark.createDataFrame([(1, "vile folk " * 30000), (2, "vile folk"), (3, None), (4, "")], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in toxicity_fm.score(long, a).collect()}
    assert s[1] == s[2] and s[3] == s[4]


def by_hand(rows, keep_strength=False):
    """(host posterior, path posterior) of each (host, path, p), by the formulas of the module."""

    def strength(groups):
        n, g = sum(len(p) for p, _ in groups), len(groups)
        within = max(sum(sum(x * x for x in p) - sum(p) ** 2 / len(p) for p, _ in groups), 0) / max(n - g, 1)
        between = (sum((sum(p) / len(p) - above) ** 2 * len(p) for p, above in groups) - within * g) / n
        return min(quality_bayes.MOST_STRENGTH, max(quality_bayes.LEAST_STRENGTH, within / between)) if between > 0 else quality_bayes.MOST_STRENGTH

    hosts, paths = {}, {}
    for h, q, p in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, q), []).append(p)
    mean = sum(p for *_, p in rows) / len(rows)
    k = strength([(p, mean) for p in hosts.values()])
    post = {h: (sum(p) + k * mean) / (len(p) + k) for h, p in hosts.items()}
    kp = strength([(p, post[h]) for (h, _), p in paths.items()])
    return [(post[h], (sum(paths[h, q]) - p + kp * post[h]) / (len(paths[h, q]) - 1 + kp)) for h, q, p in rows], mean, (k, kp)


def test_shrinkage_by_hand(spark):
    """Many good hosts, a bad host with one good path, and hosts of one document: sparse sites go to the level above."""
    good = "This is a calm and complete sentence about rivers, towns and the people who live there. It ends well."
    bad = "BUY NOW!!! $$$ ### cheap cheap cheap | home | about | $$$ !!!"
    docs = [(f"h{k % 4}", f"p{k % 2}", good + f" {k}") for k in range(80)] + [("bad", f"p{k % 3}", bad if k % 3 else good) for k in range(60)] + [("lone", "x", bad), ("solo", "y", good), (None, None, good)]
    frame = spark.createDataFrame([(k, *d) for k, d in enumerate(docs)], "doc_id long, source string, lang string, text string")
    labels = spark.createDataFrame([(k, int(d[2].startswith("This"))) for k, d in enumerate(docs)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_bayes.classify(frame, labels).collect()}
    expected, mean, (k_host, k_path) = by_hand([(h, q, got[k]["classifier"]) for k, (h, q, _) in enumerate(docs)])
    for k, (host, path) in enumerate(expected):
        assert got[k]["host_posterior"] == pytest.approx(host, rel=1e-6) and got[k]["path_posterior"] == pytest.approx(path, rel=1e-6)
        logit = lambda p: log(p / (1 - p))
        clipped = lambda p: min(1 - 1e-6, max(1e-6, p))
        z = logit(clipped(got[k]["classifier"])) + logit(clipped(path)) - logit(mean)
        assert got[k]["score"] == pytest.approx(1 / (1 + exp(-z)), rel=1e-6)
    lone, solo, bad_host = (next(k for k, d in enumerate(docs) if d[0] == h) for h in ("lone", "solo", "bad"))
    assert abs(got[lone]["host_posterior"] - mean) < abs(got[lone]["classifier"] - mean)  # one document says less than sixty
    assert got[bad_host]["host_posterior"] < got[solo]["host_posterior"] and k_host < quality_bayes.MOST_STRENGTH and k_path < quality_bayes.MOST_STRENGTH


def test_hot_sites_are_dealt_out(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "one" if k % 3 else f"s{k}", "en", f"words and more words {k}") for k in range(90)], "doc_id long, source string, lang string, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(90)], "doc_id long, quality int")
    values = lambda: sorted(tuple(r) for r in quality_bayes.classify(docs, labels).drop("classifier").collect())
    plain = values()
    monkeypatch.setattr(quality_bayes, "SITE_ROWS", 7)
    dealt = values()
    assert [r[0] for r in plain] == [r[0] for r in dealt] and np.allclose([r[1:4] for r in plain], [r[1:4] for r in dealt], rtol=1e-9)
