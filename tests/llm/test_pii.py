"""Personal data: the base against Python's patterns on hostile texts, cost by matches, what the method adds, masking."""

import random
import time

import pytest

pytest.importorskip("lakewright.llm")

from lakewright.llm import pii_votes

from test_operators import spans_of


def spans(spark, texts, weights=None):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["spans"] for r in pii_votes.annotate(frame, weights={} if weights is None else weights).collect()}


def test_base_on_hostile_texts(spark):
    r = random.Random(4)
    signs = ["1", "2", "7", "0", "4", ".", "-", " ", "@", "a", "B", "\x01", "\x02", "\x00", "é", "😀", "\n", "+", "(", ")", "_", "%", " "]
    texts = ["4111 1111 1111\x011111", "4111 1111 1111 1111", "a\x01b@c.d", "a@b\x01c.d@e.f", "a@b.c\x01d", "+1\x01555 123 4567", "1.2.3.4\x015", "4111111111111111", "\x014111-1111-1111-1111\x02"]
    texts += ["".join(r.choices(signs, weights=[9, 6, 5, 6, 6, 9, 5, 5, 6, 5, 2, 2, 1, 1, 1, 1, 1, 2, 1, 1, 1, 1, 1], k=r.randint(1, 90))) for _ in range(400)]
    texts += ["".join(r.choices("0123456789- ", weights=[3] * 10 + [1, 1], k=r.randint(10, 60))) for _ in range(200)]
    got = spans(spark, texts)
    for k, t in enumerate(texts):
        assert [(s["kind"], s["start"], s["stop"]) for s in got[k] if s["base"]] == spans_of(t), repr(t)
        raw = t.encode()
        assert all(raw[s["b0"] : s["b1"]].decode() == t[s["start"] : s["stop"]] for s in got[k])


def test_cost_grows_with_the_matches(spark):
    took = {}
    for n in (1000, 2000, 8000):
        text = " ".join(f"é mail{k}@host{k}.example, {k % 200}.1.2.3" for k in range(n))
        frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        row = pii_votes.annotate(frame, weights={}).select("doc_id", "text", "spans").withColumn("masked", pii_votes.masked()).collect()[0]
        took[n] = time.time() - began
        assert len(row["spans"]) == 2 * n and row["masked"].count("<EMAIL>") == n and row["masked"].endswith("<EMAIL>, <IP>")
    assert took[8000] < 8 * took[2000] + 1


def test_weak_supervision_finds_what_labelers_agree_on(spark):
    """Planted secrets and national numbers are added; look-alikes are left alone; precision and recall of each kind."""
    r = random.Random(9)
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    docs = []
    for k in range(300):
        word = "".join(r.choices("abcdefgh", k=6))
        docs += [
            (f"{word} token = {''.join(r.choices('0123456789abcdef', k=40))} {word}", "secret"),
            (f"please call ({r.randint(201, 989)}) {r.randint(200, 999)}-{digits(4)} {word}", "national"),
            (f"{word} order {digits(16)} {word} {word}", None),
            (f"{word} commit {''.join(r.choices('abcdefghij', k=20))} {word}", None),
        ]
    got = spans(spark, [t for t, _ in docs], pii_votes.fit(spark.createDataFrame([(t,) for t, _ in docs], "text string")))
    for kind in ("secret", "national"):
        found = {k for k, x in got.items() if any(s["kind"] == kind for s in x)}
        planted = {k for k, (_, planted_kind) in enumerate(docs) if planted_kind == kind}
        assert len(found & planted) >= 0.95 * len(planted) and len(found - planted) <= 0.02 * len(docs)
    assert all(not any(s["base"] for s in got[k]) for k, (_, kind) in enumerate(docs) if kind is None and not spans_of(docs[k][0]))


def test_expectation_maximisation_by_hand():
    """One round of EM in plain numbers gives what _posteriors gives when it runs one round."""
    import math

    rows, rounds = [((1, 1, 0, 1), 30), ((-1, 0, 0, 1), 50), ((1, 0, 1, -1), 5)], pii_votes.ROUNDS
    post = [1 / (1 + math.exp(-sum(v))) for v, _ in rows]
    for _ in range(rounds):
        weight = {c: 1 + sum(n * (p if c else 1 - p) for (_, n), p in zip(rows, post, strict=True)) for c in (0, 1)}
        share = {}
        for c in (0, 1):
            for k in range(4):
                seen = {x: 0.5 + 1.5 * (x == (1 if c else -1)) + sum(n * (p if c else 1 - p) for (v, n), p in zip(rows, post, strict=True) if v[k] == x) for x in (-1, 0, 1)}
                share[c, k] = {x: y / sum(seen.values()) for x, y in seen.items()}
        odds = [math.prod([weight[1], *(share[1, k][v[k]] for k in range(4))]) / math.prod([weight[0], *(share[0, k][v[k]] for k in range(4))]) for v, _ in rows]
        post = [o / (1 + o) for o in odds]
    assert [round(p, 6) for _, _, p in pii_votes._posteriors(rows)] == [round(p, 6) for p in post]


def test_masking_where_spans_overlap(spark):
    texts = ["ü a@b.c and 1.2.3.4 x", "call +1 (555) 123-4567!", "none", "", None, "a@b.c", "é" * 300 + " a@b.c " + "😀" * 300 + " 1.2.3.4"]
    frame = spark.createDataFrame([(k, t, len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: r for r in pii_votes.redact(frame).collect()}
    assert [got[k]["text"] for k in range(6)] == ["ü <EMAIL> and <IP> x", "call <PHONE>!", "none", "", None, "<EMAIL>"]
    assert got[6]["text"] == "é" * 300 + " <EMAIL> " + "😀" * 300 + " <IP>" and got[6]["n_chars"] == len(got[6]["text"])
    overlapping = spark.createDataFrame([("abcdefghij", [("x", 1, 4, 1, 4), ("y", 3, 6, 3, 6), ("z", 6, 8, 6, 8)])], "text string, spans array<struct<kind: string, start: int, stop: int, b0: int, b1: int>>")
    assert overlapping.select(pii_votes.masked().alias("m")).first()["m"] == "a<X><Z>ij"
