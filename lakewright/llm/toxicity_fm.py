"""Toxicity by a factorization machine over hashed terms: linear weights and pairwise interactions.

A document's terms are its distinct lower-cased words and their prefixes of 4 to 6 letters (stems of inflected
insults), hashed into BUCKETS. The terms that tell the labels apart best (chi-square over the training rows)
stay; the machine scores their presence: bias + sum of weights + sum over pairs of the inner products of factors.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, ship, staged

BUCKETS, FEATURES, FACTORS = 1 << 18, 1024, 8
#: The fit reads at most this many labelled rows, those with the smallest hashes of their ids.
MAX_TRAIN_ROWS = 20_000
#: Steps of gradient descent, whatever the number of rows: few rows are gone through more often.
STEPS, BATCH, RATE = 940, 256, 0.05
#: Pull towards 0, shared by the rows: few rows are trusted less. At most so much more weight has a row of the rarer label 1.
DECAY, MOST_WEIGHT = 2.0, 4.0
THRESHOLD = 0.7
_CACHE_WORDS = 200_000
_TOKEN = re.compile(r"[^\W_]+")


def _terms(word: str) -> list[int]:
    """Buckets of a word and of its stems."""
    raw = {"=" + word, *(f"{k}{word[:k]}" for k in (4, 5, 6) if len(word) > k)}
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in raw]


def _words(text: str | None) -> set[str]:
    return set(_TOKEN.findall(text.lower())) if text else set()


@dataclass
class FactorizationMachine:
    """bucket: sorted hashed terms that have weights; bias; w: weights; v: factors, one row a term."""

    bucket: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, present: np.ndarray) -> float:
        """Probability of label 1 for positions (into bucket) of the terms present."""
        z = self.bias
        if len(present):
            f = self.v[present].astype("f8")
            z += self.w[present].sum() + 0.5 * float((f.sum(0) ** 2 - (f**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _chosen(train: DataFrame) -> list[int]:
    """The FEATURES buckets with the largest chi-square against the label, ties to the smaller bucket."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS), "i8")
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = {t for w in _words(text) for t in _terms(w)}
                n[label, list(ids)] += 1
        at = np.nonzero(n.sum(0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0, at]), pa.array(n[1, at])], ["bucket", "n0", "n1"])

    seen = train.mapInArrow(counts, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    all0, all1 = train.agg(F.coalesce(F.sum(1 - F.col("label")), F.lit(0)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not all0 or not all1:
        return []
    n = F.col("n0") + F.col("n1")
    off = F.col("n1") * F.lit(float(all0)) - F.col("n0") * F.lit(float(all1))
    chi = off * off / (n * (F.lit(float(all0 + all1)) - n + 1))
    best = seen.where((F.col("n0") + F.col("n1")) >= 3).orderBy(chi.desc(), "bucket").limit(FEATURES).select("bucket").collect()
    return sorted(r[0] for r in best)


def _lookup(bucket: np.ndarray):
    """A function from a text to the positions of its terms, with a bounded cache of words."""
    at = {int(b): k for k, b in enumerate(bucket)}
    known: dict[str, tuple[int, ...]] = {}

    def of(text: str | None) -> np.ndarray:
        if len(known) > _CACHE_WORDS:
            known.clear()
        out: set[int] = set()
        for w in _words(text):
            ids = known.get(w)
            if ids is None:
                ids = known[w] = tuple(at[t] for t in _terms(w) if t in at)
            if ids:
                out.update(ids)
        return np.fromiter(sorted(out), "i8", len(out))

    return of


def fit(labelled: DataFrame, seed: int = 11) -> FactorizationMachine:
    """A machine for labelled (id, text, label 0 or 1), a bounded table such as labelled_rows() gives; rows with a null label are left out.

    Without rows of both labels it has no terms, and its bias is the log odds of the (smoothed) share of ones, even
    odds at most: rows of label 1 alone say nothing about what the others look like.
    """
    rows = labelled.where("label in (0, 1)").select("id", "text", F.col("label").cast("int").alias("label"))
    train = staged(rows.select("text", "label", "id"), "toxic-train")
    bucket = np.array(_chosen(train), "i8")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _lookup(bucket)
        for b in batches:
            ids = [of(t).astype("i4").tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), b.column(1), b.column(2).cast(pa.string())], ["ids", "label", "id"])

    got = train.mapInArrow(present, "ids binary, label int, id string").collect()
    got.sort(key=lambda r: (r[2] or "", r[1], bytes(r[0])))  # the rows' order must not depend on how tasks ended
    y = np.array([r[1] for r in got], "f4")
    share = float((y.sum() + 0.5) / (len(y) + 1))
    rng = np.random.default_rng(seed)
    k = len(bucket)
    model = FactorizationMachine(bucket, float(np.log(share / (1 - share))), np.zeros(k, "f4"), rng.normal(0, 0.02, (k, FACTORS)).astype("f4"))
    if not k:
        model.bias = min(model.bias, 0.0)
        return model
    x = np.zeros((len(got), k), "u1")
    for i, r in enumerate(got):
        x[i, np.frombuffer(bytes(r[0]), "i4")] = 1
    decay = DECAY / len(y)
    weigh = np.where(y > 0, min(MOST_WEIGHT, (1 - share) / share), 1).astype("f4")  # the rarer label counts more
    g_w, g_v, g_b = np.full(k, 1e-6, "f4"), np.full((k, FACTORS), 1e-6, "f4"), 1e-6
    for _ in range(-(-STEPS * BATCH // len(y))):
        perm = rng.permutation(len(y))
        for low in range(0, len(y), BATCH):
            at = perm[low : low + BATCH]
            a = x[at].astype("f4")
            s = a @ model.v
            z = model.bias + a @ model.w + 0.5 * ((s**2).sum(1) - a @ (model.v**2).sum(1))
            miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) * weigh[at] / len(at)
            d_w = a.T @ miss + decay * model.w
            d_v = a.T @ (miss[:, None] * s) - model.v * (a.T @ miss)[:, None] + decay * model.v
            d_b = float(miss.sum())
            g_w += d_w**2
            g_v += d_v**2
            g_b += d_b**2
            model.w -= RATE * d_w / np.sqrt(g_w)
            model.v -= RATE * d_v / np.sqrt(g_v)
            model.bias -= RATE * d_b / np.sqrt(g_b)
    return model


def score(docs: DataFrame, model: FactorizationMachine, text_col: str = "text") -> DataFrame:
    """docs with `score` (double, 0 to 1) in place of any column of that name.

    Each whole text is scored by itself: null and empty texts get the score of no terms, repeated rows get
    equal scores, an empty table stays empty, other columns pass through.
    """
    ship(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES terms at most
    docs = docs.drop("score")
    at = docs.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        m = told.value
        present = _lookup(m.bucket)
        for b in batches:
            s = [m.score(present(t)) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(of, StructType([*docs.schema.fields]).add("score", DoubleType()))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept out of every fit: crc32 of its id, as text, mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(id, text, label) of at most MAX_TRAIN_ROWS labelled documents that are not held out.

    The labels are bounded before they meet the documents, so the documents are not shuffled. Of several labels of
    one id the largest counts, of several texts the first in order: one row an id, so that the bound holds.
    """
    few = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("label"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN_ROWS).withColumnRenamed("doc_id", "id")
    few = staged(few, "labels")
    return docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(few), "id").groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "text", "label")
