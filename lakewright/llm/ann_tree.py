"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every vector is filed under a leaf. A query walks the tree with a
priority queue of branches and visits leaves in the order of their bounds. How many leaves it visits is widened,
on a bounded set of queries whose true neighbours are found by a scan of all rows, until the recall sought is met.

Vectors of another length have no inner product with each other, so each length has a tree of its own; together they
are a forest whose leaves are numbered on. Block products only choose candidates: the scores that count are summed
pair by pair, component after component, so equal vectors have equal scores wherever they lie.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: The tree is fitted on at most so many vectors, those with the smallest hashes of their ids.
MAX_FIT_ROWS = 20_000
#: Queries whose recall is measured.
MAX_CALIBRATION = 200
BRANCHES, LEAF_ROWS, ROUNDS = 8, 128, 10
#: Rows and queries of one leaf that meet in one task; fuller leaves are dealt out over several.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048
TARGET_RECALL = 0.94


@dataclass
class Tree:
    """centre[k], radius[k] of node k; children[k]: its nodes, empty for a leaf; leaf[k]: number of a leaf, else -1."""

    centre: np.ndarray
    radius: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1 if len(self.leaf) else 0

    def file(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: at each level the nearest centre, ties to the first."""
        at = np.zeros(len(x), "i8")
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                at[rows] = self.leaf[node]
                continue
            c = self.centre[kids]
            near = np.argmin((c**2).sum(1)[None, :] - 2 * x[rows] @ c.T, axis=1)
            todo += [(kid, rows[near == k]) for k, kid in enumerate(kids) if (near == k).any()]
        return at

    def best_first(self, q: np.ndarray, visits: int) -> list[int]:
        """The first leaves, at most visits, by inner product with the centre plus a share of what the radius allows."""
        size = float(np.linalg.norm(q))
        rank = self.centre @ q + 0.5 * self.radius * size
        queue, out = [(-rank[0], 0)], []
        while queue and len(out) < visits:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                out.append(int(self.leaf[node]))
            for kid in kids:
                heapq.heappush(queue, (-rank[kid], kid))
        return out


def build_tree(x: np.ndarray, seed: int = 5) -> Tree:
    """Split by k-means until a node has at most LEAF_ROWS sample rows or rows that are all alike."""
    rng = np.random.default_rng(seed)
    centre, radius, children, leaf = [], [], [], []

    def add(rows: np.ndarray) -> int:
        k = len(centre)
        mid = x[rows].mean(0) if len(rows) else np.zeros(x.shape[1])
        centre.append(mid)
        radius.append(float(np.sqrt(np.mean(((x[rows] - mid) ** 2).sum(1)))) if len(rows) else 0.0)
        children.append([])
        leaf.append(-1)
        return k

    todo, leaves = [(add(np.arange(len(x))), np.arange(len(x)))], 0
    while todo:
        node, rows = todo.pop()
        own = x[rows]
        distinct = np.unique(own, axis=0) if len(rows) > LEAF_ROWS else own
        if len(rows) <= LEAF_ROWS or len(distinct) <= BRANCHES:
            leaf[node], leaves = leaves, leaves + 1
            continue
        c = distinct[rng.choice(len(distinct), BRANCHES, replace=False)]
        for _ in range(ROUNDS):
            near = np.argmin((c**2).sum(1)[None, :] - 2 * own @ c.T, axis=1)
            c = np.array([own[near == k].mean(0) if (near == k).any() else c[k] for k in range(BRANCHES)])
        near = np.argmin((c**2).sum(1)[None, :] - 2 * own @ c.T, axis=1)
        groups = [rows[near == k] for k in range(BRANCHES) if (near == k).any()]
        if len(groups) == 1:
            leaf[node], leaves = leaves, leaves + 1
            continue
        for g in groups:
            kid = add(g)
            children[node].append(kid)
            todo.append((kid, g))
    return Tree(np.array(centre), np.array(radius), children, np.array(leaf))


class Forest:
    """A tree for each length of vector; leaves and nodes of all are numbered on. visits: leaves of each length that a query asks."""

    def __init__(self, sample: list[list[float]], lengths: list[int]):
        by: dict[int, list[list[float]]] = {d: [] for d in lengths}
        for v in sample:
            by[len(v)].append(v)
        self.trees = {d: build_tree(np.array(x).reshape(-1, d)) for d, x in sorted(by.items())}
        self.first, self.leaves = {}, 0
        for d, t in self.trees.items():
            self.first[d] = self.leaves
            self.leaves += t.leaves
        self.visits = {d: 1 for d in self.trees}

    def file(self, column: pa.Array) -> np.ndarray:
        """Leaf of each vector."""
        out = np.zeros(len(column), "i4")
        for d, rows, x in _by_length(column):
            out[rows] = self.first[d] + self.trees[d].file(x)
        return out

    def ask(self, v: np.ndarray, visits: int | None = None) -> list[int]:
        """Leaves to visit, best first."""
        d = len(v)
        if d not in self.trees:
            return []
        return [self.first[d] + n for n in self.trees[d].best_first(v, self.visits[d] if visits is None else visits)]


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, matrix) of the vectors of each length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten()).astype("f8")
    sizes = np.asarray(column.value_lengths()).astype("i8")
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        rows = np.nonzero(sizes == d)[0]
        yield d, rows, flat[starts[rows, None] + np.arange(d)]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id long, v array<double>) of the vectors that take part: not null, empty, zero, nor with null or non-finite parts; of any length."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q with the same rows of x, each summed from the first component to the last."""
    total = np.zeros(len(q))
    for a, b in zip(np.ascontiguousarray(q.T), np.ascontiguousarray(x.T), strict=True):
        total += a * b
    return total


def _nearest(q_ids, q, ids, x, k: int):
    """Of each query: its k best rows, (query, row id, score), own row left out, ties to the smaller id.

    A block product chooses the rows that can be among them, with room for its rounding; exact_scores() ranks these.
    """
    if not len(ids) or not len(q_ids):
        return [np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0)]
    out_q, out_i, out_s = [], [], []
    room = 4 * (x.shape[1] + 2) * np.finfo("f8").eps * np.sqrt((q**2).sum(1)) * np.sqrt((x**2).sum(1).max())
    for low in range(0, len(q), 256):
        part, own = q[low : low + 256], q_ids[low : low + 256]
        s = part @ x.T
        s[own[:, None] == ids[None, :]] = -np.inf
        n = min(k, s.shape[1])
        edge = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
        a, b = np.nonzero((s >= (edge - 2 * room[low : low + 256])[:, None]) & (s > -np.inf))
        for at in range(0, len(a), 1 << 18):  # bounds what exact_scores() gathers; ties can be many
            r, c = a[at : at + (1 << 18)], b[at : at + (1 << 18)]
            out_q.append(own[r])
            out_i.append(ids[c])
            out_s.append(exact_scores(part[r], x[c]))
    return _cut(*(np.concatenate(c) if c else np.empty(0, kind) for c, kind in ((out_q, "i8"), (out_i, "i8"), (out_s, "f8"))), k)


def _cut(q: np.ndarray, i: np.ndarray, s: np.ndarray, k: int) -> list[np.ndarray]:
    """The k best rows of each query, best first."""
    by = np.lexsort((i, -s, q))
    q, i, s = q[by], i[by], s[by]
    first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    top = np.arange(len(q)) - start < k
    return [q[top], i[top], s[top]]


def _table(q, i, s, names=("query_id", "vec_id", "score")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(q, "i8")), pa.array(np.asarray(i, "i8")), pa.array(np.asarray(s, "f8"))], list(names))


def _top(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def true_neighbours(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> dict[int, list[int]]:
    """The k best rows of a bounded list of queries, by a scan of all rows in blocks."""
    if not queries:
        return {}
    asked = {d: (np.array([q for q, v in queries if len(v) == d]), np.array([v for _, v in queries if len(v) == d])) for d in {len(v) for _, v in queries}}
    told = vectors.sparkSession.sparkContext.broadcast(asked)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "f8")]  # of all that the task has seen
        for b in batches:
            ids = np.asarray(b.column(0))
            for d, rows, x in _by_length(b.column(1)):
                if d in told.value:
                    best = _cut(*(np.concatenate(c) for c in zip(best, _nearest(*told.value[d], ids[rows], x, k), strict=True)), k)
        yield _table(*best)

    out: dict[int, list[int]] = {}
    for r in _top(vectors.mapInArrow(scan, "query_id long, vec_id long, score double"), k).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def calibrate(forest: Forest, vectors: DataFrame, filed: DataFrame, queries: list[tuple[int, list[float]]], k: int, target: float) -> float:
    """Set visits: for each length the fewest leaves, widened by an eighth at a time, whose mean recall reaches target; the recall of all.

    A length none of whose queries is among these visits all its leaves.
    """
    truth = true_neighbours(vectors, queries, k)
    wanted = vectors.sparkSession.createDataFrame(sorted({(i,) for x in truth.values() for i in x}), "vec_id long")
    leaf = {r["vec_id"]: r["leaf"] for r in filed.join(F.broadcast(wanted), "vec_id").select("vec_id", "leaf").collect()}
    every = []
    for d, tree in forest.trees.items():
        own = [(q, v) for q, v in queries if len(v) == d and truth.get(q)]
        place = [{n: r for r, n in enumerate(forest.ask(np.array(v), tree.leaves))} for _, v in own]
        found = [np.sort([at[leaf[i]] for i in truth[q]]) for (q, _), at in zip(own, place, strict=True)]
        visits = 1 if own else tree.leaves
        recall = lambda n: [float(np.mean(x < n)) for x in found]  # noqa: B023, E731
        while own and visits < tree.leaves and np.mean(recall(visits)) < target:
            visits = min(tree.leaves, max(visits + 1, visits * 9 // 8))
        forest.visits[d] = visits
        every += recall(visits)
    return float(np.mean(every)) if every else 1.0


def search(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, every: int = 20, target: float = TARGET_RECALL, id_col: str = "vec_id", vector_col: str = "embedding", report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows by inner product, in double precision.

    queries: rows of the shape of vectors; else those of vectors whose id is divisible by every. A query's own
    id is no candidate. Ties go to the smaller id. Unusable vectors (see usable) are neither queries nor
    candidates; a query's candidates are the vectors of its own length; of several rows of one id, the smallest
    vector stays. An empty table gives no rows, other columns are ignored. How many lengths there are must be
    bounded (each has a tree). report, if given, gets leaves, visits (of all lengths) and the recall measured on
    the calibration queries.
    """
    spark = vectors.sparkSession
    rows = staged(usable(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0) if queries is None else staged(usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    by_hash = lambda df, n: [(r["vec_id"], r["v"]) for r in df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).collect()]
    sample = by_hash(rows, MAX_FIT_ROWS)
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = Forest([v for _, v in sample], sorted(r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect()))
    filing = spark.sparkContext.broadcast(forest)  # nodes of MAX_FIT_ROWS sample rows at most

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(filing.value.file(b.column(1)))], ["vec_id", "v", "leaf"])

    filed = staged(rows.select("vec_id", "v").mapInArrow(file, "vec_id long, v array<double>, leaf int"), "filed")
    recall = calibrate(forest, rows, filed, by_hash(asked, MAX_CALIBRATION), k, target)
    told = spark.sparkContext.broadcast(forest)
    if report is not None:
        report |= {"leaves": forest.leaves, "visits": sum(forest.visits.values()), "recall": recall}

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, rows_, q in _by_length(b.column(1)):
                leaves = [told.value.ask(x) for x in q]
                at = np.repeat(rows_, [len(x) for x in leaves])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(np.array([n for x in leaves for n in x], "i4"))], ["vec_id", "v", "leaf"])

    visited = staged(asked.select("vec_id", "v").mapInArrow(visit, "vec_id long, v array<double>, leaf int"), "visited")
    # The number of leaves is bounded, so are these counts; they say how finely each leaf is dealt out.
    dealt = lambda df, n, name: df.groupBy("leaf").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    blocks = dealt(filed, BLOCK_ROWS, "rb").join(dealt(visited, BLOCK_QUERIES, "qb"), "leaf")
    blocks = F.broadcast(spark.createDataFrame(blocks.collect(), "leaf int, rb int, qb int"))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = filed.join(blocks, "leaf").select("leaf", own("rb").alias("i"), every_block("qb").alias("j"), F.lit(0).alias("asks"), "vec_id", "v")
    right = visited.join(blocks, "leaf").select("leaf", every_block("rb").alias("i"), own("qb").alias("j"), F.lit(1).alias("asks"), "vec_id", "v")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = left.unionByName(right).repartition(parts, "leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "asks", "vec_id")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block come first, by id, and then its queries; a block has a bounded size."""
        key, ids, xs, q_ids, qs = None, [], [], [], []

        def found() -> pa.RecordBatch | None:
            if not ids or not q_ids:
                return None
            return _table(*_nearest(np.concatenate(q_ids), np.array(qs), np.concatenate(ids), np.array(xs), k))

        for b in batches:
            keys = np.stack([np.asarray(b.column(c)) for c in range(3)], 1)
            asks, vec = np.asarray(b.column(3)), np.asarray(b.column(4))
            x: list = [None] * len(vec)  # rows of a leaf have one length
            for _, rows_, part in _by_length(b.column(5)):
                for r, v in zip(rows_.tolist(), part, strict=True):
                    x[r] = v
            cuts = np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1
            for low, high in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if key is None or (keys[low] != key).any():
                    if (out := found()) is not None:
                        yield out
                    key, ids, xs, q_ids, qs = keys[low], [], [], [], []
                n = low + int((asks[low:high] == 0).sum())
                if n > low:
                    ids.append(vec[low:n])
                    xs += x[low:n]
                if high > n:
                    q_ids.append(vec[n:high])
                    qs += x[n:high]
        if (out := found()) is not None:
            yield out

    out = both.mapInArrow(answer, "query_id long, vec_id long, score double")
    return _top(out, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
