"""N-gram Jaccard join: documents link when their word-shingle sets are similar; filtered by several global orders.

Prefix filtering: two sets of similarity t share a token among the first n - ceil(t n) + 1 of each, under any
one total order of all tokens. Here every candidate pair must share a prefix token under each of three orders
(rare first, rare level first with another tie break, a random one) before its intersection is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns_of, components, count_sketch, level, only, release, shared_dir, staged

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: Members and shingles of a block whose pairs one task compares; larger groups are dealt out block against block.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 600_000
#: Tokens counted this many times more than the mean are dealt out by document too, not by token alone.
HOT = 64
#: A hot token's sets meet the token's sizes in so many parts.
SALTS = 64
#: About so many members of a large group are compared with every block of it, so that what is alike is found alike early.
REPRESENTATIVES = 8
#: Set ids that different sets may share, at most: at 10^11 documents a few hundred do.
MOST_SHARED = 100_000

def _mix(h: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(29)) ^ np.uint64(k * 0x51ED27)) * _MIX[k % 4]
        return h ^ (h >> np.uint64(32))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype="u8") | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BASE, _BASE_INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
#: Bytes of text that are hashed at once; only a longer text takes more.
_CHUNK = 1 << 18
_powers = [np.ones(1, "u8"), np.ones(1, "u8")]


def _power(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            with np.errstate(over="ignore"):
                _powers[k] = np.concatenate([np.ones(1, "u8"), np.multiply.accumulate(np.full(max(n, 2 * _CHUNK), base, "u8"))])
    return _powers


def _sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text data[offsets[k]:offsets[k + 1]].

    A word's hash is a polynomial over its bytes, taken for all words at once from one running sum.
    """
    n = len(data)
    space = _SPACE[data]
    edge = np.ones(n, bool)
    edge[1:] = space[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    edge[inner] = True
    starts = np.nonzero(edge & ~space)[0]
    edge = np.ones(n, bool)
    edge[:-1] = space[1:]
    edge[inner - 1] = True
    ends = np.nonzero(edge & ~space)[0] + 1
    power, inverse = _power(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, "u8")
        np.cumsum(_BYTE[data] * power[:n], out=total[1:])
        a = _mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype("u8"), 3)
        cuts = np.searchsorted(starts, offsets)
        h = None
        if len(a) >= words:
            h = np.full(len(a) - words + 1, words, "u8")
            for i in range(words):
                h = (h ^ a[i : len(a) - words + 1 + i]) * _MIX[0]
                h ^= h >> np.uint64(31)
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if high - low >= words:
                x = h[low : high - words + 1].copy()
            elif high > low:
                x = np.full(1, high - low, "u8")
                for i in range(low, high):
                    x = (x ^ a[i : i + 1]) * _MIX[0]
                    x ^= x >> np.uint64(31)
            else:
                yield np.empty(0, "u8")
                continue
            x.sort()
            if len(x) > 1 and (x[1:] == x[:-1]).any():
                x = x[np.concatenate([[True], x[1:] != x[:-1]])]
            yield x


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text; none for null and for texts without words."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], "i8")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw[2], "u1") if raw[2] is not None else np.empty(0, "u1")
    null = texts.is_null().to_numpy(zero_copy_only=False)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + _CHUNK, "right")) - 1)
        high = min(high, len(texts))
        got = _sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], words)
        yield from (x[:0] if null[low + k] else x for k, x in enumerate(got))
        low = high


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def orders(h: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Positions of h's tokens under each global order."""
    doubling = _counted(h, counts) // 4
    return [rare_first(h, counts), np.lexsort((_mix(h, 1), doubling)), np.argsort(_mix(h, 2), kind="stable")]


def _counted(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return counts[(h & np.uint64(len(counts) - 1)).astype("i8")]


def rare_first(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of h's tokens (ascending hashes) by level of their count, then hash."""
    return np.argsort(_counted(h, counts), kind="stable")


def set_ids(h: np.ndarray) -> tuple[int, int]:
    """A set's id, and another one for the rare sets that share the first with a different set."""
    x = xxhash.xxh3_128_intdigest(h.tobytes())
    return (x & (1 << 64) - 1) - (1 << 63), (x >> 64) - (1 << 63)


def set_id(h: np.ndarray, shared: frozenset[int] = frozenset()) -> int:
    """The id of a set; shared: first ids that several sets have."""
    first, other = set_ids(h)
    return other if first in shared else first


def _sets_of(b: pa.RecordBatch, words: int) -> Iterator[np.ndarray]:
    return shingle_sets(b.column(b.schema.get_field_index("text")), words)


class _Find:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def __call__(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self(a), self(b)
        self.up[max(a, b)] = min(a, b)


def _shared(rows: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two rows share, exactly, by products of 0/1 matrices over the tokens met twice."""
    m = len(rows)
    out = np.zeros((m, m), "f4")
    sizes = [len(r) for r in rows]
    token, at, n = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    col = np.cumsum(n > 1) - 1
    keep = (n > 1)[at]
    row, col = np.repeat(np.arange(m), sizes)[keep], col[at][keep]
    width, step = int(np.sum(n > 1)), 4096
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    for low in range(0, width, step):
        i, j = np.searchsorted(col, [low, low + step])
        part = np.zeros((m, min(step, width - low)), "f4")
        part[row[i:j], col[i:j] - low] = 1
        out += part @ part.T
    return out


def linked_pairs(sets: list[np.ndarray], side: np.ndarray, known: np.ndarray, counts: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of positions that link; of two sides (0, 1), only pairs across them; of one, all pairs. Pairs of one class of `known` are left out."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    small, large = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
    mask = np.triu(100 * small >= percent * large, 1)
    if side.any() and not side.all():
        mask &= side[:, None] != side[None, :]
    mask &= known[:, None] != known[None, :]
    cut = [prefix_length(n, percent) for n in sizes]
    by = [orders(s, counts) for s in sets]
    for k in range(3):
        if not mask.any():
            return
        mask &= _shared([s[o[k][:c]] for s, o, c in zip(sets, by, cut, strict=True)]) > 0
    a, b = np.nonzero(mask)
    if len(a) > 4 * m:
        same = _shared(sets)[a, b]
    else:
        same = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)])
    ok = 100 * same >= percent * (sizes[a] + sizes[b] - same)
    yield from zip(a[ok].tolist(), b[ok].tolist(), strict=True)


class _Identify:
    """doc_id, rid, n, sid, alt of each text."""

    def __init__(self, words: int):
        self.words = words

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("ngram join")
        for b in batches:
            got = [(len(h), *(set_ids(h) if len(h) else (None, None))) for h in _sets_of(b, self.words)]
            own = [pa.array([x[k] for x in got], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *own], ["doc_id", "rid", "n", "sid", "alt"])


class _Prefixes:
    """sid, tokens of the prefix under the first order, and a code for each: 4 n + 2 if it is early + 1 if it is counted very often.

    Of a pair that links, the smaller set has their first common token early: at most n (1 - t) / (1 + t) places in.
    """

    def __init__(self, told, hot: int, shared: frozenset[int], percent: int, words: int):
        self.told, self.hot, self.shared, self.percent, self.words = told, hot, shared, percent, words

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = self.told.value
        for b in batches:
            sid, tokens, codes = [], [np.empty(0, "i8")], [np.empty(0, "i8")]
            for h in _sets_of(b, self.words):
                if len(h):
                    first = h[rare_first(h, c)[: prefix_length(len(h), self.percent)]]
                    early = np.arange(len(first)) * (100 + self.percent) <= len(h) * (100 - self.percent)
                    sid.append(set_id(h, self.shared))
                    tokens.append(first.view("i8"))
                    codes.append(4 * len(h) + 2 * early + (_counted(first, c) > self.hot))
            at = pa.array(np.cumsum([len(x) for x in tokens]).astype("i4"), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x).astype("i8"))) for x in (tokens, codes)]
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), *lists], ["sid", "tokens", "codes"])


def _met(prefixes: DataFrame) -> DataFrame:
    """token, sid, n, early of the prefix tokens that two different sets share, or that are hot."""
    rows = prefixes.select("sid", F.explode(F.arrays_zip("tokens", "codes")).alias("x")).select(F.col("x.tokens").alias("token"), "sid", F.col("x.codes").alias("code"))
    # One exchange serves both kinds of token: hot ones are dealt out by set too, and pass.
    hot = F.col("code") % 2 == 1
    w = Window.partitionBy("token", F.when(hot, F.col("sid"))).orderBy("sid")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    alike = rows.withColumns({"lo": F.first("sid").over(whole), "hi": F.last("sid").over(whole), "before": F.lag("sid").over(w)})
    alike = alike.where((hot | (F.col("lo") != F.col("hi"))) & ~F.col("before").eqNullSafe(F.col("sid")))
    return alike.selectExpr("token", "sid", "cast(code div 4 as int) n", "(code div 2) % 2 = 1 early", "code % 2 = 1 hot")


def _fitting(met: DataFrame, percent: int) -> DataFrame:
    """token, sid, n of the rows of met whose token has a partner of fitting size.

    That is a smaller set (or one as large) that has the token early, or a larger one (or one as large) if this one has
    it early. The sizes of a token's sets tell, so the sets of a token need not meet: a hot token's are dealt out.
    """
    sizes = met.groupBy("token", "hot", "n").agg(F.count("*").alias("c"), F.sum(F.col("early").cast("int")).alias("e"))
    by_size = Window.partitionBy("token").orderBy("n")
    smaller = F.last(F.when(F.col("e") > 0, F.col("n")), ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    below = F.coalesce(100 * smaller >= percent * F.col("n"), F.lit(False))
    above = F.coalesce(percent * F.lead("n").over(by_size) <= 100 * F.col("n"), F.lit(False))
    sizes = sizes.select("token", "hot", "n", (below | (F.col("e") > 0)).alias("if_late"), (below | above | (F.col("c") > 1)).alias("if_early")).where("if_late or if_early")
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), SALTS - 1).otherwise(0)))).drop("hot")
    rows = met.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("sid"), F.lit(SALTS)).cast("int")).otherwise(0))
    return rows.join(sizes, ["token", "n", "salt"]).where("if(early, if_early, if_late)").select("token", "sid", "n")


def _compared(dealt: DataFrame, texts: DataFrame, told, shared: frozenset[int], percent: int, words: int) -> DataFrame:
    """(a, b): links, a spanning forest of each block's. dealt: key, i, j, side, sid, known, rid; sets of one (key, i, j) are compared.

    rid tells whose text makes the set. Which rows are needed is told by a bitmap of fixed size in front of the exact join.
    """
    spark = dealt.sparkSession
    asked, _ = count_sketch(dealt.select(F.xxhash64("rid").alias("h")), lambda b: [np.unique(np.asarray(b.column(0)).view("u8"))])
    ask = spark.sparkContext.broadcast(np.packbits(asked > 0, bitorder="little"))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = ask.value
        seen: set[int] = set()  # of this task's rows: one of equal rows is enough
        for b in batches:
            at = np.asarray(b.column(2)).view("u8") & np.uint64(8 * len(bits) - 1)
            keep = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype("u1") & 1).astype(bool)
            for k in np.nonzero(keep)[0].tolist():
                rid = b.column(0)[k].as_py()
                keep[k] = rid not in seen
                seen.add(rid)
            if keep.any():
                b = b.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["rid", "text"])

    asked_texts = texts.select("rid", "text", F.xxhash64("rid").alias("h")).mapInArrow(needed, "rid long, text string")
    # Texts travel, not their sets: they are smaller once compressed.
    rows = dealt.join(asked_texts, "rid").select("key", "i", "j", "side", "sid", "known", "text")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "sid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = told.value
        at, rows = None, []

        def links() -> pa.RecordBatch:
            sids, sides, known, sets_ = [], [], [], []
            for (sid, side, was, _), h in zip(rows, shingle_sets(pa.array([t for *_, t in rows], pa.large_string()), words), strict=True):
                # equal rows can come from several tasks, and rows of an equal hash with another text
                if len(h) and not (sids and sids[-1] == sid) and set_id(h, shared) == sid:
                    sids.append(sid)
                    sides.append(side)
                    known.append(was)
                    sets_.append(h)
            find = _Find(len(sids))
            if len(sids) > 1:
                for a, b in linked_pairs(sets_, np.array(sides), np.array(known), c, percent):
                    find.join(a, b)
            to = [(sids[k], sids[find(k)]) for k in range(len(sids)) if find(k) != k]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in to], pa.int64()), pa.array([x for _, x in to], pa.int64())], ["a", "b"])

        for b in batches:
            for key, i, j, side, sid, known, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (key, i, j) != at:
                    if len(rows) > 1:
                        yield links()
                    at, rows = (key, i, j), []
                rows.append((sid, side, known, text))
        if len(rows) > 1:
            yield links()

    return rows.mapInArrow(compare, "a long, b long")


def similar_groups(docs: DataFrame, percent: int = 85, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of distinct word
    shingles; component_id is the smallest id reachable by links. Other columns are ignored, whatever
    their names. A null, empty or blank text has an empty set and links with nothing (component_id is its
    own id). Rows that repeat, texts or ids, are kept, one output row each. An empty table gives no rows;
    rows with a null id take part like others, and their component is the smallest id that they reach, or null.
    A text of any length is one set.

    Equal sets meet first by a hash of the whole set, so copies cost one row each (sets that share a hash by chance
    are told apart by another one). The token counts that order the tokens cover all documents, in a sketch of fixed
    size: it steers the order only, not the result. Groups of more sets than a block holds are compared block by block
    and with some representatives first; only pairs that this leaves in different classes are compared after that.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))

    levels, mean = count_sketch(docs.select("text"), lambda b: _sets_of(b, words))
    told = spark.sparkContext.broadcast(levels)
    hot = int(level(np.array([HOT * (mean + 1)]))[0])

    members = staged(docs.select("doc_id", "rid", "text").mapInArrow(_Identify(words), "doc_id long, rid long, n int, sid long, alt long"), "members")
    by_set = lambda rows: staged(rows.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("first_id"), F.min("rid").alias("rid"), F.min("n").alias("n"), F.min("alt").alias("lo"), F.max("alt").alias("hi")), "sets")
    sets = by_set(members)
    shared = frozenset(r["sid"] for r in sets.where("lo <> hi").select("sid").limit(MOST_SHARED + 1).collect())
    if len(shared) > MOST_SHARED:
        raise RuntimeError("too many sets share an id; this is not to be expected of fewer than 10^12 documents")
    if shared:
        members = members.withColumn("sid", F.when(F.col("sid").isin(list(shared)), F.col("alt")).otherwise(F.col("sid")))
        sets = by_set(members)
    met = staged(_met(docs.select("text").mapInArrow(_Prefixes(told, hot, shared, percent, words), "sid long, tokens array<long>, codes array<long>")), "met")
    release(spark)
    met = staged(_fitting(met, percent), "fitting")

    # Tokens that have the very same members say the same: one of them stays, known by two sums of hashes.
    mark = lambda seed: F.sum(F.pmod(F.xxhash64("sid", F.lit(seed)), F.lit(1 << 30)))
    groups = met.groupBy("token").agg(F.count("*").alias("m"), mark(1).alias("x"), mark(2).alias("y"), F.sum(F.col("n").cast("long")).alias("weight"), F.min("sid").alias("head")).where("m > 1")
    groups = staged(groups.groupBy("m", "x", "y").agg(F.min_by(F.struct("token", "weight", "head"), "token").alias("g")).selectExpr("g.token", "m", "g.weight", "g.head"), "groups")
    near = staged(met.join(groups, "token"), "near")

    # Groups that touch are compared as one where that sends fewer sets about than taking them one by one.
    label = components(near.select(F.col("sid").alias("a"), F.col("head").alias("b"))).withColumnRenamed("node", "sid")
    deal = lambda m, x: F.greatest(F.ceil(F.col(m) / BLOCK_MEMBERS), F.ceil(F.col(x) / BLOCK_SHINGLES)).cast("int")
    parts = near.select("sid", "n").distinct().join(label, "sid")
    size = parts.groupBy("component").agg(F.count("*").alias("cm"), F.sum(F.col("n").cast("long")).alias("cw"))
    cost = groups.join(label, groups["head"] == label["sid"]).groupBy("component").agg(F.sum(F.col("m") * deal("m", "weight")).alias("apart"))
    size = size.join(cost, "component").withColumn("blocks", deal("cm", "cw")).withColumn("together", F.col("cm") * F.col("blocks") <= F.col("apart"))
    parts = staged(parts.join(size, "component").select("sid", "n", "component", "blocks", "together"), "parts")
    whole = parts.where("together").select(F.col("component").alias("key"), "sid", "n", "blocks")
    apart = parts.where("not together").select("sid").join(near, "sid").select(F.col("token").alias("key"), "sid", "n", deal("m", "weight").alias("blocks"))
    wanted = staged(whole.unionByName(apart).join(sets.select("sid", "rid"), "sid"), "wanted")

    # Each block by itself, with the representatives of its group.
    block = lambda n, seed: F.pmod(F.xxhash64("sid", F.lit(seed)), n).cast("int")
    first = wanted.withColumn("own", block(F.col("blocks"), 3))
    leads = (F.col("blocks") > 1) & (block(F.col("blocks") * (max(1, BLOCK_MEMBERS // REPRESENTATIVES)), 5) == 0)
    first = first.withColumn("i", F.explode(F.when(leads, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))))
    first = first.select("key", "i", F.col("i").alias("j"), F.lit(0).alias("side"), "sid", F.col("sid").alias("known"), "rid")
    joined = components(_compared(first, docs, told, shared, percent, words))

    # Large groups: sets outside a group's largest class meet each other and that class.
    large = wanted.where("blocks > 1").join(joined.selectExpr("node sid", "component known"), "sid", "left").withColumn("known", F.coalesce("known", "sid"))
    classes = large.groupBy("key", "known").agg(F.count("*").alias("c"), F.sum(F.col("n").cast("long")).alias("w"))
    largest = classes.groupBy("key").agg(F.max(F.struct("c", "known", "w")).alias("top"), F.sum("c").alias("m"), F.sum("w").alias("weight")).where("m > top.c")
    largest = largest.select("key", F.col("top.known").alias("top"), F.col("top.c").alias("tc"), F.col("top.w").alias("tw"), (F.col("m") - F.col("top.c")).alias("oc"), (F.col("weight") - F.col("top.w")).alias("ow"))
    largest = staged(largest.select("key", "top", deal("oc", "ow").alias("out"), deal("tc", "tw").alias("inn")), "largest")
    if not largest.isEmpty():
        second = large.join(largest, "key").withColumn("outside", F.col("known") != F.col("top"))
        second = second.withColumn("own", F.when(F.col("outside"), block(F.col("out"), 7)).otherwise(F.col("out") + block(F.col("inn"), 7)))
        second = second.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("outside"), F.col("out") + F.col("inn")).otherwise(F.col("out")) - 1)))
        second = staged(second.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "sid", "known", "rid"), "second")
        links = _compared(second, docs, told, shared, percent, words)
        named = lambda c: joined.selectExpr(f"node {c}", f"component c{c}")
        links = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        over = components(links).selectExpr("node k", "component over")
        joined = joined.union(over.selectExpr("k", "k")).distinct().join(over, F.col("component") == F.col("k"), "left").selectExpr("node", "coalesce(over, component) component")

    told.unpersist()
    named = sets.select("sid", "first_id").join(joined.selectExpr("node sid", "component"), "sid", "left")
    named = named.select("sid", "first_id", F.coalesce("component", "sid").alias("component"))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(lowest, "component").select("sid", "component_id")
    out = members.join(named, "sid", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 85, words: int = 4) -> DataFrame:
    """docs without those whose component has a smaller id; of rows that repeat an id, one stays.

    Rows with a null id stay, whatever they are like; texts without words stay; an empty table stays empty; other columns pass through.
    """
    groups = similar_groups(docs, percent, words)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    known, unknown = docs.where("doc_id is not null"), docs.where("doc_id is null")
    return columns_of(known.join(gone, "doc_id", "left_anti"), docs).dropDuplicates(["doc_id"]).union(columns_of(unknown, docs))
