"""Packing of tokenised documents into sequences: bounded-space online packing.

A partition keeps a fixed number of open windows. Each piece goes into the fullest window that holds it (best
fit); when none does, the fullest window is emitted and a new one opened. A piece that fills a sequence by itself
needs no window. Windows still open at the end of a partition are written out and merged with those of other partitions.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, remembers, staged

CAPACITY, OPEN_WINDOWS = 2048, 32
#: Partitions whose open windows meet in one task at the end.
MERGED_PARTITIONS = 64
#: Runs remembered by a worker, at most twice this many: about 210 bytes each.
_CACHE_WORDS = 300_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """A tokenizer's ids of whole texts, with a bounded cache by white-space run.

    The tokenizer drops white space before anything else sees it, so runs between spaces and newlines are
    encoded alike alone and in a text. Unseen runs of a batch are encoded together, parted by a sign whose
    ids are known; a run that holds this sign is encoded alone. All this rests on what the tokenizer's own file
    says: where its normalizer or its cuts are others, or a special token could lie across runs, texts are encoded whole.
    """

    SIGN = "^"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.sign = np.array(self._alone(self.SIGN), "u4")
        self.lowers, self.by_run = self._known(json.loads(self.tokenizer.to_str()))

    @staticmethod
    def _known(spec: dict) -> tuple[bool, bool]:
        """(whether it lower-cases, whether runs are encoded alike alone and in a text)."""
        steps = lambda x, many: [] if not x else [y for z in x[many] for y in steps(z, many)] if x["type"] == "Sequence" else [x]
        rewriting, cuts = steps(spec.get("normalizer"), "normalizers"), steps(spec.get("pre_tokenizer"), "pretokenizers")
        kinds = [x["type"] for x in rewriting]
        blanks = any(x["type"] == "Replace" and x.get("pattern") == {"Regex": r"\s+"} and x.get("content") == " " for x in rewriting)
        words = bool(cuts) and cuts[0]["type"] == "Split" and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and r"[^\s" in cuts[0]["pattern"].get("Regex", "") and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] for x in cuts[1:])
        special = all(x["content"].startswith("<|") and x["content"].endswith("|>") and not x["normalized"] and not x["lstrip"] and not x["rstrip"] and not x["single_word"] for x in spec.get("added_tokens") or [])
        plain = all(k in ("NFC", "Replace", "Lowercase") for k in kinds) and kinds.count("Replace") == 1 and blanks
        return kinds[-1:] == ["Lowercase"] and special, plain and words and special and spec.get("post_processor") is None and spec.get("truncation") is None

    def _alone(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, runs: list[str]) -> None:
        sign, k = self.sign, len(self.sign)
        plain = [r for r in runs if self.SIGN not in r and "<|" not in r]
        for r in runs:
            if self.SIGN in r or "<|" in r:
                self.young[r] = np.array(self._alone(r), "<u4").tobytes()
        parts = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        texts = [f" {self.SIGN} ".join(p) for p in parts]
        for part, got in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            hit = np.nonzero(ids == sign[0])[0]
            hit = hit[hit <= len(ids) - k]
            for j in range(1, k):
                hit = hit[ids[hit + j] == sign[j]]
            raw = ids.tobytes()
            low = 0
            if len(hit) != len(part) - 1:
                raise ValueError("the tokenizer does not keep white-space runs apart")
            for r, h in zip(part, [*hit.tolist(), len(ids)], strict=True):
                self.young[r] = raw[4 * low : 4 * h]
                low = h + k

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.young) > _CACHE_WORDS:
            self.old, self.young = self.young, {"": b""}
        if not self.by_run:
            return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        # Where the tokenizer lower-cases, only the strings of its special tokens must be met as they are written.
        texts = [t.lower() if t and self.lowers and t.isascii() and "<|" not in t else t or "" for t in texts]
        split = [t.replace("\n", " ").split(" ") for t in texts]
        young, old, new, marked, todo = self.young, self.old, {}, [], []
        out = [list(map(young.get, runs)) for runs in split]
        for runs, parts in zip(split, out, strict=True):
            if None in parts:
                missing = [k for k, x in enumerate(parts) if x is None]
                todo.append((runs, parts, missing))
                for k in missing:
                    r = runs[k]
                    if r in young:
                        continue
                    if (got := old.get(r)) is not None:
                        young[r] = got
                    elif r[-1] in ".,;:" and r[-2:-1].isalnum():  # a mark is a word of its own after a letter or digit
                        marked.append(r)
                        for x in (r[:-1], r[-1]):
                            if x not in young:
                                new[x] = None
                    else:
                        new[r] = None
        if new:
            self.learn(list(new))
        for r in marked:
            young[r] = young[r[:-1]] + young[r[-1]]
        for runs, parts, missing in todo:
            for k in missing:
                parts[k] = young[runs[k]]
        return [b"".join(parts) for parts in out]


_encoders: dict[str, Encoder] = {}
remembers("tokens", _encoders.clear)


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Windows:
    """Open windows of one partition: best fit by binary search over their fills. A full piece opens none."""

    def __init__(self, capacity: int, most: int, first_id: int):
        self.capacity, self.most, self.next = capacity, most, first_id
        self.open: list[tuple[int, int]] = []  # (fill, sequence id), by fill

    def put(self, length: int) -> tuple[int, int]:
        """(sequence id, offset) for a piece of length."""
        at = -1 if length == self.capacity else bisect.bisect_right(self.open, (self.capacity - length, 1 << 62)) - 1
        if at >= 0:
            fill, seq = self.open.pop(at)
        else:
            if length < self.capacity and len(self.open) >= self.most:
                self.open.pop()  # none fits: the fullest is emitted as it is
            fill, seq = 0, self.next
            self.next += 1
        if fill + length < self.capacity:
            bisect.insort(self.open, (fill + length, seq))
        return seq, fill


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (long).

    A document is its ids and then end_id, so a null or empty text is one piece of one id. Documents are cut
    after each full capacity, and nowhere else; their rests go through the open windows. Repeated rows and ids are
    packed one by one; null ids stay null; a text of any length is packed whole; an empty table gives no rows; other
    columns, whatever their names, are ignored. Sequence ids are distinct, not dense.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("tokens")
        part = TaskContext.get().partitionId()
        encoder = _encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        windows = Windows(capacity, open_windows, part << 32)
        for b in batches:
            out: list[tuple] = []
            texts = b.column(1)
            ids = b.column(0).to_pylist()
            for low in range(0, len(ids), 256):
                for doc, raw in zip(ids[low : low + 256], encoder.encode(texts.slice(low, 256).to_pylist()), strict=True):
                    raw += end
                    total, start = len(raw) // 4, 0
                    while start < total:
                        size = min(capacity, total - start)
                        seq, offset = windows.put(size)
                        out.append((doc, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), total, seq, offset, part))
                        start += size
            yield _rows(out)
        yield _rows([(None, -1, fill, 0, 0, seq, 0, part) for fill, seq in windows.open])
        encoder.old = {}  # the worker lives on

    whole = staged(docs.mapInArrow(first, PIECES + ", part int"), "packed")
    left = whole.where("start = -1").select("sequence_id", "length", "part")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def merged() -> pa.RecordBatch:
            moved, bins = [], []  # best fit, longest first
            for fill, seq in sorted(rows, key=lambda x: (-x[0], x[1])):
                at = bisect.bisect_right(bins, (capacity - fill, 1 << 62)) - 1
                was, to = bins.pop(at) if at >= 0 else (0, seq)
                bisect.insort(bins, (was + fill, to))
                if to != seq:
                    moved.append((seq, to, was))
            return pa.RecordBatch.from_arrays([pa.array([m[k] for m in moved], pa.int64()) for k in range(3)], ["sequence_id", "to", "shift"])

        for b in batches:
            for g, seq, fill in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if g != group:
                    if rows:
                        yield merged()
                    group, rows = g, []
                rows.append((fill, seq))
        if rows:
            yield merged()

    group = F.floor(F.col("part") / MERGED_PARTITIONS).cast("long").alias("g")
    moves = left.select(group, "sequence_id", "length").repartition("g").sortWithinPartitions("g", "sequence_id").mapInArrow(merge, "sequence_id long, to long, shift long")
    moves = staged(moves, "moves")
    out = whole.where("start >= 0").join(moves, "sequence_id", "left")
    shifted = out.withColumns({"offset": F.col("offset") + F.coalesce("shift", F.lit(0)), "sequence_id": F.coalesce("to", "sequence_id")})
    return shifted.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k == 7 else pa.int64()) for k in range(8)], names)
