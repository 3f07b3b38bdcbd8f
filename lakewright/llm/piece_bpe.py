"""SentencePiece encoding and decoding of merge-type (BPE) models by an agenda of adjacent symbol pairs.

The agenda holds each adjacent pair that forms a piece, best score first, leftmost first among equals; the top
pair merges, its new neighbours enter the agenda, pairs whose symbols have changed since are passed over.
Merges never cross a boundary that no piece spans, so each stretch between such boundaries is encoded by itself
and remembered. Every stretch encoded anew is checked against the sentencepiece library, batch by batch.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, only, remembers, ship

SPACE = "▁"
#: Stretches remembered by a worker, at most twice this many: about 250 bytes each.
_CACHE_WORDS = 400_000
#: Texts of a task that are compared with the library whole, besides every stretch by itself.
VERIFIED = 64
# Kinds of piece in the model file.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        n = shift = 0
        while True:
            x = raw[i]
            i += 1
            n |= (x & 127) << shift
            shift += 7
            if x < 128:
                return n

    while i < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield tag >> 3, raw[i : i + size]
            i += size


class PieceModel:
    """Pieces and scores of a merge-type model with byte fallback and no rewriting of text."""

    def __init__(self, path: str):
        import sentencepiece

        raw = open(path, "rb").read()  # a local file of every executor, as the library needs
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, trainer, rewriting = [], {}, {}
        for field, value in _fields(raw):
            if field == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, _NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                rewriting = dict(_fields(value))
        if trainer.get(3) != 2 or rewriting.get(1) != b"identity" or rewriting.get(4, 1):
            raise ValueError("not a merge-type model that leaves text as it is")
        self.dummy_prefix = bool(rewriting.get(3, 1))
        self.id = {p: k for k, (p, _, kind) in enumerate(pieces) if kind == _NORMAL}
        ranks = sorted({-s for _, s, kind in pieces if kind == _NORMAL})
        rank = {s: k for k, s in enumerate(ranks)}  # equal scores have equal ranks: the leftmost pair goes first
        self.rank = {p: rank[-s] for p, s, kind in pieces if kind == _NORMAL}
        self.byte = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        self.unknown = next(k for k, x in enumerate(pieces) if x[2] == _UNKNOWN)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.stretch = self._stretches()
        #: Marks that no piece joins to a letter or digit before them.
        self.marks = tuple(m for m in ".,;:" if not any(re.search(rf"\w\{m}", p) for p in self.id))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _stretches(self) -> re.Pattern | None:
        """A pattern that cuts text where no piece spans the cut: before spaces and around newlines."""
        if any(re.search(f"[^{SPACE}]{SPACE}", p) or ("\n" in p and len(p) > 1) for p in self.id):
            return None
        return re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")

    def merge(self, text: str) -> list[int]:
        """Ids of one stretch, by the agenda."""
        symbols = list(text)
        n = len(symbols)
        if n > 1:
            rank, pop, push = self.rank.get, heapq.heappop, heapq.heappush
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            agenda = [r << 32 | k for k, r in enumerate(map(rank, map(add, symbols, symbols[1:]))) if r is not None]
            heapq.heapify(agenda)
            while agenda:
                top = pop(agenda)
                k = top & 0xFFFFFFFF
                j = after[k]
                if j >= n or not symbols[k]:
                    continue
                piece = symbols[k] + symbols[j]
                if rank(piece) != top >> 32:
                    continue
                symbols[k], symbols[j] = piece, ""
                nxt = after[k] = after[j]
                if nxt < n:
                    before[nxt] = k
                    r = rank(piece + symbols[nxt])
                    if r is not None:
                        push(agenda, r << 32 | k)
                prev = before[k]
                if prev >= 0:
                    r = rank(symbols[prev] + piece)
                    if r is not None:
                        push(agenda, r << 32 | prev)
        ids, known = [], self.id
        for s in symbols:
            if s:
                k = known.get(s)
                if k is not None:
                    ids.append(k)
                elif self.byte:
                    ids.extend(self.byte[x] for x in s.encode())
                else:
                    ids.append(self.unknown)
        return ids

    def _learn(self, new: list[str]) -> None:
        """Encode unseen stretches, and check them against the library in one call.

        The library puts a space before every text, so a stretch that begins with one is given without it,
        and another gets a first stretch of that space and a newline, whose ids are then dropped.
        """
        lead = self.merge(SPACE) + self.merge("\n")
        given = [s[1:] if s[0] == SPACE else "\n" + s for s in new]
        drop = [0 if s[0] == SPACE else len(lead) for s in new]
        own = [self.merge(s) for s in new]
        if self.stretch is None or not self.dummy_prefix:  # texts come whole, or nothing is put before them
            given, drop = [s[1:] if self.dummy_prefix else s for s in new], [0] * len(new)
        if new:
            told = self.library.encode(given, num_threads=1)
            for s, a, b, k in zip(new, own, told, drop, strict=True):
                if a != b[k:] and s != SPACE:
                    raise ValueError(f"the agenda and the library differ on {s[:80]!r}")
        for s, a in zip(new, own, strict=True):
            self.young[s] = array("I", a).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit integers."""
        if len(self.young) > _CACHE_WORDS:
            self.old, self.young = self.young, {}
        split = []
        for t in texts:
            t = (SPACE if t and self.dummy_prefix else "") + (t or "").replace(" ", SPACE)
            split.append(self.stretch.findall(t) if self.stretch is not None else [t] if t else [])
        young, old, new, marked = self.young, self.old, {}, []
        for parts in split:
            for s in parts:
                if s not in young:
                    if (got := old.get(s)) is not None:
                        young[s] = got
                    elif s.endswith(self.marks) and s[-2:-1].isalnum():
                        marked.append(s)
                        for x in (s[:-1], s[-1]):
                            if x not in young:
                                new[x] = None
                    else:
                        new[s] = None
        if new:
            self._learn(list(new))
        for s in marked:
            young[s] = young[s[:-1]] + young[s[-1]]
        a, z = (np.array([x], "<u4").tobytes() for x in (self.begin, self.end))
        return [b"".join([a, *[young[s] for s in parts], z]) for parts in split]

    def verify(self, texts: list[str | None], ids: list[bytes]) -> None:
        """Whole texts against the library: stretches are right one by one, and so must they be put together."""
        for text, own, told in zip(texts, ids, self.library.encode([t or "" for t in texts], add_bos=True, add_eos=True, num_threads=1), strict=True):
            if np.frombuffer(own, "<u4").tolist() != told:
                raise ValueError(f"the agenda and the library differ on {(text or '')[:80]!r}")

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.library.decode([np.frombuffer(x, "<u4").tolist() for x in ids])


_models: dict[str, PieceModel] = {}
remembers("pieces", _models.clear)


def _model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, model_path: str, text_col: str = "text", with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """docs with n_tokens (long), ids_sha256, decoded_sha256, and where asked for ids (binary: little-endian
    unsigned 32-bit integers) and decoded (text); these replace columns of the same names.

    A null text counts as empty: begin and end alone. Each whole text is encoded by itself, so repeated rows
    get equal results; an empty table stays empty; other columns pass through.
    """
    ship(docs.sparkSession)
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_text]
    docs, back = aside(docs.drop(*names), "_t")
    docs = docs.withColumn("_t", F.col(text_col).cast("string"))
    at = docs.columns.index("_t")
    others = [c for c in docs.columns if c != "_t"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("pieces")
        m, verified = _model(model_path), 0
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                b = whole.slice(low, 256)
                ids = m.encode(b.column(at).to_pylist())
                if verified < VERIFIED:
                    part = b.column(at).slice(0, VERIFIED - verified).to_pylist()
                    m.verify(part, ids[: len(part)])
                    verified += len(part)
                texts = m.decode(ids)
                got = [
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()),
                ]
                got += [pa.array(ids, pa.binary())] * with_ids + [pa.array(texts, pa.string())] * with_text
                yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(b.columns) if k != at), *got], [*others, *names])

    from pyspark.sql.types import BinaryType, LongType, StringType, StructType

    schema = StructType([f for f in docs.schema.fields if f.name != "_t"]).add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType())
    if with_ids:
        schema = schema.add("ids", BinaryType())
    if with_text:
        schema = schema.add("decoded", StringType())
    return back(docs.mapInArrow(of, schema))
