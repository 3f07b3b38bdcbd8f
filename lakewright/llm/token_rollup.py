"""Token counts as rollups kept up to date by deltas: signed inserts, deletes and revisions, committed in batches.

A batch is aggregated to one row per source, language and tokenizer version and written beside the others; the
totals are the sum of all committed batches. A batch's folder gets its name by one rename, so a batch is there
whole or not at all, and a batch that is committed again changes nothing. That needs a store whose rename of a folder
is atomic (HDFS, a POSIX file system); an object store that copies instead needs a table format in front of it.
compact() sums what has been committed so far into one table, which totals() then reads in place of those batches.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import _encoder

KEYS = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


class TokenRollup:
    """Totals of a folder on shared storage; any number of them can read while one commits."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        path, files = self._path("batches")
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes (source, lang, tokenizer, docs, tokens); False if batch is there already.

        Null sources, languages and tokenizers are groups of their own; null numbers count as 0; other columns
        are ignored; a batch without rows is committed as such.
        """
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError("a batch id has letters, digits, - and _ only")
        final, files = self._path("batches", batch)
        if files.exists(final):
            return False
        delta = changes.groupBy(*(F.col(k).cast("string").alias(k) for k in KEYS)).agg(*(F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0))).alias(c) for c in ("docs", "tokens")))
        aside = f"open-{uuid.uuid4().hex}"
        delta.where("docs <> 0 or tokens <> 0").write.parquet(f"{self.folder}/{aside}")
        files.mkdirs(final.getParent())
        if not files.exists(final) and files.rename(self._path(aside)[0], final):
            inside, _ = self._path("batches", batch, aside)
            if not files.exists(inside):
                return True
            files.delete(inside, True)  # another commit of this batch came first
            return False
        files.delete(self._path(aside)[0], True)
        return False

    def _compacted(self) -> tuple[str | None, set[str]]:
        """The newest compaction's folder and the batches that it covers."""
        path, files = self._path("compacted")
        names = sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []
        if not names:
            return None, set()
        folder = f"{self.folder}/compacted/{names[-1]}"
        return f"{folder}/rows", {r[0] for r in self.spark.read.text(f"{folder}/covers").collect()}

    def compact(self) -> int:
        """Sum all batches committed so far into one table; how many it covers. Batches stay known by their ids."""
        ids = self.committed()
        last, covered = self._compacted()
        if not ids or covered >= set(ids):
            return len(ids)
        aside = f"open-{uuid.uuid4().hex}"
        self._sums(ids, last, covered).write.parquet(f"{self.folder}/{aside}/rows")
        self.spark.createDataFrame([(i,) for i in ids], "id string").coalesce(1).write.text(f"{self.folder}/{aside}/covers")
        # Named by how much it covers: of two at a time either holds whole batches, and none is lost.
        final, files = self._path("compacted", f"{len(ids):012d}-{uuid.uuid4().hex}")
        files.mkdirs(final.getParent())
        if not files.rename(self._path(aside)[0], final):
            files.delete(self._path(aside)[0], True)
        return len(ids)

    def _sums(self, ids: list[str], last: str | None, covered: set[str]) -> DataFrame:
        paths = [*([last] if last else []), *(f"{self.folder}/batches/{b}" for b in ids if b not in covered)]
        rows = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches; groups that have come to nothing are left out."""
        return self._sums(self.committed(), *self._compacted())


def changes(docs: DataFrame, counts: dict[str, str], sign: int) -> DataFrame:
    """Signed changes of docs (source, lang and the counts): counts maps tokenizer versions to columns that hold their counts.

    Null counts are 0; every row counts, repeated ones too; other columns are ignored; an empty table gives no changes.
    """
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col(c).cast("long").alias("n")) for v, c in counts.items()]))
    return docs.select("source", "lang", each.alias("x")).select("source", "lang", "x.tokenizer", F.lit(sign).alias("docs"), (sign * F.coalesce("x.n", F.lit(0))).alias("tokens"))


def revisions(docs: DataFrame, counts: dict[str, tuple[str, str]]) -> DataFrame:
    """Changes of documents that stay with another count: counts maps versions to columns (before, after).

    A null count on either side changes nothing; every row counts, repeated ones too; an empty table gives no changes.
    """
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer"), (F.col(b) - F.col(a)).cast("long").alias("n")) for v, (a, b) in counts.items()]))
    return docs.select("source", "lang", each.alias("x")).select("source", "lang", "x.tokenizer", F.lit(0).alias("docs"), F.coalesce("x.n", F.lit(0)).alias("tokens"))


def count_tokens(docs: DataFrame, text_cols: dict[str, str], tokenizer_path: str | None = None, counter: Callable[[str], int] | None = None) -> DataFrame:
    """docs without text_cols' texts but with the token count of each (text column: name of its count), by a tokenizer file or a function.

    Null and empty texts have 0 tokens, long ones are counted whole. A second text that equals the first is not
    tokenised again. Rows that repeat are counted one by one, an empty table stays empty; other columns pass through,
    but for those named like a count, which are replaced.
    """
    cols = list(text_cols)
    counts = {c.lower() for c in text_cols.values()}
    others = [c for c in docs.columns if c not in text_cols and c.lower() not in counts]
    docs = docs.select(*others, *(F.col(c).cast("string").alias(c) for c in cols))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                b = whole.slice(low, 256)
                texts = [b.column(len(others) + k).to_pylist() for k in range(len(cols))]
                need = sorted({(k, r) for k in range(len(cols)) for r in range(b.num_rows) if texts[k][r] and (k == 0 or texts[k][r] != texts[0][r])})
                got = [counter(texts[k][r]) for k, r in need] if counter else [len(x) // 4 for x in _encoder(tokenizer_path).encode([texts[k][r] for k, r in need])]
                n = dict(zip(need, got, strict=True))
                out = [pa.array([n.get((k, r), n.get((0, r), 0)) if texts[k][r] else 0 for r in range(b.num_rows)], pa.int64()) for k in range(len(cols))]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], *out], [*others, *text_cols.values()])

    from pyspark.sql.types import LongType, StructType

    schema = StructType([docs.schema[c] for c in others])
    for c in text_cols.values():
        schema = schema.add(c, LongType())
    return docs.mapInArrow(of, schema)
