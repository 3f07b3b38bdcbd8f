"""Helpers that the training-data operators share: shared staging, graph components, counting sketches."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the query contracts: a run without space, tab, newline, vertical tab, form feed, carriage return.
WORD_SPLIT = r"[\x20\x09-\x0D]+"

#: Counters of a sketch: fixed, so that what is broadcast (1 byte each) never grows with the input.
SKETCH_BUCKETS = 1 << 24
_BLOCKS = 64
#: Levels of a sketch to each doubling of a count: 255 of them reach beyond 2^60.
_LEVELS = 4

#: Rows of a batch that goes to Python where the session says nothing: texts are long, and batches are held several times over.
BATCH_ROWS = 1000

_staged: list[tuple[SparkSession, str]] = []


_shipped: set[str] = set()

#: In a Python worker: how to empty what each operator remembers there. Workers live on from one stage to the next.
_memories: dict[str, Callable[[], None]] = {}


def remembers(operator: str, forget: Callable[[], None]) -> None:
    _memories[operator] = forget


def only(operator: str) -> None:
    """Called by a task in its worker: what other operators remember there goes."""
    for name, forget in _memories.items():
        if name != operator:
            forget()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, which may not have it installed, once a Spark application; bound Arrow batches."""
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        top = Path(__file__).resolve().parents[2]
        target = Path(tempfile.mkdtemp(prefix="lakewright-")) / "lakewright.zip"  # the driver serves it as long as it runs
        atexit.register(shutil.rmtree, target.parent, True)
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted((top / "lakewright").rglob("*.py")):
                z.write(p, p.relative_to(top))
        context.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone, so that any store Spark knows will do."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with its columns of these names (in any case) renamed, and a function that gives a frame the old names back."""
    taken, moved = {c.lower() for c in docs.columns} | set(names), {}
    for c in docs.columns:
        if c.lower() in names:
            new = c
            while new.lower() in taken:
                new = "_" + new
            taken.add(new.lower())
            moved[c] = new
    return docs.withColumnsRenamed(moved), lambda df: df.withColumnsRenamed({new: c for c, new in moved.items()})


def columns_of(frame: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, in their order, from frame; names may hold dots."""
    return frame.select(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    ship(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lakewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; cleanup() or the end of the process removes it."""
    path = f"{shared_dir(spark)}/lakewright/{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: it cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more: its cleaner follows the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cleanup() -> None:
    """Remove every table that staged() has written; DataFrames that read them must not be used afterwards."""
    while _staged:
        spark, path = _staged.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: a cluster's own cleaner takes over
            continue


atexit.register(cleanup)


def level(counts: np.ndarray) -> np.ndarray:
    """Counts as levels of one byte, on a logarithmic scale that no corpus fills."""
    return np.rint(_LEVELS * np.log2(1.0 + counts)).astype("u1")


def count_sketch(df: DataFrame, hashes) -> tuple[np.ndarray, float]:
    """(levels, mean count) of 64-bit hashes by their low bits, over all rows, in SKETCH_BUCKETS counters; see level().

    hashes: function of a record batch to arrays of uint64, each without repeats. Each task adds up its own counters and
    sends them compressed, in blocks; blocks meet in a few tasks that add them as a stream.
    """
    size = SKETCH_BUCKETS // _BLOCKS

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("sketch")
        counts, sets, one = np.zeros(SKETCH_BUCKETS, "u2"), 0, np.uint16(1)

        def told() -> Iterator[pa.RecordBatch]:
            for k, x in enumerate(np.split(counts, _BLOCKS)):
                x = x.astype("u1") if x.max() < 256 else x
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["block", "counts"])

        for b in batches:
            for h in hashes(b):
                sets += 1
                np.add.at(counts, (h & np.uint64(SKETCH_BUCKETS - 1)).astype("i8"), one)
                if sets == 50_000:  # before a counter is full: a set counts once in it, but for chance
                    yield from told()
                    counts[:] = 0
                    sets = 0
        if sets:
            yield from told()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = zlib.decompress(x)
                x = np.frombuffer(x, "u1" if len(x) == size else "u2").astype("u8")
                sums[k] = sums[k] + x if k in sums else x
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(level(x).tobytes(), 1)], pa.binary()), pa.array([float(x.sum())])], ["block", "counts", "n"])

    rows = df.mapInArrow(part, "block int, counts binary").repartition(16, "block").mapInArrow(total, "block int, counts binary, n double").collect()
    out = np.zeros((_BLOCKS, size), "u1")
    for r in rows:
        out[r[0]] = np.frombuffer(zlib.decompress(bytes(r[1])), "u1")
    return out.reshape(-1), sum(r[2] for r in rows) / SKETCH_BUCKETS


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that edges (a, b: long) connect it with; nodes without edges are left out.

    Every round hooks each root onto the smallest root next to it and then shortens paths, so rounds grow with the
    logarithm of the longest path. A round writes its hooks and its labels to the shared folder. When no edge crosses
    two labels, each component has one, which is its smallest node.
    """
    edges = staged(edges.where("a <> b").distinct(), "edges")
    label = staged(edges.selectExpr("a node", "b other").union(edges.selectExpr("b", "a")).groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "labels")
    for _ in range(most_rounds):
        a, b = label.selectExpr("node a", "component ca"), label.selectExpr("node b", "component cb")
        cross = edges.join(a, "a").join(b, "b").where("ca <> cb").select(F.greatest("ca", "cb").alias("root"), F.least("ca", "cb").alias("to")).groupBy("root").agg(F.min("to").alias("to"))
        cross = staged(cross, "hooks")  # joined as it was written: where many nodes have one root, Spark can deal them out
        if cross.isEmpty():
            return label
        hooked = label.join(cross, F.col("component") == F.col("root"), "left").selectExpr("node", "coalesce(to, component) component")
        up = hooked.selectExpr("node root2", "component to2")
        label = staged(hooked.join(up, F.col("component") == F.col("root2"), "left").selectExpr("node", "coalesce(to2, component) component"), "labels")
    raise RuntimeError("components did not settle")
