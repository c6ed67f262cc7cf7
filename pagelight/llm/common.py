"""Helpers shared by the training-data operators: inputs, durable tables, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's defaults for an Arrow batch, and what they become where the session has them.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once a context: their workers need not have it installed.

    Where the session has Spark's defaults for an Arrow batch, whose long texts would fill a worker, it
    gets smaller ones."""
    for key, (default, value) in ARROW.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)
    context = spark.sparkContext
    if getattr(context, "_pagelight", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="pagelight-code-"), "pagelight.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(root)))
    context.addPyFile(path)
    context._pagelight = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store Spark knows will do."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode, where both are
    one process, a temporary one if that isn't set."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_pagelight_dir", None)
    if not found:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = context._pagelight_dir = tempfile.mkdtemp(prefix="pagelight-")
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    """A path and its file system, for the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet into the shared folder and read it back.

    Shuffle files of the write are of no use after it; Spark is told to delete them then. The table goes
    when the driver ends, or with drop()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    p, store = _path(spark, path)
    store.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that materialise() wrote, once nothing reads it any more."""
    path = getattr(df, "_written_to", None)
    if path:
        p, store = _path(df.sparkSession, path)
        store.delete(p, True)


_claimed: list = [None, None]  # the operator that this worker process serves, and what clears its caches


def release() -> None:
    """Give memory that Arrow and the C library keep for later back to the system, where they can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def claim(owner: str, clear=None) -> None:
    """Called on a worker by an operator that begins there. Spark keeps worker processes; what the operator
    before has cached in this one goes, and so does what its work has left in allocators, as memory is for the one that runs."""
    if _claimed[0] not in (None, owner):
        if _claimed[1] is not None:
            _claimed[1]()
        release()
    _claimed[:] = [owner, clear]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (n + 1) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(offsets: np.ndarray, size: int):
    """Row ranges whose bytes come to about `size`; a longer row gets a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


class Forest:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected `edges` (a long, b long): (node, component), the smallest node.

    Alternating large-star and small-star rounds. Each finds the least neighbour of every node by an
    aggregation that combines before its shuffle, and joins it back to the node's edges; the edges of a
    hot node are shuffled as they are, which adaptive execution splits. Each round is written to the
    shared folder. No links or labels come to the driver, only a count and a checksum.
    """
    now = materialise(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: a node's smaller neighbours and the node itself go to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = materialise(small, "stars")
        drop(now)
        now = small
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (sums["n"], sums["s"]) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = (sums["n"], sums["s"])
