"""Shared pieces of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: The same white space as plain characters.
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Largest table, in bytes, that an operator broadcasts; beyond it the join is shuffled.
BROADCAST_BYTES = 32 << 20

#: Rows and MB of an Arrow batch while a table is settled: about what a Python worker, and its executor beside the heap, hold of it at once.
BATCH = (1024, 4)

#: Bytes of freed tables that are worth a collection of the driver's garbage.
GC_BYTES = 16 << 20

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """A table of a folder. One of fewer parts than there are cores, such as a single file, is dealt out to all of them; larger ones are read as they are."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and the master is local, as in tests, is a folder of this machine used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not re.match(r"local(\[[^-]*)?$", spark.sparkContext.master):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docquire-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def _file_system(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextlib.contextmanager
def bounded_batches(spark: SparkSession, rows: int, megabytes: int):
    """Arrow batches of a size for what runs inside."""
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": f"{megabytes}m"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def settle(df: DataFrame, name: str = "t", batch: tuple[int, int] = BATCH) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage ends there, so that a lost executor costs no recomputation of what came
    before, and the size of the table is known to the planner afterwards. ``free`` deletes the
    table; what isn't freed goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/docquire-{name}-{uuid.uuid4().hex}"
    with bounded_batches(spark, *batch):
        df.write.option("compression", "zstd").parquet(path)
    at, fs = _file_system(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more; after large ones, let go of the shuffle files of jobs that are done as well."""
    size = 0
    for t in tables:
        path = _paths.pop(t, None)
        if path is not None:
            at, fs = _file_system(t.sparkSession, path)
            size += fs.getContentSummary(at).getLength()
            fs.delete(at, True)
            fs.cancelDeleteOnExit(at)
    if size >= GC_BYTES:  # Spark's cleaner deletes them when the driver collects its garbage
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def settled_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a settled table."""
    at, fs = _file_system(df.sparkSession, _paths[df])
    return fs.getContentSummary(at).getLength()


def small(df: DataFrame, limit: int = BROADCAST_BYTES, times: int = 4) -> DataFrame:
    """Mark a settled table for broadcast if ``times`` its file size is within the limit.

    Beyond the limit the planner's shuffled join, with adaptive splitting of skewed
    partitions, takes its place.
    """
    return F.broadcast(df) if settled_bytes(df) * times <= limit else df


def blocks(df: DataFrame, key: str) -> list[DataFrame]:
    """A settled table as broadcastable parts: one if it is small, else as many by hash of ``key`` as fit the limit."""
    n = max(1, math.ceil(4 * settled_bytes(df) / BROADCAST_BYTES))
    return [F.broadcast(df if n == 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i)) for i in range(n)]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For functions of Arrow batches: a worker that waits for its next task holds no memory that this one is done with."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
            trim(0)

    return tidied


def portions(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes in a column, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        done = sizes[begin - 1] if begin else 0
        stop = max(int(np.searchsorted(sizes, done + limit, "right")), begin + 1)
        yield batch.slice(begin, stop - begin)
        begin = stop


def by_text(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """A list for each of ``n`` texts, null for an empty one; ``values`` stand in the order of ``owner``, the texts they belong to."""
    upto = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(upto), pa.array(values), mask=pa.array(np.diff(upto) == 0))


def words(text: Column) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """A 64-bit name of a text, to tell apart rows that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
