"""The shared folder, written tables, the size-checked broadcast that the operators use, and what keeps their Python workers small."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast below this many bytes (rows counted, times a row's width); beyond it both sides shuffle.
BROADCAST_LIMIT = 64 << 20
#: Bytes of text that Python objects are made of at a time.
PIECE = 512 << 10


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset on a single machine. A cluster without it raises: no executor but one would see the folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = getattr(spark, "_newsloom_dir", None) or "file://" + tempfile.mkdtemp(prefix="newsloom-")
        spark._newsloom_dir = found
    if "://" not in found:
        found = "file://" + found
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/newsloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._newsloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more; others are left alone."""
    for df in tables:
        if path := getattr(df, "_newsloom_path", None):
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries within go when each ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as make it differ from all columns of the table (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def salt(df: DataFrame) -> Column:
    """A hash of a row's columns, the same whenever a task runs again. It spreads rows that share a null key."""
    plain = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """A broadcast hint if the rows, counted, fit the limit; else the DataFrame as it is. Give a written() one: it is counted."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def pieces(batch: pa.RecordBatch, n: int, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, of one row at least, that end where the values of column n (strings or bytes) come to size bytes. What is made of values is held for one slice."""
    column = batch.column(n)
    if not any(kind(column.type) for kind in (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary)):
        yield batch
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = before = 0
    while a < batch.num_rows:
        b = min(int(np.searchsorted(ends, before + size)) + 1, batch.num_rows)
        yield batch.slice(a, b - a)
        a, before = b, int(ends[b - 1])


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for mapInArrow, after whose rows free memory goes back to the system: a worker waits for its next task with all that its allocators keep, also while the JVM beside it works alone."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return whole


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system that holds a URI, and the path in it; works on the driver and on executors."""
    return pafs.FileSystem.from_uri(uri)
