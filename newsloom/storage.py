"""The shared folder for checkpoints, and cutting lineage there."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that Python objects are made of at a time.
PIECE = 512 << 10


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset on a single machine. A cluster without it raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return found or tempfile.mkdtemp(prefix="newsloom-")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, pa.Array]]:
    """Slices of strings or bytes of about so many bytes, of one row at least, and where they begin."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = before = 0
    while a < len(column):
        b = min(int(np.searchsorted(ends, before + size)) + 1, len(column))
        yield a, column.slice(a, b - a)
        a, before = b, int(ends[b - 1])


def give_back() -> None:
    """Free memory goes back to the system: a worker would keep what its largest batch took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)
