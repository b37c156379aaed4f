"""Steps that call a model: extraction, embedding, decisions. The model is a function that is passed in; what comes with the package is deterministic."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Extractor = Callable[[list[str]], list[list[str]]]


def sentences(texts: list[str]) -> list[list[str]]:
    """Statements by punctuation: what stands in for a language model."""
    # A statement begins where the one before, or a line, ends; a search from every letter of an open end would read it as often as it has letters.
    return [[m.strip() for m in re.findall(r"(?<![^.!?\n])[^.!?\n]++[.!?]", t)] for t in texts]


def extract(df: DataFrame, key: str, text: str, client: Extractor, *, batch: int = 32, tries: int = 3) -> DataFrame:
    """key, statement_no, statement. The client gets texts in batches and is asked again if it fails; a null text has no statements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a in range(0, rows.num_rows, batch):
                part = rows.slice(a, batch)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for left in reversed(range(tries)):
                    try:
                        got = client(texts)
                        break
                    except OSError:
                        if not left:
                            raise
                counts = np.array([len(f) for f in got], "i8")
                owner = np.repeat(np.arange(part.num_rows), counts)
                number = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(list(chain.from_iterable(got)), pa.string())], [key, "statement_no", "statement"])

    return df.select(key, F.col(text).cast("string").alias("_t")).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, statement_no int, statement string")


def hashed(texts: list[str], dimensions: int) -> list[list[float]]:
    """Signed counts of words by hash, of unit length."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = xxhash.xxh64_intdigest(w)
            out[i, h % dimensions] += 1 if h >> 63 else -1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, n, out=out, where=n > 0).tolist()


def embed(df: DataFrame, key: str, text: str, dimensions: int = 256, model: Callable[[list[str], int], list[list[float]]] = hashed, *, batch: int = 64) -> DataFrame:
    """key, embedding. A model that returns another number or size of vectors raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a in range(0, rows.num_rows, batch):
                part = rows.slice(a, batch)
                got = model([t or "" for t in part.column(1).to_pylist()], dimensions)
                if len(got) != part.num_rows or any(len(v) != dimensions for v in got):
                    raise ValueError("the model's vectors don't fit")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.list_(pa.float32()))], [key, "embedding"])

    return df.select(key, F.col(text).cast("string").alias("_t")).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, embedding array<float>")


def ends(subject: Column, predicate: Column, value: Column, subject2: Column, predicate2: Column, value2: Column) -> Column:
    """Whether a later statement ends an earlier one: the same subject and predicate, another object."""
    return (subject == subject2) & (predicate == predicate2) & (value != value2)
