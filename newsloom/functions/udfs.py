"""Functions that Spark lacks, as Arrow functions, and their registration for SQL."""

from __future__ import annotations

import html
import unicodedata
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.storage import give_back, pieces


def _texts(one: Callable, kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    """An Arrow function of single texts or bytes. A batch has 10,000 of any length; Python objects are made of a piece of it at a time, and what they took goes back."""

    def run(column: pa.Array) -> pa.Array:
        done = [pa.array([None if t is None else one(t) for t in part.to_pylist()], kind) for _, part in pieces(column)]
        give_back()
        return pa.concat_arrays(done) if done else pa.array([], kind)

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return run


def _nfc(t: str) -> str:
    return unicodedata.normalize("NFC", t)


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of a machine word as long as need be."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    state = (1 << len(a)) - 1
    full = state
    for c in b:
        u = state & places.get(c, 0)
        state = (state + u | state - u) & full
    return len(a) - state.bit_count()


def ratio_of(a: str, b: str) -> float:
    """1 less the share of characters to insert and delete; 1 for two empty strings."""
    return 1.0 if not a and not b else 2 * _lcs(a, b) / (len(a) + len(b))


def partial_ratio_of(a: str, b: str) -> float:
    """The best ratio of the shorter string to a part as long of the longer one, parts that stick out at the ends too."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    n = len(a)
    return max(ratio_of(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio_of(x, y) for x, y in zip(a, b)], dtype="float64")


def _partial(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else partial_ratio_of(x, y) for x, y in zip(a, b)], dtype="float64")


def _inflate(raw: bytes) -> str:
    for wbits in (15, -15, 31):
        try:
            return zlib.decompress(raw, wbits).decode("utf-8", "ignore")
        except zlib.error:
            pass
    return raw.decode("utf-8", "ignore")


def _deflate(t: str) -> bytes:
    return zlib.compress(t.encode(), 6)


def _to_floats(s: pd.Series) -> pd.Series:
    return s.map(lambda raw: None if raw is None else np.frombuffer(bytes(raw), "<f4").tolist())


def _from_floats(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


_HEAD = b"EMBD"


def _from_headed(s: pd.Series) -> pd.Series:
    """Big-endian floats behind a header: mark, version, kind of number, how many."""

    def one(raw):
        if raw is None:
            return None
        raw = bytes(raw)
        n = int.from_bytes(raw[6:10], "big")
        if raw[:4] != _HEAD or raw[4:6] != b"\x01\x01" or len(raw) != 10 + 4 * n:
            raise ValueError("not an embedding")
        return np.frombuffer(raw[10:], ">f4").astype(float).tolist()

    return s.map(one)


def _to_headed(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else _HEAD + b"\x01\x01" + len(v).to_bytes(4, "big") + np.asarray(v, ">f4").tobytes())


_FLOATS = T.ArrayType(T.FloatType())
nfc_full = F.arrow_udf(_texts(_nfc, pa.string()), T.StringType())
unescape_full = F.arrow_udf(_texts(html.unescape, pa.string()), T.StringType())
indel_ratio = F.pandas_udf(_ratio, T.DoubleType())
partial_ratio = F.pandas_udf(_partial, T.DoubleType())
inflate = F.arrow_udf(_texts(_inflate, pa.string()), T.StringType())
deflate = F.arrow_udf(_texts(_deflate, pa.binary()), T.BinaryType())
floats_from_bytes = F.pandas_udf(_to_floats, _FLOATS)
floats_to_bytes = F.pandas_udf(_from_floats, T.BinaryType())
floats_from_headed = F.pandas_udf(_from_headed, _FLOATS)
floats_to_headed = F.pandas_udf(_to_headed, T.BinaryType())


def nfc(text: Column) -> Column:
    """Composed form."""
    return nfc_full(text)


def register_all(spark: SparkSession) -> None:
    for name, f in (
        ("nfc", nfc_full), ("html_unescape", unescape_full), ("indel_ratio", indel_ratio), ("partial_ratio", partial_ratio), ("inflate", inflate), ("deflate", deflate),
        ("floats_from_bytes", floats_from_bytes), ("floats_to_bytes", floats_to_bytes), ("floats_from_headed", floats_from_headed), ("floats_to_headed", floats_to_headed),
    ):
        spark.udf.register(name, f)
