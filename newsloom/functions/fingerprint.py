"""Shingles, MinHash and SimHash, as column expressions and grouped aggregates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grams whose hashes a task keeps.
KNOWN = 1 << 16
#: Tokens that votes are counted of at a time.
TOKENS = 1 << 16


def shingles(text: Column, k: int = 3) -> Column:
    """Distinct lower-case k-grams of characters; a shorter text is its own."""
    # The characters are bound once; substring() would lower and walk the text again for every gram.
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - k + 1, F.lit(1))), lambda i: F.concat(*(F.coalesce(F.get(c, i - 1 + j), F.lit("")) for j in range(k))))
    every = F.element_at(F.transform(F.array(F.split(F.lower(text), "")), lambda c: F.array_distinct(grams(c))), 1)
    return F.when(F.length(F.lower(text)) < k, F.array(F.lower(text))).otherwise(every)


def word32(data: Column) -> Column:
    """The first 32 bits of an MD5, unsigned."""
    return F.conv(F.substring(F.md5(data), 1, 8), 16, 10).cast("long")


def minhash(df: DataFrame, key: str, grams: Column, permutations: int = 128) -> DataFrame:
    """key, signature: for each i the least first 32 bits of MD5(gram + i as four little-endian bytes), 2^32 - 1 without grams. One row for each row; words of a gram are kept, KNOWN grams at most."""
    suffix = [i.to_bytes(4, "little") for i in range(permutations)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}

        def words(g: str) -> np.ndarray:
            if g not in known:
                if len(known) >= KNOWN:
                    known.clear()
                known[g] = np.frombuffer(b"".join(hashlib.md5(g.encode() + s).digest()[:4] for s in suffix), ">u4").astype("u4")
            return known[g]

        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                part, out = rows.slice(at, 256), []
                for gs in part.column(1):
                    least = np.full(permutations, 0xFFFFFFFF, "u4")
                    gs = gs.as_py() or []
                    for k in range(0, len(gs), 4096):
                        least = np.minimum(least, np.min([words(g) for g in gs[k : k + 4096]], axis=0))
                    out.append(least.astype("i8"))
                values = pa.array(np.concatenate(out), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(range(0, len(values) + 1, permutations), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [key, "signature"])

    return df.select(key, grams.alias("_g")).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, signature array<bigint>")


def jaccard_estimate(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def simhash(df: DataFrame, key: str, tokens: Column, bits: int = 64) -> DataFrame:
    """key, simhash (hexadecimal): of each bit the sign of the votes of all token occurrences' MD5s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            column = rows.column(1)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), dtype="i8")
            a = before = 0
            while a < len(column):
                # Rows of about TOKENS tokens; a longer one by itself, in slices.
                b = min(int(np.searchsorted(ends, before + TOKENS)) + 1, len(column))
                part, some = column.slice(a, b - a), np.diff(ends[a:b], prepend=before)
                words = part.flatten().dictionary_encode()
                digests = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest()[: bits // 8] for w in words.dictionary.to_pylist()), "u1").reshape(-1, bits // 8)
                signs = np.unpackbits(digests, axis=1).astype("i4") * 2 - 1
                index, starts = words.indices.to_numpy(), np.cumsum(some) - some
                kept = np.flatnonzero(some)
                votes = np.zeros((len(kept), bits), "i8")
                for x in range(0, len(index), 2 * TOKENS):
                    y = min(x + 2 * TOKENS, len(index))
                    owner = np.searchsorted(starts[kept], [x, y - 1], "right") - 1
                    inside = np.arange(owner[0], owner[1] + 1)
                    votes[inside] += np.add.reduceat(signs[index[x:y]], np.maximum(starts[kept][inside] - x, 0), axis=0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, votes.size + 1, bits), pa.int32()), pa.array(votes.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(kept + a)), lists], [key, "v"])
                a, before = b, int(ends[b - 1])

    votes = df.select(key, tokens.alias("_w")).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, v array<bigint>")
    # Rows of one key vote together; a row's own words never leave it.
    grouped = votes.groupBy(key).agg(F.array(*(F.sum(F.col("v")[i]) for i in range(bits))).alias("v"))
    digits = F.transform(F.sequence(F.lit(0), F.lit(bits // 4 - 1)), lambda j: F.hex(F.aggregate(F.slice("v", j * 4 + 1, F.lit(4)), F.lit(0).cast("long"), lambda s, x: s * 2 + (x > 0).cast("long"))))
    return grouped.select(key, F.lower(F.array_join(digits, "")).alias("simhash"))
