"""Interval operators over half-open spans [start, end) in code points."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], cell: int = 512) -> DataFrame:
    """Rows of a (start, end) with rows of b (start2, end2) that overlap, of the same keys. Both are put into cells of positions, and a pair is taken in the first cell they share."""
    cells = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / cell), F.floor(F.greatest(F.col(e) - 1, F.col(s)) / cell)))
    left, right = a.withColumn("_cell", cells("start", "end")), b.withColumn("_cell", cells("start2", "end2"))
    met = left.join(right, [*keys, "_cell"]).filter((F.col("start") < F.col("end2")) & (F.col("end") > F.col("start2")))
    return met.filter(F.col("_cell") == F.floor(F.greatest("start", "start2") / cell)).drop("_cell")


def contained(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a that lie within a row of b."""
    return overlap_join(a, b, keys).filter((F.col("start2") <= F.col("start")) & (F.col("end") <= F.col("end2"))).select(*a.columns).distinct()


def as_of(a: DataFrame, b: DataFrame, keys: list[str], at: str, before: str, value: str) -> DataFrame:
    """a with the value of b's last row at or before ``at``: one sort of both by key, no join of pairs."""
    left = a.withColumn("_at", F.col(at).cast("double")).withColumn("_side", F.lit(1))
    right = b.select(*keys, F.col(before).cast("double").alias("_at"), F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    own = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(own))
    return both.filter("_side = 1").drop("_at", "_side", "_v")


def nearest(a: DataFrame, b: DataFrame, keys: list[str], a_at: str, b_at: str, limit: float, b_order: str) -> DataFrame:
    """For each row of a the nearest of b within a limit, the least by b_order of equally near ones. Cells as wide as the limit make it an equi-join."""
    cell = F.floor(F.col(a_at) / limit)
    left = a.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    right = b.withColumn("_cell", F.floor(F.col(b_at) / limit))
    gap = F.abs(F.col(a_at) - F.col(b_at))
    met = left.join(right, [*keys, "_cell"]).filter(gap <= limit).withColumn("gap", gap).drop("_cell")
    other = [c for c in b.columns if c not in keys]
    best = met.groupBy(*a.columns).agg(F.min_by(F.struct("gap", *other), F.struct("gap", b_order)).alias("_b"))
    return best.select(*a.columns, "_b.*")


def merged(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end: overlapping and touching spans joined."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.select(*keys, "start", "end").withColumn("_new", F.when(reach >= F.col("start"), 0).otherwise(1))
    runs = opened.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def resolve_overlaps(df: DataFrame, keys: list[str], margin: float = 0.1) -> DataFrame:
    """Greedy by (start, -length, -confidence): a span is kept unless it overlaps the last one kept; a clearly surer one takes its place.

    The fold is sequential: a key's spans pass in order, sorted on disk if need be, and the last one kept is all that is held."""
    n = len(keys)
    rows = df.select("*", *(F.col(c).alias(f"_{i}") for i, c in enumerate([*keys, "start", "end", "confidence"])))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "start", F.desc("end"), F.desc_nulls_last("confidence"))
    width = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = now = last = None
        for batch in batches:
            own, kept, at = batch.select(list(range(width))), [], None
            for i, (s, e, c, *key) in enumerate(zip(*(batch.column(width + j).to_pylist() for j in (n, n + 1, n + 2, *range(n))))):
                if last is not None and key == now and s < last[1] and e > last[0]:
                    if c is None or last[2] is None or not c > last[2] + margin:
                        continue
                elif at is not None:
                    kept.append(at)
                elif held is not None:
                    yield held
                held, now, last, at = None, key, (s, e, c), i
            yield own.take(pa.array(kept, pa.int64()))
            if at is not None:
                held = own.take(pa.array([at]))
        if held is not None:
            yield held

    return rows.mapInArrow(run, df.schema)


def pack(lines: DataFrame, key: str, *, target: int = 512, most: int = 1024) -> DataFrame:
    """key, chunk, start, end, tokens of blocks (key, start, end, tokens) packed in order: a chunk closes at the target, never passes the most; a larger block is one by itself.

    A key's blocks pass in order, sorted on disk if need be; only the chunk at hand is held."""
    rows = lines.select(key, "start", "end", "tokens").repartition(key).sortWithinPartitions(key, "start", "end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for k, s, e, n in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and now[0] == k and now[4] < target and now[4] + n <= most:
                    now[3], now[4] = e, now[4] + n
                    continue
                if now is not None:
                    out.append(now)
                now = [k, now[1] + 1 if now is not None and now[0] == k else 0, s, e, n]
            yield made(out)
        yield made([] if now is None else [now])

    def made(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 5)], names=[key, "chunk", "start", "end", "tokens"])

    return rows.mapInArrow(run, f"{key} bigint, chunk bigint, start bigint, end bigint, tokens bigint")
