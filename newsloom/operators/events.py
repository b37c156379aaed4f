"""Events: revisions, metrics, alerts, timelines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.ids import sid


def first_rows(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key; a sort within keys, no collection."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def revisions(df: DataFrame, event: str, order: list[str], document: str) -> DataFrame:
    """Adds revision_no, supersedes (the previous one's id), documents (how many distinct so far) and revision_id."""
    own = Window.partitionBy(event).orderBy(*order)
    numbered = df.withColumn("revision_no", F.row_number().over(own)).withColumn("revision_id", sid(event, "revision_no"))
    seen = Window.partitionBy(event, document).orderBy(*order)
    numbered = numbered.withColumn("_first", (F.row_number().over(seen) == 1).cast("int"))
    return numbered.withColumn("supersedes", F.lag("revision_id").over(own)).withColumn("documents", F.sum("_first").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("_first")


def current(df: DataFrame, event: str, *columns: str) -> DataFrame:
    """Of each event the columns of its highest revision."""
    return df.groupBy(event).agg(F.max_by(F.struct(*columns), "revision_no").alias("_c")).select(event, "_c.*")


def slot_confidence(slots: list[Column], confidences: Column) -> Column:
    """0.6 for the share of filled slots, 0.4 for their mean confidence (0.5 without any)."""
    filled = sum((s.isNotNull().cast("int") for s in slots), F.lit(0)) / len(slots)
    return 0.6 * filled + 0.4 * F.coalesce(confidences, F.lit(0.5))


def suppress(df: DataFrame, keys: list[str], at: str, hours: str | float, order: list[str] = ()) -> DataFrame:
    """Alerts among matches: of each key the first one, and each that comes later than the window after the last alert. A match that is suppressed opens no window.

    The rows of a key pass in order, sorted on disk if need be; all that is kept is the last alert's time. hours: a number, or a column. order: what breaks ties of time.
    """
    width = F.col(hours) if isinstance(hours, str) else F.lit(hours)
    rows = df.select("*", F.unix_micros(F.col(at).cast("timestamp")).alias("_t"), (width * 3600e6).cast("long").alias("_w"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, at, *order)
    n = len(df.columns)
    same = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            keep = []
            parts = [batch.column(i).to_pylist() for i in same]
            for t, w, *key in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), *parts):
                fresh = now is None or key != now
                # A row without a time has no window and is no one's last alert.
                due = t is not None and (fresh or last is None or t - last > w)
                if fresh:
                    now, last = key, None
                if due:
                    last = t
                keep.append(due)
            yield batch.select(list(range(n))).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, df.schema)


def metric_series(df: DataFrame, name: Column, geography: Column, unit: Column, period: Column, value: Column) -> DataFrame:
    """series_id, period_start, points, total, previous, change by series and month."""
    points = df.select(name.alias("metric"), geography.alias("geography"), unit.alias("unit"), F.to_date(F.date_trunc("month", period)).alias("period_start"), value.alias("v"))
    summed = points.groupBy("metric", "geography", "unit", "period_start").agg(F.count("*").alias("points"), F.sum("v").alias("total"))
    series = Window.partitionBy("metric", "geography", "unit").orderBy("period_start")
    return summed.withColumn("series_id", sid("metric", "geography", F.lit("month"), "unit")).withColumn("previous", F.lag("total").over(series))


def date_spine(df: DataFrame, at: str, days: int) -> DataFrame:
    """day, n of the last days up to the last one with rows, days without rows too."""
    counts = df.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"))
    last = counts.agg(F.max("day").alias("last"))
    spine = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))
