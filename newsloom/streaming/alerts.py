"""Streams: incremental ingestion, daily digests, suppressed alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    """A stream of the event files of a folder that fit a pattern, so many at a time."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need it


def digest(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """window, event_type, items, total: closed once the watermark has passed the window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("items"), F.round(F.sum("value"), 2).alias("total"))


def alerts(events: DataFrame, matches: Column, keys: list[str], window: str) -> DataFrame:
    """Matching events, the first of each key within a window; state older than the window is dropped by the watermark."""
    return events.filter(matches).withWatermark("ts", window).dropDuplicatesWithinWatermark(keys)


def ingest(stream: DataFrame, target: str, key: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Append rows of unknown keys to a table. A batch that is run again overwrites its own folder, so nothing comes twice."""

    def write(batch: DataFrame, number: int) -> None:
        fresh = transform(batch).dropDuplicates([key])
        try:
            known = batch.sparkSession.read.parquet(target).filter(F.col("batch") != number).select(key)
            fresh = fresh.join(known, key, "left_anti")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        fresh.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
