"""Publication tables: reading compressed texts, mappings, configuration; writing texts, catalogues and matrices."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.udfs import deflate, inflate
from newsloom.ids import sid

SCHEMA = "id string, published_on timestamp, title string, added_on timestamp, url string, language string, post binary"


def read_publications(spark: SparkSession, path: str, *, latest_first: bool = False) -> DataFrame:
    """Publications with their texts; rows without url, title or date are left out."""
    rows = spark.read.schema(SCHEMA).parquet(path).filter("url IS NOT NULL AND title IS NOT NULL AND published_on IS NOT NULL")
    rows = rows.withColumn("text", inflate("post")).drop("post")
    return rows.orderBy(F.desc("published_on"), "id") if latest_first else rows


def find_publication(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The publication of an id; the filter reaches the scan."""
    return read_publications(spark, path).filter(F.col("id") == key)


def to_publications(df: DataFrame) -> DataFrame:
    """Rows (url, title, published_on, added_on, language, text) in the stored form; the id is that of the url."""
    return df.select(sid("url").alias("id"), "published_on", "title", "added_on", "url", "language", deflate("text").alias("post"))


def read_mappings(spark: SparkSession, path: str) -> DataFrame:
    """bad, good, line of a mapping file: ``bad -> good`` or with an arrow or a tab; # begins a comment."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "x"))
    parts = F.split("x", r"\s*(?:->|→|\t)\s*", 2)
    rows = lines.filter(~F.trim("x").startswith("#") & (F.size(parts) == 2)).select(F.trim(parts[0]).alias("bad"), F.trim(parts[1]).alias("good"), "line")
    return rows.filter("bad <> ''")


def write_markdown(df: DataFrame, folder: str, *, key: str, title: str, text: str) -> int:
    """One file for each publication, named by title and key; returns how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at)
        n = 0
        for batch in batches:
            for k, head, body in zip(*(c.to_pylist() for c in batch.columns)):
                name = re.sub(r"[^\w-]+", "_", head or "untitled")[:80].strip("_") or "untitled"
                with fs.open_output_stream(f"{at}/{name}-{k}.md") as f:
                    f.write(f"# {head or ''}\n\n{body or ''}\n".encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return df.select(F.col(key).cast("string"), title, text).mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def write_catalogue(df: DataFrame, folder: str, run: str) -> None:
    """Rows as Parquet below a run, and as JSON lines; a run that is written again replaces only itself."""
    out = df.withColumn("run", F.lit(run))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{folder}/catalogue")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").json(f"{folder}/traces")


def scrape_matrix(df: DataFrame, publisher: str, at: str, publishers: list[str] | None = None) -> DataFrame:
    """day by publisher counts. Give the publishers, or they are read first, by a distinct."""
    return df.groupBy(F.to_date(at).alias("day")).pivot(publisher, publishers).count().na.fill(0)


def config_version(config: dict) -> str:
    """The digest of a configuration, its keys in order."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def slice_tables(tables: dict[str, DataFrame], keys: dict[str, str], rows: int = 20) -> dict[str, DataFrame]:
    """The first rows of each table by its key, for tests."""
    return {name: df.orderBy(keys[name]).limit(rows) for name, df in tables.items()}
