"""Queries over functions that need Python, resolution and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.catalog import query, table
from newsloom.functions import udfs
from newsloom.functions.text import acronym
from newsloom.operators import extraction, resolution
from newsloom.storage import shared_folder
from newsloom.streaming import alerts


@query("nfc_normalize", "SELECT doc_id, nfc_normalize(replace(text, 'é', 'e' || chr(769))) AS body FROM documents")
def nfc_normalize(spark, sf_dir):
    apart = F.replace(F.col("text"), F.lit("é"), F.lit("é"))
    return table(spark, sf_dir, "documents").select("doc_id", udfs.nfc(apart).alias("body"))


@query("zlib_codec", "SELECT doc_id, sha256(text) AS text_hash, true AS same FROM documents")
def zlib_codec(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", udfs.inflate(udfs.deflate("text")).alias("back"))
    return rows.select("doc_id", F.sha2("back", 256).alias("text_hash"), (F.col("back") == F.col("text")).alias("same"))


@query("vector_codec", "SELECT vec_id, len(embedding)::BIGINT AS n, true AS same FROM embeddings")
def vector_codec(spark, sf_dir):
    e = F.col("embedding")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", udfs.floats_from_bytes(udfs.floats_to_bytes(e)).alias("a"), udfs.floats_from_headed(udfs.floats_to_headed(e)).alias("b"))
    return rows.select("vec_id", F.size("a").cast("long").alias("n"), ((F.col("a") == e) & (F.col("b") == e)).alias("same"))


@query("fuzzy_names")
def fuzzy_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("kind"), F.col("p_type").alias("name")).distinct()
    return resolution.fuzzy_clusters(rows, "kind", "name", 0.8)


@query("acronym_merge", "WITH n AS (SELECT DISTINCT p_name AS name FROM part), s AS (SELECT name, upper(array_to_string(list_transform(list_filter(string_split(name, ' '), lambda w: w <> ''), lambda w: w[1]), '')) AS acronym FROM n WHERE contains(name, ' ')) SELECT acronym, min(name) AS name FROM s GROUP BY 1")
def acronym_merge(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return resolution.acronyms(names.unionByName(names.filter("name LIKE '% %'").select(acronym(F.col("name")).alias("name"))))


@query("stream_digest", "SELECT ts::DATE AS day, event_type, count(*) AS items, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_digest(spark, sf_dir):
    """The stream is run to its end into a memory table, without a bound on lateness but the data's own."""
    name = f"digest_{uuid.uuid4().hex}"
    rows = alerts.digest(alerts.event_stream(spark, sf_dir, "events.parquet"), late="0 seconds")
    run = rows.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared_folder(spark)}/{name}").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select(F.to_date("window.start").alias("day"), "event_type", "items", "total")


@query("hashed_embeddings")
def hashed_embeddings(spark, sf_dir):
    return extraction.embed(table(spark, sf_dir, "documents"), "doc_id", "text", 64)


@query(
    "pattern_statements",
    r"""SELECT doc_id, len(regexp_extract_all(text, '[^.!?\n]+[.!?]'))::BIGINT AS statements FROM documents WHERE len(regexp_extract_all(text, '[^.!?\n]+[.!?]')) > 0""".replace("\\n", "\n"),
)
def pattern_statements(spark, sf_dir):
    found = extraction.extract(table(spark, sf_dir, "documents"), "doc_id", "text", extraction.sentences)
    return found.groupBy("doc_id").agg(F.count("*").alias("statements"))
