"""The corpus pipeline: documents without toxic ones, without near duplicates, without benchmark contamination, with secrets masked, as SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Rows keep all their columns, in their order, whatever their names. Null and empty texts pass every stage and have no ids; rows
with null ids are kept, also as near duplicates of others. Rows that share the least id of a group of near duplicates all stay. Very long texts go through whole. Empty tables give no rows; without labels of both kinds no
text is toxic, without items none is contaminated.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import decontamination, jaccard, secrets, sentencepiece, toxicity
from newsloom.llm.shared import free_name, fresh_dir

TOKENIZERS = os.environ.get("TOKENIZERS", "/opt/tokenizers")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.7 or more go."""
    return toxicity.keep_clean(docs, toxicity.train(docs.select("doc_id", "text"), _table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go."""
    return decontamination.clean(docs, _table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of secrets, and of weak parts beside them, are masked; all documents stay. Where a text changes, n_chars, if there is one, follows it."""
    spans = free_name(docs, "spans")
    found = secrets.scan(docs, out=spans)
    some = F.size(spans) > 0
    masked = found.withColumn("text", F.when(some, secrets.redact(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(some, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return masked.drop(spans)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids."""
    return sentencepiece.encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("SentencePiece encoding", encode),
]

#: The first and last stages, a fitted score and a tokenizer, are beyond SQL; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    folder = fresh_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
