"""Mentions: patterns, dictionary words, proposals for unknown names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERNS = {
    "emails": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phones": r"\+?\d[\d ()/-]{7,}\d",
    "quantities": r"\b\d+(?:[.,]\d+)?\s?(?:%|kWh|MW|EUR)",
    "references": r"(?:Version|§)\s?\d+(?:\.\d+)*",
}


def pattern_counts(df: DataFrame, key: str, text: str, patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """key and the number of matches of each pattern."""
    return df.select(key, *(F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))).cast("long").alias(n) for n, p in patterns.items()))


def by_word(df: DataFrame, key: str, text: str, forms: DataFrame) -> DataFrame:
    """key, entity, mentions, confidence: dictionary words by an equi-join on words; forms: entity, surface, confidence. Spark picks the join by size."""
    every = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}0-9]+"), F.lit(0))).alias("surface"))
    counts = every.join(forms, "surface").groupBy(key, "entity").agg(F.count("*").alias("mentions"), F.max("confidence").alias("confidence"))
    return counts


def proposals(found: DataFrame) -> DataFrame:
    """surface, occurrences, documents, sources, first_doc of (doc_id, source, surface)."""
    return found.groupBy("surface").agg(F.count("*").alias("occurrences"), F.countDistinct("doc_id").alias("documents"), F.countDistinct("source").alias("sources"), F.min("doc_id").alias("first_doc"))
