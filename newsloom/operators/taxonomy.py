"""Classification of documents by weighted signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_words(body: Column) -> Column:
    """A text's different words in lower case: runs of letters, digits and underscores."""
    return F.array_distinct(F.split(F.lower(body), r"[^\p{L}\p{N}_]+"))


def hits(words: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords are among the words."""
    return sum((F.array_contains(words, k).cast("int") for k in keywords), F.lit(0))


def keyword_score(n_high: Column, n_medium: Column, *, weights: tuple[float, float] = (0.3, 0.15), bonus: float = 0.1) -> tuple[Column, Column]:
    """Score and number of distinct keywords that occur as whole words; a bonus for two or more."""
    n = n_high + n_medium
    return weights[0] * n_high + weights[1] * n_medium + F.when(n >= 2, bonus).otherwise(0.0), n


def confidence(base: float, scores: Sequence[Column], caps: Sequence[float]) -> Column:
    """The base and each signal up to its cap, within 0..1."""
    total = F.lit(base)
    for s, cap in zip(scores, caps):
        total = total + F.least(s, F.lit(cap))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def ranked(df: DataFrame, key: str, topic: str, conf: str, *, most: int = 2, floor: float = 0.3) -> DataFrame:
    """Topics by rank: the first stays, others up to ``most`` that reach the floor; gap: distance to the next one's confidence."""
    own = Window.partitionBy(key).orderBy(F.desc(conf), topic)
    rows = df.withColumn("rank", F.row_number().over(own)).withColumn("gap", F.col(conf) - F.coalesce(F.lead(conf).over(own), F.lit(0.0)))
    return rows.filter((F.col("rank") == 1) | ((F.col("rank") <= most) & (F.col(conf) >= floor)))
