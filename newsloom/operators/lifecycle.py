"""Work sets, status merges, retention and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINAL = ("ok", "skipped")


def work_set(items: DataFrame, status: DataFrame, prerequisite: DataFrame, key: str) -> DataFrame:
    """Items whose prerequisite is ok and whose own status is none, failed, or blocked. status, prerequisite: key, status."""
    ready = prerequisite.filter("status = 'ok'").select(key)
    done = status.filter(F.col("status").isin(*FINAL)).select(key)
    return items.join(ready, key, "left_semi").join(done, key, "left_anti")


def merge_status(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, status, attempt: a final status stays; else the new one counts as one more attempt."""
    other = new.select(key, F.col("status").alias("_s"))
    both = old.join(other, key, "full")
    keep = F.col("status").isin(*FINAL) | F.col("_s").isNull()
    attempt = F.when(keep, F.col("attempt")).otherwise(F.coalesce("attempt", F.lit(0)) + 1)
    return both.select(key, F.when(keep, F.col("status")).otherwise(F.col("_s")).alias("status"), attempt.alias("attempt"))


def upsert(old: DataFrame, new: DataFrame, key: str, overwrite: bool) -> DataFrame:
    """Rows by key: those that are there stay unless overwritten."""
    if overwrite:
        return old.join(new.select(key), key, "left_anti").unionByName(new)
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def all_eligible(df: DataFrame, key: str, members: str, eligible: DataFrame) -> DataFrame:
    """Rows of which every member is eligible (eligible: member); rows without members aren't."""
    flat = df.select(key, F.explode(F.array_distinct(members)).alias("member"))
    ok = flat.join(eligible.select("member", F.lit(True).alias("_ok")).distinct(), "member", "left").groupBy(key).agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("_ok"))
    return df.join(ok.filter("_ok").select(key), key, "left_semi")


def stages_complete(status: DataFrame, key: str, stages: int) -> DataFrame:
    """Keys that are ok in so many stages."""
    return status.filter("status = 'ok'").groupBy(key).agg(F.countDistinct("stage").alias("n")).filter(F.col("n") == stages).select(key)


def missing_references(df: DataFrame, column: str, target: DataFrame, target_column: str) -> DataFrame:
    """Rows that refer to nothing; null references aren't errors."""
    return df.filter(F.col(column).isNotNull()).join(target.select(F.col(target_column).alias(column)).distinct(), column, "left_anti")


def reference_counts(df: DataFrame, column: str, target: DataFrame, target_column: str) -> DataFrame:
    """violations, total: how many rows refer to nothing, of how many, in one pass; null references aren't errors."""
    known = target.select(F.col(target_column).alias("_k")).distinct().withColumn("_ok", F.lit(True))
    met = df.select(F.col(column).alias("_k")).join(known, "_k", "left")
    return met.agg(F.count_if(F.col("_ok").isNull() & F.col("_k").isNotNull()).alias("violations"), F.count("*").alias("total"))


def keep_largest(df: DataFrame, keys: list[str], size: str, order: str) -> DataFrame:
    """Of each duplicate group the largest row, the first by order of equal ones; as an aggregate, without a sort."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(F.col(size), -F.col(order))).alias("_b"))
    return best.select(*keys, "_b.*")
