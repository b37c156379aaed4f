"""Vector expressions over array<float> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is the zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def normalized(a: Column) -> Column:
    """Of unit length; the zero vector stays."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a))).otherwise(a.cast("array<double>"))


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """group, centroid, members: means by component. Partial sums run before the shuffle, one row for each component and group in a partition."""
    parts = df.select(group, F.posexplode(vector).alias("p", "v")).groupBy(group, "p").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count("*").alias("n"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("centroid"), F.max("n").alias("members"))
