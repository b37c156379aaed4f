"""Evaluation: confusion counts, precision, recall, F1, greedy matching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(df: DataFrame, guess: Column, truth: Column) -> DataFrame:
    return df.agg(F.count_if(guess & truth).alias("tp"), F.count_if(guess & ~truth).alias("fp"), F.count_if(~guess & truth).alias("fn"), F.count("*").alias("n"))


def scores(df: DataFrame) -> DataFrame:
    """Adds precision, recall and F1; null where there is nothing to divide by."""
    share = lambda a, b: F.round(F.try_divide(a, b), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumn("precision", share(tp, tp + fp)).withColumn("recall", share(tp, tp + fn)).withColumn("f1", share(2 * tp, 2 * tp + fp + fn))


def match_greedily(pairs: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """keys, gold, found, score: gold rows in their order take the best row that is still free. pairs: keys, gold, found, score."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for gold, own in pdf[pdf.score >= least].groupby("gold", sort=True):
            own = own[~own.found.isin(used)].sort_values(["score", "found"], ascending=[False, True])
            if len(own):
                used.add(own.found.iat[0])
                out.append(own.iloc[0])
        return pd.DataFrame(out, columns=pdf.columns)

    return pairs.groupBy(*keys).applyInPandas(fold, pairs.schema)
