"""Full-text search: postings and BM25 as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.storage import cut

#: Terms of queries that are looked for inside the row; more of them are joined.
TERMS = 10_000


def words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}0-9]+"), F.lit(0))


def _counted(rows: DataFrame, key: str, terms: str) -> DataFrame:
    """term, key, n, tf. n is a column already: beside an explode it would be worked out anew for every word."""
    return rows.select(key, "n", F.explode(terms).alias("term")).groupBy("term", key, "n").agg(F.count("*").alias("tf"))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf, n (the document's words)."""
    # Arrays are bound once, as the optimizer would put the split into every use of it.
    once = F.element_at(F.transform(F.array(words(text)), lambda w: F.struct(F.size(w).alias("n"), w.alias("w"))), 1)
    return _counted(df.select(key, once.alias("_w")).select(key, "_w.n", "_w.w"), key, "w")


def bm25(df: DataFrame, key: str, text: str, queries: DataFrame, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query, key, score of documents that hold a query's terms. queries: query, term. Texts are split once; only the queries' terms are kept before anything is shuffled."""
    wanted = queries.select("term").filter("term IS NOT NULL").distinct()
    terms = [r.term for r in wanted.limit(TERMS + 1).collect()]
    few = len(terms) <= TERMS
    hit = lambda w: F.filter(w, lambda x: x.isin(*terms)) if few else w
    once = F.element_at(F.transform(F.array(words(text)), lambda w: F.struct(F.size(w).alias("n"), hit(w).alias("w"))), 1)
    rows = cut(df.select(key, once.alias("_w")).select(key, "_w.n", "_w.w"))
    docs, mean = rows.agg(F.count("*"), F.avg("n")).first()
    tf = _counted(rows.filter(F.size("w") > 0), key, "w")
    if not few:
        tf = tf.join(wanted, "term", "left_semi")
    df_ = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(df_, "term").join(queries, "term")
    idf = F.log(1 + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.lit(mean or 1.0)))
    return scored.groupBy("query", key).agg(F.sum(part).alias("score"))
