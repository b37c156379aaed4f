"""Entity resolution: fuzzy clusters and acronyms."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import acronym, clean_name
from newsloom.functions.udfs import indel_ratio, partial_ratio, partial_ratio_of

#: Letters, rare ones first; all other characters come before them.
_COMMON = "qjxzkvwybpgfmcduhlonsirat e"


def fuzzy_clusters(df: DataFrame, kind: str, name: str, least: float = 0.8) -> DataFrame:
    """kind, name, canonical: greedily, the first free name takes all that are like it. Sequential within a kind, over distinct names only."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["name"].dropna()))
        out: dict[str, str] = {}
        for i, a in enumerate(names):
            if a not in out:
                out[a] = a
                out |= {b: a for b in names[i + 1 :] if b not in out and partial_ratio_of(a, b) >= least}
        return pd.DataFrame({"kind": [pdf["kind"].iat[0]] * len(out), "name": list(out), "canonical": list(out.values())})

    rows = df.select(F.col(kind).alias("kind"), clean_name(F.col(name)).alias("name")).distinct()
    return rows.groupBy("kind").applyInPandas(fold, "kind string, name string, canonical string")


def _characters(text: str) -> list[str]:
    """Each character with its number of occurrence so far, in one fixed order: rare Latin letters first."""
    seen: dict[str, int] = {}
    out = []
    for c in text:
        seen[c] = seen.get(c, 0) + 1
        out.append((_COMMON.find(c.lower()), c, seen[c]))
    return [f"{c}{n}" for _, c, n in sorted(out)]


def _first(text: str, common: int) -> list[str]:
    """Of the characters of a text so many that another one that shares ``common`` of them has one of these (and of its own first ones, if those are as many by its own length)."""
    return _characters(text)[: len(text) - common + 1]


def _at_least(x: float) -> int:
    """x rounded up, less what floats may have added."""
    return max(math.ceil(x - 1e-9), 1)


def _keys(kind: str, least: float):
    """A function of a series of names: the keys under which those that may be like each other meet.

    whole, other: a ratio of ``least`` needs least * (m + n) / 2 common characters, so lengths are bound, and the first characters for those lengths meet.
    short, long: a part of the longer name shares least * n / (2 - least) characters with all n of the shorter one.
    """

    def of(text: str) -> list[str]:
        n = len(text)
        if kind == "long":
            return ["", *_characters(text)]
        if kind == "short":
            return _first(text, _at_least(least * n / (2 - least))) if n else [""]
        lengths = range(_at_least(least * n / (2 - least)), math.floor(n * (2 - least) / least + 1e-9) + 1)
        return [f"{m} {n} {k}" if kind == "other" else f"{n} {m} {k}" for m in lengths for k in _first(text, _at_least(least * (m + n) / 2))]

    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else of(t)), "array<string>")


def best_match(names: DataFrame, canonical: DataFrame, least: float = 0.8) -> DataFrame:
    """name, canonical, score: the best canonical name, if it is like enough. Characters that the shorter of two like names must share block the join; no match is lost. ``least`` is more than 0."""
    a = names.select("name").filter("name IS NOT NULL").distinct()
    b = canonical.select(F.col("name").alias("canonical")).filter("canonical IS NOT NULL").distinct()
    met = []
    for kind, other in (("short", "long"), ("long", "short")):
        x = a.withColumn("_b", F.explode(_keys(kind, least)("name")))
        y = b.withColumn("_b", F.explode(_keys(other, least)("canonical")))
        shorter = F.length("name") <= F.length("canonical") if kind == "short" else F.length("name") > F.length("canonical")
        met.append(x.join(y, "_b").filter(shorter).select("name", "canonical"))
    scored = met[0].unionByName(met[1]).distinct().withColumn("score", partial_ratio("name", "canonical")).filter(F.col("score") >= least)
    best = scored.groupBy("name").agg(F.min_by(F.struct("canonical", "score"), F.struct(-F.col("score"), F.col("canonical"))).alias("m"))
    return best.select("name", "m.canonical", F.round("m.score", 6).alias("score"))


def acronyms(names: DataFrame, least: float = 0.8) -> DataFrame:
    """acronym, name: single words that are like the initials of a longer name, the least of several. Lengths and first characters block the join; no match is lost."""
    words = names.select("name").distinct()
    several = words.filter(F.col("name").contains(" ")).select("name", acronym(F.col("name")).alias("initials"))
    initials = several.select("initials").distinct().withColumn("_b", F.explode(_keys("whole", least)("initials")))
    single = words.filter(~F.col("name").contains(" ")).select(F.upper("name").alias("acronym")).distinct().withColumn("_b", F.explode(_keys("other", least)("acronym")))
    met = initials.join(single, "_b").select("initials", "acronym").distinct().filter(indel_ratio("initials", "acronym") >= least)
    return several.join(met, "initials").groupBy("acronym").agg(F.min("name").alias("name"))
