"""Work that grows no faster than the input: results against brute force, and sizes at which listing pairs, or splitting a text once for each of its words, doesn't end in time."""

import datetime
import hashlib
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom import catalog
from newsloom.functions import fingerprint, udfs
from newsloom.operators import extraction, graph, novelty, search, similarity, spans

DAY = datetime.timedelta(days=1)
START = datetime.datetime(2024, 1, 1)


def test_first_later_facts(spark):
    r = random.Random(3)
    rows = []
    for i in range(300):
        at = START + DAY * r.randint(0, 40)
        end = r.choice([None, at, at + 2 * DAY, at + 9 * DAY])
        rows.append((i, r.choice([None, 1, 2, 3, 4]), r.choice([None, 1, 2, 3, 4, 5]), r.choice("gh"), r.choice(["STATE", "EVENT", "ATEMPORAL"]), r.choice([at, at, at, None]), end, r.choice(["LOW", "HIGH"])))
    facts = spark.createDataFrame(rows, "id long, subject long, object long, `group` string, kind string, valid_at timestamp, invalid_at timestamp, conf string")
    want = {}
    for i, s, o, g, kind, at, end, conf in rows:
        for i2, s2, o2, g2, _, at2, end2, conf2 in rows:
            if i != i2 and g == g2 and None not in (at, at2) and at2 >= at and ((s is not None and s == s2) or (o is not None and o == o2)):
                until = end2 or at2
                fits = (kind == "STATE" and at <= until and (end or datetime.datetime(9999, 12, 31)) >= at2) or (kind == "EVENT" and at2 != until and at2 <= at <= until)
                if fits and not (conf == conf2 == "LOW" and at == at2):
                    want[i] = min(want.get(i, (at2, i2)), (at2, i2))
    got = {r.event: (r.invalid_at, r.invalidated_by) for r in graph.first_later(facts).collect()}
    assert got == want and len(want) > 60


def test_many_facts_of_one_object(spark, tmp_path):
    spark.range(60_000).select(F.col("id").alias("event_id"), F.expr("TIMESTAMP'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id)").alias("ts"), F.col("id").alias("user_id"), F.lit("signup").alias("event_type"), F.lit(5.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    began = time.perf_counter()
    got = catalog.QUERIES["earliest_invalidation"](spark, str(tmp_path))
    assert got.filter("invalidated_by = event_id + 1").count() == 59_999 and time.perf_counter() - began < 60


def test_long_text_is_split_once(spark):
    df = spark.createDataFrame([(1, "word license " * 20_000), (2, "license, Version"), (3, ""), (4, None)], "k long, t string")
    queries = spark.createDataFrame([(1, "license"), (2, "version")], "query int, term string")
    began = time.perf_counter()
    got = {(r["query"], r.k) for r in search.bm25(df, "k", "t", queries).collect()}
    few, search.TERMS = search.TERMS, 0
    try:
        joined = {(r["query"], r.k) for r in search.bm25(df, "k", "t", queries).collect()}
    finally:
        search.TERMS = few
    counts = {(r.term, r.k): (r.tf, r.n) for r in search.postings(df, "k", "t").collect()}
    assert got == joined == {(1, 1), (1, 2), (2, 2)} and counts == {("word", 1): (20_000, 40_000), ("license", 1): (20_000, 40_000), ("license", 2): (1, 2), ("version", 2): (1, 2)}
    assert time.perf_counter() - began < 40


def _vectors(spark, n, seed=5):
    """Random vectors with copies, a zero vector, and ties of similarities; ids in no order."""
    r = np.random.default_rng(seed)
    m = np.round(r.normal(size=(n, 4)) * 2) / 2
    m[:3], m[3:6] = 0, m[6]
    ids, labels = r.permutation(n), r.integers(0, 3, n)
    df = spark.createDataFrame([(int(i), v.tolist(), None if j == 7 else int(l)) for j, (i, v, l) in enumerate(zip(ids, m, labels))], "k long, v array<float>, l int")
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    return df, dict(zip(ids.tolist(), unit)), {int(i): None if j == 7 else int(l) for j, (i, l) in enumerate(zip(ids, labels))}


@pytest.mark.parametrize("rows", [1024, 40, 9])
def test_tiles_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(similarity, "PIECE", 16)
    monkeypatch.setattr(similarity, "HELD", 50)
    df, unit, label = _vectors(spark, 120)
    s = {(a, b): round(float(unit[a] @ unit[b]), 6) + 0.0 for a in unit for b in unit if a != b}
    nearest = {a: sorted((-s[a, b], b) for b in unit if b != a)[:5] for a in unit}
    assert {(r.k, r.rank): (-r.similarity, r.neighbour) for r in similarity.top_k(df, "k", "v", 5, rows=rows).collect()} == {(a, i + 1): t for a, ts in nearest.items() for i, t in enumerate(ts)}
    others = {a: max(s[a, b] for b in unit if b != a and None not in (label[a], label[b]) and label[a] != label[b]) for a in unit if label[a] is not None}
    assert {r.k: r.similarity for r in similarity.best_other(df, "k", "v", "l", rows=rows).collect()} == others
    pairs = {(a, b): x for (a, b), x in s.items() if a < b}
    found = {r.units: r.n for r in similarity.counts(df, "k", "v", rows=rows).collect()}
    assert found == dict(Counter(round(x * 1e6) for x in pairs.values()))
    high = {p: x for p, x in pairs.items() if x >= 0.9}
    assert {(r.a, r.b): r.similarity for r in similarity.pairs_above(df, "k", "v", 0.9, rows=rows).collect()} == high
    linked = similarity.linked(df, "k", "v", 0.9, rows=rows).collect()
    sums = Counter()
    for r in linked:
        sums[r.a] += r.units
    assert +sums == Counter({a: sum(round(x * 1e6) for p, x in high.items() if a in p) for p in high for a in p})
    edges = spark.createDataFrame(list(high), "a long, b long")
    roots = lambda e: {(r.node, r.root) for r in similarity.components(e).collect()}
    assert roots(similarity.linked(df, "k", "v", 0.9, rows=rows).filter("b IS NOT NULL")) == roots(edges)


def test_rows_are_sent_so_many_times_whatever_their_number(spark):
    """A scan sends a row BLOCKS times at most, and a tile gives at most a row for each of its rows where pairs would be many more."""
    same = spark.range(3_000).select(F.col("id").alias("k"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("v"), (F.col("id") % 2).alias("l"))
    sent = similarity._scan(same, "k", "v", lambda tiles: (pa.RecordBatch.from_arrays([pa.array([len(a.unit) + (0 if b is None else len(b.unit))], pa.int64())], ["n"]) for a, b in tiles), "n long", rows=10)
    assert sent.agg(F.sum("n")).first()[0] == similarity.BLOCKS * 3_000
    assert similarity.linked(same, "k", "v", 0.4).count() < 3 * 2 * 3_000 and similarity.counts(same, "k", "v").count() == 1
    assert similarity.components(similarity.linked(same, "k", "v", 0.4).filter("b IS NOT NULL")).filter("root = 0").count() == 3_000


def test_empty_short_and_astral_texts_match_items(spark):
    """As in SQL: an empty text is a set of one, and grams are of code points."""
    docs = spark.createDataFrame([(1, ""), (2, "ab"), (3, "AB"), (4, "a😀b😀"), (5, None), (6, "xyz" * 9)], "d long, t string")
    items = spark.createDataFrame([(1, ""), (2, "ab"), (3, "a😀b"), (4, None), (5, "xyzx")], "i long, t string")
    got = {(r.d, r.i): (r.common, r.jaccard) for r in novelty.shingle_matches(docs, "d", items, "i", "t", 0.25).collect()}
    assert got == {(1, 1): (1, 1.0), (2, 2): (1, 1.0), (3, 2): (1, 1.0), (4, 3): (1, 0.5), (6, 5): (2, 0.666667)}


def test_folds_of_many_and_of_long_keys(spark):
    began = time.perf_counter()
    many = spark.range(60_000).selectExpr("id AS d", "0L AS start", "9L AS end", "5L AS tokens", "0.5D AS confidence")
    assert spans.pack(many, "d").count() == 60_000 and spans.resolve_overlaps(many, ["d"]).count() == 60_000 and time.perf_counter() - began < 30
    long = spark.range(25_000).selectExpr("7L AS d", "id * 10 AS start", "id * 10 + 11 AS end", "100L AS tokens", "0.5D AS confidence")
    chunks = sorted(spans.pack(long, "d").collect(), key=lambda r: r.chunk)
    assert [(r.chunk, r.start, r.end, r.tokens) for r in chunks[:2]] == [(0, 0, 61, 600), (1, 60, 121, 600)] and len(chunks) == 4167 and chunks[-1].end == 250_001
    assert sorted(r.start for r in spans.resolve_overlaps(long, ["d"]).collect()) == list(range(0, 250_000, 20))


def test_simhash_of_long_texts_without_rows_of_words(spark):
    words = [f"w{i * i % 997}" for i in range(300_000)]
    df = spark.createDataFrame([(1, words), (2, ["a"]), (3, []), (4, None), (5, ["a", "b"]), (5, ["c"])], "k long, w array<string>")
    found = fingerprint.simhash(df, "k", F.col("w"))
    want = {}
    for k, ws in {1: words, 2: ["a"], 5: ["a", "b", "c"]}.items():
        votes = np.zeros(64, int)
        for w, n in Counter(ws).items():
            votes += n * (2 * np.unpackbits(np.frombuffer(hashlib.md5(w.encode()).digest()[:8], "u1")).astype(int) - 1)
        want[k] = np.packbits(votes > 0).tobytes().hex()
    assert {r.k: r.simhash for r in found.collect()} == want
    assert "Generate" not in found._jdf.queryExecution().toString()


def test_texts_of_a_batch_are_taken_in_pieces():
    column = pa.array(["é" * 20_000, None, ""] * 500)
    tracemalloc.start()
    got = udfs._texts(udfs._nfc, pa.string())(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.equals(column) and peak < 10 << 20


def test_open_end_is_read_once():
    began = time.perf_counter()
    assert extraction.sentences(["a" * 200_000 + "\nOne. Two!?x"]) == [["One.", "Two!"]] and time.perf_counter() - began < 5
