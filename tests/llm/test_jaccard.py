import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from newsloom.llm import jaccard as jc


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def brute(rows):
    """(key, n, similar, component) by comparing everything."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    similar = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j]):
                similar[i] += 1
                similar[j] += 1
                parent[root(i)] = root(j)
    out = []
    for i, (k, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((k, len(sets[i]), similar[i], min(keys) if keys else k))
    return sorted(out, key=str)


def corpus(seed, n=120):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmno") + r.choice(["", "x", "É"])
    line = "licensed under the common licence of all the words that are shared by very many texts here"
    rows = [(-1, None), (-2, ""), (-3, " \n"), (-4, "one"), (-5, "One"), (-6, "one two"), (-7, "ONE\ttwo"), (-8, "a b c"), (-9, "a b c d")]
    for k in range(n):
        if rows and r.random() < 0.55:
            w = (r.choice(rows)[1] or "x y z").split()
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w)) if w else 0 :][:1] = [word()] if w else []
                if w:
                    w[r.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(r.choice([3, 4, 5, 8, 20, 60, 150]))]
        if r.random() < 0.3:
            w = line.split() + w
        rows.append((k, " ".join(w)))
    return rows


def got(spark, rows, schema="doc_id bigint, text string"):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return sorted([(r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in jc.similar(df).collect()], key=str)


def test_against_all_pairs(spark):
    rows = corpus(1)
    want = brute(rows)
    assert got(spark, rows) == want
    assert sum(x[2] > 0 for x in want) > 40


def test_many_blocks_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(jc, "BLOCK", 4)
    monkeypatch.setattr(jc, "RARE", 2)
    monkeypatch.setattr(jc, "small", lambda x, row_bytes: x)
    monkeypatch.setattr(jc.components, "__defaults__", (-1,))
    rows = corpus(2, 90)
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", range(6))
def test_linked_sets_share_a_signature(seed):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64))
    for _ in range(150):
        n = int(rng.integers(3, 400))
        x = np.unique(rng.choice(pool, n, replace=False))
        level = lambda t: (t >> np.uint64(9)) % np.uint64(12)
        lose = int(rng.integers(0, jc.loss(n) + 1))
        y = rng.permutation(x)[lose:]
        both = len(y)
        more = int(rng.integers(0, max(1, both * 100 // 70 - n + 1)))
        y = np.unique(np.concatenate([y, rng.choice(np.setdiff1d(pool, x), more, replace=False)]))
        if 100 * both >= 70 * (n + more) and not np.array_equal(x, y):
            a, b = jc.prefix(x, level(x)), jc.prefix(y, level(y))
            met = np.intersect1d(a, b)
            assert len(met) > max(jc.sure(len(x)), jc.sure(len(y)))
            often = rng.random(len(met)) < rng.random()
            common = set(jc.bands(len(x))) & set(jc.bands(len(y)))
            assert len(x).bit_length() in common and len(y).bit_length() in common
            for band in {len(x).bit_length(), len(y).bit_length()}:
                shared = (~often).sum() + len(np.unique(jc.combinations(met[often], band)))
                assert shared >= 1 + -(-max(jc.sure(len(x)), jc.sure(len(y))) // 2), (n, lose, more)


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    near = text.replace("w39", "other")
    rows = [(5, text), (5, text), (5, "quite different words altogether in here"), (None, near), (None, near), (None, "alone by itself it stands"), (3, near)]
    assert got(spark, rows) == brute(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, component int")
    kept = jc.keep_one(df)
    assert kept.columns == df.columns and kept.filter("doc_id = 5").count() == 0 and kept.filter("doc_id = 3").count() == 1
    assert jc.similar(df.limit(0)).count() == 0 and jc.keep_one(df.limit(0)).count() == 0


def test_components_in_rounds(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(50)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    one = {(x.a, x.root) for x in jc.components(df).collect()}
    assert one == {(x.a, x.root) for x in jc.components(df, local=0).collect()} and (60, 0) in one


def by_chance(n=60, parts=12):
    """Texts of whole passages, each of which one other text has, always a different one; and a near copy of the first."""
    r = random.Random(4)
    made, texts = {}, []
    for i in range(n):
        words = []
        for d in range(1, parts // 2 + 1):
            for a in (i, (i - d) % n):
                words += made.setdefault((a, d), [f"w{r.randrange(10**9)}" for _ in range(9)])
        texts.append(" ".join(words))
    return [*enumerate(texts), (n, texts[0] + " and more")]


def test_tokens_shared_by_chance_go_before_blocks(spark, monkeypatch):
    rows, counts, kept = by_chance(), {}, jc.written

    def counted(df, name, **by):
        out = kept(df, name, **by)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(jc, "written", counted)
    assert got(spark, rows) == brute(rows)
    # Only the near copies have tokens left, or a few sets whose partners fall into one class.
    assert 2 <= counts["enough"] <= 6 and counts["across"] <= 6


def test_tables_and_shuffles_go(spark):
    from newsloom.llm import shared

    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    folder = shared.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    want = sorted(map(tuple, jc.similar(spark.createDataFrame(corpus(3), "doc_id bigint, text string")).collect()), key=str)
    assert want == brute(corpus(3))
    assert len({x.split("-")[1] for x in set(os.listdir(folder)) - before} - {"survey", "final", "edges"}) == 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize("many", [3, 10**6])
def test_masks_against_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(jc, "RARE", many)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = np.random.default_rng(8)
        rows = [(int(s), int(x), 20) for s, x in zip(rng.integers(0, 40, 600), rng.integers(0, 90, 600))] + [(99, x, 20) for x in range(50)] * 2
        df = spark.createDataFrame(rows, "sig bigint, set bigint, n bigint")
        out = [tuple(r) for r in jc._others(df).collect()]
        kind = lambda x: int(jc._mix(np.array([x], np.uint64))[0]) & 63
        lists, want, per = {}, {}, {}
        for s, x, _ in rows:
            lists.setdefault(s, set()).add(x)
        for s, xs in lists.items():
            for x in xs if len(xs) > 1 else ():
                want[s, x] = (1 << 64) - 1 if len(xs) > many else sum(1 << k for k in {kind(y) for y in xs if y != x})
                per.setdefault(x, []).append(s)
        assert {(s, x): m % (1 << 64) for s, x, _, m in out} == want and len(out) == len(want)
        keep = set()
        for x, ss in per.items():
            full = [k for k in range(64) if sum(want[s, x] >> k & 1 for s in ss) > jc.sure(20)]
            keep |= {(s, x) for s in ss if any(want[s, x] >> k & 1 for k in full)}
        left = [(r.sig, r.set) for r in jc._narrowed(jc._others(df)).collect()]
        assert set(left) == keep and len(left) == len(keep) and (many < 10 or len(keep) < len(want))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def traced(monkeypatch, df, make, batch):
    """Rows out, and peak and lasting MB of Python and numpy, of the function that make(df) gives to mapInArrow, run over one batch here."""
    caught = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: caught.append(f) or self)
    make(df)
    tracemalloc.start()
    try:
        n = sum(b.num_rows for b in caught[0](iter([batch])))
        left, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    return n, peak / 1e6, left / 1e6


def test_workers_hold_little(spark, monkeypatch):
    """A batch of many different words: what is made of texts is held for a piece of them, and no table of words grows."""
    r = random.Random(5)
    texts = [" ".join(f"{r.getrandbits(48):x}" for _ in range(300)) for _ in range(2000)]
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    keys = pa.array(range(2000), pa.int64())
    common = np.zeros(1 << jc.BUCKET_BITS, np.uint8)
    n, peak, _ = traced(monkeypatch, df, lambda d: jc._survey(d, "doc_id", "text"), pa.RecordBatch.from_arrays([keys, keys, pa.array(texts)], ["key", "place", "_t"]))
    assert n >= 2000 and peak < 55, peak
    n, peak, _ = traced(monkeypatch, df, lambda d: jc._prefixes(d, "text", common), pa.RecordBatch.from_arrays([pa.array(texts)], ["_t"]))
    assert n == 2000 * len(jc.prefix(np.arange(298, dtype=np.uint64), common[:298])) and peak < 30, peak


def test_pieces():
    from newsloom.llm.shared import pieces

    texts = ["ab", None, "", "x" * 50, "éé", None, "c" * 9, "d"]
    for kind in (pa.string(), pa.large_string(), pa.binary()):
        values = [t.encode() if t is not None and kind == pa.binary() else t for t in texts]
        batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(values, kind)], ["k", "t"])
        for size in (1, 5, 12, 1000):
            got = list(pieces(batch.slice(1), 1, size))
            assert pa.Table.from_batches(got) == pa.Table.from_batches([batch.slice(1)])
            # Without its last value, no piece has come to the size.
            assert all(sum(len((t or "").encode()) for t in texts[p.column(0)[0].as_py() : p.column(0)[-1].as_py()]) < size for p in got)
    assert not list(pieces(batch.slice(0, 0), 1)) and [p.num_rows for p in pieces(pa.RecordBatch.from_arrays([pa.nulls(3)], ["t"]), 0)] == [3]
