import hashlib
import random
import re

from newsloom.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, items):
    words = WORD.findall((text or "").translate(LOWER))
    hit, ids = set(), set()
    for key, item in items:
        w = WORD.findall((item or "").translate(LOWER))
        if key is None or not w:
            continue
        n = min(8, len(w))
        for s in range(len(w) - n + 1):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == w[s : s + n]:
                    hit.update(range(p, p + n))
                    ids.add(str(key))
    ids = sorted(ids)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(ids) >= 2


def fuzz():
    r = random.Random(8)
    vocabulary = "the of and É é Éa İx K k straße a1 b2 c3 d4 e5 f6 g7".split()
    item = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, item(n)) for i, n in enumerate([1, 2, 3, 7, 8, 9, 12, 20, 20, 30])]
    items += [(100, items[7][1]), (7, items[7][1]), (101, None), (None, "a1 b2"), (102, ""), (103, " .,"), (104, "zz zz zz zz zz zz zz zz zz")]
    docs = [None, "", "...", "THE", ". the of", "zz " * 30]
    for _ in range(120):
        parts = []
        for _ in range(r.randint(1, 6)):
            w = r.choice(items)[1] or ""
            w = w.split()
            a = r.randint(0, len(w))
            parts.append(r.choice([" ", ", ", "\n"]).join(w[a : a + r.randint(0, 25)]).upper() if r.random() < 0.3 else " ".join(w[a : a + r.randint(0, 25)]))
            parts.append(item(r.randint(0, 5)))
        docs.append(r.choice(["", "  ", "«"]) + r.choice([" ", " - "]).join(parts) + r.choice(["", "."]))
    return docs, items


def test_against_brute_force(spark):
    docs, items = fuzz()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)] + [(0, docs[20], "y")], "doc_id bigint, text string, n_words string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.mark(df, it).select("doc_id", *dc.digest_columns()).collect())
    want = sorted([(i, *brute(t, items)) for i, t in enumerate(docs)] + [(0, *brute(docs[20], items))])
    assert got == want
    assert sum(w[2] > 0 for w in want) > 60


def test_hits_are_positions_of_words(spark):
    df = spark.createDataFrame([(1, '"One two THREE four')], "doc_id bigint, text string")
    it = spark.createDataFrame([(5, "two three")], "item_id bigint, text string")
    r = dc.mark(df, it).first().marks
    assert (r["hits"], r["items"], r["near_items"]) == ([1, 2], ["5"], [])


def test_proximity(spark):
    words = [f"w{i}" for i in range(20)]
    near = " ".join(w + (" filler" if i % 4 == 3 else "") for i, w in enumerate(words[:16]))
    df = spark.createDataFrame([(1, near), (2, " ".join(words)), (3, "w1 nothing else")], "doc_id bigint, text string")
    it = spark.createDataFrame([(9, " ".join(words))], "item_id bigint, text string")
    got = {r.doc_id: (r.marks["items"], r.marks["near_items"]) for r in dc.mark(df, it).collect()}
    assert got == {1: ([], ["9"]), 2: (["9"], []), 3: ([], [])}


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    it = spark.createDataFrame([(9, "a b")], "item_id bigint, text string")
    assert dc.mark(df.limit(0), it).count() == 0
    r = dc.mark(df, it.limit(0)).first().marks
    assert (r.n_words, r["hits"], r["items"]) == (3, [], [])


def test_many_rows_are_shuffled_not_broadcast(spark, monkeypatch):
    docs, items = fuzz()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(dc, "small", lambda x, row_bytes: x)
    got = sorted((r.doc_id, r.n_hit) for r in dc.mark(df, it).select("doc_id", *dc.digest_columns()).collect())
    assert got == sorted((i, brute(t, items)[1]) for i, t in enumerate(docs))


def near_brute(text, item, docs, slop=8):
    """Whether three anchors (two, if there are no more) meet in different words on diagonals within slop. Words are in lower case."""
    w, t = item.split(), text.split()
    tf = lambda x: sum(d.split().count(x) for d in docs)
    anchors = set()
    for s in range(max(len(w) - 7, 1)):
        window = [(tf(w[q]), q) for q in range(s, min(s + 8, len(w)))]
        if min(window)[0]:
            anchors |= {q for _, q in sorted(window)[:2]}
    need = max(2, min(3, len(anchors)))
    hits = [(p - q, q, p) for q in anchors for p, x in enumerate(t) if x == w[q]]
    for low in {d for d, _, _ in hits}:
        met = [h for h in hits if low <= h[0] <= low + slop]
        if len({q for _, q, _ in met}) >= need and len({p for _, _, p in met}) >= need:
            return True
    return False


def test_near_matches_of_short_items_and_across_any_border(spark):
    short, middle = "alpha beta gamma delta", "m0 m1 m2 m3 m4 m5 m6 m7 m8"
    long = " ".join(f"x{i}" for i in range(24))
    gap = lambda words, at, n: " ".join([*words.split()[:at], *["pad"] * n, *words.split()[at:]])
    docs = [gap(short, 2, 1), gap(middle, 4, 2), *(("lead " * k) + gap(long, i, 1) for k in range(9) for i in (2, 9)), "alpha pad pad", "zz", "alpha " + "pad " * 40 + "beta"]
    docs += [docs[-3]] * 4  # copies of a text count once
    r = random.Random(3)
    vocabulary = [f"v{i}" for i in range(30)]
    docs += [" ".join(r.choice(vocabulary) for _ in range(r.randint(3, 40))) for _ in range(60)]
    items = [short, middle, long, "zz zz zz", *(" ".join(r.choice(vocabulary) for _ in range(n)) for n in (2, 3, 5, 8, 9, 14, 20))]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    it = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {r.doc_id: (r.marks["items"], r.marks["near_items"]) for r in dc.mark(df, it).collect()}
    assert "0" in got[0][1] and "1" in got[1][1] and got[docs.index("zz")] == ([], [])
    assert all("2" in got[i][0] + got[i][1] for i in range(2, 20))
    for i, t in enumerate(docs):
        assert got[i][1] == sorted(str(k) for k, item in enumerate(items) if near_brute(t, item, docs) and str(k) not in got[i][0]), (t, got[i])
    assert sum(len(n) for _, n in got.values()) > 30


def test_registered_query_returns_proximity(spark, tmp_path):
    from newsloom.llm.queries import QUERIES

    spark.createDataFrame([(1, "alpha beta pad gamma delta")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, "alpha beta gamma delta")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert QUERIES["op1_proximity"](spark, str(tmp_path)).first()["n_near"] == 1


def test_sigma_beside_marks(spark):
    """A capital sigma at a word's end is lowered alike whatever follows it."""
    docs = ["ΑΣ'Β", "ΑΣ Β", "ας β", "ασ β", "x ΑΣ.Β"]
    items = [(1, "ΑΣ Β"), (2, "ας β")]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.mark(df, it).select("doc_id", *dc.digest_columns()).collect()}
    assert got == {i: brute(t, items) for i, t in enumerate(docs)} and got[0][2] == got[1][2] == 1


def test_clashing_names_stay(spark):
    schema = "doc_id bigint, text string, items string, HITS string, marks string, _nl_text string, _nl_found int, n_words string, _nl_judged map<string,int>"
    df = spark.createDataFrame([(1, "one two", "i", "h", "m", "t", 1, "n", {}), (2, None, "i", "h", "m", "t", 1, "n", None)], schema)
    it = spark.createDataFrame([(5, "two")], "item_id bigint, text string")
    got = dc.mark(df, it)
    assert got.columns == [*df.columns, "marks_"]
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1][:8] == (1, "one two", "i", "h", "m", "t", 1, "n") and rows[1]["marks_"]["items"] == ["5"] and rows[2]["marks_"]["n_words"] == 0
    assert dc.clean(df, it).columns == df.columns and [r.doc_id for r in dc.clean(df, it).collect()] == [2]


def test_long_texts_ties_and_repeats(spark):
    """A text of a megabyte; all its terms are equally frequent, and it is there twice."""
    words = [f"w{i}" for i in range(150_000)]
    long = " ".join(words)
    items = [(1, " ".join(words[75_000:75_012])), (2, " ".join(words[149_990:])), (3, " ".join(words[10:14] + ["no"] + words[15:19]))]
    df = spark.createDataFrame([(1, long), (1, long), (2, "w1")], "doc_id bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in dc.mark(df, it).select("doc_id", *dc.digest_columns()).collect())
    assert len(long) > 1_000_000 and got == [(1, 150_000, 22, 2)] * 2 + [(2, 1, 0, 0)]
