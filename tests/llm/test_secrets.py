import hashlib
import random
import re

from pyspark.sql import functions as F

from newsloom.llm import secrets

BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
]


def brute(text):
    found = [(m.start(), i, m.end()) for i, (_, p, g, n) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= n]
    found.sort()
    s = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in found)
    return [sum(k == i for _, k, _ in found) for i in range(3)], hashlib.sha256(s.encode()).hexdigest(), s


def fuzz(n=300):
    r = random.Random(5)
    bits = ["password", "PassWd", "secret=", "token", ": ", "=", '"', "'", " ", "api_key", "apikey:", "abcdefgh", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "0123456789abcdef" * 2, "é😀", "\n", "x" * 9, "a.b/c+d==", "user=bob99", "https://h.example.org:80/x", "db.local:5432", "Ab1" * 15]
    return [None, "", "password=short", "secret:token=abcdefghij", "password=token: abcdefgh12"] + ["".join(r.choice(bits) for _ in range(r.randint(1, 30))) for _ in range(n)]


def test_base_spans_against_python(spark):
    texts = fuzz()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in secrets.scan(df).select("doc_id", *secrets.digest_columns(F.col("spans"))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        counts, digest, shown = brute(t)
        r = got[i]
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == (counts, digest), (t, shown, r.spans)


def test_weak_parts_need_complements(spark):
    far = " pad" * 200
    rows = [
        (1, "user=alice99 then nothing"),
        (2, "user=alice99 password=abcdefgh1"),
        (3, "user=alice99" + far + "password=abcdefgh1"),
        (4, "blob " + "Ab1" * 15),
        (5, "blob " + "Ab1" * 15 + " at db.local:5432"),
        (6, "user=alice99 at db.local:5432"),
        (7, "AKIAABCDEFGHIJKL " + "Ab1" * 15),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: {s.kind for s in r.spans} for r in secrets.scan(df).collect()}
    assert got == {1: set(), 2: {"user", "assign"}, 3: {"assign"}, 4: set(), 5: {"blob", "endpoint"}, 6: set(), 7: {"access", "blob"}}


def test_redaction_and_cases(spark):
    df = spark.createDataFrame([(1, "a password=abcdefgh1 b", 1), (1, "a password=abcdefgh1 b", 1), (None, "😀 AKIAABCDEFGHIJKL", 2), (3, None, 3), (4, "", 4)], "doc_id bigint, text string, start int")
    got = secrets.scan(df).select("doc_id", "start", secrets.redact(F.col("text"), F.col("spans")).alias("t")).collect()
    assert sorted((r.start, r.t) for r in got if r.t is not None) == [(1, "a [REDACTED] b"), (1, "a [REDACTED] b"), (2, "😀 [REDACTED]"), (4, "")]
    assert secrets.scan(df.limit(0)).count() == 0


def merged(text, spans, mask="[REDACTED]"):
    out, at = [], 0
    blocks = []
    for s, e in sorted(spans):
        if blocks and s <= blocks[-1][1]:
            blocks[-1][1] = max(e, blocks[-1][1])
        else:
            blocks.append([s, e])
    for s, e in blocks:
        out += [text[at:s], mask]
        at = e
    return "".join([*out, text[at:]])


def test_redaction_against_slices(spark):
    """Spans that overlap, touch, lie in each other and cross pieces of text."""
    r = random.Random(4)
    rows = []
    for i in range(60):
        text = "".join(r.choice("ab😀é\n") for _ in range(r.choice([0, 5, 300, 9_000])))
        spans = sorted((a, min(len(text), a + r.choice([1, 3, 50, 5_000]))) for a in (r.randrange(len(text)) for _ in range(r.randint(0, 12)))) if text else []
        rows.append((i, text, [(a, b) for a, b in spans if a < b]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans array<struct<start:int,end:int>>")
    got = {x.doc_id: x.t for x in df.select("doc_id", secrets.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    for i, text, spans in rows:
        assert got[i] == merged(text, spans), (text, spans)


def test_long_text_with_many_spans(spark):
    """A megabyte of secrets takes seconds, not minutes."""
    import time

    text = "password=abcdefgh1 é " * 50_000
    df = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (2, None, "z")], "doc_id bigint, text string, spans string")
    began = time.perf_counter()
    found = secrets.scan(df)
    assert found.columns == ["doc_id", "text", "spans", "spans_"]
    got = found.select("spans", "spans_", F.size("spans_").alias("n"), secrets.redact(F.col("text"), F.col("spans_")).alias("t")).collect()
    took = time.perf_counter() - began
    # Plain truth values: an explanation of a failed comparison would take longer than the scan.
    masked = [x.t == "[REDACTED] é " * 50_000 for x in got if x.spans != "z"]
    first = [[(s.start, s.end) for s in x["spans_"][:2]] for x in got if x.spans != "z"]
    counts = sorted(x.n for x in got)
    null = [x.t for x in got if x.spans == "z"]
    del got
    assert masked == [True, True] and null == [None] and counts == [0, 50_000, 50_000]
    assert first == [[(0, 18), (21, 39)]] * 2 and took < 60


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "user=alice99 password=abcdefgh1", 5, {}, "k")], "doc_id bigint, text string, _nl_key int, _nl_parts map<string,int>, _NL_LINKS string")
    row = secrets.scan(df).first()
    assert row[:5] == (1, "user=alice99 password=abcdefgh1", 5, {}, "k") and [s.kind for s in row["spans"]] == ["user", "assign"]
