"""Operators on small tables with answers worked out by hand."""

import random

from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.functions import udfs
from newsloom.ids import sid
from newsloom.operators import evaluation, events, graph, lifecycle, novelty, parse, resolution, rules, similarity, spans


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_ids_keep_nulls_apart(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("a", "", "b")], "x string, y string, z string")
    got = [r.i for r in df.select(sid("x", "y", "z").alias("i")).collect()]
    assert got[0] == got[2] != got[1]


def test_urls(spark):
    x = F.col("x")
    n = lambda u: one(spark, tx.normalize_url(x), u)
    assert n("HTTP://Ex.org:80/a/./b/?b=2&a=1&utm_source=q#f") == "http://ex.org/a/b?a=1&b=2"
    assert n("https://ex.org:8443/") == "https://ex.org:8443" and n("no url") == "no url"


def test_texts(spark):
    x = F.col("x")
    assert one(spark, tx.collapse_whitespace(x), "\r\n a \t b \r\n\r\n\r\n\r\nc ") == "a b\n\nc"
    assert one(spark, tx.strip_html(x), "<p>a &amp; b</p><script>x()</script><!-- n -->c") == "a & b c"
    assert one(spark, tx.strip_links(x), "![i](u)a [b](c) []") == "a b []"
    assert one(spark, tx.mask_numbered(x, "[a-z]+@[a-z]+", "E"), "a@b c@d a@b") == "[E_1] [E_2] [E_1]"
    assert one(spark, tx.parse_date(x, ("yyyy-MM-dd", "d MMMM yyyy")), "3 März 2024").isoformat() == "2024-03-03"
    assert one(spark, tx.date_to_iso(x), "Q3 2023") == "2023-07-01" and one(spark, tx.date_to_iso(x), "1.2.2024") == "2024-02-01"
    assert one(spark, tx.parse_number(x), "1 234,5 kWh") == 1234.5 and one(spark, tx.unit_of(x), "5 kWh") == "kWh" and one(spark, tx.parse_number(x), "n/a") is None
    assert one(spark, tx.between_markers(x, ("<<",), (">>",)), "a<<b>>c") == "b" and one(spark, tx.between_markers(x, ("<<",), (">>",)), "abc") is None
    assert one(spark, tx.remove_boilerplate(x, ("cookie",)), "a\nmy cookie\ncookies\nb") == "a\ncookies\nb"


def test_python_functions(spark):
    assert udfs.ratio_of("abcd", "abce") == 0.75 and udfs.partial_ratio_of("abc", "xxabcxx") == 1.0 and udfs.ratio_of("", "") == 1.0
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in "xy")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if p == q else max(t[i][j + 1], t[i + 1][j])
        assert udfs._lcs(a, b) == t[-1][-1]
    udfs.register_all(spark)
    assert spark.sql("SELECT nfc('é') AS a, html_unescape('&uuml;') AS b, inflate(deflate('hé')) AS c").first() == ("é", "ü", "hé")


def test_spans(spark):
    a = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 500, 1600), (2, 0, 5)], "d int, start bigint, end bigint")
    b = spark.createDataFrame([(1, 5, 10), (1, 10, 11), (1, 400, 2000), (2, 5, 9)], "d int, start2 bigint, end2 bigint")
    assert sorted((r.start, r.start2) for r in spans.overlap_join(a, b, ["d"]).collect()) == [(0, 5), (10, 10), (500, 400)]
    assert [r.start for r in spans.contained(a, b, ["d"]).collect()] == [500]
    assert sorted((r.d, r.start, r.end) for r in spans.merged(a, ["d"]).collect()) == [(1, 0, 20), (1, 500, 1600), (2, 0, 5)]
    m = spark.createDataFrame([(1, 0, 10, 0.5), (1, 5, 8, 0.9), (1, 8, 12, 0.95), (1, 12, 14, 0.1)], "d int, start bigint, end bigint, confidence double")
    assert sorted(r.start for r in spans.resolve_overlaps(m, ["d"]).collect()) == [5, 8, 12]
    p = spark.createDataFrame([(1, 0, 10, 300), (1, 11, 20, 300), (1, 21, 30, 2000), (1, 31, 40, 5)], "d bigint, start bigint, end bigint, tokens bigint")
    assert sorted((r.chunk, r.start, r.end, r.tokens) for r in spans.pack(p, "d").collect()) == [(0, 0, 20, 600), (1, 21, 30, 2000), (2, 31, 40, 5)]


def test_blocks(spark):
    text = "# T\n## U\na\nb\n\n- x\n- y\n| a | b |\n|---|---|\n| 1 | 2 |"
    df = spark.createDataFrame([(1, text)], "d int, t string")
    got = [(r.block_type, text[r.start : r.end]) for r in parse.blocks(df, "d", "t").orderBy("block_no").collect()]
    assert got == [("HEADING", "# T"), ("HEADING", "## U"), ("PARAGRAPH", "a\nb"), ("LIST", "- x\n- y"), ("TABLE", "| a | b |\n|---|---|\n| 1 | 2 |")]
    assert [(r.header, r.value) for r in parse.table_cells(df, "d", "t").orderBy("col_no").collect()] == [("a", "1"), ("b", "2")]


def test_novelty_borders(spark):
    df = spark.createDataFrame([(0.70, 0), (0.30, 0), (0.29, 2), (0.0, 0)], "s double, m int")
    label, conf = novelty.label_of(F.col("s"), F.col("m"))
    got = [(r.l, round(r.c, 6)) for r in df.select(label.alias("l"), conf.alias("c")).collect()]
    assert got == [("re_report", 0.7), ("update", 0.5), ("new", 0.51), ("new", 1.0)]


def test_neighbours_in_many_blocks(spark):
    rows = [(i, [float((i * 7 + j * 3) % 11) - 5 for j in range(4)]) for i in range(40)] + [(99, [0.0] * 4)]
    df = spark.createDataFrame(rows, "k bigint, v array<float>")
    a = sorted(map(tuple, similarity.top_k(df, "k", "v", 3).collect()))
    assert a == sorted(map(tuple, similarity.top_k(df, "k", "v", 3, rows=7).collect())) and len(a) == 41 * 3
    b = sorted(map(tuple, similarity.pairs_above(df, "k", "v", 0.9).collect()))
    assert b == sorted(map(tuple, similarity.pairs_above(df, "k", "v", 0.9, rows=7).collect())) and b


def test_components(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a bigint, b bigint")
    assert {(r.node, r.root) for r in similarity.components(df).collect()} == {(i, 1) for i in range(1, 41)} | {(100, 100), (101, 100)}


def test_rules(spark):
    df = spark.createDataFrame([("A", "5", None), ("B", "x", "2024-01-03")], "t string, v string, d string")
    at = F.lit("2024-01-01").cast("date")
    c = lambda *a, **k: rules.condition(*a, **k)
    get = lambda e: [r.y for r in df.select(e.alias("y")).collect()]
    assert get(c(F.col("v"), "gt", "4")) == [True, False] and get(c(F.col("d"), "within_days", "2", as_of=at)) == [False, True] and get(c(F.col("d"), "within_days", "1", as_of=at)) == [False, False]
    assert get(c(F.col("v"), "like", "5")) == [False, False] and get(rules.rule([], "AND")) == [False, False] and get(rules.rule([], "OR")) == [True, True]
    assert get(rules.watchlist(F.array("t"), F.col("v"), F.col("t"), F.array("t"), {"event_types": ["A"]})) == [False, False]


def test_suppression(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'k', TIMESTAMP'2024-01-01 00:00'), (2, 'k', TIMESTAMP'2024-01-01 05:00'), (3, 'k', TIMESTAMP'2024-01-01 20:00'), (4, 'j', TIMESTAMP'2024-01-01 05:00') AS t(x_id, k, at)")
    assert sorted(r.x_id for r in events.suppress(df, ["k"], "at", 6).collect()) == [1, 3, 4]


def test_suppressed_matches_open_no_window(spark):
    """Matches five hours apart with a window of six: every other one is an alert; null times never are, ties go by their order."""
    rows = [("k", i, f"2024-01-01 {5 * i:02d}:00", 6) for i in range(5)] + [("k", 9, None, 6), ("j", 11, "2024-01-01 00:00", 6), ("j", 10, "2024-01-01 00:00", 6), (None, 12, "2024-01-01 00:00", 6), (None, 13, "2024-01-01 07:00", 6)]
    df = spark.createDataFrame(rows, "k string, x_id int, at string, h int").withColumn("at", F.col("at").cast("timestamp")).repartition(3)
    got = events.suppress(df, ["k"], "at", "h", ["x_id"])
    assert got.columns == df.columns and sorted(r.x_id for r in got.collect()) == [0, 2, 4, 10, 12, 13]
    assert events.suppress(df.limit(0), ["k"], "at", 6).count() == 0


def test_lifecycle(spark):
    ids = lambda df: sorted(r[0] for r in df.collect())
    items = spark.createDataFrame([(i,) for i in range(5)], "k int")
    status = spark.createDataFrame([(0, "ok"), (1, "failed"), (2, "skipped")], "k int, status string")
    ready = spark.createDataFrame([(i, "ok") for i in range(4)] + [(4, "failed")], "k int, status string")
    assert ids(lifecycle.work_set(items, status, ready, "k")) == [1, 3]
    sets = spark.createDataFrame([(1, [1, 2]), (2, [1, 9]), (3, [])], "k int, m array<int>")
    assert ids(lifecycle.all_eligible(sets, "k", "m", spark.createDataFrame([(1,), (2,)], "member int"))) == [1]
    assert ids(lifecycle.missing_references(spark.createDataFrame([(1,), (7,), (None,)], "k int"), "k", items, "k")) == [7]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, "p", 1), (1, 2, "p", 2), (3, None, "q", 1)], "subject int, object int, predicate string, id int")
    assert sorted(map(tuple, graph.edges(e, ["id"]).collect())) == [(1, 2, "p", 2), (3, 3, "q", 1)]
    s = spark.createDataFrame([(1, "a", "b", "g"), (2, "a", "z", "g"), (3, "y", "b", "g"), (4, "a", "b", "h")], "id int, subject string, object string, group string")
    assert sorted(map(tuple, graph.related(s, s).filter("a = 1").collect())) == [(1, 2), (1, 3)]


def test_resolution_and_matching(spark):
    df = spark.createDataFrame([("o", "Alpha Grid"), ("o", "alpha grid gmbh"), ("o", "Beta"), ("p", "Beta")], "kind string, name string")
    got = {(r.kind, r.name): r.canonical for r in resolution.fuzzy_clusters(df, "kind", "name").collect()}
    assert got == {("o", "alpha grid"): "alpha grid", ("o", "alpha grid gmbh"): "alpha grid", ("o", "beta"): "beta", ("p", "beta"): "beta"}
    names = spark.createDataFrame([("big blue sea",), ("BBS",), ("xy",)], "name string")
    assert [tuple(r) for r in resolution.acronyms(names).collect()] == [("BBS", "big blue sea")]
    pairs = spark.createDataFrame([(1, 1, 1, 0.9), (1, 2, 1, 0.95), (1, 2, 2, 0.6)], "p int, gold int, found int, score double")
    assert sorted((r.gold, r.found) for r in evaluation.match_greedily(pairs, ["p"]).collect()) == [(1, 1), (2, 2)]


def test_runs():
    import datetime

    import pytest

    from newsloom.operators import runs

    t = datetime.datetime(2024, 1, 1)
    every, a = runs.acquire([], "a", "c1", t)
    assert runs.acquire(every, "b", "c1", t)[1] == a
    with pytest.raises(RuntimeError, match="configuration"):
        runs.acquire(every, "b", "c2", t)
    later, b = runs.acquire(every, "b", "c2", t + datetime.timedelta(days=2))
    assert [r.status for r in later] == ["failed", "running"] and b.run_id == "b"
    done = runs.finish(later, "b", "completed")
    with pytest.raises(RuntimeError, match="ended"):
        runs.acquire(done, "b", "c2", t)


def test_extraction(spark):
    import pytest

    from newsloom.operators import extraction

    df = spark.createDataFrame([(1, "One. Two! three"), (2, None), (3, "")], "k int, t string")
    assert sorted(map(tuple, extraction.extract(df, "k", "t", extraction.sentences).collect())) == [(1, 0, "One."), (1, 1, "Two!")]
    got = {r.k: r.embedding for r in extraction.embed(df, "k", "t", 8).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and got[2] == got[3] == [0.0] * 8
    with pytest.raises(Exception, match="fit"):
        extraction.embed(df, "k", "t", 8, lambda texts, n: [[0.0]] * len(texts)).collect()
