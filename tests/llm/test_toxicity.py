import random
import zlib

import numpy as np
import pandas as pd

from newsloom.llm import toxicity as tx


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_distances():
    r = random.Random(3)
    terms = sorted({"".join(r.choice("abc") for _ in range(r.randint(2, 8))) for _ in range(40)})
    lexicon = tx.Lexicon([(t, "word", 1 + i / 100) for i, t in enumerate(terms)])
    for _ in range(4000):
        w = "".join(r.choice("abcd") for _ in range(r.randint(0, 9)))
        near = [t for t in terms if distance(w, t) <= (1 if len(t) >= 5 else 0)]
        got = lexicon.find(w)
        assert (got is not None) == bool(near), (w, near, got)
        if got:
            assert (got[0] == 0) == (w in terms) and lexicon.terms[got[1]][0] in near


def test_stems():
    lexicon = tx.Lexicon([("abcd", "stem", 2.0), ("idiot", "word", 3.0)])
    assert lexicon.find("abcdxyz") == (0, 0) and lexicon.find("abxd") is None and lexicon.find("idi0t") == (1, 1) and lexicon.find("idiot") == (0, 1)


def test_context():
    s = tx.Scanner(tx.Lexicon([("idiot", "word", 3.0)]))
    at = lambda t: s.context(t, t.index("idiot"), t.index("idiot") + 5)
    assert at('they shouted "idiot" at him') == (True, False)
    assert at("you idiot go") == (False, True)
    assert at("the word idiot is old") == (True, False)
    assert at("plain idiot here") == (False, False)
    quoted, plain = s.features('they shouted "idiot" at him'), s.features("plain idiot here")
    assert quoted[3] > 0 and quoted[0] == 0 and plain[0] > 0 and plain[3] == 0
    assert s.features("an idi0t")[2] > 0 and s.features("") == [0.0] * tx.Scanner.FEATURES


def test_held_out_is_crc32(spark):
    got = spark.range(200).select("id", tx.held_out(tx.F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = tx.score(docs, tx.train(docs, labels)).toPandas().merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    held = got[[zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]]
    assert len(held) > 80 and (held.predicted == held.toxic).mean() > 0.95
    assert ((got.score >= 0.7) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_cases(spark):
    docs = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (2, None, 2), (None, "idiot " * 3000, 3)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id bigint, toxic int")
    model = tx.train(docs, labels)
    assert model.weights is None and [r.score for r in tx.score(docs, model).collect()] == [0.0] * 4
    model = tx.Model(tx.Lexicon([("idiot", "word", 3.0)]), np.array([-3.0, 1, 1, 0, 0, 0]))
    kept = tx.keep_clean(docs, model)
    assert kept.columns == docs.columns and sorted(r.score for r in kept.collect()) == [1, 1, 2]
    assert tx.score(docs.limit(0), model).count() == 0 and tx.keep_clean(docs.limit(0), model).count() == 0


def brute_score(terms, weights, text):
    """The score from the definitions: edit distances to all terms, contexts by words, no automaton."""
    lower = (text or "").lower()
    found = {}
    words = [(m[0], m.start(), m.end()) for m in tx._WORD.finditer(lower)]
    for w in {w for w, _, _ in words}:
        fits = [(0, -weight, k) for k, (t, kind, weight) in enumerate(terms) if kind == "word" and t == w]
        if not fits:
            fits = [(0, -len(t), k) for k, (t, kind, _) in enumerate(terms) if kind == "stem" and w.startswith(t)]
        if not fits:
            fits = [(1, -weight, k) for k, (t, kind, weight) in enumerate(terms) if kind == "word" and len(t) >= 5 and distance(w, t) == 1]
        if fits:
            found[w] = min(fits)[0], terms[min(fits)[2]][2]
    sums = {"exact": 0.0, "fuzzy": 0.0, "quoted": 0.0}
    n = 0
    context = tx.Scanner(tx.Lexicon([])).context
    for w, a, b in words:
        if w in found:
            edits, weight = found[w]
            calm, harsh = context(lower, a, b)
            sums["quoted" if calm else "fuzzy" if edits else "exact"] += weight * (1.5 if harsh and not calm else 1)
            n += 1
    x = [min(sums["exact"], 12), min(np.log1p(sums["exact"]), 5), np.log1p(sums["fuzzy"]), np.log1p(sums["quoted"]), min(1, 20 * n / (1 + len({w for w, _, _ in words})))]
    return 1 / (1 + np.exp(-(weights[0] + np.dot(x, weights[1:]))))


def test_scores_against_brute_force(spark):
    r = random.Random(12)
    terms = sorted([("idiot", "word", 5.0), ("idiots", "word", 4.5), ("moron", "word", 4.0), ("scum", "word", 3.0), ("worth", "stem", 2.5), ("trash", "word", 3.5)])
    weights = np.array([-4.0, 0.5, 0.7, 0.9, -0.3, 1.1])
    bits = ["idiot", "idi0t", "Idiots", "idot", "moron", "morons", "scum", "scumm", "worthless", "trahs", "you", "said", '"', "“", "”", "plain", "words", "a_b", "é", "\n", "trash,", "(scum)", "Du"]
    texts = [None, "", *(" ".join(r.choice(bits) for _ in range(r.randint(1, 30))) for _ in range(300)), "idiot plain you " * 70_000]
    df = spark.createDataFrame([(i, t, "x", 0.5) for i, t in enumerate(texts)], "doc_id bigint, text string, predicted string, score double")
    got = {x.doc_id: x for x in tx.score(df, tx.Model(tx.Lexicon(terms), weights)).collect()}
    for i, t in enumerate(texts):
        want = brute_score(terms, weights, t)
        assert abs(got[i].score - want) < 1e-9 and got[i].predicted == (got[i].score >= 0.7), (i, (t or "")[:200])


def test_repeated_ids_are_learned_from_once(spark):
    docs = spark.createDataFrame([(i, f"awful{i % 2} word" if i % 2 else "fine", "x") for i in range(60)] * 3 + [(1, "zzz", "y")] * 500, "doc_id bigint, text string, toxic string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    one, two = tx.train(docs, labels), tx.train(docs.dropDuplicates(["doc_id", "text"]), labels)
    assert np.allclose(one.weights, two.weights) and one.lexicon.terms == two.lexicon.terms
