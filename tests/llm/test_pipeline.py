import random

import sentencepiece as library

import corpus_pipeline as cp
from newsloom.llm import toxicity
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_jaccard import brute as linked
from tests.llm.test_secrets import brute as spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark, extra=()):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).unionByName(spark.createDataFrame(list(extra), "doc_id bigint, text string, lang string, source string, n_chars bigint"))


def test_stages_one_after_the_other(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    r = random.Random(1)
    passage = " ".join(items[0][1].split()[:8])
    near = " ".join(f"word{i}" for i in range(50))
    extra = [(10_001, "clean " + passage, "en", "s", 1), (10_002, "x password=abcdefgh12 y", "en", "s", 23), (10_003, None, "en", "s", None), (10_004, near, "en", "s", 1), (10_005, near.replace("word49", "z"), "en", None, 1), (None, "no id at all " + str(r.random()), None, "s", 1)]
    docs = documents(spark, extra)
    before = [tuple(x) for x in docs.collect()]

    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {(x.doc_id): x.predicted for x in toxicity.score(docs, model).collect()}
    got = cp.drop_toxic(spark, docs, sf)
    one = [tuple(x) for x in got.collect()]
    assert got.columns == COLUMNS and sorted(map(str, one)) == sorted(str(x) for x in before if not scores[x[0]])

    docs = spark.createDataFrame(one, got.schema)
    got = cp.drop_near_duplicates(spark, docs, sf)
    two = [tuple(x) for x in got.collect()]
    keep = {(k, c) for k, _, _, c in linked([(x[0], x[1]) for x in one])}
    assert got.columns == COLUMNS and sorted(str(x[0]) for x in two) == sorted(str(k) for k, c in keep if k is None or k == c)
    assert 10_004 in [x[0] for x in two] and 10_005 not in [x[0] for x in two]

    docs = spark.createDataFrame(two, got.schema)
    got = cp.drop_contaminated(spark, docs, sf)
    three = [tuple(x) for x in got.collect()]
    assert got.columns == COLUMNS and sorted(map(str, three)) == sorted(str(x) for x in two if not leaks(x[1], items)[1])
    assert 10_001 in [x[0] for x in two] and 10_001 not in [x[0] for x in three]

    docs = spark.createDataFrame(three, got.schema)
    got = cp.mask_secrets(spark, docs, sf)
    four = {x.doc_id: tuple(x) for x in got.collect()}
    assert got.columns == COLUMNS and len(four) == len(three)
    for x in three:
        if x[1] is None or not sum(spans(x[1])[0]):
            assert four[x[0]] == x or "[REDACTED]" in (four[x[0]][1] or "")
        else:
            assert not sum(spans(four[x[0]][1])[0]) and four[x[0]][4] == len(four[x[0]][1])
    assert four[10_002][1] == "x [REDACTED] y"

    last = {x.doc_id: x for x in cp.encode(spark, got, sf).collect()}
    model = library.SentencePieceProcessor(model_file=f"{cp.TOKENIZERS}/piece_bpe_32k.model")
    assert all(list(last[k].ids) == model.encode(x[1] or "") for k, x in four.items())


def test_run_writes_every_stage(spark):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "SentencePiece encoding"]
    assert cp.run(spark, "/root/testdata/sf0.001").count() > 50


def test_cases(spark):
    """Empty tables, repeated rows, a long text, other columns with names of ours."""
    sf = "/root/testdata/sf0.001"
    schema = "marks string, doc_id bigint, text string, items string, spans string, _nl_gone int, n_chars bigint, hits int"
    long = " ".join(f"w{i}" for i in range(30_000)) + " password=abcdefgh1"
    rows = [("m", 1, long, "i", "s", 1, len(long), 2), ("m", 2, None, None, "s", 1, None, 2), ("m", 2, None, None, "s", 1, None, 2), ("m", 3, "", "i", "s", 1, 0, 2)]
    docs = spark.createDataFrame(rows, schema)
    assert [cp.encode(spark, docs.limit(0), sf).count(), cp.mask_secrets(spark, docs.limit(0), sf).count()] == [0, 0]
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(got.collect(), got.schema)
    assert cp.encode(spark, docs, sf).count() == 4
    (one,) = docs.filter("doc_id = 1").collect()
    ok = one.text == long.replace("password=abcdefgh1", "[REDACTED]")
    assert ok and one.n_chars == len(long) - 8 and one["marks"] == "m"
