import os
import random

import pytest

from newsloom.llm import tokencounts as tc
from newsloom.llm.shared import fresh_dir

PATH = os.environ.get("TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"


def n(text):
    return len(tc._encoding(PATH).encode_ordinary(text)) if text else 0


def totals(live):
    out = {}
    for source, lang, text in live:
        d, t = out.get((source, lang), (0, 0))
        out[source, lang] = d + 1, t + n(text)
    return out


def read(store):
    return {(r.source, r.lang): (r.documents, r.tokens) for r in store.totals().collect()}


@pytest.fixture
def store(spark):
    return tc.Rollup(spark, fresh_dir(spark, "t"), "v1", PATH)


SCHEMA = "doc_id bigint, source string, lang string, op string, seq bigint, text string, tokens string"


def test_against_recounting(spark, store):
    r = random.Random(6)
    state, loose = {}, []
    for step in range(4):
        rows = []
        for _ in range(25):
            key = r.choice([None, *range(12)])
            rows.append((key, r.choice(["a", "b", None]), r.choice(["en", None]), r.choice(["upsert", "upsert", "delete"]), r.randint(0, 3), r.choice([None, "", "hello world", "x" * r.randint(1, 50)]), "extra"))
        df = spark.createDataFrame(rows, SCHEMA)
        assert store.apply(f"b{step}", df, op="op", seq="seq")
        assert not store.apply(f"b{step}", df, op="op", seq="seq")
        best = {}
        order = lambda v: (v is not None, v)
        for row in rows:
            key, source, lang, op, seq, text, _ = row
            if key is None:
                if op == "upsert":
                    loose.append((source, lang, text))
            else:
                best.setdefault(key, []).append(row)
        for key, same in best.items():
            top = max(x[4] for x in same)
            same = sorted((x for x in same if x[4] == top), key=lambda x: (x[3], order(x[1]), order(x[2])))
            row = same[0]
            ties = [x for x in same if x[1:4] == row[1:4]]
            if len({n(x[5]) for x in ties}) > 1:
                pytest.skip("the tie is broken by a hash")
            if row[3] == "delete":
                state.pop(key, None)
            else:
                state[key] = (row[1], row[2], row[5])
        assert read(store) == totals([*state.values(), *loose])


def test_failed_batch_is_tried_again(spark, store):
    one = spark.createDataFrame([(1, "a", "en", "upsert", 0, "one two", "")], SCHEMA)
    store.apply("x", one)
    real, store._mark = store._mark, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    two = spark.createDataFrame([(1, "b", "en", "upsert", 0, "three", ""), (2, "a", "en", "upsert", 0, "four", "")], SCHEMA)
    with pytest.raises(OSError):
        store.apply("y", two)
    assert read(store) == totals([("a", "en", "one two")])
    store._mark = real
    assert store.apply("y", two) and read(store) == totals([("b", "en", "three"), ("a", "en", "four")])
    into = tc.Rollup(spark, fresh_dir(spark, "t"), "v1", PATH)
    store.compact(into)
    assert read(into) == read(store)
    assert into.apply("z", spark.createDataFrame([(2, None, None, "delete", 0, None, "")], SCHEMA), op="op") and read(into) == totals([("b", "en", "three")])


def test_versions_are_apart_and_empty_batches_commit(spark, store):
    one = spark.createDataFrame([(1, "a", "en", "upsert", 0, "one two", "")], SCHEMA)
    assert store.apply("e", one.limit(0)) and read(store) == {}
    store.apply("x", one)
    other = tc.Rollup(spark, store.folder, "v2", PATH)
    other.apply("x2", one)
    assert sorted((r.tokenizer, r.documents) for r in store.totals().collect()) == [("v1", 1), ("v2", 1)]


def test_query_against_recounting(spark, tmp_path):
    """Inserts, revisions and deletes of the registered query; columns called op and seq, a text of a megabyte, repeated rows."""
    import re

    from newsloom.llm.queries import QUERIES

    long = "word  " * 160_000 + "a" * 50_000
    rows = [(1, "a", "en", "x  y", "delete", 5), (2, "a", "en", "x  y", "delete", 1), (3, "b", None, "x y", "?", None), (4, None, "en", None, "delete", 1), (5, "a", "en", "", None, 1), (6, "a", "en", "", None, 1), (None, "a", "en", "x  y", None, 1), (7, "b", "de", long, "", 2), (8, "b", "de", "tab\t\n end", "", 2), (9, "b", "de", "q", "", 1), (9, "b", "de", "q", "", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string, op string, seq int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    live, texts = [], {}
    for key, source, lang, text, _, _ in dict.fromkeys(rows):
        if key is not None and text is not None and texts.setdefault(text, key) != key:
            continue
        live.append((source, lang, text if key is None or text is None else re.sub(r"([ \t-\r])[ \t-\r]+", r"\1", text)))
    got = {(r.source, r.lang): (r.documents, r.tokens) for r in QUERIES["op7_token_counts"](spark, str(tmp_path)).collect()}
    assert got == totals(live)
