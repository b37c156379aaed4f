import hashlib
import os
import random
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece as library

from newsloom.llm import sentencepiece as sp
from tests.llm.test_jaccard import traced

PATH = os.environ.get("TOKENIZERS", "/opt/tokenizers") + "/piece_bpe_32k.model"


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if number == 2:
        return varint(number << 3 | 5) + value
    return varint(number << 3 | 2) + varint(len(value)) + value


def as_unigram(path, to):
    """The same pieces, with other scores, as a unigram model, which the library can search, too."""
    raw = open(path, "rb").read()
    out, i = b"", 0
    for n, v in sp._fields(raw):
        if n == 1:
            # Scores without ties; ties may be broken either way.
            p, i = dict(sp._fields(v)), i + 1
            v = b"".join(field(k, struct.pack("<f", -6 - i * 0.61803399 % 1 * 7) if k == 2 else x) for k, x in p.items())
        if n == 2:
            v = field(3, 1) + field(35, 1)
        out += varint(n << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else field(n, v)
    open(to, "wb").write(out)
    return to


def texts():
    r = random.Random(2)
    docs = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()]
    alphabet = list("abcdeéß  \n\t▁.,#12") + ["😀", "the", "ing", "  ", "中", "\r\n", "https://", "aaaa", "{{", "\\"]
    return ["", " ", "  ", "a", "\n", "\n\n a", " a", "a ", "▁", "▁▁a", "aaaaaaaaa", "\rx", "x \ry", "\x00"] + docs + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(500)]


def test_bpe_ids_are_the_librarys():
    model, cache, other = sp.load(PATH), sp.Cache(), library.SentencePieceProcessor(model_file=PATH)
    assert model.kind == "bpe"
    every = texts()
    for t, ids in zip(every, model.encode(every, cache)):
        assert ids.tolist() == other.encode(t), t
        assert model.decode(ids) == t.replace("▁", " ")


def test_search_agrees_with_merging_one_by_one():
    model, r = sp.load(PATH), random.Random(4)
    words = ["".join(r.choice("aeiousthn ▁ingé1.") for _ in range(12)).replace(" ", "") + "x" * 6 for _ in range(3000)]
    words = [w[:11] for w in words if "▁▁" not in w and len(w) >= 11]
    ids, ends = model.search(words)
    for w, got in zip(words, np.split(ids, ends[:-1])):
        assert got.tolist() == [model.ids.get(p, -1 - i) for p, i in sp._ends(model.merge(w))], w


def test_unigram_ids_are_the_librarys(tmp_path):
    path = as_unigram(PATH, str(tmp_path / "u.model"))
    model, other = sp.Model(path), library.SentencePieceProcessor(model_file=path)
    assert model.kind == "unigram"
    # The library adds up in single precision, so long texts, and unknown characters' huge costs, blur its sums.
    every = [line for t in texts() for line in t.split("\n") if len(line) < 150 and "  " not in line and not line.startswith(" ")]
    every = [t for t in every if all(c == " " or c in model.ids for c in t)]
    same = 0
    for t, ids in zip(every, model.encode(every, sp.Cache())):
        want = other.encode(t)
        ours, theirs = (sum(model.scores[i] for i in x) for x in (ids.tolist(), want))
        assert ids.tolist() == want or ours >= theirs - 0.1, t
        same += ids.tolist() == want
    assert len(every) > 300 and same > 0.99 * len(every)


def test_columns(spark):
    rows = [(1, "a b", 0), (1, "a b", 0), (2, None, 1), (3, "", 2), (None, "x" * 5000 + " é", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sp.encode(df, PATH).collect()
    other = library.SentencePieceProcessor(model_file=PATH)
    assert sorted((r.doc_id or 0, list(r.ids)) for r in got) == sorted((k or 0, other.encode(t or "")) for k, t, _ in rows)
    back = {r.doc_id: r.text for r in sp.decode(sp.encode(df, PATH), PATH).collect()}
    assert back == {k: t or "" for k, t, _ in rows}
    trip = {r.doc_id: r for r in sp.round_trip(df, PATH).collect()}
    for k, t, _ in rows:
        ids = np.array(other.encode(t or ""), "<i4")
        assert (trip[k].n_tokens, trip[k].ids_sha256, trip[k].same) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), True)
    assert sp.round_trip(df.limit(0), PATH).count() == 0


def test_cache_is_bounded_and_forgets_nothing_needed():
    model, cache = sp.load(PATH), sp.Cache(keep=5)
    for t in ("a b c d e f g", "h i j k l m", "a b z"):
        assert model.encode([t], cache)[0].tolist() == library.SentencePieceProcessor(model_file=PATH).encode(t)
    assert len(cache.new) + len(cache.old) < 40


def test_other_models_are_refused(tmp_path):
    with pytest.raises((ValueError, OSError)):
        sp.Model(str(tmp_path / "none.model"))


def test_texts_without_spaces():
    r = random.Random(7)
    long = ["".join(chr(r.randint(0x4E00, 0x5FFF)) for _ in range(200_000)), "".join(r.choice("etaoinshrdlu") for _ in range(100_000)), "a" * 50_000, "😀é" * 9_000, " " * 20_000 + "x" + "\n" * 9_000]
    model, other = sp.load(PATH), library.SentencePieceProcessor(model_file=PATH)
    for t, ids in zip(long, model.encode(long, sp.Cache())):
        same = ids.tolist() == other.encode(t)
        back = model.decode(ids) == t
        assert same and back, t[:20]


def test_long_words_alone_agree_with_search(tmp_path, monkeypatch):
    r = random.Random(9)
    for model in (sp.load(PATH), sp.Model(as_unigram(PATH, str(tmp_path / "u.model")))):
        words = ["▁" + "".join(r.choice("aeiousthn.ingéz中😀1") for _ in range(r.randint(20, 60))) for _ in range(200)]
        want = model.segment(words)
        monkeypatch.setattr(sp, "_LONG", 8)
        assert model.segment(words) == want
        monkeypatch.undo()


def test_cache_is_bounded_by_characters():
    model, cache = sp.load(PATH), sp.Cache(keep=10)
    for i in range(5):
        model.encode([f"{i}" * 1000], cache)
    assert cache.chars < 3000


def test_no_words_stay_in_a_worker(spark, monkeypatch):
    """What a task has learned of words goes with it."""
    r = random.Random(6)
    texts = [" ".join(f"{r.getrandbits(40):x}" for _ in range(200)) for _ in range(200)]
    sp.load(PATH, None)
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(texts)], ["doc_id", "_t"])
    n, _, left = traced(monkeypatch, df, lambda d: sp.encode(d, PATH), batch)
    assert n == 200 and left < 3, left
