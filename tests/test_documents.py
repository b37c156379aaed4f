import hashlib

from newsloom import catalog

TEXTS = ["", "ab", "The quick brown fox jumps over the lazy dog", "the quick brown fox jumps over a lazy dog", "The quick brown fox", "zzz " * 5000, "Über straße ÉÉ", None]


def grams(t):
    t = t.lower()
    return {t} if len(t) < 3 else {t[i : i + 3] for i in range(len(t) - 2)}


def tables(spark, path, items=("the quick brown fox jumps over the lazy dog", "zzz zzz")):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_every_document_has_128_permutations(spark, tmp_path):
    got = {r.doc_id: r.signature for r in catalog.QUERIES["minhash_sig"](spark, tables(spark, tmp_path)).collect()}
    for k, t in enumerate(TEXTS):
        words = [[int(hashlib.md5(g.encode() + i.to_bytes(4, "little")).hexdigest()[:8], 16) for g in grams(t)] if t else [2**32 - 1] for i in range(128)]
        assert got.pop(k) == ",".join(str(min(w)) for w in words)
    assert not got


def test_documents_meet_items(spark, tmp_path):
    sf = tables(spark, tmp_path, items := ("the quick brown fox jumps over the lazy dog", "zzz zzz"))
    got = {(r.doc_id, r.item_id): (r.common, r.jaccard) for r in catalog.QUERIES["shingle_jaccard"](spark, sf).collect()}
    want = {}
    for k, t in enumerate(TEXTS):
        for i, item in enumerate(items):
            a, b = grams(t) if t is not None else set(), grams(item)
            if len(a & b) / len(a | b) >= 0.25:
                want[k, i] = (len(a & b), round(len(a & b) / len(a | b), 6))
    assert got == want and len(want) >= 4


def test_simhash_and_embeddings_are_of_documents(spark, tmp_path):
    sf = tables(spark, tmp_path)
    got = {r.doc_id: r.simhash for r in catalog.QUERIES["simhash_sig"](spark, sf).collect()}
    for k, t in enumerate(TEXTS):
        if t:
            votes = [0] * 64
            for w in t.lower().split():
                h = int(hashlib.md5(w.encode()).hexdigest()[:16], 16)
                votes = [v + (1 if h >> (63 - i) & 1 else -1) for i, v in enumerate(votes)]
            assert got.pop(k) == f"{sum((v > 0) << (63 - i) for i, v in enumerate(votes)):016x}"
    assert not got
    assert sorted(r.doc_id for r in catalog.QUERIES["hashed_embeddings"](spark, sf).collect()) == list(range(len(TEXTS)))
