from newsloom import catalog


def test_mentions_beyond_100000_characters(spark, tmp_path):
    n = 130_000
    spark.createDataFrame([(1, "x" * n), (2, "x" * 149), (3, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.start): (r.chunks, r.chunk_starts) for r in catalog.QUERIES["mention_chunk_overlap"](spark, str(tmp_path)).collect()}
    want = {}
    for s in range(0, n - 149, 777):
        met = [c for c in range(0, max(n - 100, 1), 900) if s < min(c + 1000, n) and s + 150 > c]
        want[1, s] = (len(met), ",".join(map(str, met)))
    assert got == want
