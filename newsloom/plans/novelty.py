"""Queries over vectors and fingerprints: neighbours, novelty, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import query, table
from newsloom.functions import fingerprint, vectors
from newsloom.ids import sid
from newsloom.operators import novelty, similarity
from newsloom.storage import cut

_PAIRS = """
    n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM n a JOIN n b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM p)
"""


@query("knn10", f"WITH {_PAIRS} SELECT a AS vec_id, b AS neighbour, s AS similarity, rank::INT AS rank FROM r WHERE rank <= 10")
def knn10(spark, sf_dir):
    return similarity.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)


@query(
    "novelty_labels",
    f"""WITH {_PAIRS}, t AS (SELECT a, max(s) AS s, string_agg(b::VARCHAR, ',' ORDER BY rank) AS neighbours FROM r WHERE rank <= 10 GROUP BY a),
    l AS (SELECT *, CASE WHEN s >= 0.45 THEN 're_report' WHEN s >= 0.30 THEN 'update' ELSE 'new' END AS label,
                 CASE WHEN s >= 0.45 THEN s WHEN s >= 0.30 THEN 0.5 + 0.5 * (s - 0.30) / (0.45 - 0.30) ELSE greatest(0.5, 1 - s) END AS c FROM t)
    SELECT a AS vec_id, label, round(c, 5) AS confidence, neighbours, sha256(a::VARCHAR || '|' || label) AS novelty_id FROM l""",
)
def novelty_labels(spark, sf_dir):
    near = similarity.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)
    best = near.groupBy("vec_id").agg(F.max("similarity").alias("s"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))), lambda x: x["neighbour"]), ",").alias("neighbours"))
    label, confidence = novelty.label_of(F.col("s"), report=0.45)
    return best.select("vec_id", label.alias("label"), F.round(confidence, 5).alias("confidence"), "neighbours").withColumn("novelty_id", sid("vec_id", "label"))


@query(
    "centroids",
    """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS p FROM embeddings), m AS (SELECT label, p, avg(x) AS m, count(*) AS n FROM e GROUP BY ALL)
       SELECT label, max(n) AS members, round(sqrt(sum(m * m)), 6) AS length, round(max_by(m, -p), 6) AS first_component FROM m GROUP BY label""",
)
def centroids(spark, sf_dir):
    got = vectors.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return got.select("label", "members", F.round(vectors.norm(F.col("centroid")), 6).alias("length"), F.round(F.col("centroid")[0], 6).alias("first_component"))


@query(
    "l2_normalize",
    "WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), m AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM n) SELECT vec_id, round(v[1] / n, 6) AS first_component, round(sqrt(list_sum(list_transform(v, lambda x: x * x))) / n, 6) AS length FROM m",
)
def l2_normalize(spark, sf_dir):
    unit = vectors.normalized(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(unit[0], 6).alias("first_component"), F.round(vectors.norm(unit), 6).alias("length"))


@query(
    "chunk_novelty",
    f"""WITH {_PAIRS}, c AS (SELECT p.a, max(greatest(0, least(1, s))) AS m FROM p JOIN n x ON x.vec_id = p.a JOIN n y ON y.vec_id = p.b WHERE x.label <> y.label GROUP BY p.a)
    SELECT n.vec_id, round(1 - coalesce(m, 0), 6) AS novelty, CASE WHEN 1 - coalesce(m, 0) >= 0.7 THEN 'new' WHEN 1 - coalesce(m, 0) >= 0.3 THEN 'partial_overlap' ELSE 'duplicate' END AS label FROM n LEFT JOIN c ON c.a = n.vec_id""",
)
def chunk_novelty(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return novelty.chunk_novelty(rows, "vec_id", "label", "embedding")


@query(
    "similarity_stats",
    f"""WITH {_PAIRS}, u AS (SELECT s FROM p WHERE a < b)
    SELECT count(*) AS pairs, min(s) AS low, max(s) AS high, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(stddev_pop(s), 6) AS deviation, round(quantile_cont(s, 0.95), 6) AS p95,
           count(*) FILTER (s >= 0.1) AS at_10, count(*) FILTER (s >= 0.3) AS at_30 FROM u""",
)
def similarity_stats(spark, sf_dir):
    return similarity.stats(similarity.counts(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


_REACH = """
    e AS (SELECT a, b FROM p WHERE s >= 0.40), nodes AS (SELECT DISTINCT a AS v FROM e),
    reach AS (SELECT v AS a, v AS b FROM nodes UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), root AS (SELECT a AS member, min(b) AS seed FROM reach GROUP BY a)
"""


@query(
    "story_clusters",
    f"""WITH RECURSIVE {_PAIRS}, {_REACH}, k AS (SELECT seed, count(*) AS n, sha256(string_agg(member::VARCHAR, '|' ORDER BY member)) AS story_id FROM root GROUP BY seed)
    SELECT story_id, root.seed, member, n AS members, round(coalesce(p.s, 1.0), 6) AS score FROM root JOIN k ON root.seed = k.seed LEFT JOIN p ON p.a = root.seed AND p.b = member""",
)
def story_clusters(spark, sf_dir):
    return novelty.story_clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.40)


@query(
    "cluster_medoids",
    f"""WITH RECURSIVE {_PAIRS}, {_REACH}, i AS (SELECT x.seed, p.a, round(sum(p.s), 6) AS t FROM p JOIN root x ON x.member = p.a JOIN root y ON y.member = p.b AND x.seed = y.seed WHERE p.s >= 0.40 GROUP BY ALL)
    SELECT seed AS cluster, arg_min(a, (-t, a)) AS medoid FROM i GROUP BY seed""".replace("arg_min(a, (-t, a))", "first(a ORDER BY t DESC, a)"),
)
def cluster_medoids(spark, sf_dir):
    found = cut(similarity.linked(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.40))
    roots = similarity.components(found.filter("b IS NOT NULL")).withColumnsRenamed({"node": "a", "root": "cluster"})
    return similarity.medoids(found.filter("b IS NULL").join(roots, "a"))


_SHINGLES = "list_distinct(list_transform(range(1, greatest(length(t) - 1, 2)), lambda i: substr(t, i, 3)))"


@query(
    "shingle_jaccard",
    f"""WITH s AS (SELECT doc_id, {_SHINGLES} AS g FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)), i AS (SELECT item_id, {_SHINGLES} AS g FROM (SELECT item_id, lower(text) AS t FROM benchmark WHERE text IS NOT NULL)),
    c AS (SELECT doc_id, item_id, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s) a JOIN (SELECT item_id, len(g) AS n, unnest(g) AS x FROM i) b USING (x) GROUP BY ALL)
    SELECT doc_id, item_id, k AS common, round(k / (n + m - k), 6) AS jaccard FROM c WHERE k / (n + m - k) >= 0.25""",
)
def shingle_jaccard(spark, sf_dir):
    """All documents against all items."""
    return novelty.shingle_matches(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id", "text", 0.25)


@query("minhash_sig")
def minhash_sig(spark, sf_dir):
    """All documents, 128 permutations; too many digests for SQL, so tests hold it against brute force."""
    got = fingerprint.minhash(table(spark, sf_dir, "documents"), "doc_id", F.when(F.length("text") > 0, fingerprint.shingles(F.col("text"))), 128)
    return got.select("doc_id", F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


@query(
    "simhash_sig",
    r"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS w FROM documents),
    c AS (SELECT w, i, CASE WHEN (('0x' || substr(md5(w), 1 + i // 4, 1))::INT >> (3 - i % 4)) & 1 = 1 THEN 1 ELSE -1 END AS v FROM (SELECT DISTINCT w FROM w), range(0, 64) AS r(i)),
    v AS (SELECT doc_id, i, sum(v) > 0 AS b FROM w JOIN c USING (w) GROUP BY ALL),
    q AS (SELECT doc_id, i // 4 AS j, sum(CASE WHEN b THEN 1 << (3 - (i % 4))::INT ELSE 0 END)::INT AS d FROM v GROUP BY ALL)
    SELECT doc_id, string_agg(lower(to_hex(d)), '' ORDER BY j) AS simhash FROM q GROUP BY doc_id""",
)
def simhash_sig(spark, sf_dir):
    """All documents with words."""
    tokens = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    return fingerprint.simhash(table(spark, sf_dir, "documents"), "doc_id", tokens)
