"""The registered queries of the operators, each over whole tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from newsloom.llm import chat, decontamination, jaccard, media, secrets, sentencepiece, tokencounts, toxicity, urls, warc

#: The folder of the tokenizers' files.
TOKENIZERS = os.environ.get("TOKENIZERS", "/opt/tokenizers")

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op5_url_filter",
    r"""
    WITH cut AS (SELECT page_id, coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') AS h,
                        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    u AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut),
    rules(verdict, host, path, rule) AS (VALUES ('block', 'net', '/', 'net/'), ('allow', 'example.net', '/en/', 'example.net/en/'),
                                                ('block', 'example.com', '/de/', 'example.com/de/'), ('allow', 'org', '/fr/', 'org/fr/')),
    best AS (SELECT u.page_id, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
             FROM u JOIN rules r ON (u.host = r.host OR suffix(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY 1)
    SELECT u.page_id, u.host, u.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM u LEFT JOIN best b USING (page_id)
    """,
)
def op5(spark, sf_dir):
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


@query(
    "op10_warc",
    """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
    g AS (SELECT payload_digest, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
    SELECT d.page_id, d.payload_bytes, d.payload_digest,
           CASE WHEN g.top > d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN g.top > d.page_id THEN g.top END AS refers_to
    FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND d.payload_bytes >= 1000
    """,
)
def op10(spark, sf_dir):
    got = warc.round_trip(_table(spark, sf_dir, "pages"))
    return got.selectExpr("metadata.capture_id AS page_id", "response.payload_bytes AS payload_bytes", "response.payload_digest AS payload_digest", "response.warc_type AS record_type", "metadata.refers_to AS refers_to")


@query("op2_secret_scan")
def op2(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs).select("doc_id", *secrets.digest_columns(F.col("spans")))


_OP8_SQL = r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
    f AS (SELECT *, CASE WHEN role IN ('user', 'assistant', 'system') THEN length(role) ELSE 1 + length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')) END + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + 14 AS n FROM c)
    SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
    FROM f GROUP BY 1
    """


@query("op8_chat_format", _OP8_SQL)
def op8(spark, sf_dir):
    """The rows become records of four layouts, which are told apart by their fingerprints again."""
    said = "\\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"))
    turns = chat.read_records(chat.as_records(rows), "conv_id", "record", "first")
    # The records are made here, so a reject is a fault of ours, not of the table.
    turns = turns.withColumn("role", F.when(F.col("problem").isNull(), F.col("role")).otherwise(F.raise_error("problem")))
    return chat.read_back(chat.format_turns(turns))


@query("op4_media_jpeg")
def op4(spark, sf_dir):
    """The images are written to the shared folder; features and full-resolution RGB tensors come from what is read there."""
    return media.features(media.stored(media.with_media(_table(spark, sf_dir, "documents"))), tensors=True)


_OP1_SQL = r"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    i AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
    win AS (SELECT item_id, least(len(w), 8) AS n, array_to_string(w[s : s + least(len(w), 8) - 1], ' ') AS t
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
    places AS (SELECT d.r, s, z.n, array_to_string(d.w[s : s + z.n - 1], ' ') AS t FROM d, (SELECT DISTINCT n FROM win) z, unnest(range(1, len(d.w) - z.n + 2)) AS u(s)),
    met AS (SELECT p.r, p.s, p.n, win.item_id FROM places p JOIN win ON p.t = win.t AND p.n = win.n),
    hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM met) GROUP BY 1),
    its AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT r, item_id::VARCHAR AS k FROM met) GROUP BY 1)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
    FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
    """


@query("op1_decontamination", _OP1_SQL)
def op1(spark, sf_dir):
    marked = decontamination.mark(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", *decontamination.digest_columns()).drop("n_near")


@query("op1_proximity")
def op1_proximity(spark, sf_dir):
    """All that op1 finds, with the proximity matches that its SQL has no column for."""
    marked = decontamination.mark(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", *decontamination.digest_columns())


@query("op3_sentencepiece")
def op3(spark, sf_dir):
    return sentencepiece.round_trip(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


@query("op6_toxicity")
def op6(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op7_token_counts")
def op7(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return tokencounts.rollup_of(docs, "byte_bpe_50k", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


_OP9_SQL = r"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
    u AS (SELECT doc_id, unnest(g) AS t FROM s), n AS (SELECT doc_id, len(g) AS n FROM s),
    e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.t = b.t AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 70 * (max(x.n) + max(y.n) - count(*))),
    reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
    c AS (SELECT a, min(b) AS low FROM reach GROUP BY 1), k AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
    SELECT n.doc_id, n.n AS n_shingles, coalesce(k.n, 0) AS n_similar, least(n.doc_id, coalesce(c.low, n.doc_id)) AS component_id
    FROM n LEFT JOIN k ON k.a = n.doc_id LEFT JOIN c ON c.a = n.doc_id
    """


@query("op9_jaccard_join", _OP9_SQL)
def op9(spark, sf_dir):
    return jaccard.similar(_table(spark, sf_dir, "documents").select("doc_id", "text"))
