"""Queries over search, masking, candidates, integrity and dumps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom.catalog import query, table
from newsloom.functions import text as tx
from newsloom.ids import sid
from newsloom.operators import novelty, search


@query(
    "fts_bm25",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}0-9]+') AS ws FROM documents), s AS (SELECT count(*) AS docs, avg(len(ws)) AS mean FROM w),
    q(query, term) AS (VALUES (1, 'license'), (1, 'version'), (2, 'worthless'), (2, 'idiot')), t AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM w),
    p AS (SELECT term, doc_id, n, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
    SELECT query, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM p JOIN d USING (term) JOIN q USING (term), s GROUP BY ALL""",
)
def fts_bm25(spark, sf_dir):
    queries = spark.createDataFrame([(1, "license"), (1, "version"), (2, "worthless"), (2, "idiot")], "query int, term string")
    return search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", queries).withColumn("score", F.round("score", 6))


@query("entity_mask", "SELECT doc_id, replace(replace(text, 'Apache License', '[E1]'), 'Apache', '[E2]') AS masked, true AS same FROM documents")
def entity_mask(spark, sf_dir):
    names = sorted(("Apache", "Apache License"), key=lambda n: (-len(n), n))
    pairs = [(n, f"[E{i}]") for i, n in enumerate(names, 1)]
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", tx.replace_all(F.col("text"), pairs).alias("masked"))
    return rows.select("doc_id", "masked", (tx.replace_all(F.col("masked"), [(b, a) for a, b in pairs]) == F.col("text")).alias("same"))


_SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@query("statement_normalize", rf"""SELECT conv_id, turn, regexp_replace(lower(trim(regexp_replace(text, '[{_SPACE}]+', ' ', 'g'))), '[!-/:-@\[-`{{-~]+$', '') AS statement FROM conversations""")
def statement_normalize(spark, sf_dir):
    """Whole statements, white space as one blank, with all ASCII punctuation taken off their ends."""
    s = F.regexp_replace(F.lower(F.trim(F.regexp_replace("text", rf"[{_SPACE}]+", " "))), r"[!-/:-@\[-`{-~]+\z", "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", s.alias("statement"))


@query("event_type_alias", "SELECT event_id, CASE lower(trim(event_type)) WHEN 'purchase' THEN 'purchase_made' WHEN 'signup' THEN 'signup_opened' ELSE lower(trim(event_type)) END AS event_type FROM events")
def event_type_alias(spark, sf_dir):
    aliases = {"purchase": "purchase_made", "signup": "signup_opened"}
    kind = F.lower(F.trim("event_type"))
    mapping = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(mapping[kind], kind).alias("event_type"))


@query("berlin_times", "SELECT event_id, timezone('UTC', timezone('Europe/Berlin', ts)) AS utc, make_date(year(ts), 1, 1) AS year_start FROM events")
def berlin_times(spark, sf_dir):
    ts = F.col("ts").cast("timestamp_ntz")
    utc = F.convert_timezone(F.lit("Europe/Berlin"), F.lit("UTC"), ts)
    return table(spark, sf_dir, "events").select("event_id", utc.alias("utc"), F.make_date(F.year("ts"), F.lit(1), F.lit(1)).alias("year_start"))


@query(
    "title_candidates",
    r"""WITH c AS (SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS a, nullif(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), '') AS b FROM pages)
    SELECT page_id, coalesce(b, a, 'untitled') AS title, CASE WHEN b IS NOT NULL THEN 0.9 WHEN a IS NOT NULL THEN 0.8 ELSE 0.1 END::DOUBLE AS confidence, coalesce(a = b, false) AS agree FROM c""",
)
def title_candidates(spark, sf_dir):
    found = lambda p: F.nullif(F.trim(F.regexp_extract("html", p, 1)), F.lit(""))
    rows = table(spark, sf_dir, "pages").select("page_id", found(r"<title>([^<]*)</title>").alias("a"), found(r"<h1>([^<]*)</h1>").alias("b"))
    best = F.array_max(F.filter(F.array(F.struct(F.lit(0.9).alias("c"), F.col("b").alias("t")), F.struct(F.lit(0.8).alias("c"), F.col("a").alias("t")), F.struct(F.lit(0.1).alias("c"), F.lit("untitled").alias("t"))), lambda x: x["t"].isNotNull()))
    return rows.select("page_id", best["t"].alias("title"), best["c"].alias("confidence"), F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("agree"))


@query("first_line_slot", "SELECT doc_id, left(list_filter(string_split(left(text, 500), chr(10)), lambda x: trim(x) <> '')[1], 200) AS slot, 0.7::DOUBLE AS confidence FROM documents")
def first_line_slot(spark, sf_dir):
    line = F.get(F.filter(F.split(F.substring("text", 1, 500), "\n", -1), lambda x: F.trim(x) != ""), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(line, 1, 200).alias("slot"), F.lit(0.7).alias("confidence"))


@query(
    "table_metrics",
    """SELECT o_custkey, unnest(['orders', 'total', 'largest']) AS metric, unnest([count(*)::DOUBLE, round(sum(o_totalprice), 2), max(o_totalprice)]) AS value FROM orders GROUP BY o_custkey""",
)
def table_metrics(spark, sf_dir):
    wide = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_totalprice").alias("largest"))
    return wide.unpivot("o_custkey", ["orders", "total", "largest"], "metric", "value")


@query(
    "extract_summary",
    "SELECT event_type, count(*) AS n, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END)::BIGINT AS large, count(DISTINCT user_id) AS users, coalesce(max(CASE WHEN value > 10000 THEN value END), 0) AS outlier, string_agg(DISTINCT (user_id % 5)::VARCHAR, ',' ORDER BY (user_id % 5)::VARCHAR) AS groups FROM events GROUP BY 1",
)
def extract_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("large"), F.countDistinct("user_id").alias("users"),
        F.coalesce(F.max(F.when(F.col("value") > 10000, F.col("value"))), F.lit(0.0)).alias("outlier"), F.array_join(F.array_sort(F.collect_set((F.col("user_id") % 5).cast("string"))), ",").alias("groups"),
    )


@query(
    "shared_mentions",
    """WITH m AS (SELECT DISTINCT o_custkey AS doc, o_orderpriority AS key, o_orderstatus AS type FROM orders), n AS (SELECT c_custkey AS doc, c_custkey + r AS neighbour FROM customer, range(1, 4) AS t(r)),
    s AS (SELECT m.doc, m.key, m.type FROM m JOIN n ON m.doc = n.doc JOIN m o ON o.doc = n.neighbour AND o.key = m.key)
    SELECT doc, count(DISTINCT key) AS shared, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM s GROUP BY 1""",
)
def shared_mentions(spark, sf_dir):
    mentions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("key"), F.col("o_orderstatus").alias("type")).distinct()
    near = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.posexplode(F.sequence(F.col("c_custkey") + 1, F.col("c_custkey") + 3)).alias("p", "neighbour")).select("doc", "neighbour", (F.col("p") + 1).alias("rank"))
    return novelty.shared_mentions(near, mentions).withColumn("types", F.array_join("types", ","))


@query(
    "integrity_violations",
    """SELECT 'gap_in_turns' AS rule, count(*) AS n FROM (SELECT turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS d FROM conversations) WHERE d <> 1
    UNION ALL SELECT 'wrong_length', count(*) FROM documents WHERE length(text) <> n_chars UNION ALL SELECT 'repeated_key', count(*) - count(DISTINCT doc_id) FROM documents
    UNION ALL SELECT 'discount_out_of_range', count(*) FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.05""",
)
def integrity_violations(spark, sf_dir):
    count = lambda rule, df: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    turns = table(spark, sf_dir, "conversations").select((F.col("turn") - F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))).alias("d")).filter("d <> 1")
    docs = table(spark, sf_dir, "documents")
    repeated = docs.agg((F.count("*") - F.countDistinct("doc_id")).alias("n")).select(F.lit("repeated_key").alias("rule"), "n")
    lines = table(spark, sf_dir, "lineitem").filter(~F.col("l_discount").between(0, 0.05))
    return count("gap_in_turns", turns).unionByName(count("wrong_length", docs.filter(F.length("text") != F.col("n_chars")))).unionByName(repeated).unionByName(count("discount_out_of_range", lines))


@query(
    "knowledge_dump",
    """SELECT o_custkey AS publication, count(*) AS statements, string_agg(o_orderkey || ':' || o_orderstatus || ':' || coalesce(n, 0), ';' ORDER BY o_orderkey) AS body FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""",
)
def knowledge_dump(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.col("o_custkey").alias("publication"), "o_orderkey", "o_orderstatus", F.coalesce("n", F.lit(0)).alias("n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "n"))), lambda x: F.concat_ws(":", x["o_orderkey"], x["o_orderstatus"], x["n"])), ";")
    return rows.groupBy("publication").agg(F.count("*").alias("statements"), body.alias("body"))


@query("expired_states", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 50000 THEN o_orderdate END AS expired_at FROM orders")
def expired_states(spark, sf_dir):
    ended = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 50000)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(ended, F.col("o_orderdate")).alias("expired_at"))


@query("ui_filter", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'example.net') AND contains(lower(html), 'the') ORDER BY page_id LIMIT 50")
def ui_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").filter(F.lower("url").contains("example.net") & F.lower("html").contains("the"))
    return rows.select("page_id", "url").orderBy("page_id").limit(50)


@query("sample_spans", "SELECT doc_id, sha256(doc_id || '|0|' || least(100, length(text))) AS evidence_id FROM documents ORDER BY doc_id LIMIT 200")
def sample_spans(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", sid("doc_id", F.lit(0), F.least(F.lit(100), F.length("text"))).alias("evidence_id"))
    return rows.orderBy("doc_id").limit(200)


@query("date_sniff", r"SELECT page_id, regexp_extract(html, '(\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4})', 1) AS found, regexp_matches(lower(html), 'captcha|just a moment') AS challenge FROM pages")
def date_sniff(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4})", 1).alias("found"), F.lower("html").rlike("captcha|just a moment").alias("challenge"))
