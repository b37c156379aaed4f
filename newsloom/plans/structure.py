"""Queries over spans, blocks, chunks and mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import query, table
from newsloom.functions import text as tx
from newsloom.ids import sid
from newsloom.operators import mentions, parse, spans

_LINES = """
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    o AS (SELECT doc_id, i - 1 AS line_no, line, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1)::BIGINT AS s FROM l)
"""


@query("line_offsets", f"WITH {_LINES} SELECT doc_id, line_no::INT AS line_no, s AS start, (s + length(line))::BIGINT AS \"end\", sha256(line) AS line_hash FROM o")
def line_offsets(spark, sf_dir):
    return parse.lines(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("line_hash", F.sha2("line", 256)).drop("line")


_KIND = r"""CASE WHEN trim(line) = '' THEN 'BLANK' WHEN regexp_matches(line, '^\s*\|.*\|\s*$|^[^|]+\|[^|]+\|') THEN 'TABLE' WHEN regexp_matches(line, '^#{1,6}\s') THEN 'HEADING' WHEN regexp_matches(line, '^\s*([-*+]|\d+[.)])\s') THEN 'LIST' ELSE 'PARAGRAPH' END"""
_BLOCKS = f"""{_LINES}, k AS (SELECT *, {_KIND} AS kind FROM o), g AS (SELECT *, CASE WHEN kind = lag(kind) OVER w AND kind <> 'HEADING' THEN 0 ELSE 1 END AS fresh FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM g),
    b AS (SELECT doc_id, run, kind AS block_type, min(s) AS s, max(s + length(line)) AS e FROM r WHERE kind <> 'BLANK' GROUP BY ALL)"""


@query("paragraph_blocks", f'WITH {_BLOCKS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1)::INT AS block_no, block_type, s::BIGINT AS start, e::BIGINT AS "end" FROM b')
def paragraph_blocks(spark, sf_dir):
    return parse.blocks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "interval_coverage",
    f"""WITH {_BLOCKS}, c AS (SELECT doc_id, sum(e - s) AS covered, count(*) AS n FROM b GROUP BY 1)
    SELECT doc_id, n AS blocks, round(covered / greatest(length(text), 1), 6) AS coverage, round(0.4 * covered / greatest(length(text), 1) + 0.4 * 0.9 + CASE WHEN n > 3 THEN 0.1 ELSE 0 END, 5) AS parse_quality FROM documents JOIN c USING (doc_id)""",
)
def interval_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = parse.blocks(docs, "doc_id", "text")
    whole = spans.merged(found, ["doc_id"]).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.count("*").alias("blocks"))
    share = F.col("covered") / F.greatest(F.length("text"), F.lit(1))
    return docs.join(whole, "doc_id").select("doc_id", "blocks", F.round(share, 6).alias("coverage"), F.round(0.4 * share + 0.4 * 0.9 + F.when(F.col("blocks") > 3, 0.1).otherwise(0.0), 5).alias("parse_quality"))


@query(
    "fixed_chunks",
    """WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 100, 1), 900)) AS s, unnest(range(0, len(range(0, greatest(length(text) - 100, 1), 900)))) AS i FROM documents)
    SELECT doc_id, i::INT AS chunk_no, s AS start, least(s + 1000, length(text))::BIGINT AS "end", sha256(doc_id || '|' || s || '|' || least(s + 1000, length(text))) AS evidence_id,
           ((length(substr(text, s + 1, 1000)) + 3) // 4)::BIGINT AS tokens FROM c""",
)
def fixed_chunks(spark, sf_dir):
    chunks = parse.fixed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return chunks.select("doc_id", "chunk_no", "start", "end", sid("doc_id", "start", "end").alias("evidence_id"), F.ceil(F.length("chunk") / 4).alias("tokens"))


@query(
    "span_verification",
    """WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 100, 1), 900)) AS s FROM documents)
    SELECT doc_id, count(*) AS checked, 0::BIGINT AS wrong FROM c GROUP BY doc_id""",
)
def span_verification(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chunks = parse.fixed_chunks(docs, "doc_id", "text")
    met = chunks.join(docs.select("doc_id", "text"), "doc_id")
    wrong = F.count_if((F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("chunk")) | (F.col("end") > F.length("text")))
    return met.groupBy("doc_id").agg(F.count("*").alias("checked"), wrong.alias("wrong"))


@query(
    "heading_asof",
    """SELECT e.event_id, h.event_id AS heading FROM (SELECT * FROM events WHERE event_type <> 'signup') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') h ON e.user_id = h.user_id AND e.ts >= h.ts""",
)
def heading_asof(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    heads = rows.filter("event_type = 'signup'").select("user_id", F.col("at").alias("before"), F.col("event_id").alias("heading"))
    return spans.as_of(rows.filter("event_type <> 'signup'").select("event_id", "user_id", "at"), heads, ["user_id"], "at", "before", "heading").select("event_id", "heading")


@query(
    "nearest_event",
    """WITH a AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'), b AS (SELECT event_id AS o, user_id, epoch_us(ts) AS u FROM events WHERE event_type = 'view'),
    m AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(t - u), o) AS r FROM a JOIN b USING (user_id) WHERE abs(t - u) <= 21600000000)
    SELECT event_id, o AS view_id, abs(t - u)::DOUBLE AS gap FROM m WHERE r = 1""",
)
def nearest_event(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    views = rows.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("t").alias("u"))
    got = spans.nearest(rows.filter("event_type = 'purchase'").select("event_id", "user_id", "t"), views, ["user_id"], "t", "u", 6 * 3600 * 1e6, "view_id")
    return got.select("event_id", "view_id", F.col("gap").cast("double").alias("gap"))


_CAPS = r"list_filter(string_split_regex(text, '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][A-Z0-9]{2,7}'))"


@query(
    "acronym_mentions",
    rf"""WITH m AS (SELECT doc_id, source, unnest({_CAPS}) AS surface FROM documents)
    SELECT surface, count(*) AS occurrences, count(DISTINCT doc_id) AS documents, count(DISTINCT source) AS sources, min(doc_id) AS first_doc FROM m WHERE surface NOT IN ('THE', 'AND', 'DER', 'DIE') GROUP BY 1""",
)
def acronym_mentions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", "source", F.explode(F.filter(F.split("text", r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[A-Z][A-Z0-9]{2,7}$"))).alias("surface"))
    return mentions.proposals(found.filter(~F.col("surface").isin("THE", "AND", "DER", "DIE")))


@query(
    "mention_chunk_overlap",
    """WITH m AS (SELECT doc_id, s AS ms, s + 150 AS me FROM documents, unnest(range(0, length(text) - 149, 777)) AS r(s)),
    c AS (SELECT doc_id, unnest(range(0, greatest(length(text) - 100, 1), 900)) AS cs, length(text) AS n FROM documents)
    SELECT m.doc_id, ms AS start, count(*) AS chunks, string_agg(cs::VARCHAR, ',' ORDER BY cs) AS chunk_starts FROM m JOIN c ON m.doc_id = c.doc_id AND ms < least(cs + 1000, n) AND me > cs GROUP BY ALL""",
)
def mention_chunk_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.filter("length(text) >= 150").select("doc_id", F.explode(F.sequence(F.lit(0), F.length("text") - 150, F.lit(777))).alias("s")).select("doc_id", F.col("s").cast("long").alias("start"), (F.col("s") + 150).cast("long").alias("end"))
    chunks = parse.fixed_chunks(docs, "doc_id", "text").select("doc_id", F.col("start").alias("start2"), F.col("end").alias("end2"))
    met = spans.overlap_join(found, chunks, ["doc_id"])
    return met.groupBy("doc_id", "start").agg(F.count("*").alias("chunks"), F.array_join(F.array_sort(F.collect_list("start2")), ",").alias("chunk_starts"))


@query(
    "pattern_mentions",
    r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))::BIGINT AS emails, len(regexp_extract_all(text, '\+?\d[\d ()/-]{7,}\d'))::BIGINT AS phones,
           len(regexp_extract_all(text, '\b\d+(?:[.,]\d+)?\s?(?:%|kWh|MW|EUR)'))::BIGINT AS quantities, len(regexp_extract_all(text, '(?:Version|§)\s?\d+(?:\.\d+)*'))::BIGINT AS references FROM documents""".replace("AS references", 'AS "references"'),
)
def pattern_mentions(spark, sf_dir):
    return mentions.pattern_counts(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "gazetteer_mentions",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}0-9]+')) AS w FROM documents), g(entity, surface, confidence) AS (VALUES ('licence', 'licensed', 0.9), ('licence', 'license', 0.85), ('apache', 'apache', 0.9), ('version', 'version', 0.7))
    SELECT doc_id, entity, count(*) AS mentions, max(confidence)::DOUBLE AS confidence FROM w JOIN g ON w.w = g.surface GROUP BY ALL""",
)
def gazetteer_mentions(spark, sf_dir):
    forms = spark.createDataFrame([("licence", "licensed", 0.9), ("licence", "license", 0.85), ("apache", "apache", 0.9), ("version", "version", 0.7)], "entity string, surface string, confidence double")
    return mentions.by_word(table(spark, sf_dir, "documents"), "doc_id", "text", forms)


@query(
    "table_cells",
    r"""WITH t AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: contains(x, '|') AND NOT regexp_matches(x, '^[\s|:-]+$')) AS r FROM documents),
    h AS (SELECT doc_id, list_transform(string_split(regexp_replace(trim(r[1]), '^\||\|$', '', 'g'), '|'), lambda c: trim(c)) AS h, unnest(r[2:]) AS line, unnest(range(0, len(r) - 1)) AS row_no FROM t WHERE len(r) > 1),
    c AS (SELECT doc_id, row_no, h, list_transform(string_split(regexp_replace(trim(line), '^\||\|$', '', 'g'), '|'), lambda c: trim(c)) AS c FROM h),
    f AS (SELECT doc_id, row_no, h, unnest(c) AS value, unnest(range(0, len(c))) AS col_no FROM c)
    SELECT doc_id, row_no::INT AS row_no, col_no::INT AS col_no, h[col_no + 1] AS header, value FROM f""",
)
def table_cells(spark, sf_dir):
    return parse.table_cells(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("packed_chunks")
def packed_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sized = parse.lines(docs, "doc_id", "text").select("doc_id", "start", "end", F.ceil(F.length("line") / 4).alias("tokens"))
    return spans.pack(sized, "doc_id")


@query("resolved_mentions")
def resolved_mentions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chunks = parse.lines(docs, "doc_id", "text").select("doc_id", "start", "end", F.lit(0.5).alias("confidence"))
    other = parse.fixed_chunks(docs, "doc_id", "text", 300, 50).select("doc_id", "start", "end", F.lit(0.7).alias("confidence"))
    return spans.resolve_overlaps(chunks.unionByName(other), ["doc_id"])


@query("snap_to_words", r"""SELECT doc_id, (100 - length(regexp_extract(left(text, 100), '\S*$')))::BIGINT AS start, (200 + length(regexp_extract(substr(text, 201), '^\S*')))::BIGINT AS "end" FROM documents WHERE length(text) > 200""")
def snap_to_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("length(text) > 200")
    before, after = F.regexp_extract(F.substring("text", 1, 100), r"\S*\z", 0), F.regexp_extract(F.substring("text", F.lit(201), F.length("text")), r"^\S*", 0)
    return docs.select("doc_id", (100 - F.length(before)).cast("long").alias("start"), (200 + F.length(after)).cast("long").alias("end"))
