"""Queries over texts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import query, table
from newsloom.functions import text as tx
from newsloom.ids import sid


@query(
    "url_normalize",
    r"""
    WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1) AS h, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]*:([0-9]+)', 1) AS port,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]*(?::[0-9]+)?([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
    k AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT split_part(x, '=', 1) IN ('ref', 'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid'))) AS kept FROM p)
    SELECT page_id, s || '://' || lower(h) || CASE WHEN port = '' OR (s = 'http' AND port = '80') OR (s = 'https' AND port = '443') THEN '' ELSE ':' || port END
        || regexp_replace(replace(path, '/./', '/'), '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_normalized FROM k
    """,
)
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.normalize_url(F.col("url")).alias("url_normalized"))


_COLLAPSE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '\A[ \n]+|[ \n]+\z', '', 'g')"
_BARE = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
_DECODED = "replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query("html_strip", f"SELECT page_id, {_COLLAPSE.format(_DECODED.format(_BARE))} AS body FROM pages")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_html(F.col("html")).alias("body"))


@query("html_links", r"""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages""")
def html_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("link"))


@query("collapse_whitespace", f"SELECT doc_id, {_COLLAPSE.format('text')} AS body FROM documents")
def collapse_whitespace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.collapse_whitespace(F.col("text")).alias("body"))


@query(
    "quality_score",
    r"""
    WITH d AS (SELECT doc_id, length(text)::DOUBLE AS n, length(regexp_replace(text, '\P{L}', '', 'g')) AS letters,
        len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS words, len(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'licensed under'))) / len(string_split(text, chr(10))) AS boiler FROM documents),
    a AS (SELECT *, CASE WHEN n > 0 THEN letters / n ELSE 0 END AS alpha FROM d)
    SELECT doc_id, round(greatest(least(0.3 * least(words / 100.0, 1.0) + 0.4 * (CASE WHEN alpha < 0.5 THEN alpha / 2 ELSE alpha END) + 0.3 * (1 - boiler), 1.0), 0.0), 3) AS score FROM a
    """,
)
def quality_score(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    boiler = F.size(F.filter(lines, lambda x: F.lower(x).contains("licensed under"))) / F.size(lines)
    return table(spark, sf_dir, "documents").select("doc_id", tx.quality_score(F.col("text"), boiler).alias("score"))


_LANG_SQL = ", ".join(f"len(list_intersect(own, {list(ws)!r}))::DOUBLE AS {k}" for k, ws in sorted(tx.LANGUAGE_WORDS.items()))


@query(
    "lang_indicator",
    rf"""
    WITH o AS (SELECT doc_id, lang, list_distinct(string_split_regex(lower(text), '[^\p{{L}}]+')) AS own FROM documents),
    c AS (SELECT doc_id, lang, {_LANG_SQL} FROM o),
    s AS (SELECT *, greatest(de, en, es, fr) AS best, de + en + es + fr AS total FROM c),
    r AS (SELECT *, CASE WHEN total > 0 THEN best / total ELSE 0 END AS share FROM s)
    SELECT doc_id, CASE WHEN share >= 0.4 THEN CASE best WHEN de THEN 'de' WHEN en THEN 'en' WHEN es THEN 'es' ELSE 'fr' END ELSE lang END AS language,
           round(CASE WHEN share >= 0.4 THEN share ELSE 0.9 END, 6) AS confidence FROM r
    """,
)
def lang_indicator(spark, sf_dir):
    lang, confidence = tx.detect_language(F.col("text"), tx.LANGUAGE_WORDS, 0.4, F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", lang.alias("language"), F.round(confidence, 6).alias("confidence"))


@query(
    "clean_lines",
    """
    SELECT doc_id, array_to_string(list_filter(list_filter(string_split(text, chr(10)), lambda x: NOT contains(lower(x), 'licensed under') AND NOT starts_with(x, 'The ')),
           lambda x: NOT regexp_matches(x, '(?i)(?:^|[^a-zA-Z])(?:worthless|apache)(?:[^a-zA-Z]|$)')), chr(10)) AS body FROM documents
    """,
)
def clean_lines(spark, sf_dir):
    kept = tx.filter_lines(F.col("text"), prefixes=("The ",), contains=("licensed under",))
    return table(spark, sf_dir, "documents").select("doc_id", tx.remove_boilerplate(kept, ("worthless", "apache")).alias("body"))


@query(
    "block_filter",
    r"SELECT page_id, array_to_string(list_filter(string_split_regex(replace(html, '</p>', chr(10) || chr(10)), '\n\s*\n'), lambda b: NOT contains(b, 'track(') AND NOT contains(b, '<nav>')), chr(10) || chr(10)) AS body FROM pages",
)
def block_filter(spark, sf_dir):
    parts = F.replace(F.col("html"), F.lit("</p>"), F.lit("\n\n"))
    return table(spark, sf_dir, "pages").select("page_id", tx.remove_blocks(parts, ("track(", "<nav>")).alias("body"))


@query(
    "marker_extract",
    """
    WITH b AS (SELECT page_id, html, CASE WHEN instr(html, '<main>') > 0 THEN instr(html, '<main>') + 6 WHEN instr(html, '<article>') > 0 THEN instr(html, '<article>') + 9 END AS s FROM pages),
    r AS (SELECT page_id, CASE WHEN s IS NOT NULL THEN substr(html, s) END AS rest FROM b)
    SELECT page_id, CASE WHEN instr(rest, '</main>') > 0 THEN left(rest, instr(rest, '</main>') - 1) WHEN instr(rest, '</article>') > 0 THEN left(rest, instr(rest, '</article>') - 1) ELSE rest END AS body FROM r
    """,
)
def marker_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.between_markers(F.col("html"), ("<main>", "<article>"), ("</main>", "</article>")).alias("body"))


@query(
    "link_strip",
    r"""SELECT doc_id, regexp_replace(regexp_replace('![i](u) [' || left(text, 40) || '](http://x) ' || text, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g') AS body FROM documents""",
)
def link_strip(spark, sf_dir):
    shown = F.concat(F.lit("![i](u) ["), F.substring("text", 1, 40), F.lit("](http://x) "), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.strip_links(shown).alias("body"))


@query(
    "control_chars",
    r"""SELECT doc_id, replace(replace(regexp_replace(replace(replace(chr(8203) || chr(7) || text, chr(10), '<<n>>'), chr(9), '<<t>>'), '[\p{Cc}\p{Cf}]', '', 'g'), '<<n>>', chr(10)), '<<t>>', chr(9)) AS body FROM documents""",
)
def control_chars(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.remove_control(F.concat(F.lit("​\x07"), F.col("text"))).alias("body"))


@query(
    "mojibake_repair",
    """
    WITH b AS (SELECT doc_id, replace(replace(text, 'ü', 'Ã¼'), 'é', 'Ã©') AS bad FROM documents)
    SELECT doc_id, replace(replace(bad, 'Ã¼', 'ü'), 'Ã©', 'é') AS body, ((length(bad) - length(replace(bad, 'Ã¼', ''))) // 2 + (length(bad) - length(replace(bad, 'Ã©', ''))) // 2)::BIGINT AS repairs FROM b
    """,
)
def mojibake_repair(spark, sf_dir):
    pairs = (("Ã¼", "ü"), ("Ã©", "é"))
    bad = tx.replace_all(F.col("text"), [(good, wrong) for wrong, good in pairs])
    counted = tx.occurrences(F.col("bad"), "Ã¼") + tx.occurrences(F.col("bad"), "Ã©")
    return table(spark, sf_dir, "documents").select("doc_id", bad.alias("bad")).select("doc_id", tx.replace_all(F.col("bad"), pairs).alias("body"), counted.alias("repairs"))


@query(
    "token_estimate",
    r"""
    WITH d AS (SELECT doc_id, length(text)::DOUBLE AS n, length(regexp_replace(text, '[\p{L}\s]', '', 'g')) / greatest(length(text), 1)::DOUBLE AS dense,
        list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS ws FROM documents),
    c AS (SELECT *, coalesce(list_sum(list_transform(ws, lambda w: CASE WHEN length(w) <= 4 THEN 1.0::DOUBLE WHEN length(w) <= 10 THEN 1.5::DOUBLE ELSE length(w) / 4.0::DOUBLE END)), 0) AS cost FROM d)
    SELECT doc_id, (length(text_) + 3) // 4 AS simple, ceil(greatest(n / CASE WHEN dense > 0.2 THEN 3.0::DOUBLE WHEN dense > 0.1 THEN 3.3::DOUBLE ELSE 3.6::DOUBLE END, cost) * CASE WHEN dense > 0.1 THEN 1.12::DOUBLE ELSE 1.08::DOUBLE END)::BIGINT AS tokens
    FROM c JOIN (SELECT doc_id AS i, text AS text_ FROM documents) ON i = doc_id
    """,
)
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.ceil(F.length("text") / 4).alias("simple"), tx.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


@query("title_normalize", r"SELECT doc_id, trim(regexp_replace(regexp_replace('## ' || split_part(text, chr(10), 1), '^#+\s*', ''), '\s+', ' ', 'g')) AS title FROM documents")
def title_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.strip_heading(F.concat(F.lit("## "), F.split("text", "\n", 2)[0])).alias("title"))


_FORMATS = ("yyyy-MM-dd", "dd.MM.yyyy", "d MMMM yyyy", "MMMM d, yyyy")


@query(
    "date_formats",
    """
    SELECT o_orderkey, o_orderdate::DATE AS parsed, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso,
           CASE WHEN o_orderkey % 4 < 2 THEN 'day' ELSE 'month' END AS granularity FROM orders
    """,
)
def date_formats(spark, sf_dir):
    d = F.col("o_orderdate")
    german = tx.replace_all(F.date_format(d, "d MMMM yyyy"), [(en, de) for de, en in tx.GERMAN_MONTHS])
    shown = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format(d, "dd.MM.yyyy")).when(F.col("o_orderkey") % 4 == 2, german).otherwise(F.date_format(d, "MMMM d, yyyy"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("s"))
    return rows.select("o_orderkey", tx.parse_date(F.col("s"), _FORMATS).alias("parsed"), tx.date_to_iso(F.col("s")).alias("iso"), tx.granularity(F.col("s")).alias("granularity"))


@query(
    "numeric_cells",
    """
    WITH c AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS v, (ARRAY['EUR', 'kg', '%'])[1 + l_linenumber % 3] AS unit FROM lineitem)
    SELECT l_orderkey, l_linenumber, v AS number, unit, CASE unit WHEN 'EUR' THEN 'money' WHEN 'kg' THEN 'mass' ELSE 'share' END AS category,
           CASE unit WHEN 'EUR' THEN v BETWEEN 0 AND 50000 WHEN 'kg' THEN v BETWEEN 0 AND 10000 ELSE v BETWEEN 0 AND 100 END AS valid FROM c
    """,
)
def numeric_cells(spark, sf_dir):
    unit = F.element_at(F.array(F.lit("EUR"), F.lit("kg"), F.lit("%")), 1 + F.col("l_linenumber") % 3)
    cell = F.concat(F.replace(F.format_string("%.2f", F.col("l_extendedprice")), F.lit("."), F.lit(",")), F.lit(" "), unit)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cell.alias("cell"))
    rows = rows.select("l_orderkey", "l_linenumber", tx.parse_number(F.col("cell")).alias("number"), tx.unit_of(F.col("cell")).alias("unit"))
    units = spark.createDataFrame([("EUR", "money", 0.0, 50000.0), ("kg", "mass", 0.0, 10000.0), ("%", "share", 0.0, 100.0)], "unit string, category string, low double, high double")
    joined = rows.join(F.broadcast(units), "unit", "left")  # three rows
    return joined.select("l_orderkey", "l_linenumber", "number", "unit", "category", F.coalesce(F.col("number").between(F.col("low"), F.col("high")), F.lit(True)).alias("valid"))


@query(
    "pii_mask",
    r"""
    WITH m AS (SELECT doc_id, text, list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS found FROM documents)
    SELECT doc_id, len(found)::BIGINT AS addresses, regexp_matches(text, '@') AS marked FROM m
    """,
)
def pii_mask(spark, sf_dir):
    pattern = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    masked = tx.mask_numbered(F.col("text"), pattern, "EMAIL")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", masked.alias("masked"))
    return rows.select("doc_id", F.size(F.array_distinct(F.regexp_extract_all("masked", F.lit(r"\[EMAIL_\d+\]"), F.lit(0)))).cast("long").alias("addresses"), F.col("text").contains("@").alias("marked"))


@query(
    "row_ids",
    """SELECT doc_id, sha256(concat_ws('|', source, doc_id::VARCHAR, coalesce(nullif(lang, 'en'), ''))) AS document_id, sha256(to_json({'a': doc_id, 'b': lang})::VARCHAR) AS cache_key,
              round(((n_chars + 3) // 4) / 1e6 * 2.5, 9) AS cost FROM documents""",
)
def row_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", sid("source", "doc_id", F.nullif(F.col("lang"), F.lit("en"))).alias("document_id"),
        F.sha2(F.to_json(F.struct(F.col("doc_id").alias("a"), F.col("lang").alias("b"))), 256).alias("cache_key"),
        F.round(F.ceil(F.col("n_chars") / 4) / 1e6 * 2.5, 9).alias("cost"),
    )


@query(
    "json_props",
    """SELECT event_id, json_valid(props) AS valid, json_extract_string(props, '$.ref') AS ref, len(json_keys(props))::BIGINT AS fields FROM events""",
)
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").isNotNull().alias("valid"), F.get_json_object("props", "$.ref").alias("ref"), F.size(F.json_object_keys("props")).cast("long").alias("fields"))


@query(
    "template_keys",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'customer:n=' || c_nationkey ELSE c_mktsegment || '/' || c_nationkey END AS canonical_key,
              upper(array_to_string(list_transform(list_filter(string_split_regex(n_name, '\\s+'), lambda w: w <> ''), lambda w: w[1]), '')) AS acronym,
              translate(lower(trim(c_name)), '.,;:!?''"()[]-_/&#', '') AS cleaned FROM customer JOIN nation ON c_nationkey = n_nationkey""".replace("\\\\s", "\\s"),
)
def template_keys(spark, sf_dir):
    segment = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        "c_custkey", tx.fill_template(F.lit("customer"), "{s}/{n}", {"s": segment, "n": F.col("c_nationkey").cast("string")}).alias("canonical_key"),
        tx.acronym(F.col("n_name")).alias("acronym"), F.replace(tx.clean_name(F.col("c_name")), F.lit("#"), F.lit("")).alias("cleaned"),
    )


@query("publication_scan", "SELECT doc_id, source, length(text)::BIGINT AS length_chars, octet_length(encode(text))::BIGINT AS length_bytes, split_part(text, chr(10), 1) AS title FROM documents WHERE lang = 'de'")
def publication_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter("lang = 'de'")
    return rows.select("doc_id", "source", F.length("text").cast("long").alias("length_chars"), F.octet_length("text").cast("long").alias("length_bytes"), F.split("text", "\n", 2)[0].alias("title"))
