"""Queries over events, metrics, rules, timelines and classifications."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom.catalog import query, table
from newsloom.ids import sid
from newsloom.operators import events as ev
from newsloom.operators import rules, taxonomy

_TOPICS = {"energy": (("the", "of"), ("and",)), "market": (("der", "die"), ("und",)), "policy": (("les", "des"), ("pour",)), "society": (("los", "que"), ("una",))}


def _scores(k):
    high, medium = _TOPICS[k]
    both = lambda ws: " + ".join(rf"regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_]){w}([^\p{{L}}\p{{N}}_]|$)')::INT" for w in ws)
    return f"({both(high)}) AS {k}_h, ({both(medium)}) AS {k}_m"


_KEYWORD_SQL = (
    f"WITH h AS (SELECT doc_id, source, {', '.join(map(_scores, _TOPICS))} FROM documents), s AS ("
    + " UNION ALL ".join(f"SELECT doc_id, source, '{k}' AS topic, {k}_h + {k}_m AS n, 0.3::DOUBLE * {k}_h + 0.15::DOUBLE * {k}_m + CASE WHEN {k}_h + {k}_m >= 2 THEN 0.1 ELSE 0 END AS score FROM h" for k in _TOPICS)
    + "), c AS (SELECT doc_id, topic, n, score, greatest(0, least(1, 0.1 + least(score, 0.6) + CASE WHEN source IN ('src1', 'src2') THEN 0.05 ELSE 0 END)) AS confidence FROM s WHERE n > 0)"
)


def _keyword_rows(spark, sf_dir):
    # Each text is split once; the topics look into its words.
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", taxonomy.distinct_words(F.col("text")).alias("words"))
    hits = F.array(*(F.struct(F.lit(topic).alias("topic"), taxonomy.hits(F.col("words"), high).alias("h"), taxonomy.hits(F.col("words"), medium).alias("m")) for topic, (high, medium) in _TOPICS.items()))
    rows = docs.select("doc_id", "source", F.explode(F.filter(hits, lambda t: t["h"] + t["m"] > 0)).alias("t")).select("doc_id", "source", "t.*")
    score, n = taxonomy.keyword_score(F.col("h"), F.col("m"))
    prior = F.when(F.col("source").isin("src1", "src2"), 0.05).otherwise(0.0)
    return rows.select("doc_id", "topic", n.alias("n"), score.alias("score"), taxonomy.confidence(0.1, (score, prior), (0.6, 0.05)).alias("confidence"))


@query("keyword_scores", f"{_KEYWORD_SQL} SELECT doc_id, topic, n::INT AS n, round(score, 6) AS score, round(confidence, 6) AS confidence FROM c")
def keyword_scores(spark, sf_dir):
    return _keyword_rows(spark, sf_dir).select("doc_id", "topic", "n", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


@query(
    "topic_rank",
    f"""{_KEYWORD_SQL}, r AS (SELECT doc_id, topic, round(confidence, 6) AS confidence, row_number() OVER w AS rank, round(round(confidence, 6) - coalesce(lead(round(confidence, 6)) OVER w, 0), 6) AS gap FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY round(confidence, 6) DESC, topic))
    SELECT doc_id, topic, confidence, rank::INT AS rank, gap FROM r WHERE rank = 1 OR (rank <= 2 AND confidence >= 0.3)""",
)
def topic_rank(spark, sf_dir):
    rows = _keyword_rows(spark, sf_dir).select("doc_id", "topic", F.round("confidence", 6).alias("confidence"))
    return taxonomy.ranked(rows, "doc_id", "topic", "confidence").withColumn("gap", F.round("gap", 6))


@query("evidence_span", """SELECT doc_id, (greatest(instr(lower(text), 'version') - 81, 0))::BIGINT AS start, least(instr(lower(text), 'version') + 86, length(text))::BIGINT AS "end" FROM documents WHERE instr(lower(text), 'version') > 0""")
def evidence_span(spark, sf_dir):
    at = F.instr(F.lower("text"), "version")
    docs = table(spark, sf_dir, "documents").filter(at > 0)
    return docs.select("doc_id", F.greatest(at - 81, F.lit(0)).cast("long").alias("start"), F.least(at + 86, F.length("text")).cast("long").alias("end"))


@query(
    "trigger_detect",
    """WITH k(event_type, keyword) AS (VALUES ('licence', 'licensed under'), ('licence', 'apache'), ('insult', 'worthless'), ('contact', '@mail'))
    SELECT doc_id, event_type, count(*) AS triggers FROM documents JOIN k ON contains(lower(text), keyword) GROUP BY ALL""",
)
def trigger_detect(spark, sf_dir):
    triggers = {"licence": ("licensed under", "apache"), "insult": ("worthless",), "contact": ("@mail",)}
    lower = F.lower("text")
    counts = F.array(*(F.struct(F.lit(t).alias("event_type"), sum((lower.contains(k).cast("long") for k in ks), F.lit(0)).alias("triggers")) for t, ks in triggers.items()))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(counts).alias("t")).select("doc_id", "t.event_type", "t.triggers").filter("triggers > 0")


_REV = """r AS (SELECT event_id, user_id || ':' || event_type AS event, event_type, user_id, ts, value, ts::DATE AS day FROM events),
    n AS (SELECT *, row_number() OVER w AS revision_no, CASE WHEN row_number() OVER (PARTITION BY event, day ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS fresh FROM r WINDOW w AS (PARTITION BY event ORDER BY ts, event_id))"""


@query(
    "event_revisions",
    f"""WITH {_REV} SELECT event_id, event, revision_no::INT AS revision_no, sha256(event || '|' || revision_no) AS revision_id, CASE WHEN revision_no > 1 THEN sha256(event || '|' || (revision_no - 1)) END AS supersedes,
           (sum(fresh) OVER (PARTITION BY event ORDER BY ts, event_id))::BIGINT AS documents FROM n""",
)
def event_revisions(spark, sf_dir):
    return _revisions(spark, sf_dir).select("event_id", "event", "revision_no", "revision_id", "supersedes", "documents")


def _revisions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat_ws(":", "user_id", "event_type").alias("event"), "event_type", "user_id", "ts", "value", F.to_date("ts").alias("day"))
    return ev.revisions(rows, "event", ["ts", "event_id"], "day")


@query("current_revision", f"WITH {_REV} SELECT event, max(revision_no)::INT AS revision_no, max_by(event_id, revision_no) AS event_id, max_by(value, revision_no) AS value FROM n GROUP BY event")
def current_revision(spark, sf_dir):
    return ev.current(_revisions(spark, sf_dir), "event", "revision_no", "event_id", "value")


@query(
    "slot_fill",
    """SELECT user_id, event_type, round(0.6 * ((max(value) IS NOT NULL)::INT + (max(CASE WHEN value > 400 THEN 1 END) IS NOT NULL)::INT) / 2.0::DOUBLE + 0.4 * coalesce(avg(CASE WHEN value > 300 THEN value / 1000 END), 0.5), 6) AS confidence,
              CASE WHEN 0.6 * ((max(value) IS NOT NULL)::INT + (max(CASE WHEN value > 400 THEN 1 END) IS NOT NULL)::INT) / 2.0::DOUBLE + 0.4 * coalesce(avg(CASE WHEN value > 300 THEN value / 1000 END), 0.5) >= 0.7 THEN 'promoted' ELSE 'rejected' END AS status FROM events GROUP BY ALL""",
)
def slot_fill(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("a"), F.max(F.when(F.col("value") > 400, 1)).alias("b"), F.avg(F.when(F.col("value") > 300, F.col("value") / 1000)).alias("c"))
    got = ev.slot_confidence([F.col("a"), F.col("b")], F.col("c"))
    return rows.select("user_id", "event_type", F.round(got, 6).alias("confidence"), F.when(got >= 0.7, "promoted").otherwise("rejected").alias("status"))


@query(
    "metric_series",
    """WITH s AS (SELECT n_name AS geography, date_trunc('month', o_orderdate)::DATE AS period_start, count(*) AS points, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
    SELECT sha256('revenue|' || geography || '|month|USD') AS series_id, geography, period_start, points, total, lag(total) OVER (PARTITION BY geography ORDER BY period_start) AS previous FROM s""",
)
def metric_series(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    # Nations are joined to customers first, so that the large join carries three columns.
    places = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(places, F.col("o_custkey") == F.col("c_custkey"))
    value = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    series = ev.metric_series(rows, F.lit("revenue"), F.col("n_name"), F.lit("USD"), F.col("o_orderdate"), value)
    return series.select("series_id", "geography", "period_start", "points", F.round("total", 4).alias("total"), F.round("previous", 4).alias("previous"))


@query(
    "metric_dedup",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_returnflag ORDER BY (l_quantity IS NULL), l_shipdate, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1""",
)
def metric_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_shipdate")
    return ev.first_rows(rows, ["l_partkey", "l_suppkey", "l_returnflag"], [F.col("l_quantity").isNull(), "l_shipdate", "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


_ALERTS = """a AS (SELECT event_id, user_id, ts, value, event_type, 'big_purchase' AS rule_id, 24 AS hours FROM events WHERE event_type IN ('purchase') AND value > 300
    UNION ALL SELECT event_id, user_id, ts, value, event_type, 'any_error' AS rule_id, 6 AS hours FROM events WHERE event_type = 'error' AND (value < 20 OR user_id IN (1, 2, 3, 4)))"""


def _alerts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    big = rules.rule([rules.condition(F.col("value").cast("string"), "gt", "300")], "AND", event_type=F.col("event_type"), event_types=["purchase"])
    errors = rules.rule([rules.condition(F.col("value").cast("string"), "lt", "20"), rules.condition(F.col("user_id").cast("string"), "in", values=["1", "2", "3", "4"]), rules.condition(F.col("value"), "nonsense")], "OR", event_type=F.col("event_type"), event_types=["error"])
    matched = F.array_compact(F.array(F.when(big, F.struct(F.lit("big_purchase").alias("rule_id"), F.lit(24).alias("hours"))), F.when(errors, F.struct(F.lit("any_error").alias("rule_id"), F.lit(6).alias("hours")))))
    # All rules are tested in one scan; rows aren't multiplied by rules.
    return rows.select("*", F.explode(matched).alias("m")).select("event_id", "user_id", "ts", "value", "m.*")


@query("rule_matches", f"WITH {_ALERTS} SELECT event_id, rule_id FROM a")
def rule_matches(spark, sf_dir):
    return _alerts(spark, sf_dir).select("event_id", "rule_id")


@query(
    "rule_alerts",
    f"""WITH RECURSIVE {_ALERTS}, u AS (SELECT rule_id, user_id, ts, hours, min(event_id) AS event_id FROM a GROUP BY ALL),
    n AS MATERIALIZED (SELECT u.*, v.ts AS due, v.event_id AS following FROM (SELECT *, ts + hours * INTERVAL 1 HOUR AS until FROM u) u ASOF LEFT JOIN u v ON u.rule_id = v.rule_id AND u.user_id = v.user_id AND u.until < v.ts),
    k AS (SELECT rule_id, user_id, arg_min(event_id, ts) AS event_id FROM u GROUP BY ALL UNION ALL SELECT k.rule_id, k.user_id, n.following FROM k JOIN n ON n.event_id = k.event_id AND n.rule_id = k.rule_id WHERE n.following IS NOT NULL)
    SELECT event_id, rule_id, sha256(rule_id || '|' || event_id) AS alert_id FROM k""",
)
def rule_alerts(spark, sf_dir):
    found = _alerts(spark, sf_dir).select("rule_id", "user_id", "event_id", "ts", "hours")
    return ev.suppress(found, ["rule_id", "user_id"], "ts", "hours", ["event_id"]).select("event_id", "rule_id", sid("rule_id", "event_id").alias("alert_id"))


@query(
    "watchlist_alerts",
    """SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE (c_mktsegment IN ('BUILDING') OR o_orderpriority = '1-URGENT') AND o_orderstatus IN ('F', 'O') AND (c_nationkey % 2 = 0)""",
)
def watchlist_alerts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    parity = F.array(F.when(F.col("c_nationkey") % 2 == 0, "even").otherwise("odd"))
    spec = {"entities": ["BUILDING"], "publishers": ["1-URGENT"], "event_types": ["F", "O"], "topics": ["even"]}
    return rows.filter(rules.watchlist(F.array("c_mktsegment"), F.col("o_orderpriority"), F.col("o_orderstatus"), parity, spec)).select("o_orderkey")


@query(
    "digest_items",
    """WITH s AS (SELECT ts::DATE AS day, CASE WHEN event_type IN ('purchase', 'signup') THEN 'business' WHEN event_type = 'error' THEN 'problems' ELSE 'traffic' END AS section, value, event_id FROM events)
    SELECT day, section, count(*) AS items, max_by(event_id, (value, -event_id)) AS top_event FROM s GROUP BY ALL""".replace("max_by(event_id, (value, -event_id))", "first(event_id ORDER BY value DESC, event_id)"),
)
def digest_items(spark, sf_dir):
    section = F.when(F.col("event_type").isin("purchase", "signup"), "business").when(F.col("event_type") == "error", "problems").otherwise("traffic")
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), section.alias("section"), "value", "event_id")
    return rows.groupBy("day", "section").agg(F.count("*").alias("items"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("top_event"))


@query(
    "entity_timeline",
    """SELECT sha256('order|' || o_orderkey) AS item_id, o_custkey AS entity_id, 'order' AS kind, o_orderdate AS event_time FROM orders
    UNION ALL SELECT sha256('shipment|' || l_orderkey || '|' || l_linenumber), o_custkey, 'shipment', l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(l_shipdate) BETWEEN 1993 AND 1997""",
)
def entity_timeline(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").filter(F.year("l_shipdate").between(1993, 1997))
    placed = orders.select(sid(F.lit("order"), "o_orderkey").alias("item_id"), F.col("o_custkey").alias("entity_id"), F.lit("order").alias("kind"), F.col("o_orderdate").alias("event_time"))
    shipped = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(sid(F.lit("shipment"), "l_orderkey", "l_linenumber").alias("item_id"), F.col("o_custkey").alias("entity_id"), F.lit("shipment").alias("kind"), F.col("l_shipdate").alias("event_time"))
    return placed.unionByName(shipped)


@query(
    "entity_names",
    """WITH names AS (SELECT n_nationkey AS id, lower(n_name) AS name FROM nation UNION ALL SELECT n_nationkey, lower(left(n_name, 3)) FROM nation), m AS (SELECT name, min(id) AS id FROM names GROUP BY 1)
    SELECT c_custkey, coalesce(m.id::VARCHAR, 'unknown') AS entity_id FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN m ON lower(left(n_name, 2 + c_custkey % 2)) = m.name""",
)
def entity_names(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    names = nations.select(F.col("n_nationkey").alias("id"), F.explode(F.array(F.lower("n_name"), F.lower(F.substring("n_name", 1, 3)))).alias("name"))
    first = names.groupBy("name").agg(F.min("id").alias("id"))
    rows = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("c_custkey", F.lower(F.substring("n_name", F.lit(1), (2 + F.col("c_custkey") % 2).cast("int"))).alias("name"))
    return rows.join(first, "name", "left").select("c_custkey", F.coalesce(F.col("id").cast("string"), F.lit("unknown")).alias("entity_id"))


@query("date_spine", "WITH c AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), s AS (SELECT unnest(range(0, 14)) AS k, (SELECT max(day) FROM c) AS last) SELECT (last - k::INT)::DATE AS day, coalesce(n, 0) AS n FROM s LEFT JOIN c ON c.day = (last - k::INT)::DATE")
def date_spine(spark, sf_dir):
    return ev.date_spine(table(spark, sf_dir, "events"), "ts", 14)


@query(
    "prefer_language",
    """WITH g AS (SELECT doc_id, lang, doc_id // 3 AS day, count(*) OVER w AS n, count(*) FILTER (lang = 'de') OVER w AS de, count(*) FILTER (lang = 'en') OVER w AS en FROM documents WINDOW w AS (PARTITION BY doc_id // 3))
    SELECT doc_id FROM g WHERE CASE WHEN n = 2 AND de = 1 THEN lang = 'de' WHEN en > 0 THEN lang = 'en' ELSE true END""",
)
def prefer_language(spark, sf_dir):
    w = Window.partitionBy("day")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.floor(F.col("doc_id") / 3).alias("day"))
    rows = rows.withColumn("n", F.count("*").over(w)).withColumn("de", F.count_if(F.col("lang") == "de").over(w)).withColumn("en", F.count_if(F.col("lang") == "en").over(w))
    keep = F.when((F.col("n") == 2) & (F.col("de") == 1), F.col("lang") == "de").when(F.col("en") > 0, F.col("lang") == "en").otherwise(True)
    return rows.filter(keep).select("doc_id")


@query(
    "scrape_matrix",
    """SELECT ts::DATE AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1""",
)
def scrape_matrix(spark, sf_dir):
    kinds = ["click", "error", "purchase", "signup", "view"]
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).pivot("event_type", kinds).count().na.fill(0)


@query(
    "status_colours",
    """WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, day, n, CASE WHEN n = 0 THEN 'gray' WHEN n >= 70 THEN 'green' WHEN n >= 60 THEN 'yellow' ELSE 'red' END AS colour, coalesce(lag(n) OVER (PARTITION BY event_type ORDER BY day), 0) AS yesterday FROM d""",
)
def status_colours(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    colour = F.when(F.col("n") == 0, "gray").when(F.col("n") >= 70, "green").when(F.col("n") >= 60, "yellow").otherwise("red")
    return days.select("event_type", "day", "n", colour.alias("colour"), F.coalesce(F.lag("n").over(Window.partitionBy("event_type").orderBy("day")), F.lit(0)).alias("yesterday"))


@query(
    "turn_dump",
    "SELECT conv_id, count(*) AS turns, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS shape, max(CASE WHEN turn = 0 THEN role END) AS first_role FROM conversations GROUP BY conv_id",
)
def turn_dump(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    shape = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "n"))), lambda x: F.concat_ws(":", x["role"], x["n"])), ",")
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), shape.alias("shape"), F.max(F.when(F.col("turn") == 0, F.col("role"))).alias("first_role"))
