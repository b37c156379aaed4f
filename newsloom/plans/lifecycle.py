"""Queries over work sets, retention, validation, graphs and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom.catalog import query, table
from newsloom.operators import events as ev
from newsloom.operators import graph
from newsloom.operators import lifecycle as lc


@query(
    "work_set",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
)
def work_set(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    status = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("ok").alias("status"))
    ready = orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ok").alias("status"))
    return lc.work_set(orders.select("o_orderkey"), status, ready, "o_orderkey")


@query(
    "status_merge",
    """WITH o AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'failed' ELSE 'blocked' END AS status, 1 AS attempt FROM orders WHERE o_orderdate < DATE '1998-01-01'), n AS (SELECT DISTINCT l_orderkey AS k, 'ok' AS s FROM lineitem WHERE l_returnflag = 'R')
    SELECT coalesce(o.k, n.k) AS o_orderkey, CASE WHEN o.status = 'ok' OR s IS NULL THEN status ELSE s END AS status, CASE WHEN o.status = 'ok' OR s IS NULL THEN attempt ELSE coalesce(attempt, 0) + 1 END AS attempt FROM o FULL JOIN n ON o.k = n.k""",
)
def status_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    old = orders.filter("o_orderdate < DATE '1998-01-01'").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "failed").otherwise("blocked").alias("status"), F.lit(1).alias("attempt"))
    return lc.merge_status(old, table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("ok").alias("status")).distinct(), "o_orderkey")


@query(
    "upsert_publications",
    "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' OR c_acctbal < 0 THEN lower(c_name) ELSE c_name END AS name, CASE WHEN c_mktsegment = 'BUILDING' OR c_acctbal < 0 THEN 'new' ELSE 'old' END AS version FROM customer",
)
def upsert_publications(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    old = rows.filter("c_mktsegment <> 'BUILDING'").select("c_custkey", F.col("c_name").alias("name"), F.lit("old").alias("version"))
    new = rows.filter("c_mktsegment = 'BUILDING' OR c_acctbal < 0").select("c_custkey", F.lower("c_name").alias("name"), F.lit("new").alias("version"))
    return lc.upsert(old, new, "c_custkey", overwrite=True)


@query("natural_key_dedup", "SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def natural_key_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.sha2("text", 256).alias("_h"))
    return lc.keep_largest(rows, ["_h"], "n_chars", "doc_id").select("doc_id", "source", "lang")


@query(
    "quality_gates",
    "SELECT doc_id, CASE WHEN length(text) < 200 AND (length(text) + 3) // 4 < 40 THEN 'trivial' WHEN contains(text, '|') THEN 'table' WHEN length(text) < 400 THEN 'short' ELSE 'ok' END AS gate FROM documents",
)
def quality_gates(spark, sf_dir):
    n = F.length("text")
    gate = F.when((n < 200) & (F.ceil(n / 4) < 40), "trivial").when(F.col("text").contains("|"), "table").when(n < 400, "short").otherwise("ok")
    return table(spark, sf_dir, "documents").select("doc_id", gate.alias("gate"))


@query(
    "preflight_delta",
    "SELECT s.n_name AS publisher, count(*) AS expected, count(o.o_custkey) AS known, count(*) - count(o.o_custkey) AS fresh FROM customer JOIN nation s ON c_nationkey = n_nationkey LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON o.o_custkey = c_custkey GROUP BY 1",
)
def preflight_delta(spark, sf_dir):
    known = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("k", F.lit(1))
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(known, "c_custkey", "left")
    return rows.groupBy(F.col("n_name").alias("publisher")).agg(F.count("*").alias("expected"), F.count("k").alias("known"), (F.count("*") - F.count("k")).alias("fresh"))


@query(
    "retention_runs",
    """WITH r AS (SELECT ts::DATE AS run, count(*) AS n, row_number() OVER (ORDER BY ts::DATE DESC) AS rn, lag(ts::DATE) OVER (ORDER BY ts::DATE) AS previous FROM events GROUP BY 1)
    SELECT event_id, run, previous FROM events JOIN r ON ts::DATE = run WHERE rn <= 5""",
)
def retention_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("run"))
    # Days are few, so one window over them is small; events are joined, not windowed.
    days = rows.groupBy("run").agg(F.count("*").alias("n"))
    ranked = days.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("run")))).withColumn("previous", F.lag("run").over(Window.orderBy("run")))
    return rows.join(ranked.filter("rn <= 5").select("run", "previous"), "run").select("event_id", "run", "previous")


@query(
    "docs_all_eligible",
    """WITH m AS (SELECT o_custkey, list(o_orderkey) AS orders FROM orders GROUP BY 1), e AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 30000)
    SELECT o_custkey FROM m WHERE len(list_filter(orders, lambda x: x NOT IN (SELECT o_orderkey FROM e))) = 0""".replace("SELECT o_custkey FROM m WHERE len(list_filter(orders, lambda x: x NOT IN (SELECT o_orderkey FROM e))) = 0", "SELECT o_custkey FROM orders GROUP BY 1 HAVING bool_and(o_totalprice > 30000)"),
)
def docs_all_eligible(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    sets = orders.groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("orders"))
    return lc.all_eligible(sets, "o_custkey", "orders", orders.filter("o_totalprice > 30000").select(F.col("o_orderkey").alias("member"))).select("o_custkey")


@query("stages_complete", "SELECT user_id FROM events WHERE value > 5 GROUP BY user_id HAVING count(DISTINCT event_type) = 5")
def stages_complete(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("stage"), F.when(F.col("value") > 5, "ok").otherwise("failed").alias("status"))
    return lc.stages_complete(rows, "user_id", 5)


@query(
    "validate_linkage",
    """SELECT 'orders_without_customer' AS check_name, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS violations, (SELECT count(*) FROM orders) AS total
    UNION ALL SELECT 'lines_without_order', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)), (SELECT count(*) FROM lineitem)
    UNION ALL SELECT 'customers_without_orders', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)), (SELECT count(*) FROM customer)
    UNION ALL SELECT 'labels_without_document', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)), (SELECT count(*) FROM labels)""",
)
def validate_linkage(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    parts = []
    for name, rows, column, target, target_column in (
        ("orders_without_customer", "orders", "o_custkey", "customer", "c_custkey"),
        ("lines_without_order", "lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("customers_without_orders", "customer", "c_custkey", "orders", "o_custkey"),
        ("labels_without_document", "labels", "doc_id", "documents", "doc_id"),
    ):
        checked = lc.reference_counts(t(rows), column, t(target), target_column)
        parts.append(checked.select(F.lit(name).alias("check_name"), "violations", "total"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "table_audit",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")),
)
def table_audit(spark, sf_dir):
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")
    parts = [table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("trace_samples", "SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS samples FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 20 GROUP BY 1")
def trace_samples(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id")
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("r <= 20")
    return first.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("samples"))


@query(
    "export_totals",
    """SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, count(l_linenumber) AS lines, count(*) FILTER (l_returnflag = 'R') AS returned, round(coalesce(sum(l_quantity), 0), 2) AS quantity
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def export_totals(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.sum("l_quantity").alias("quantity"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    sums = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), *(F.sum(c).alias(c) for c in ("lines", "returned", "quantity")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return table(spark, sf_dir, "customer").select("c_custkey").join(sums, "c_custkey", "left").select("c_custkey", zero("orders"), zero("lines"), zero("returned"), F.round(F.coalesce("quantity", F.lit(0.0)), 2).alias("quantity"))


_STATE = """f AS (SELECT event_id AS id, user_id AS subject, (value * 100)::BIGINT % 50 AS object, CASE WHEN event_type IN ('click', 'view') THEN 'visit' ELSE 'act' END AS g, CASE WHEN event_type IN ('signup', 'purchase') THEN 'STATE' ELSE 'EVENT' END AS kind,
    ts AS valid_at, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 2 DAY END AS invalid_at, CASE WHEN value < 100 THEN 'LOW' ELSE 'HIGH' END AS conf FROM events)"""


def _facts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("subject"), (F.round(F.col("value") * 100).cast("long") % 50).alias("object"), F.when(F.col("event_type").isin("click", "view"), "visit").otherwise("act").alias("group"),
        F.when(F.col("event_type").isin("signup", "purchase"), "STATE").otherwise("EVENT").alias("kind"), F.col("ts").alias("valid_at"),
        F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("invalid_at"), F.when(F.col("value") < 100, "LOW").otherwise("HIGH").alias("conf"),
    )


_CANDIDATES = f"""{_STATE}, c AS (SELECT n.id AS a, f.id AS b, n.valid_at AS a_at, f.valid_at AS b_at FROM f n JOIN f ON n.g = f.g AND (n.subject = f.subject OR n.object = f.object) AND n.id <> f.id
    WHERE ((f.kind = 'STATE' AND f.valid_at <= coalesce(n.invalid_at, n.valid_at) AND coalesce(f.invalid_at, TIMESTAMP '9999-12-31') >= n.valid_at) OR (f.kind = 'EVENT' AND n.valid_at <> coalesce(n.invalid_at, n.valid_at) AND f.valid_at BETWEEN n.valid_at AND coalesce(n.invalid_at, n.valid_at)))
      AND NOT (n.conf = 'LOW' AND f.conf = 'LOW' AND n.valid_at = f.valid_at) AND NOT (n.conf = 'HIGH' AND f.conf = 'LOW' AND date_diff('day', n.valid_at, f.valid_at) > 30))"""


def _candidates(spark, sf_dir):
    """Every fact as an incoming one. The tests on times run in the joins, which have no pair in common, so the many pairs are never listed to be made distinct."""
    facts = _facts(spark, sf_dir)
    x = facts.select(F.col("id").alias("a"), F.col("subject").alias("s1"), F.col("object").alias("o1"), F.col("group").alias("g1"), F.col("valid_at").alias("at"), F.coalesce("invalid_at", "valid_at").alias("until"), F.col("conf").alias("ac"))
    y = facts.withColumnRenamed("id", "b")
    fits = graph.overlaps(F.col("kind"), F.col("valid_at"), F.col("invalid_at"), F.col("at"), F.col("until")) & graph.worth_considering(F.col("ac"), F.col("at"), F.col("conf"), F.col("valid_at"))
    group, subject = F.col("g1") == F.col("group"), F.col("s1") == F.col("subject")
    one = x.join(y, group & subject & (F.col("a") != F.col("b")) & fits)
    two = x.join(y, group & (F.col("o1") == F.col("object")) & ~F.coalesce(subject, F.lit(False)) & (F.col("a") != F.col("b")) & fits)
    return one.unionByName(two)


@query("invalidation_candidates", f"WITH {_CANDIDATES} SELECT a, b FROM c")
def invalidation_candidates(spark, sf_dir):
    """Every fact is an incoming one."""
    return _candidates(spark, sf_dir).select("a", "b")


@query("earliest_invalidation", f"WITH {_CANDIDATES} SELECT b AS event_id, min(a_at) AS invalid_at, first(a ORDER BY a_at, a) AS invalidated_by FROM c WHERE a_at >= b_at GROUP BY b")
def earliest_invalidation(spark, sf_dir):
    """The earliest of all invalidating facts."""
    return graph.first_later(_facts(spark, sf_dir)).withColumnRenamed("event", "event_id")


@query(
    "temporal_ranges",
    """WITH k AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'ATEMPORAL' ELSE 'STATE' END AS kind, CASE WHEN l_linenumber % 3 <> 0 THEN l_shipdate END AS v, l_shipdate + (INTERVAL 1 DAY) * (l_linenumber - 3) AS i, o_orderdate AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    b AS (SELECT *, CASE WHEN kind <> 'ATEMPORAL' THEN coalesce(v, p) END AS valid_at FROM k)
    SELECT l_orderkey, l_linenumber, valid_at, CASE WHEN kind <> 'ATEMPORAL' AND i >= valid_at THEN i END AS invalid_at, CASE WHEN v IS NULL THEN 'LOW' ELSE 'HIGH' END AS confidence FROM b""",
)
def temporal_ranges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("l_returnflag") == "A", "ATEMPORAL").otherwise("STATE")
    valid = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_shipdate"))
    begin, end, sure = graph.temporal_range(kind, valid, F.col("l_shipdate") + F.make_dt_interval(days=F.col("l_linenumber") - 3), F.col("o_orderdate"))
    return rows.select("l_orderkey", "l_linenumber", begin.alias("valid_at"), end.alias("invalid_at"), sure.alias("confidence"))


_EDGES = "t AS (SELECT l_suppkey AS subject, CASE WHEN l_linenumber < 7 THEN l_partkey END AS object, l_returnflag AS predicate, l_orderkey * 10 + l_linenumber AS id FROM lineitem), e AS (SELECT subject, coalesce(object, subject) AS object, predicate, max(id) AS id FROM t GROUP BY ALL)"


@query("graph_edges", f"WITH {_EDGES} SELECT subject, object, predicate, id FROM e")
def graph_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


def _edges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), F.when(F.col("l_linenumber") < 7, F.col("l_partkey")).alias("object"), F.col("l_returnflag").alias("predicate"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return graph.edges(rows, ["id"])


@query(
    "graph_stats",
    f"WITH {_EDGES}, n AS (SELECT unnest([subject, object]) AS n FROM e), d AS (SELECT n, count(*) AS d FROM n GROUP BY 1) SELECT count(*) AS nodes, (sum(d) // 2)::BIGINT AS edges, round(sum(d) / 2 / (count(*) * (count(*) - 1)), 6) AS density, min(d) AS low, max(d) AS high, round(avg(d), 6) AS mean FROM d",
)
def graph_stats(spark, sf_dir):
    return graph.degree_stats(_edges(spark, sf_dir))


@query(
    "eval_prf",
    """WITH p AS (SELECT l.toxic, regexp_matches(lower(text), '\\b(idiot|loser|pathetic|clown|moron|scum|worthless|trash|disgusting|stupid)\\b')::INT AS guess FROM labels l JOIN documents USING (doc_id)),
    c AS (SELECT count(*) FILTER (guess = 1 AND toxic = 1) AS tp, count(*) FILTER (guess = 1 AND toxic = 0) AS fp, count(*) FILTER (guess = 0 AND toxic = 1) AS fn, count(*) AS n FROM p)
    SELECT tp, fp, fn, n, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""".replace("\\\\b", "\\b"),
)
def eval_prf(spark, sf_dir):
    from newsloom.operators.evaluation import counts, scores

    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    guess = F.lower("text").rlike(r"\b(idiot|loser|pathetic|clown|moron|scum|worthless|trash|disgusting|stupid)\b")
    return scores(counts(rows, guess, F.col("toxic") == 1))


@query(
    "temporal_accuracy",
    "SELECT l_returnflag, count(*) AS n, round(avg((date_diff('day', o_orderdate::DATE, l_shipdate::DATE) = 0)::INT), 6) AS exact, round(avg((abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) <= 1)::INT), 6) AS near FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
)
def temporal_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    gap = F.datediff("l_shipdate", "o_orderdate")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg((gap == 0).cast("int")), 6).alias("exact"), F.round(F.avg((F.abs(gap) <= 1).cast("int")), 6).alias("near"))


@query(
    "response_cache",
    "SELECT e.event_id, c.event_id AS cached, c.event_id IS NOT NULL AS hit FROM events e LEFT JOIN (SELECT event_type || round(value)::BIGINT AS k, min(event_id) AS event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1) c ON e.event_type || round(e.value)::BIGINT = c.k",
)
def response_cache(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.concat("event_type", F.round("value").cast("long").cast("string")).alias("k"))
    live = rows.filter(F.col("ts") >= F.lit("2024-01-15").cast("timestamp")).groupBy("k").agg(F.min("event_id").alias("cached"))
    return rows.join(live, "k", "left").select("event_id", "cached", F.col("cached").isNotNull().alias("hit"))


@query(
    "set_differences",
    "SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers_only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)",
)
def set_differences(spark, sf_dir):
    t = lambda n, c: table(spark, sf_dir, n).select(F.col(c).alias("k"))
    count = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    a, b = t("customer", "c_nationkey"), t("supplier", "s_nationkey")
    return count("both", a.intersect(b)).unionByName(count("customers_only", t("customer", "c_custkey").subtract(t("orders", "o_custkey")))).unionByName(count("either", a.union(b).distinct()))


@query("rollup_report", "SELECT n_name, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, o_orderpriority)")
def rollup_report(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("n_name", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("first_publications", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_publications(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return ev.first_rows(rows, ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"])
