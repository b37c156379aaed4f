"""Sources, sinks and streams."""

import datetime
import os

from newsloom.operators import graph  # noqa: F401
from newsloom.sources import publications as pub
from newsloom.streaming import alerts


def test_publications(spark, tmp_path):
    at = datetime.datetime(2024, 1, 2)
    rows = [("http://a", "A", at, at, "de", "Grüße"), ("http://b", "B", at + datetime.timedelta(1), at, "en", ""), (None, "C", at, at, "en", "x")]
    df = spark.createDataFrame(rows, "url string, title string, published_on timestamp, added_on timestamp, language string, text string")
    pub.to_publications(df).write.parquet(str(tmp_path / "p"))
    got = pub.read_publications(spark, str(tmp_path / "p"), latest_first=True).collect()
    assert [(r.title, r.text) for r in got] == [("B", ""), ("A", "Grüße")]
    assert pub.find_publication(spark, str(tmp_path / "p"), got[1].id).first().title == "A"
    assert pub.config_version({"a": 1, "b": [2]}) == pub.config_version({"b": [2], "a": 1})


def test_markdown_and_mappings(spark, tmp_path):
    df = spark.createDataFrame([(1, "A / b", "x"), (2, None, None)], "k int, title string, text string")
    assert pub.write_markdown(df, "file://" + str(tmp_path / "md"), key="k", title="title", text="text") == 2
    assert sorted(os.listdir(tmp_path / "md")) == ["A_b-1.md", "untitled-2.md"]
    (tmp_path / "m.txt").write_text("# note\nÃ¼ -> ü\nÃ©\té\n\nbroken\n")
    assert [(r.bad, r.good) for r in pub.read_mappings(spark, str(tmp_path / "m.txt")).orderBy("line").collect()] == [("Ã¼", "ü"), ("Ã©", "é")]


def test_catalogue_is_replaced_by_run(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    for run, rows in (("a", df), ("b", df), ("a", df.limit(1))):
        pub.write_catalogue(rows, str(tmp_path), run)
    got = spark.read.parquet(str(tmp_path / "catalogue")).groupBy("run").count().collect()
    assert sorted(map(tuple, got)) == [("a", 1), ("b", 2)]


def test_ingestion_is_idempotent(spark, tmp_path):
    source = tmp_path / "in"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.limit(50).coalesce(1).write.parquet(str(source))
    for _ in range(2):
        alerts.ingest(alerts.event_stream(spark, str(source)), str(tmp_path / "out"), "event_id", str(tmp_path / "c")).awaitTermination()
    events.limit(80).coalesce(1).write.mode("append").parquet(str(source))
    alerts.ingest(alerts.event_stream(spark, str(source)), str(tmp_path / "out"), "event_id", str(tmp_path / "c")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("event_id").distinct().count() == 80


def test_alert_stream(spark, tmp_path):
    rows = alerts.alerts(alerts.event_stream(spark, "/root/testdata/sf0.001", "events.parquet"), graph.F.col("event_type") == "error", ["user_id"], "30 days")
    q = rows.writeStream.format("memory").queryName("alerts_once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("alerts_once")
    assert got.count() == got.select("user_id").distinct().count() > 0
