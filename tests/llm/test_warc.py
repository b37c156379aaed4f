import gzip
import hashlib

import pytest

from newsloom.llm import warc
from newsloom.llm.shared import fresh_dir


def rows():
    big = "x" * 2000 + "é"
    return [
        (1, "http://a/", big), (2, "http://b/", big), (9, "http://c/\r\nx%", big), (3, None, "small"), (4, "http://d/", "small"), (5, "http://e/", None), (6, "http://f/", ""),
        (7, "http://g/", "y" * 1000), (8, "http://h/", "z" * 999), (10, "http://i/", "z" * 999), (None, "http://n/", big), (7, "http://g/", "y" * 1000), (2, "http://b/", big),
    ]


def brute(data):
    top = {}
    for k, _, html in data:
        if len((html or "").encode()) >= 1000 and k is not None:
            top[html] = max(top.get(html, k), k)
    out = []
    for k, _, html in data:
        b = (html or "").encode()
        revisit = k is not None and html in top and top[html] != k
        out.append((k, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top[html] if revisit else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("parts", [1, 4])
def test_round_trip(spark, parts):
    df = spark.createDataFrame([(*r, "clash") for r in rows()], "page_id bigint, url string, html string, warc_type string").repartition(parts)
    got = warc.round_trip(df, keep_payload=True)
    flat = got.selectExpr("metadata.capture_id", "response.payload_bytes", "response.payload_digest", "response.warc_type", "metadata.refers_to").collect()
    assert sorted(str(tuple(r)) for r in flat) == brute(rows())
    payloads = {r.capture_id: r.payload for r in got.selectExpr("metadata.capture_id", "response.payload", "response.warc_type").collect() if r.warc_type == "response"}
    assert payloads[9].decode() == "x" * 2000 + "é" and payloads[5] == b""
    assert got.filter("request.target_uri <> response.target_uri OR request IS NULL").count() == 0
    named = {r.capture_id: r.target_uri for r in got.selectExpr("metadata.capture_id", "response.target_uri").collect()}
    assert named[9] == "http://c/\r\nx%" and named[3] == ""


def test_revisits_name_a_response(spark):
    df = spark.createDataFrame(rows(), "page_id bigint, url string, html string").repartition(3)
    got = warc.round_trip(df).cache()
    refs = got.filter("response.warc_type = 'revisit'").selectExpr("response.refers_to_id AS record_id").distinct()
    assert refs.join(got.filter("response.warc_type = 'response'"), "record_id", "left_anti").count() == 0 and refs.count() == 1


def test_files_are_plain_gzip(spark, tmp_path):
    folder = "file://" + str(tmp_path / "w")
    df = spark.createDataFrame(rows()[:3], "page_id bigint, url string, html string").coalesce(1)
    assert warc.write_archives(warc.plan_captures(df), folder) == 3
    raw = gzip.decompress((tmp_path / "w/part-00000.warc.gz").read_bytes())
    assert raw.count(b"WARC/1.1\r\n") == 9 and raw.count(b"x" * 2000) == 1
    assert warc.read_archives(spark, folder).count() == 9


def test_damage_is_seen(spark, tmp_path):
    headers = {"warc-type": "response", "warc-record-id": "r", "warc-payload-digest": "sha1:" + hashlib.sha1(b"ab").hexdigest()}
    with pytest.raises(ValueError, match="payload"):
        warc.parse_record(headers, b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nac", True)


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.round_trip(df).count() == 0
    assert warc.read_archives(spark, fresh_dir(spark, "none")).count() == 0


def test_record_ids_are_unique(spark, tmp_path):
    """Small rows that repeat, the same id with two payloads, repeated targets: in one file and in several."""
    big, other = "x" * 3000, "y" * 3000
    data = [(1, "u", "small")] * 40 + [(5, "u", big), (5, "u", other), (4, "u", big), (3, "u", other)] + [(9, "u", "z" * 2000)] * 3 + [(8, "u", "z" * 2000), (None, "u", big), (None, "u", big)]
    for parts in (1, 5):
        folder = f"file://{tmp_path}/{parts}"
        df = spark.createDataFrame(data, "page_id bigint, url string, html string").repartition(parts)
        assert warc.write_archives(warc.plan_captures(df), folder) == len(data)
        ids = [r.record_id for r in warc.read_archives(spark, folder).collect()]
        assert len(ids) == 3 * len(data) == len(set(ids))
        got = warc.assemble(warc.read_archives(spark, folder)).selectExpr("metadata.capture_id", "response.*", "metadata.refers_to").collect()
        named = {r.capture_id: r.refers_to_id for r in got if r.warc_type == "revisit"}
        assert set(named) == {4, 3, 8} and named[8] is None and {named[4], named[3]} <= set(ids)
        assert sorted(str((r.capture_id, r.payload_bytes, r.payload_digest, r.warc_type, r.refers_to)) for r in got) == brute(data)


def test_long_payloads_and_many_small_ones(spark):
    """Payloads of megabytes, and members smaller than what is read at once."""
    data = [(1, "u", "é" * 1_500_000), (2, "u", "é" * 1_500_000)] + [(i, "u" * i, str(i)) for i in range(3, 900)]
    df = spark.createDataFrame(data, "page_id bigint, url string, html string").coalesce(1)
    got = warc.round_trip(df).selectExpr("metadata.capture_id", "response.payload_bytes", "response.payload_digest", "response.warc_type", "metadata.refers_to").collect()
    same = sorted(str(tuple(r)) for r in got) == brute(data)
    assert same
