"""WARC archives: written record by record, read back, and assembled into one nested row per capture.

Each capture is a transaction of three records: request, response (or revisit) and metadata. The request and the
metadata name the response's record id in ``WARC-Concurrent-To``; assembly joins on it. Records are gzip members of
their own, so a reader streams a file in bounded memory.

A payload of at least ``least`` bytes that several captures share is stored once, by the capture with the largest id;
the others are revisits: they keep the digest, the payload's length and the id of the record they refer to.

Record ids are unique in a folder. A response that revisits name is called by its capture and digest, all others by the place
they are written at.

Cases: null html is an empty payload, a null url an empty target; rows with a null id are responses of their own, with
a null id, and never the target of a revisit. Rows that repeat an id with the largest id of their payload are all responses,
and their revisits keep the capture's id but name no record. An empty table gives no archives and no rows. Extra columns aren't
archived, whatever their names. A very long payload is in memory once as it is written and once as it is read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shared import filesystem, fresh_dir, small, written

LEAST = 1000
_CHUNK = 1 << 20
#: Bytes given to the decompressor at once: what lies behind a member's end is copied, so it has to be little.
_FED = 1 << 13
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
RECORD = pa.schema(
    [
        ("record_id", pa.string()), ("warc_type", pa.string()), ("concurrent_to", pa.string()), ("refers_to_id", pa.string()),
        ("target_uri", pa.string()), ("capture_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("payload", pa.binary()),
    ]
)
_DDL = (
    "record_id string, warc_type string, concurrent_to string, refers_to_id string, target_uri string, "
    "capture_id bigint, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
)


def _uuid(*parts) -> str:
    h = hashlib.sha256("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def _member(headers: list[tuple[str, str]], body: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    raw = b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"Content-Length: %d\r\n\r\n" % len(body)
    return z.compress(raw) + z.compress(body) + z.compress(b"\r\n\r\n") + z.flush()


def _line(value: str) -> str:
    """A header's value can't hold line ends; they are percent-encoded."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def transaction(row: int | None, url: str, payload: bytes, digest: str, target: int | None, named: bool, place: str) -> bytes:
    """The three records of one capture. target: the id of the capture that holds the payload, for a revisit. named: whether a revisit names its target's record, or a response is called so that revisits can name it."""
    own = named and target is None
    main, uri = _uuid("response", row, digest) if own else _uuid("record", place), _line(url)
    common = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri)]
    http = _HTTP % len(payload)
    if target is None:
        kind, body = [("WARC-Type", "response")], http + payload
    else:
        kind, body = [("WARC-Type", "revisit"), *([("WARC-Refers-To", _uuid("response", target, digest))] if named else []), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], http
    request = b"GET / HTTP/1.1\r\n\r\n"
    fields = b"" if row is None else b"capture: %d\r\n" % row
    if target is not None:
        fields += b"refers-to-capture: %d\r\n" % target
    return b"".join(
        (
            _member([("WARC-Type", "request"), ("WARC-Record-ID", _uuid("request", place)), ("WARC-Concurrent-To", main), *common, ("Content-Type", "application/http;msgtype=request")], request),
            _member([*kind, ("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")], body),
            _member([("WARC-Type", "metadata"), ("WARC-Record-ID", _uuid("metadata", place)), ("WARC-Concurrent-To", main), *common, ("Content-Type", "application/warc-fields")], fields),
        )
    )


def plan_captures(pages: DataFrame, least: int = LEAST, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """_row, _url, _payload, _digest, _target, _named. Only ids and digests are shuffled; which capture refers to which is joined by id."""
    base = pages.select(pages[key].cast("long").alias("_row"), F.coalesce(pages[url].cast("string"), F.lit("")).alias("_url"), F.encode(F.coalesce(pages[html].cast("string"), F.lit("")), "UTF-8").alias("_payload"))
    base = base.withColumn("_digest", F.sha1("_payload"))
    thin = base.filter((F.octet_length("_payload") >= least) & F.col("_row").isNotNull()).groupBy("_row", "_digest").agg(F.count("*").alias("_n"))
    thin = written(thin, "warc-digests")
    largest = thin.groupBy("_digest").agg(F.max(F.struct("_row", "_n")).alias("_t"), F.count("*").alias("_k")).filter("_k > 1").select("_digest", "_t")
    # A target's record can be named if only one row has it.
    notes = thin.join(largest, "_digest").select("_row", F.col("_digest").alias("_d"), F.when(F.col("_row") != F.col("_t._row"), F.col("_t._row")).alias("_target"), (F.col("_t._n") == 1).alias("_named"))
    notes = written(notes, "warc-revisits").withColumnRenamed("_row", "_r")
    rows = base.join(small(notes, 100), (F.col("_row") == F.col("_r")) & (F.col("_digest") == F.col("_d")), "left")
    return rows.select("_row", "_url", "_payload", "_digest", "_target", F.coalesce("_named", F.lit(False)).alias("_named"))


def write_archives(captures: DataFrame, folder: str) -> int:
    """One .warc.gz file for each partition, written beside its place and moved there, so that a task that runs twice leaves one whole file. Returns the number of captures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs, at = filesystem(folder)
        fs.create_dir(at)
        n, stream = 0, None
        for batch in batches:
            for row, url, payload, digest, target, named in zip(*(c.to_pylist() for c in batch.columns)):
                if stream is None:
                    stream = fs.open_output_stream(f"{at}/.part-{part:05d}-{attempt}", compression=None)
                stream.write(transaction(row, url, payload, digest, target, named, f"{part}.{n}"))
                n += 1
        if stream is not None:
            stream.close()
            fs.move(f"{at}/.part-{part:05d}-{attempt}", f"{at}/part-{part:05d}.warc.gz")
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return captures.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and body of each gzip member, streamed."""
    z, parts = zlib.decompressobj(31), []
    while data := memoryview(stream.read(_CHUNK)):
        at = 0
        while at < len(data):
            fed = data[at : at + _FED]
            parts.append(z.decompress(fed))
            at += len(fed) - len(z.unused_data)
            if z.eof:
                raw = b"".join(parts)
                z, parts = zlib.decompressobj(31), []
                head, _, body = raw.partition(b"\r\n\r\n")
                lines = head.decode("utf-8", "surrogatepass").split("\r\n")
                headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
                yield headers, body[: int(headers["content-length"])]
    if parts:
        raise ValueError("the archive ends within a record")


def parse_record(headers: dict[str, str], body: bytes, keep_payload: bool) -> dict:
    kind = headers["warc-type"]
    out = dict.fromkeys(RECORD.names) | {"record_id": headers["warc-record-id"], "warc_type": kind, "concurrent_to": headers.get("warc-concurrent-to"), "refers_to_id": headers.get("warc-refers-to"), "target_uri": _unline(headers.get("warc-target-uri", ""))}
    if kind == "metadata":
        fields = dict(x.split(": ", 1) for x in body.decode().split("\r\n") if x)
        out |= {k: int(fields[f]) for k, f in (("capture_id", "capture"), ("refers_to", "refers-to-capture")) if f in fields}
    elif kind in ("response", "revisit"):
        http, _, payload = body.partition(b"\r\n\r\n")
        length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
        out |= {"payload_bytes": length, "payload_digest": headers["warc-payload-digest"].removeprefix("sha1:")}
        if kind == "response":
            if len(payload) != length or hashlib.sha1(payload).hexdigest() != out["payload_digest"]:
                raise ValueError(f"{out['record_id']}: the payload isn't what its digest says")
            out["payload"] = payload if keep_payload else None
    return out


def read_archives(spark, folder: str, *, keep_payload: bool = True) -> DataFrame:
    """The records of all archives of a folder, a task for each file or few. Payloads are checked against their digests."""
    fs, at = filesystem(folder)
    from pyarrow.fs import FileSelector

    names = sorted(f.base_name for f in fs.get_file_info(FileSelector(at, allow_not_found=True)) if f.base_name.endswith(".warc.gz"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{at}/{name}", compression=None) as f:
                    for headers, body in _records(f):
                        rows.append(parse_record(headers, body, keep_payload))
                        size += len(body) if keep_payload else 300
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, RECORD)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORD)

    files = spark.createDataFrame([(n,) for n in names], "name string").repartitionByRange(max(1, len(names)), "name")
    return files.mapInArrow(run, _DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with the request and the metadata that name it."""
    r = records
    main = r.filter(r.warc_type.isin("response", "revisit")).select("record_id", F.struct("warc_type", "target_uri", "refers_to_id", "payload_bytes", "payload_digest", "payload").alias("response"))
    sides = r.filter(r.warc_type.isin("request", "metadata") & r.concurrent_to.isNotNull()).groupBy(F.col("concurrent_to").alias("record_id")).agg(
        F.min(F.when(F.col("warc_type") == "request", F.struct("record_id", "target_uri"))).alias("request"),
        F.min(F.when(F.col("warc_type") == "metadata", F.struct("record_id", "capture_id", "refers_to"))).alias("metadata"),
    )
    return main.join(sides, "record_id", "left")


def round_trip(pages: DataFrame, least: int = LEAST, *, keep_payload: bool = False, **columns: str) -> DataFrame:
    """Write the archives of a table to the shared folder, read them back and assemble the captures."""
    spark = pages.sparkSession
    folder = fresh_dir(spark, "warc")
    write_archives(plan_captures(pages, least, **columns), folder)
    return assemble(read_archives(spark, folder, keep_payload=keep_payload))
