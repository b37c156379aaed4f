import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from newsloom.llm import media


class Writer:
    """Bits of a scan."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def bytes(self):
        b = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\0")


def size(v):
    return abs(int(v)).bit_length()


def extra(w, v, n):
    w.put(int(v) if v >= 0 else int(v) + (1 << n) - 1, n)


def plain_jpeg(coefs, cols, rows, interval=0):
    """A grey progressive image with zero coefficients, runs, end-of-block runs, refinement of new coefficients and restarts."""
    # A flat table: every symbol has 8 bits but 255, which no table may use for all ones; symbol 0xFF doesn't occur.
    lengths, symbols = [0] * 7 + [255] + [0] * 8, list(range(255))
    out = [b"\xff\xd8", media._segment(0xDB, bytes([0] + [2] * 64)), media._segment(0xC2, struct.pack(">BHHB", 8, 8 * rows, 8 * cols, 1) + bytes([1, 0x11, 0])), media._dht(0, 0, lengths, symbols), media._dht(1, 0, lengths, symbols)]
    if interval:
        out.append(media._segment(0xDD, struct.pack(">H", interval)))
    step = interval or len(coefs)

    def scan(head, write):
        out.append(head)
        for i, a in enumerate(range(0, len(coefs), step)):
            if i:
                out.append(bytes([0xFF, 0xD0 + (i - 1) % 8]))
            w = Writer()
            write(w, coefs[a : a + step])
            out.append(w.bytes())

    def dc_first(w, blocks):
        last = 0
        for b in blocks:
            d = (int(b[0]) >> 1) - last
            last = int(b[0]) >> 1
            w.put(size(d), 8)
            extra(w, d, size(d))

    def dc_refine(w, blocks):
        for b in blocks:
            w.put(int(b[0]) & 1, 1)

    def first(v, low):
        return int(np.sign(v)) * (abs(int(v)) >> low)

    def ac_first(start, end, low):
        def write(w, blocks):
            run = 0

            def flush():
                nonlocal run
                if run:
                    n = run.bit_length() - 1
                    w.put(n << 4, 8)
                    w.put(run - (1 << n), n)
                    run = 0

            for b in blocks:
                v = [first(x, low) for x in b[start : end + 1]]
                zeros, last = 0, max((i for i, x in enumerate(v) if x), default=-1)
                if last >= 0:
                    flush()
                for x in v[: last + 1]:
                    if not x:
                        zeros += 1
                        continue
                    while zeros > 15:
                        w.put(0xF0, 8)
                        zeros -= 16
                    w.put(zeros << 4 | size(x), 8)
                    extra(w, x, size(x))
                    zeros = 0
                if last < len(v) - 1:
                    run += 1
            flush()

        return write

    def ac_refine(w, blocks):
        for b in blocks:
            v = [int(x) for x in b[1:]]
            last = max((i for i, x in enumerate(v) if abs(x) == 1), default=-1)
            zeros, pending = 0, []
            for i, x in enumerate(v[: last + 1]):
                if abs(x) > 1:
                    pending.append(abs(x) & 1)
                elif x == 0:
                    zeros += 1
                    if zeros == 16:
                        w.put(0xF0, 8)
                        for p in pending:
                            w.put(p, 1)
                        zeros, pending = 0, []
                else:
                    w.put(zeros << 4 | 1, 8)
                    w.put(int(x > 0), 1)
                    for p in pending:
                        w.put(p, 1)
                    zeros, pending = 0, []
            if last < 62:
                w.put(0, 8)
                for p in pending:
                    w.put(p, 1)
                for x in v[last + 1 :]:
                    if abs(x) > 1:
                        w.put(abs(x) & 1, 1)

    scan(media._sos(1, 0, 0, 0, 0, 1), dc_first)
    scan(media._sos(1, 0, 1, 5, 0, 1), ac_first(1, 5, 1))
    scan(media._sos(1, 0, 6, 63, 0, 1), ac_first(6, 63, 1))
    scan(media._sos(1, 0, 1, 63, 1, 0), ac_refine)
    scan(media._sos(1, 0, 0, 0, 1, 0), dc_refine)
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("interval", [0, 3])
def test_any_progressive_image(interval):
    rng = np.random.default_rng(3)
    coefs = rng.integers(-30, 31, (12, 64)) * (rng.random((12, 64)) < 0.25)
    coefs[4, 1:] = 0
    coefs[5, 1:] = 0
    coefs[:, 40] = rng.integers(-1, 2, 12)
    coefs[7] = 0
    coefs[7, 63] = 1
    raw = plain_jpeg(coefs, 4, 3, interval)
    assert (media.coefficients_slowly(media.Frame(raw))[0] == coefs).all()
    # brute force: the defining double sum of the inverse transform
    rgb = media.decode(raw)
    assert rgb.shape == (24, 32, 3)
    for b in (0, 5, 11):
        natural = np.zeros(64)
        natural[media._ZIGZAG] = coefs[b] * 2
        f = natural.reshape(8, 8)
        c = [2**-0.5] + [1] * 7
        want = np.array([[sum(c[u] * c[v] * f[u, v] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4 for y in range(8)] for x in range(8)]) + 128
        got = rgb[8 * (b // 4) : 8 * (b // 4) + 8, 8 * (b % 4) : 8 * (b % 4) + 8, 0]
        assert np.abs(np.clip(want, 0, 255) - got).max() <= 0.51


def test_lookup_and_bits_agree():
    r = random.Random(1)
    texts = [b"", b"a", bytes(range(256)) * 5, bytes(r.randrange(256) for _ in range(5000)), b"\xff" * 700, b"\0" * 600]
    raws = media.encode_batch(texts)
    frames = [media.Frame(x) for x in raws]
    assert all(map(media._is_ours, frames))
    whole = media.coefficients_batch(frames)
    at = [0, 0, 0]
    tensors = media.tensors_batch(frames, whole)
    seen = 0
    for text, raw, frame in zip(texts, raws, frames):
        slow = media.coefficients_slowly(frame)
        own = []
        for c in range(3):
            own.append(whole[c][at[c] : at[c] + len(slow[c])])
            at[c] += len(slow[c])
            assert (own[c] == slow[c]).all()
        assert media.payload_of(frame, own) == media.pad(text)
        rgb = media.decode(raw)
        assert (rgb == media.decode(raw, slowly=True)).all()
        w, h = frame.mcus
        assert (rgb.reshape(h, 16, w, 16, 3).swapaxes(1, 2).reshape(-1, 16, 16, 3) == tensors[seen : seen + w * h]).all()
        seen += w * h


def test_zigzag():
    assert media._ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and media._ZIGZAG[-3:].tolist() == [55, 62, 63]


def test_columns(spark):
    rows = [(1, "", 7), (2, None, 7), (3, "é😀" * 400, 7), (3, "é😀" * 400, 7), (None, "x" * 200_000, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, media int")
    stored = media.stored(media.with_media(df))
    got = media.features(stored).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    for k, t, _ in rows:
        b = (t or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        r = by[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert by[1].feature == by[2].feature and by[1].media_sha256 == by[2].media_sha256
    t = media.with_tensors(stored.filter("doc_id = 3")).first()
    rgb = np.frombuffer(t.rgb, np.uint8).reshape(t.height, t.width, 3).astype(float)
    assert by[3].feature == ",".join(f"{rgb[..., c].mean():.3f}:{rgb[..., c].std():.3f}" for c in range(3))
    assert media.features(media.with_media(df.limit(0))).count() == 0


def test_baseline_is_refused():
    with pytest.raises(ValueError, match="SOF0"):
        media.Frame(b"\xff\xd8" + media._segment(0xC0, b"\x08\0\x08\0\x08\x01\x01\x11\0") + b"\xff\xd9")


def test_images_of_any_origin(spark):
    rng = np.random.default_rng(5)
    coefs = rng.integers(-30, 31, (12, 64)) * (rng.random((12, 64)) < 0.25)
    foreign, (ours,) = plain_jpeg(coefs, 4, 3), media.encode_batch([b"abc"])
    baseline = b"\xff\xd8" + media._segment(0xC0, b"\x08\0\x08\0\x08\x01\x01\x11\0") + b"\xff\xd9"
    rows = [(1, foreign), (2, ours), (3, None), (4, baseline), (5, b""), (6, ours[: len(ours) // 2]), (None, foreign)]
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in rows], "doc_id bigint, media binary").coalesce(1)
    got = {r.doc_id: r for r in media.features(df).collect()}
    rgb = media.decode(foreign).astype(float)
    assert got[1].feature == got[None].feature == ",".join(f"{rgb[..., c].mean():.3f}:{rgb[..., c].std():.3f}" for c in range(3)) and got[1].n_bytes is None
    assert got[2].n_bytes == 3 and got[2].payload_sha256 == hashlib.sha256(media.pad(b"abc")).hexdigest()
    assert list(got[3])[1:] == [None] * 7 and [got[k].feature for k in (4, 5, 6)] == [None] * 3 and got[4].media_bytes == len(baseline)


def test_long_text(spark):
    text = "é" * 1_000_000
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string")
    a, b = media.features(media.stored(media.with_media(df))).collect()
    assert a[1:] == b[1:] and a.payload_sha256 == hashlib.sha256(media.pad(text.encode())).hexdigest()


def test_the_query_returns_whole_tensors(spark, tmp_path):
    from newsloom.llm import queries

    texts = ["", None, "é😀" * 400, "x" * 50_000, "abc"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op4_media_jpeg"](spark, str(tmp_path)).collect()}
    assert len(got) == 5
    for k, t in enumerate(texts):
        rgb = media.decode(media.encode_batch([(t or "").encode()])[0], slowly=True)
        assert (got[k].height, got[k].width) == rgb.shape[:2] and got[k].rgb == rgb.tobytes()


def test_tensors_of_any_origin(spark):
    rng = np.random.default_rng(5)
    foreign, (ours,) = plain_jpeg(rng.integers(-30, 31, (12, 64)) * (rng.random((12, 64)) < 0.25), 4, 3), media.encode_batch([b"abc"])
    # The same scans, but another quantisation, and a width that isn't whole MCUs.
    coarse = ours.replace(bytes([0, *[1] * 64]), bytes([0, *[3] * 64]))
    at = ours.index(b"\xff\xc2") + 7
    narrow = ours[:at] + struct.pack(">H", int.from_bytes(ours[at : at + 2], "big") - 3) + ours[at + 2 :]
    rows = [(1, foreign), (2, ours), (3, None), (4, b""), (5, coarse), (6, narrow)]
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in rows], "doc_id bigint, media binary").coalesce(1)
    got = {r.doc_id: r for r in media.features(df, tensors=True).collect()}
    for k in (1, 2, 5, 6):
        rgb = media.decode(dict(rows)[k], slowly=True)
        assert (got[k].height, got[k].width, got[k].rgb, got[k].feature) == (*rgb.shape[:2], rgb.tobytes(), media._shown(rgb))
    assert list(got[3])[1:] == [None] * 10 and list(got[4])[7:] == [None] * 4
