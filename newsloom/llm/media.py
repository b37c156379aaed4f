"""Media columns: progressive JPEG, decoded to full-resolution RGB tensors in numpy.

``decode`` takes any baseline-Huffman progressive JPEG (SOF2, 8 bits, one or three components, any sampling, restart
intervals): it accumulates DC and AC scans, first passes and refinements, into coefficient arrays, inverse-transforms
them with one matrix product, upsamples chroma by repetition and converts YCbCr to RGB.

``encode_batch`` stores bytes without loss. The samples of a JPEG are lossy, its quantised coefficients are not:
they are the format's unit, and one byte of payload becomes one coefficient. A DC coefficient is ``b - 128``, an AC
coefficient ``b - 130`` below 128, else ``b - 126``: never 0 or 1 in size, so that no coefficient is zero after the first scan.
Then each scan has one width: with code lengths of 8 less the number of extra bits, a first scan has
8 bits a coefficient, an AC refinement 64 bits a block (an end-of-block of one bit and 63 correction bits), a DC
refinement 1 bit. Scans of this kind are read by table lookup for a whole batch at once; all others take the
bit-by-bit path, and both give the same arrays. Quantisation is 1; components are 4:2:0; images are one strip of MCUs
wide enough, or several of 4095. Left-over coefficients are 255. The length of the payload is kept in a comment.

``stored`` writes the images to the shared folder and reads them again; ``features`` takes images of any origin: the ones
that encode_batch made are decoded together, all others one by one and have no payload, what isn't a progressive JPEG has no feature, a null image has nulls only. With ``tensors`` it returns the full-resolution RGB tensors too, those
that the features are made of; whoever writes the result stores them.

Cases: a null text is empty, and empty is padded like all others, so every row has an image; null keys stay. Extra columns are
ignored, whatever their names; repeated rows give equal values; an empty table gives no rows. A very long text is one image, in memory
with its coefficients (some 20 bytes for each byte). A payload beyond 6.4 GB has no place in one JPEG and raises; a text of Spark can't be so long. A tensor of 2 GB (of a text of 1 GB) has no place in one cell and raises.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shared import fresh_dir

UNIT = 576
_MAX_ROW = 4095
#: Payload bytes that are encoded, or decoded, at once.
_SLICE = 2 << 20

_ZIGZAG = np.array(sorted(range(64), key=lambda i: ((i // 8 + i % 8), (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


def _dct_matrix() -> np.ndarray:
    """M[k, s]: what zigzag coefficient k adds to sample s of a block."""
    c = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    return np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)[_ZIGZAG].astype(np.float32)


IDCT = _dct_matrix()


# tables of one width


def _canonical(lengths: list[int], symbols: list[int]) -> dict[tuple[int, int], int]:
    """(length, code): symbol. lengths: how many codes there are of each length from 1 to 16."""
    code, i, out = 0, 0, {}
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[n, code] = symbols[i]
            code, i = code + 1, i + 1
        code <<= 1
    return out


def _up(a: int, b: int) -> int:
    return -(-a // b)


def _extend(bits: int, n: int) -> int:
    return bits if n and bits >> (n - 1) else bits - (1 << n) + 1


def fixed_width(lengths: list[int], symbols: list[int]) -> np.ndarray | None:
    """256 values by byte, if each symbol has run 0 and its code and extra bits make 8 bits together; 9999 where no code is."""
    table = np.full(256, 9999, np.int32)
    for (n, code), s in _canonical(lengths, symbols).items():
        if s >> 4 or n + s != 8:
            return None
        for bits in range(1 << s):
            table[code << s | bits] = _extend(bits, s)
    return table


_DC_SYMBOLS, _AC_SYMBOLS = list(range(7, -1, -1)), list(range(7, 0, -1))
_DC_LENGTHS, _AC_LENGTHS = [1] * 8 + [0] * 8, [1] * 7 + [0] * 9
_DC_TABLE, _AC_TABLE = fixed_width(_DC_LENGTHS, _DC_SYMBOLS), fixed_width(_AC_LENGTHS, _AC_SYMBOLS)


def _inverse(table: np.ndarray) -> np.ndarray:
    """By value + 256, the byte."""
    out = np.zeros(512, np.uint8)
    good = np.flatnonzero(table != 9999)
    out[table[good] + 256] = good
    return out


_DC_CODE, _AC_CODE = _inverse(_DC_TABLE), _inverse(_AC_TABLE)
#: By payload byte: the AC coefficient, the code of its first scan, its refinement bit.
_AC_VALUE = np.array([b - 130 if b < 128 else b - 126 for b in range(256)], np.int16)
_AC_FIRST = _AC_CODE[np.sign(_AC_VALUE) * (np.abs(_AC_VALUE) >> 1) + 256]
_AC_LOW = (np.abs(_AC_VALUE) & 1).astype(np.uint8)


# encoding


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, slot: int, lengths: list[int], symbols: list[int]) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | slot, *lengths, *symbols]))


_HEAD = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xDB, bytes([0, *[1] * 64]))
_TABLES = _dht(0, 0, _DC_LENGTHS, _DC_SYMBOLS) + _dht(1, 0, _AC_LENGTHS, _AC_SYMBOLS)
#: The refinement's table has one symbol, an end of block for one block.
_REFINE = _dht(1, 1, [1] + [0] * 15, [0])


def _sos(component: int, ac: int, start: int, end: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([1, component, ac, start, end, high << 4 | low]))


def _layout(n_bytes: int) -> tuple[int, int]:
    """MCUs in a row, and rows, for a padded payload."""
    mcus = -(-n_bytes // 384)
    rows = -(-mcus // _MAX_ROW)
    if rows > _MAX_ROW:
        raise ValueError(f"a payload of {n_bytes} bytes is too large for one image")
    return -(-mcus // rows), rows


def pad(text: bytes) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def encode_batch(texts: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each text; codes are looked up for all at once."""
    padded = [pad(t) for t in texts]
    shapes = [_layout(len(p)) for p in padded]
    blocks = [6 * w * h for w, h in shapes]
    data = np.frombuffer(b"".join(p + b"\xff" * (64 * n - len(p)) for p, n in zip(padded, blocks)), np.uint8).reshape(-1, 64)
    first, dc = _AC_FIRST[data[:, 1:]], data[:, 0].astype(np.int16) - 128
    low_band, high_band = np.ascontiguousarray(first[:, :5]), np.ascontiguousarray(first[:, 5:])
    refine = np.zeros(data.shape, np.uint8)
    refine[:, 1:] = _AC_LOW[data[:, 1:]]
    refine = np.packbits(refine, axis=1)
    ends = np.cumsum(blocks)
    starts = ends - blocks
    # Differences start anew with each component of each image.
    edges = np.concatenate([[s, s + 4 * n // 6, s + 5 * n // 6] for s, n in zip(starts, blocks)])
    half = dc >> 1
    diff = np.diff(half, prepend=0)
    diff[edges] = half[edges]
    dc_code, dc_bit = _DC_CODE[diff + 256], (dc & 1).astype(np.uint8)
    out = []
    for text, (w, h), s, n in zip(texts, shapes, starts, blocks):
        sof = struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        parts = [_HEAD, _segment(0xFE, b"bytes=%d" % len(text)), _segment(0xC2, sof), _TABLES]
        spans = [(1, s, s + 4 * n // 6), (2, s + 4 * n // 6, s + 5 * n // 6), (3, s + 5 * n // 6, s + n)]
        for scan, codes in ((0, 0, 0, 0, 1), dc_code), ((0, 1, 5, 0, 1), low_band), ((0, 6, 63, 0, 1), high_band), ((1, 1, 63, 1, 0), refine), ((0, 0, 0, 1, 0), None):
            if codes is refine:
                parts.append(_REFINE)
            for c, a, b in spans:
                raw = codes[a:b].tobytes() if codes is not None else _ones(dc_bit[a:b])
                parts += [_sos(c, *scan), raw.replace(b"\xff", b"\xff\0")]
        parts.append(b"\xff\xd9")
        out.append(b"".join(parts))
    return out


def _ones(bits: np.ndarray) -> bytes:
    """Packed bits; the last byte is filled with ones."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


# decoding


class Frame:
    """What the headers of an image say, and its scans' data, without stuffing, by restart interval."""

    def __init__(self, raw: bytes):
        self.quant, self.scans, self.comment, self.interval = {}, [], b"", 0
        tables: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        if raw[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        at = 2
        while True:
            marker, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
            if marker == 0xD9:
                break
            if raw[at] != 0xFF:
                raise ValueError(f"no marker at {at}")
            body, at = raw[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide, n = body[0] >> 4, 64 * (1 + (body[0] >> 4))
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    lengths = list(body[1:17])
                    n = sum(lengths)
                    tables[body[0] >> 4, body[0] & 15] = (lengths, list(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.interval = int.from_bytes(body, "big")
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xC2:
                _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                self.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                if n not in (1, 3):
                    raise ValueError(f"{n} components")
                self._shape()
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError(f"not a progressive Huffman image: SOF{marker - 0xC0}")
            elif marker == 0xDA:
                n = body[0]
                who = [(next(i for i, c in enumerate(self.components) if c[0] == body[1 + 2 * k]), body[2 + 2 * k]) for k in range(n)]
                start, end, bits = body[1 + 2 * n : 4 + 2 * n]
                stop = at
                while True:
                    stop = raw.index(b"\xff", stop)
                    if raw[stop + 1] == 0 or 0xD0 <= raw[stop + 1] <= 0xD7:
                        stop += 2
                    else:
                        break
                data = raw[at:stop]
                pieces = [data]
                if self.interval:
                    pieces, last, i = [], 0, data.find(b"\xff")
                    while i >= 0:
                        if 0xD0 <= data[i + 1] <= 0xD7:
                            pieces.append(data[last:i])
                            last = i + 2
                        i = data.find(b"\xff", i + 2)
                    pieces.append(data[last:])
                self.scans.append((who, start, end, bits >> 4, bits & 15, dict(tables), self.interval, [p.replace(b"\xff\0", b"\xff") for p in pieces]))
                at = stop

    def _shape(self):
        hm, vm = max(c[1] for c in self.components), max(c[2] for c in self.components)
        self.mcus = -(-self.width // (8 * hm)), -(-self.height // (8 * vm))
        #: Block columns and rows that the arrays have, and those that a scan of one component has.
        self.grid = [(self.mcus[0] * c[1], self.mcus[1] * c[2]) for c in self.components]
        self.own = [(_up(_up(self.width * c[1], hm), 8), _up(_up(self.height * c[2], vm), 8)) for c in self.components]


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big") if len(data) < 4096 else None, 8 * len(data)
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        if n == 0:
            return 0
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        chunk = int.from_bytes(self.data[a:b].ljust(b - a, b"\xff"), "big")
        self.at += n
        return chunk >> (8 * b - self.at) & ((1 << n) - 1)


def _symbol(bits: _Bits, codes: dict[tuple[int, int], int]) -> int:
    code = 0
    for n in range(1, 17):
        code = code << 1 | bits.take(1)
        if (n, code) in codes:
            return codes[n, code]
    raise ValueError("no such code")


def _scan_slowly(frame: Frame, scan, coefficients: list[np.ndarray]) -> None:
    """Any scan, bit by bit."""
    who, start, end, high, low, tables, interval, pieces = scan
    if len(who) == 1:
        c = who[0][0]
        cols, rows = frame.own[c]
        units = [[(c, y * frame.grid[c][0] + x)] for y in range(rows) for x in range(cols)]
    else:
        units = [
            [(c, (my * frame.components[c][2] + v) * frame.grid[c][0] + mx * frame.components[c][1] + h) for c, _ in who for v in range(frame.components[c][2]) for h in range(frame.components[c][1])]
            for my in range(frame.mcus[1])
            for mx in range(frame.mcus[0])
        ]
    codes = {c: _canonical(*tables[(0, t >> 4) if start == 0 else (1, t & 15)]) if not (start == 0 and high) else None for c, t in who}
    step = interval or len(units)
    for piece, first in zip(pieces, range(0, len(units), step)):
        bits, run, last = _Bits(piece), 0, dict.fromkeys(codes, 0)
        for unit in units[first : first + step]:
            for c, b in unit:
                block = coefficients[c][b]
                if start == 0:
                    if high:
                        block[0] |= bits.take(1) << low
                    else:
                        n = _symbol(bits, codes[c])
                        last[c] += _extend(bits.take(n), n)
                        block[0] = last[c] << low
                elif not high:
                    if run:
                        run -= 1
                        continue
                    k = start
                    while k <= end:
                        rs = _symbol(bits, codes[c])
                        r, s = rs >> 4, rs & 15
                        if s:
                            k += r
                            block[k] = _extend(bits.take(s), s) * (1 << low)
                            k += 1
                        elif r == 15:
                            k += 16
                        else:
                            run = (1 << r) + bits.take(r) - 1
                            break
                else:
                    run = _refine(bits, block, start, end, low, codes[c], run)


def _refine(bits: _Bits, block: np.ndarray, start: int, end: int, low: int, codes, run: int) -> int:
    """One block of an AC refinement; the end-of-block run that is left."""

    def correct(k: int) -> None:
        if bits.take(1):
            block[k] += (1 << low) if block[k] > 0 else -(1 << low)

    k = start
    while not run and k <= end:
        rs = _symbol(bits, codes)
        r, s = rs >> 4, rs & 15
        value = 0
        if s:
            value = (1 << low) if bits.take(1) else -(1 << low)
        elif r < 15:
            run = (1 << r) + bits.take(r)
            break
        while k <= end:
            if block[k]:
                correct(k)
            elif r == 0:
                if value:
                    block[k] = value
                k += 1
                break
            else:
                r -= 1
            k += 1
    if run:
        while k <= end:
            if block[k]:
                correct(k)
            k += 1
        run -= 1
    return run


def coefficients_slowly(frame: Frame) -> list[np.ndarray]:
    """An array (blocks, 64) of zigzag coefficients for each component; every scan bit by bit."""
    out = [np.zeros((w * h, 64), np.int32) for w, h in frame.grid]
    for scan in frame.scans:
        _scan_slowly(frame, scan, out)
    return out


def _is_ours(frame: Frame) -> bool:
    """Whether every scan has one width, so that lookup reads it."""
    if frame.interval or frame.own != frame.grid or [s[1:5] for s in frame.scans[::3]] != [(0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (1, 63, 1, 0), (0, 0, 1, 0)]:
        return False
    shape = [[c for c, _ in s[0]] for s in frame.scans] == [[0], [1], [2]] * 5
    first = frame.scans[0][5]
    return (
        shape
        and first[0, 0] == (_DC_LENGTHS, _DC_SYMBOLS)
        and all(s[5][1, 0] == (_AC_LENGTHS, _AC_SYMBOLS) and s[0][0][1] == 0 for s in frame.scans[3:9])
        and all(s[5][1, s[0][0][1] & 15] == ([1] + [0] * 15, [0]) for s in frame.scans[9:12])
    )


def coefficients_batch(frames: list[Frame]) -> list[np.ndarray]:
    """For the three components, the coefficient blocks of all images, one image after the other. All are _is_ours."""
    out = []
    for c in range(3):
        n = [f.grid[c][0] * f.grid[c][1] for f in frames]
        blocks = np.zeros((sum(n), 64), np.int32)
        joined = [np.frombuffer(b"".join(f.scans[3 * k + c][7][0] for f in frames), np.uint8) for k in range(4)]
        # Spectral selection: DC differences are summed within an image; AC bands come by lookup.
        diff = _DC_TABLE[joined[0]]
        total = np.cumsum(diff)
        ends = np.cumsum(n)
        before = np.concatenate([[0], total[ends[:-1] - 1]]) if len(n) > 1 else np.zeros(1, np.int64)
        blocks[:, 0] = (total - np.repeat(before, n)) << 1
        blocks[:, 1:6] = _AC_TABLE[joined[1].reshape(-1, 5)] << 1
        blocks[:, 6:] = _AC_TABLE[joined[2].reshape(-1, 58)] << 1
        if (np.abs(blocks) > 2048).any() or (blocks[:, 1:] == 0).any():
            raise ValueError("a code that no symbol has")
        # Successive approximation: correction bits enlarge what isn't zero.
        bits = np.unpackbits(joined[3].reshape(-1, 8), axis=1)
        blocks[:, 1:] += np.where(blocks[:, 1:] > 0, bits[:, 1:], -bits[:, 1:].astype(np.int32))
        low = np.concatenate([np.unpackbits(np.frombuffer(f.scans[12 + c][7][0], np.uint8), count=k) for f, k in zip(frames, n)])
        blocks[:, 0] |= low
        out.append(blocks)
    return out


def _planes(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Samples of blocks, level-shifted, not yet rounded: (blocks, 8, 8)."""
    return ((coefficients * quant).astype(np.float32) @ IDCT + 128).reshape(-1, 8, 8)


def _rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """Whole samples in 0..255, converted; the last axis is RGB."""
    y, cb, cr = (np.clip(np.rint(p), 0, 255) for p in (y, cb, cr))
    cb, cr = cb - np.float32(128), cr - np.float32(128)
    out = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], axis=-1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def decode(raw: bytes, slowly: bool = False) -> np.ndarray:
    """The full-resolution RGB tensor (height, width, 3) of a progressive JPEG."""
    frame = Frame(raw)
    if _is_ours(frame) and not slowly:
        coefficients = coefficients_batch([frame])
    else:
        coefficients = coefficients_slowly(frame)
    hm, vm = max(c[1] for c in frame.components), max(c[2] for c in frame.components)
    planes = []
    for blocks, (w, h), (_, ch, cv, q) in zip(coefficients, frame.grid, frame.components):
        plane = _planes(blocks, frame.quant[q]).reshape(h, w, 8, 8).swapaxes(1, 2).reshape(8 * h, 8 * w)
        planes.append(np.repeat(np.repeat(plane, vm // cv, axis=0), hm // ch, axis=1)[: frame.height, : frame.width])
    if len(planes) == 1:
        planes += [np.full_like(planes[0], 128)] * 2
    return _rgb(*planes)


def payload_of(frame: Frame, coefficients: list[np.ndarray]) -> bytes:
    """The padded payload that an image of encode_batch holds."""
    blocks = np.concatenate(coefficients)
    data = np.empty(blocks.shape, np.uint8)
    data[:, 0] = blocks[:, 0] + 128
    data[:, 1:] = np.where(blocks[:, 1:] < 0, blocks[:, 1:] + 130, blocks[:, 1:] + 126)
    n = int(frame.comment.removeprefix(b"bytes="))
    return data.reshape(-1)[: max(1, -(-n // UNIT)) * UNIT].tobytes()


# columns


def _slices(items: list, size) -> Iterator[list]:
    part, total = [], 0
    for x in items:
        part.append(x)
        total += size(x)
        if total >= _SLICE:
            yield part
            part, total = [], 0
    if part:
        yield part


def with_media(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, media: the text's bytes as a progressive JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for part in _slices(rows, lambda r: len(r[1])):
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], batch.schema.field(0).type), pa.array(encode_batch([t for _, t in part]), pa.binary())], [key, "media"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8").alias("_t")).mapInArrow(run, f"`{key}` {kind}, media binary")


def stored(media: DataFrame) -> DataFrame:
    """The images, written to the shared folder and read again. Their codes are whole bytes, so Zstandard takes more than half off."""
    spark, path = media.sparkSession, fresh_dir(media.sparkSession, "media")
    media.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(media.schema).parquet(path)


def with_tensors(media: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, height, width, rgb: the tensor's bytes in row order. For pipelines that train on the images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in zip(batch.column(0), batch.column(1).to_pylist()):
                rgb = None if raw is None else decode(raw)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k.as_py()], batch.schema.field(0).type), *(pa.array([x], t) for x, t in ((rgb is not None and rgb.shape[0] or None, pa.int64()), (rgb is not None and rgb.shape[1] or None, pa.int64()), (rgb is not None and rgb.tobytes() or None, pa.binary())))],
                    [key, "height", "width", "rgb"],
                )

    kind = dict(media.dtypes)[key]
    return media.select(key, "media").mapInArrow(run, f"`{key}` {kind}, height bigint, width bigint, rgb binary")


_UNREADABLE = (ValueError, IndexError, KeyError, StopIteration, AttributeError, struct.error)


def _frame(raw: bytes | None) -> Frame | None:
    try:
        return None if raw is None else Frame(raw)
    except _UNREADABLE:
        return None


def _cell(rgb: np.ndarray) -> tuple[int, int, bytes]:
    if rgb.nbytes >= 1 << 31:
        raise OverflowError(f"a tensor of {rgb.nbytes} bytes is too large for one cell")
    return rgb.shape[0], rgb.shape[1], rgb.tobytes()


def _plain(frame: Frame) -> bool:
    """Whether an image is one of encode_batch's in what the scans don't say: quantisation of 1, 4:2:0, whole MCUs."""
    ones = all(q in frame.quant and (frame.quant[q] == 1).all() for *_, q in frame.components)
    return ones and [c[1:3] for c in frame.components] == [(2, 2), (1, 1), (1, 1)] and (frame.width, frame.height) == (16 * frame.mcus[0], 16 * frame.mcus[1])


def features(media: DataFrame, *, key: str = "doc_id", tensors: bool = False) -> DataFrame:
    """Of each stored image the payload's digest and tail, the stored form's digest, and the means and deviations of its RGB tensor. With tensors: height, width, rgb (its bytes in row order) as well."""
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    more = ""
    if tensors:
        names += ["height", "width", "rgb"]
        types += [pa.int64(), pa.int64(), pa.binary()]
        more = ", height bigint, width bigint, rgb binary"

    def other(k, raw: bytes | None) -> tuple:
        if raw is None:
            return (k, *[None] * (len(names) - 1))
        try:
            rgb = decode(raw)
            feature = _shown(rgb)
        except _UNREADABLE:
            rgb = feature = None
        cells = () if not tensors else (None, None, None) if rgb is None else _cell(rgb)
        return (k, None, None, None, None, len(raw), hashlib.sha256(raw).hexdigest(), feature, *cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types[0] = batch.schema.field(0).type
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for part in _slices(rows, lambda r: len(r[1] or b"")):
                read = [_frame(raw) for _, raw in part]
                mine = [i for i, f in enumerate(read) if f is not None and f.comment.startswith(b"bytes=") and _is_ours(f) and _plain(f)]
                frames = [read[i] for i in mine]
                whole = coefficients_batch(frames) if mine else []
                rgb = tensors_batch(frames, whole) if mine else None
                moments = _moments(frames, rgb) if mine else []
                first = np.concatenate([[0], np.cumsum([f.mcus[0] * f.mcus[1] for f in frames])]).astype(int)
                cuts = [np.concatenate([[0], np.cumsum([f.grid[c][0] * f.grid[c][1] for f in frames])]).astype(int) for c in range(3)]
                done: dict[int, tuple] = {}
                for i, (at, frame) in enumerate(zip(mine, frames)):
                    k, raw = part[at]
                    payload = payload_of(frame, [whole[c][cuts[c][i] : cuts[c][i + 1]] for c in range(3)])
                    cells = _cell(_in_rows(rgb[first[i] : first[i + 1]], frame)) if tensors else ()
                    done[at] = (k, int(frame.comment.removeprefix(b"bytes=")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), moments[i], *cells)
                out = [done[i] if i in done else other(*part[i]) for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names)

    kind = dict(media.dtypes)[key]
    return media.select(key, "media").mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + more)


def tensors_batch(frames: list[Frame], whole: list[np.ndarray]) -> np.ndarray:
    """The RGB tensors of all images, MCU by MCU: (MCUs, 16, 16, 3). Only the order of MCUs differs from decode()'s."""
    ys = []
    at = 0
    luma = _planes(whole[0], np.float32(1))
    for f in frames:
        w, h = f.mcus
        n = 4 * w * h
        ys.append(luma[at : at + n].reshape(h, 2, w, 2, 8, 8).transpose(0, 2, 1, 4, 3, 5).reshape(-1, 16, 16))
        at += n
    y = np.concatenate(ys)
    cb, cr = (np.repeat(np.repeat(_planes(whole[c], np.float32(1)), 2, axis=1), 2, axis=2) for c in (1, 2))
    return _rgb(y, cb, cr)


def _in_rows(mcus: np.ndarray, frame: Frame) -> np.ndarray:
    """One image's part of tensors_batch as decode() gives it."""
    w, h = frame.mcus
    return mcus.reshape(h, w, 16, 16, 3).swapaxes(1, 2).reshape(16 * h, 16 * w, 3)


def _moments(frames: list[Frame], tensors: np.ndarray) -> list[str]:
    """Whole numbers, exact whatever the order: the sums of each colour and of its squares make the mean and deviation."""
    rgb = tensors.reshape(-1, 256, 3)
    one = rgb.sum(axis=1, dtype=np.int64)
    two = np.einsum("mpc,mpc->mc", rgb.astype(np.int32), rgb.astype(np.int32)).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum([f.mcus[0] * f.mcus[1] for f in frames])[:-1]])
    sums, squares = np.add.reduceat(one, starts), np.add.reduceat(two, starts)
    return [_mean_and_deviation(256 * f.mcus[0] * f.mcus[1], s, q) for f, s, q in zip(frames, sums, squares)]


def _shown(rgb: np.ndarray) -> str:
    """The same of one tensor."""
    flat = rgb.reshape(-1, 3).astype(np.int64)
    return _mean_and_deviation(len(flat), flat.sum(axis=0), (flat * flat).sum(axis=0))


def _mean_and_deviation(n: int, total: np.ndarray, squares: np.ndarray) -> str:
    mean = total / n
    return ",".join(f"{m:.3f}:{d:.3f}" for m, d in zip(mean, np.sqrt(np.maximum(squares / n - mean**2, 0))))
