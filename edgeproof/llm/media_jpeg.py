"""Media columns: baseline JPEG.

The decoder parses markers, Huffman-decodes the scan and rebuilds a DC-only luminance thumbnail in numpy, all restart
segments of a batch in step. The writer stores any bytes without loss in the format's own unit, the quantised DCT
coefficient: each byte is one coefficient of size category 8 (its eight extra bits are the byte), in scan order, 192 a
minimum coded unit of three components, each unit a restart interval, all quantisers 1.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import chunks, text_buffer

UNIT = 192
#: Most units in a row: 65,535 pixels of 8.
ACROSS = 8191


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _huffman(cls: int, ident: int, codes: list[tuple[int, int]]) -> bytes:
    """A DHT segment from (length, symbol) in the order of the codes."""
    counts = bytes(sum(n == k for n, _ in codes) for k in range(1, 17))
    return _segment(0xC4, bytes([cls << 4 | ident]) + counts + bytes(s for _, s in codes))


_QUANT = _segment(0xDB, bytes([0]) + bytes([1] * 64))
_TABLES = _huffman(0, 0, [(1, 8), (2, 0)]) + _huffman(1, 0, [(1, 8), (2, 0)])
_SCAN = _segment(0xDD, b"\x00\x01") + _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
#: A unit of three blocks without coefficients (codes 10 for a zero DC and 10 for end of block), filled up with ones.
_BLANK = b"\xaa\xaf"


def _head(size: int, across: int, down: int) -> bytes:
    frame = bytes([8]) + (8 * down).to_bytes(2, "big") + (8 * across).to_bytes(2, "big") + bytes([3, 1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + _segment(0xFE, b"payload=%d" % size) + _QUANT + _segment(0xC0, frame) + _TABLES + _SCAN


def pad(data: bytes) -> bytes:
    """Bytes 32 appended up to a positive multiple of 192."""
    return data + b" " * ((-len(data)) % UNIT or UNIT * (not data))


def encode(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG file for each payload (of a positive multiple of 192 bytes)."""
    units = np.array([len(p) // UNIT for p in payloads])
    flat = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT, 1)
    bits = np.zeros((len(flat), UNIT, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(flat, axis=2)
    coded = np.packbits(bits.reshape(len(flat), -1), axis=1)
    size = coded.shape[1]
    coded = coded.ravel()
    first = np.cumsum(units) - units
    # every FF is followed by a stuffed 00, every unit but an image's last by a restart marker
    ff = coded == 0xFF
    turn = np.zeros(len(coded), np.int8)
    ends = np.arange(1, len(flat) + 1) * size - 1
    last = np.zeros(len(flat), bool)
    last[first + units - 1] = True
    turn[ends] = 2 * ~last
    step = 1 + ff + turn
    end = np.cumsum(step)
    out = np.zeros(end[-1], np.uint8)
    out[end - step] = coded
    at = end[ends[~last]]
    out[at - 2] = 0xFF
    out[at - 1] = 0xD0 + ((np.arange(len(flat)) - np.repeat(first, units)) % 8)[~last]
    stop = end[ends[last]]
    files, start = [], 0
    for n, p, e in zip(units.tolist(), payloads, stop.tolist(), strict=True):
        down = -(-n // ACROSS)
        across = -(-n // down)
        more = b"".join(bytes([0xFF, 0xD0 + (k - 1) % 8]) + _BLANK for k in range(n, across * down))
        files.append(_head(len(p), across, down) + out[start:e].tobytes() + more + b"\xff\xd9")
        start = e
    return files


@dataclass
class Header:
    """What the markers say. parts: of each component (id, across, down, quantiser, DC table, AC table)."""

    width: int = 0
    height: int = 0
    restart: int = 0
    parts: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[tuple[int, int], bytes] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)
    scan: int = 0

    def layout(self) -> tuple:
        return (tuple(self.parts), tuple(sorted(self.codes.items())))

    def units(self) -> tuple[int, int]:
        """Minimum coded units across and down."""
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.parts) == 1:
            h = v = 1
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes) -> Header | None:
    """The header of a baseline JPEG with one interleaved scan; None for anything else."""
    if data[:2] != b"\xff\xd8":
        return None
    out, i, frame = Header(), 2, []
    try:
        while True:
            if data[i] != 0xFF:
                return None
            while data[i + 1] == 0xFF:
                i += 1
            marker, n = data[i + 1], int.from_bytes(data[i + 2 : i + 4], "big")
            body = data[i + 4 : i + 2 + n]
            if n < 2 or len(body) != n - 2:
                return None
            i += 2 + n
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    size = 64 * (1 + wide)
                    out.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8, 64).astype(np.int64)
                    body = body[1 + size :]
            elif marker == 0xC4:
                while body:
                    size = 17 + sum(body[1:17])
                    out.codes[(body[0] >> 4, body[0] & 15)] = body[1:size]
                    body = body[size:]
            elif marker == 0xC0:
                if body[0] != 8:
                    return None
                out.height, out.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                frame = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            elif marker == 0xDD:
                out.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xFE:
                out.comments.append(bytes(body))
            elif marker == 0xDA:
                tables = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
                if not frame or set(tables) != {p[0] for p in frame} or not out.width or not out.height:
                    return None
                out.parts = [(*p, tables[p[0]] >> 4, tables[p[0]] & 15) for p in frame]
                if any((0, p[4]) not in out.codes or (1, p[5]) not in out.codes or p[3] not in out.quant or not p[1] or not p[2] for p in out.parts):
                    return None
                out.scan = i
                return out
            elif 0xC1 <= marker <= 0xCF or marker == 0xD9:
                return None
    except IndexError:
        return None


_LOOKUP: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """For each next 16 bits: length of the code << 8 | symbol; 0 where there is no code."""
    if table not in _LOOKUP:
        out, code, k = np.zeros(1 << 16, np.int32), 0, 16
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | table[k]
                code, k = code + 1, k + 1
            code <<= 1
        if len(_LOOKUP) > 64:
            _LOOKUP.clear()
        _LOOKUP[table] = out
    return _LOOKUP[table]


def _segments(data: np.ndarray, start: int) -> tuple[list[tuple[int, int]], int]:
    """Byte ranges of the restart segments from ``start`` on, and the end of the scan."""
    ff = np.flatnonzero(data[start:-1] == 0xFF) + start
    nxt = data[ff + 1]
    marks = ff[(nxt != 0) & (nxt != 0xFF)]
    kinds = data[marks + 1]
    stop = np.flatnonzero((kinds < 0xD0) | (kinds > 0xD7))
    n = int(stop[0]) if len(stop) else len(marks)
    end = int(marks[n]) if n < len(marks) else len(data)
    return list(zip([start, *(marks[:n] + 2).tolist()], [*marks[:n].tolist(), end], strict=True)), end


class _Lanes:
    """Restart segments with the same layout, Huffman-decoded in step: one symbol of every lane at a time."""

    def __init__(self, stream: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        b = np.concatenate([stream, np.full(8, 255, np.uint8)]).astype(np.uint32)
        self.word = b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]
        self.at, self.stop = start * 8, end * 8
        self.ok = np.ones(len(start), bool)

    def symbol(self, lut: np.ndarray, i: np.ndarray | slice) -> np.ndarray:
        at = np.minimum(self.at[i], 8 * (len(self.word) - 1))
        got = lut[(self.word[at >> 3] >> (16 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)]
        self.at[i] = at + (got >> 8)
        return np.where(got > 0, got & 255, -1)

    def extra(self, n: np.ndarray, i: np.ndarray | slice) -> np.ndarray:
        """The next n bits, extended to a coefficient."""
        at = np.minimum(self.at[i], 8 * (len(self.word) - 1))
        bits = ((self.word[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(16)).astype(np.int32) >> (16 - n)
        self.at[i] = at + n
        return np.where((n > 0) & (bits < (1 << np.maximum(n - 1, 0))), bits - (1 << n) + 1, bits)


def decode(files: list[bytes]) -> list[tuple[Header, list[np.ndarray]] | None]:
    """Header and quantised coefficients of each file, in scan order: of each component an array (units, blocks, 64). None where a file is no sound baseline JPEG."""
    out: list = [None] * len(files)
    groups: dict[tuple, list[tuple[int, Header]]] = {}
    for i, data in enumerate(files):
        if (h := parse(data)) is not None:
            groups.setdefault(h.layout(), []).append((i, h))
    for group in groups.values():
        raw, starts, ends, counts, spans, base = [], [], [], [], [], 0
        for i, h in group:
            data = np.frombuffer(files[i], np.uint8)
            segs, end = _segments(data, h.scan)
            across, down = h.units()
            total = across * down
            want = -(-total // h.restart) if h.restart else 1
            whole = len(segs) == want
            spans.append((len(counts), len(counts) + (want if whole else 0), whole))
            if whole:
                starts += [base + s - h.scan for s, _ in segs]
                ends += [base + e - h.scan for _, e in segs]
                counts += [min(h.restart, total - k * h.restart) for k in range(want)] if h.restart else [total]
                raw.append(data[h.scan : end])
                base += end - h.scan
        if not counts:
            continue
        flat = np.concatenate(raw)
        keep = np.ones(len(flat), bool)
        keep[1:] = ~((flat[1:] == 0) & (flat[:-1] == 0xFF))
        moved = np.concatenate([[0], np.cumsum(keep)])
        parts = group[0][1].parts
        lanes = _Lanes(flat[keep], moved[starts], moved[ends])
        per = [(p[1] * p[2] if len(parts) > 1 else 1) for p in parts]
        number = np.array(counts)
        where = np.cumsum(number) - number
        coef = [np.zeros((int(number.sum()), n, 64), np.int16) for n in per]
        pred = np.zeros((len(parts), len(number)), np.int32)
        codes = group[0][1].codes
        for unit in range(int(number.max())):
            live = np.flatnonzero((number > unit) & lanes.ok)
            for c, p in enumerate(parts):
                dc, ac = _lookup(codes[(0, p[4])]), _lookup(codes[(1, p[5])])
                for block in range(per[c]):
                    _block(lanes, live, dc, ac, pred[c], coef[c][:, block], where + unit)
        lanes.ok &= lanes.at <= lanes.stop
        for (i, h), (a, z, whole) in zip(group, spans, strict=True):
            if whole and lanes.ok[a:z].all():
                s, e = where[a], where[z - 1] + number[z - 1]
                out[i] = (h, [x[s:e] for x in coef])
    return out


def _block(lanes: _Lanes, live: np.ndarray, dc: np.ndarray, ac: np.ndarray, pred: np.ndarray, coef: np.ndarray, row: np.ndarray) -> None:
    """Decode one block of every live lane into coef[row[lane]]."""
    size = lanes.symbol(dc, live)
    lanes.ok[live] &= (size >= 0) & (size <= 11)
    size = np.clip(size, 0, 11)
    pred[live] += lanes.extra(size, live)
    coef[row[live], 0] = pred[live]
    k = np.ones(len(live), np.int64)
    while len(live):
        got = lanes.symbol(ac, live)
        run, size = got >> 4, got & 15
        more = (got >= 0) & ((size > 0) | (run == 15))
        lanes.ok[live] &= got >= 0
        k += np.where(more & (size == 0), 16, run)
        value = lanes.extra(np.where(more, size, 0), live)
        fits = more & (k < 64)
        put = fits & (size > 0)
        if put.all():
            coef[row[live], k] = value
            k += 1
        else:
            coef[row[live[put]], k[put]] = value[put]
            k[put] += 1
            lanes.ok[live] &= ~(more & (k > 64))
        go = fits & (k < 64)
        if not go.all():
            live, k = live[go], k[go]


def thumbnail(h: Header, coef: list[np.ndarray]) -> np.ndarray:
    """One pixel a luminance block, from its DC alone."""
    across, down = h.units()
    _, x, y, q, _, _ = h.parts[0]
    if len(h.parts) == 1:
        x = y = 1
    dc = coef[0][:, :, 0].astype(np.int64).reshape(down, across, y, x).transpose(0, 2, 1, 3).reshape(down * y, across * x)
    return np.clip((dc * h.quant[q][0] + 4) // 8 + 128, 0, 255).astype(np.uint8)


def feature(h: Header, coef: list[np.ndarray]) -> str:
    """Dimensions, a digest of the thumbnail, and the 64-bit average hash of it cut into 8 x 8 cells."""
    t = thumbnail(h, coef)
    flat = t.ravel().astype(np.int64)
    edge = np.arange(65) * len(flat) // 64
    cell = np.concatenate([[0], np.cumsum(flat)])
    n = np.maximum(edge[1:] - edge[:-1], 1)
    mean = (cell[np.maximum(edge[1:], np.minimum(edge[:-1] + 1, len(flat)))] - cell[edge[:-1]]) / n
    ahash = int.from_bytes(np.packbits(mean >= mean.mean()).tobytes(), "big")
    return f"{h.width}x{h.height}:{hashlib.sha256(t.tobytes()).hexdigest()[:16]}:{ahash:016x}"


def payload(h: Header, coef: list[np.ndarray]) -> bytes:
    """The bytes that ``encode`` stored."""
    size = int(h.comments[0].removeprefix(b"payload="))
    flat = np.stack([c[:, 0] for c in coef], axis=1).reshape(-1)[:size]
    return np.where(flat < 0, flat + 255, flat).astype(np.uint8).tobytes()


MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Store each whole text as a baseline JPEG, read it back, and describe both.

    One row for each input row, no shuffle: id_col, n_bytes, payload_bytes, payload_sha256 (of the payload as read back),
    tail_crc32, media_bytes, media_sha256, feature, and the file itself as ``media`` if asked for. A null text is empty; an
    empty text is one unit of blanks; null ids, repeated rows and further columns of any name pass (those are not returned).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole):
                buf, at = text_buffer(b.column("text"))
                data = buf.tobytes()
                texts = [data[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                files = encode([pad(t) for t in texts])
                rows = []
                for t, f, got in zip(texts, files, decode(files), strict=True):
                    back = payload(*got)
                    rows.append((len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(f), hashlib.sha256(f).hexdigest(), feature(*got)))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                arrays = [b.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
                names = ["id", *(x.split()[0] for x in MEDIA.split(", "))]
                if with_media:
                    arrays.append(pa.array(files, pa.binary()))
                    names.append("media")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    got = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {MEDIA}" + ", media binary" * with_media)
    return got.withColumnRenamed("id", id_col)


def thumbnails(df: DataFrame, content_col: str = "content") -> DataFrame:
    """Dimensions and thumbnail hashes of a column of JPEG files, beside the columns of ``df``.

    Adds media_width, media_height, media_thumbnail (bytes, row by row), media_feature; all null for a null, or a file that is
    no sound baseline JPEG with one scan. Columns of ``df`` with these names are replaced.
    """
    names = ["media_width", "media_height", "media_thumbnail", "media_feature"]
    base = df.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = [x or b"" for x in b.column(content_col).to_pylist()]
            got = decode(files)
            cols = [
                pa.array([g and g[0].width for g in got], pa.int32()),
                pa.array([g and g[0].height for g in got], pa.int32()),
                pa.array([g and thumbnail(*g).tobytes() for g in got], pa.binary()),
                pa.array([g and feature(*g) for g in got], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *names])

    from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

    kinds = [IntegerType(), IntegerType(), BinaryType(), StringType()]
    schema = StructType([*base.schema.fields, *(StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    return base.mapInArrow(run, schema)


def op10_media_jpeg(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents stored as baseline JPEG and read back."""
    return store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
