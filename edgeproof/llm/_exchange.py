"""Documents in chunks of bounded size, and messages between chunks and hash ranges.

Exact questions about passages of all documents (does this window occur elsewhere, and where first) are put by hash range: a chunk
sends each different hash once, as sorted arrays, whatever the number of its occurrences; the range answers each message in its
own order; and the chunk applies the answers to its texts. No passage, however common, gathers rows in one task, but one entry a
chunk, and no text is sent but the chunk's own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import chunks, text_buffer, written

MESSAGE = "bucket long, chunk long, kind long, body binary"
_MESSAGE = [("bucket", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int64()), ("body", pa.binary())]


#: Bytes of text whose hashes make a range; a range is answered in one task.
RANGE_BYTES = 32 << 20
#: Arrays of fewer bytes are sent as they are: compressed, they would be longer.
SMALL = 128
_PRESS, _RELEASE = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def press(data: bytes | np.ndarray) -> bytes:
    return _PRESS.compress(data)


def release(data: bytes, most: int = 0) -> bytes:
    return _RELEASE.decompress(data, max_output_size=most)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one length or several, by byte planes, compressed unless they are small."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        parts += [len(a).to_bytes(4, "little"), a.dtype.str.encode().ljust(4), planes]
    raw = b"".join(parts)
    return b"\0" + raw if len(raw) < SMALL else b"\1" + press(raw)


def expand(data: bytes) -> list[np.ndarray]:
    raw, out, at = (release(data[1:]) if data[0] else data[1:]), [], 0
    while at < len(raw):
        n, kind = int.from_bytes(raw[at : at + 4], "little"), np.dtype(raw[at + 4 : at + 8].decode().strip())
        at += 8
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def deltas(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=sorted_keys.dtype.type(0))


def range_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Hash range of each 64-bit hash, in the hashes' order."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def runs(sorted_ranges: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each range that occurs, with its first place and the one after its last."""
    edge = np.flatnonzero(np.append(True, sorted_ranges[1:] != sorted_ranges[:-1])[: len(sorted_ranges)]).tolist()
    yield from zip(sorted_ranges[edge].tolist(), edge, [*edge[1:], len(sorted_ranges)][: len(edge)], strict=True)


def parts(sorted_keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """Each hash range that sorted hashes meet, with its first place and the one after its last; however many ranges there are, the others cost nothing."""
    return runs(range_of(sorted_keys, buckets))


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of hashes: where each different one stands first, in order, and to which of them each belongs."""
    by = np.lexsort((b, a))
    new = np.append(True, (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1]))[: len(a)]
    inv = np.empty(len(a), np.int64)
    inv[by] = np.cumsum(new) - 1
    return by[new], inv


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def chunk_table(docs: DataFrame, id_col: str, text_col: str, name: str, most: int = 1 << 20, gather: bool = False) -> DataFrame:
    """chunk (a number of its own), ids, at (offsets of the texts), text (UTF-8, compressed) and size (its bytes), of about ``most`` bytes of text a row or one longer document; written to the shared folder, so chunks stay what they are. ``gather``: texts are so short that a batch has fewer bytes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in gathered(batches, most) if gather else batches:
            for b in chunks(whole, most=most):
                buf, at = text_buffer(b.column("text"))
                ids = b.column("id")
                rows = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                cols = [pa.array([number]), rows, pa.array([at.astype("<i8").tobytes()]), pa.array([press(np.ascontiguousarray(buf))]), pa.array([len(buf)])]
                yield pa.RecordBatch.from_arrays(cols, names=["chunk", "ids", "at", "text", "size"])
                number += 1

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return written(own.mapInArrow(run, f"chunk long, ids array<{kind}>, at binary, text binary, size long"), name)


def text_bytes(table: DataFrame) -> int:
    """Bytes of text of all chunks."""
    return table.agg(F.sum("size")).first()[0] or 0


def ranges(table: DataFrame) -> int:
    """Number of hash ranges for a table of chunks: the session's shuffle partitions, or more, so that a range stays as large as it is at any size of the corpus."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(table) // RANGE_BYTES))


def unpacked(table: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a chunk."""
    at = np.frombuffer(table.column("at")[row].as_py(), "<i8")
    raw = release(table.column("text")[row].as_py(), max(1, int(at[-1])))
    return np.frombuffer(raw, np.uint8), at


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _MESSAGE, strict=True)], names=[n for n, _ in _MESSAGE])


def send(table: DataFrame, ask: Callable[[np.ndarray, np.ndarray, pa.RecordBatch, int], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """Messages (bucket, chunk, kind, body) of every chunk: ask(bytes, offsets, batch, row) gives (bucket, kind, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                chunk = b.column("chunk")[row].as_py()
                yield messages([(bucket, chunk, kind, body) for bucket, kind, body in ask(*unpacked(b, row), b, row)])

    return table.mapInArrow(run, MESSAGE)


def answer(sent: DataFrame, buckets: int, reply: Callable[[int, list[tuple[int, bytes]]], list[bytes]]) -> DataFrame:
    """An answer to each message: reply(kind, messages of a range, as (chunk, body) by chunk) gives one for each."""

    def run(table: pa.Table) -> pa.Table:
        order = sorted(zip(*(table[c].to_pylist() for c in ("kind", "chunk", "body")), strict=True))
        bucket, out = table["bucket"][0].as_py(), []
        for kind in sorted({k for k, _, _ in order}):
            own = [(c, body) for k, c, body in order if k == kind]
            out += [(bucket, c, kind, r) for (c, _), r in zip(own, reply(kind, own), strict=True)]
        return pa.Table.from_batches([messages(out)])

    # by number, so that ranges are not put together by their size: an answer may take long over few bytes
    return sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, MESSAGE)


def answered(table: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """The chunks with their answers as column ``name``: an array of (kind, bucket, body), in order; null without any."""
    own = answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("kind", "bucket", "body"))).alias(name))
    return table.join(own, "chunk", "left")


def bodies(batch: pa.RecordBatch, name: str, row: int) -> dict[tuple[int, int], bytes]:
    """Answers of a chunk by (kind, bucket)."""
    got = batch.column(name)[row].as_py() or []
    return {(x["kind"], x["bucket"]): x["body"] for x in got}


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


#: Low bits of a hash that give way to its place; the same everywhere, so that equal strings choose alike.
PLACE = 24


def anchors(gram: np.ndarray, width: int) -> np.ndarray:
    """Place of the least hash among each ``width`` consecutive ones: by its high bits, and the first of those equal in them. It hangs on these hashes alone, wherever they stand."""
    step = (1 << PLACE) - width
    if len(gram) > 1 << PLACE:
        return np.concatenate([anchors(gram[k : k + step + width - 1], width) + k for k in range(0, len(gram) - width + 1, step)])
    mask = np.uint64((1 << PLACE) - 1)
    place = np.arange(len(gram), dtype=np.uint64)
    return (sliding_min((gram & ~mask) | place, width) & mask).astype(np.int64)
