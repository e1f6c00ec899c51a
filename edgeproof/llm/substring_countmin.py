"""Substring dedup: count-min prefilter.

A window is so many consecutive words. First all windows are counted in a count-min sketch of two rows: each chunk makes a sparse sketch
of its own windows, the sketches are merged by range of cells (counters that stop at two), and each range answers a chunk which of its
cells hold two or more. A window's estimate is the lesser of its two cells, so never too low. The second pass sends only windows
estimated to be repeated to an exact grouping, which tells each chunk whether its first occurrence of a window is the first of all; one
estimated so in vain is found single there. The sketch has so many cells for a word of the corpus, in parts by range, and is never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _exchange as ex
from ._arrow import mix, prefix_hash, range_hash, word_bounds, word_hashes

#: Words of a window.
WINDOW = 20
#: Cells of the sketch for each word of the corpus (both rows), and bytes a word is taken to have.
CELLS_A_WORD, WORD_BYTES = 8, 6
#: Bytes of text that ask together.
ASK = 4 << 20
_BASE, _CHECK = 0xC2B2AE3D27D4EB4F, 0x9E3779B97F4A7C15


@dataclass
class Windows:
    """Words of a chunk; of each window its first word and text."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    words: np.ndarray
    at: np.ndarray
    doc: np.ndarray

    def hashes(self, width: int) -> np.ndarray:
        return range_hash(prefix_hash(self.words, _BASE), self.at, self.at + width, _BASE)

    def checks(self, pick: np.ndarray, width: int) -> np.ndarray:
        """A second hash of some windows, of 32 bits."""
        return (range_hash(prefix_hash(mix(self.words), _CHECK), self.at[pick], self.at[pick] + width, _CHECK) >> np.uint64(32)).astype(np.uint32)


def windows(buf: np.ndarray, at: np.ndarray, width: int) -> Windows:
    start, end, first = word_bounds(buf, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    n = max(0, len(start) - width + 1)
    whole = np.flatnonzero(doc[:n] == doc[width - 1 :][:n])
    return Windows(start, end, first, word_hashes(buf, start, end), whole, doc[whole])


def cells_of(h: np.ndarray, cells: int) -> np.ndarray:
    """Cells of a window in the two rows, side by side."""
    half = np.uint64(cells // 2)
    return np.stack([mix(h) % half, mix(h ^ np.uint64(0x9E3779B97F4A7C15)) % half + half])


def merged(got: list[tuple[int, bytes]], span: int) -> list[bytes]:
    """The sketches of a range of ``span`` cells merged; of each message's cells, which hold two or more."""
    count, each = np.zeros(span, np.uint8), []
    for _, body in got:
        step, more = ex.expand(body)
        cell = np.cumsum(step.astype(np.int64))
        count[cell] = np.minimum(count[cell] + 1 + np.unpackbits(more, count=len(cell)), 2)
        each.append(cell)
    return [np.packbits(count[cell] == 2).tobytes() for cell in each]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, cells: int | None = None, buckets: int | None = None, kept: bool = False) -> DataFrame:
    """id_col, n_words, n_removed, kept_sha256 of each row, and with ``kept`` the kept words as text, joined by one space.

    A word goes if a window covers it whose words also start earlier: in a text of a smaller id, or in the same text. Null ids come
    first, and ids that are no integers in the order of their hash; rows of one id are ordered by the window's place alone, and where that
    is the same neither is earlier, so a repeated row has the result of its first one. Null, empty and short texts have no windows and stay.
    """
    table = ex.chunk_table(docs, id_col, text_col, "chunks", ASK)
    buckets = buckets or ex.ranges(table)
    if cells is None:
        cells = max(1 << 12, CELLS_A_WORD * ex.text_bytes(table) // WORD_BYTES)
    cells += cells % 2
    span = -(-cells // buckets)

    def counted(buf: np.ndarray, at: np.ndarray) -> tuple[Windows, np.ndarray, np.ndarray, np.ndarray]:
        """Windows and their hashes; the different cells of all in order, and to which each window's two belong."""
        w = windows(buf, at, width)
        h = w.hashes(width)
        cell, inv = np.unique(cells_of(h, cells).ravel(), return_inverse=True)
        return w, h, cell, inv

    def count(buf: np.ndarray, at: np.ndarray, *_) -> Iterator[tuple[int, int, bytes]]:
        _, _, cell, inv = counted(buf, at)
        more = np.bincount(inv, minlength=len(cell)) > 1
        for k, s, e in ex.runs(cell // np.uint64(span)):
            yield k, 0, ex.squeeze(ex.deltas(cell[s:e] - np.uint64(k * span)).astype(np.uint32), np.packbits(more[s:e]))

    def estimate(buf: np.ndarray, at: np.ndarray, b: pa.RecordBatch, row: int) -> tuple[Windows, np.ndarray, np.ndarray]:
        """Windows, those estimated to be repeated, and their hashes."""
        w, h, cell, inv = counted(buf, at)
        got, twice = ex.bodies(b, "estimates", row), np.zeros(len(cell), bool)
        for k, s, e in ex.runs(cell // np.uint64(span)):
            twice[s:e] = np.unpackbits(np.frombuffer(got[(0, k)], np.uint8), count=e - s)
        pick = np.flatnonzero(twice[inv].reshape(2, -1).all(axis=0))
        return w, pick, h[pick]

    def order(b: pa.RecordBatch, row: int) -> np.ndarray:
        ids = b.column("ids")[row].values
        if pa.types.is_integer(ids.type):
            return np.where(ids.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).min, ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
        return np.array([np.iinfo(np.int64).min if x is None else int.from_bytes(hashlib.sha256(str(x).encode()).digest()[:7], "big") for x in ids.to_pylist()], np.int64)

    def entries(buf: np.ndarray, at: np.ndarray, b: pa.RecordBatch, row: int) -> tuple:
        """Windows; those estimated to be repeated; the two hashes of the different ones; to which each belongs; rank and place of each; the first of each different one; and the ids by rank."""
        w, pick, h = estimate(buf, at, b, row)
        check = w.checks(pick, width)
        one, inv = ex.distinct(h, check)
        ids = order(b, row)
        by_rank, rank = np.unique(ids, return_inverse=True)
        pos = w.at[pick] - w.first[w.doc[pick]]
        key = (rank[w.doc[pick]] << 40) + pos
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, inv, key)
        return w, pick, h[one], check[one], inv, key, least, by_rank

    def ask(buf: np.ndarray, at: np.ndarray, b: pa.RecordBatch, row: int) -> Iterator[tuple[int, int, bytes]]:
        _, _, u, check, _, _, least, ids = entries(buf, at, b, row)
        for k, s, e in ex.parts(u, buckets):
            yield k, 1, ex.squeeze(ex.deltas(u[s:e]), check[s:e], ids[least[s:e] >> 40], (least[s:e] & ((1 << 40) - 1)).astype(np.uint32))

    def reply(_: int, got: list[tuple[int, bytes]]) -> list[bytes]:
        each = [ex.expand(body) for _, body in got]
        h = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in each])
        check, ids, pos = (np.concatenate([p[i] for p in each]) for i in (1, 2, 3))
        by = np.lexsort((pos, ids, check, h))
        new = np.append(True, (h[by][1:] != h[by][:-1]) | (check[by][1:] != check[by][:-1]))
        head = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
        own = np.empty(len(h), bool)
        own[by] = (ids[by] == ids[head]) & (pos[by] == pos[head])
        cut = np.cumsum([0] + [len(p[0]) for p in each])
        return [np.packbits(own[s:e]).tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                buf, at = ex.unpacked(b, row)
                w, pick, u, _, inv, key, least, _ = entries(buf, at, b, row)
                got, own = ex.bodies(b, "answers", row), np.zeros(len(u), bool)
                for k, s, e in ex.parts(u, buckets):
                    own[s:e] = np.unpackbits(np.frombuffer(got[(1, k)], np.uint8), count=e - s)
                again = pick[~(own[inv] & (key == least[inv]))]
                edge = np.zeros(len(w.start) + 1, np.int64)
                np.add.at(edge, w.at[again], 1)
                np.add.at(edge, w.at[again] + width, -1)
                gone = np.cumsum(edge)[:-1] > 0
                total = np.append(0, np.cumsum(gone))
                removed = total[w.first[1:]] - total[w.first[:-1]]
                raw, texts = buf.tobytes(), []
                for d in range(len(at) - 1):
                    words = raw[at[d] : at[d + 1]].split()
                    if removed[d]:
                        words = [x for x, g in zip(words, gone[w.first[d] : w.first[d + 1]].tolist(), strict=True) if not g]
                    texts.append(b" ".join(words))
                cols = [b.column("ids")[row].values, pa.array(np.diff(w.first)), pa.array(removed), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                names = ["id", "n_words", "n_removed", "kept_sha256"]
                if kept:
                    cols.append(pa.array([t.decode() for t in texts]))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    estimated = ex.answered(table, ex.answer(ex.send(table, count), buckets, lambda _, got: merged(got, span)), "estimates")
    whole = ex.answered(estimated, ex.answer(ex.send(estimated, ask), buckets, reply), "answers")
    got = whole.mapInArrow(finish, f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * kept)
    return got.withColumnRenamed("id", id_col)


def op2_substring_countmin(spark, sf_dir: str) -> DataFrame:
    """Repeated windows of 20 words removed from every whole text of documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 19) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY sha256(array_to_string(g, ' ')) ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM dup),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY word.p) AS t FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) AS BIGINT) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
