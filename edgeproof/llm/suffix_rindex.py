"""Suffix-array dedup: a run-length index.

A byte is removed if a string of ``width`` bytes covers it that also starts anywhere else. Equal strings have the same anchor, the
least of their shorter grams by hash, at the same place; strings in a row with one anchor occurrence form a segment. First the
chunks ask whether a segment occurs again as a whole (then all its strings do; two 64-bit hashes must agree) and how many different
segments have its anchor. Only where different segments share an anchor are their bytes sent, each different segment once: there a suffix array gives
a run-compressed Burrows-Wheeler transform with suffix positions sampled at both ends of its runs. Longest common prefixes are
compared at these samples alone; streamed along the text they give every position's matching statistic, the length of its longest
match elsewhere, and mark the long matches. Anchors with very many different segments go another exact way, so that no group grows with
the corpus: their strings are counted by hash range, each once a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _exchange as ex
from ._arrow import BYTE, mix, prefix_hash, range_hash

#: Bytes of a string, and of an anchor.
WIDTH, GRAM = 400, 200
#: Anchors with more different segments than this are resolved by counting strings.
CROWD = 256
#: Bytes of segments that an index holds, whole anchors together.
INDEX_BYTES = 1 << 20
_ONE, _TWO = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def suffix_array(packed: np.ndarray, symbols: int) -> np.ndarray:
    """Suffixes in order. packed: of each place the next ``symbols`` symbols as one number; the text's last symbol is unique and least."""
    n = len(packed)
    order = np.argsort(packed, kind="stable")
    new = np.append(True, packed[order][1:] != packed[order][:-1])
    start = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = start[np.cumsum(new) - 1]
    step = symbols
    alone = new & np.append(new[1:], True)
    open_ = order[~alone]  # suffixes that are not told apart, by rank
    while len(open_):
        old = rank[open_]
        far = open_ + step
        key = old * (n + 1) + np.where(far < n, rank[np.minimum(far, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        open_, key, old = open_[by], key[by], old[by]
        group = np.append(True, old[1:] != old[:-1])
        new = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(group)[np.cumsum(group) - 1]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        rank[open_] = old + head - first
        alone = new & np.append(new[1:], True)
        open_ = open_[~alone]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


@dataclass
class RunLengthIndex:
    """Runs of the transform: symbol, first place, and the text positions of the suffixes at the first and last place of each.

    text: the symbols (byte + 2; 1 between segments; 0 at the end), packed: seven of them at each place.
    """

    text: np.ndarray
    packed: np.ndarray
    symbol: np.ndarray
    start: np.ndarray
    head: np.ndarray
    tail: np.ndarray

    SYMBOLS = 7

    @staticmethod
    def of(segments: list[np.ndarray]) -> RunLengthIndex:
        size = sum(len(s) + 1 for s in segments) + 1
        text, at = np.ones(size, np.int64), 0
        for s in segments:
            text[at : at + len(s)] = s.astype(np.int64) + 2
            at += len(s) + 1
        text[-1] = 0
        more = np.concatenate([text, np.zeros(RunLengthIndex.SYMBOLS, np.int64)])
        packed = np.zeros(size, np.int64)
        for k in range(RunLengthIndex.SYMBOLS):
            packed = packed << 9 | more[k : k + size]
        sa = suffix_array(packed, RunLengthIndex.SYMBOLS)
        bwt = text[sa - 1]
        start = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
        end = np.append(start[1:], size) - 1
        index = RunLengthIndex(text, packed, bwt[start], start, sa[start], sa[end])
        return index

    def _common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefix of the suffixes at i and j."""
        k, n = self.SYMBOLS, len(self.text)
        out, live = np.zeros(len(i), np.int64), np.arange(len(i))
        while len(live):
            a, b = i[live] + out[live], j[live] + out[live]
            inside = (a < n) & (b < n)
            x = np.where(inside, self.packed[np.minimum(a, n - 1)] ^ self.packed[np.minimum(b, n - 1)], 1 << 62)
            same = x == 0
            rest = x[~same]
            bit = np.floor(np.log2(rest.astype(np.float64))).astype(np.int64)
            bit -= (rest >> bit) == 0  # the logarithm may round up
            out[live[~same]] += (9 * k - 1 - bit) // 9
            live = live[same]
            out[live] += k
        return out

    def matching_statistics(self) -> np.ndarray:
        """Of each text position the length of its longest match with another one.

        With the neighbour before in suffix order, the length drops by one from position to position but where a run starts; with the
        one after, but where a run ends. So lengths are compared at these samples, and streamed on.
        """
        n, best = len(self.text), np.zeros(len(self.text), np.int64)
        for own, other in ((self.head[1:], self.tail[:-1]), (self.tail[:-1], self.head[1:])):
            value = np.full(n, -1)
            value[own] = self._common(own, other) + own
            known = np.maximum.accumulate(np.where(value >= 0, np.arange(n), -1))
            length = np.where(known >= 0, value[np.maximum(known, 0)] - np.arange(n), 0)
            best = np.maximum(best, length)
        return best


@dataclass
class Segments:
    """Of each segment: text, first and last string, anchor key and two hashes of its bytes; prefixes give the two hashes of any string."""

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    key: np.ndarray
    content: np.ndarray
    check: np.ndarray
    prefix: tuple[np.ndarray, np.ndarray]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return range_hash(self.prefix[0], start, end, _TWO), range_hash(self.prefix[1], start, end, _ONE)


def segments(buf: np.ndarray, at: np.ndarray, width: int, gram: int) -> Segments:
    none, zero = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(buf) - width + 1
    if n <= 0 or (np.diff(at) < width).all():
        return Segments(none, none, none, zero, zero, zero, (zero, zero))
    unit = BYTE[buf]
    prefix = (prefix_hash(unit, _TWO), prefix_hash(unit, _ONE))
    grams = range_hash(prefix[1], np.arange(len(buf) - gram + 1), np.arange(gram, len(buf) + 1), _ONE)
    place = ex.anchors(grams, width - gram + 1)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole = doc[:n] == doc[width - 1 :]
    new = whole & np.append(True, (place[1:] != place[:-1]) | (doc[1:n] != doc[: n - 1]) | ~whole[:-1])
    first = np.flatnonzero(new)
    end = whole & np.append(new[1:] | ~whole[1:], True)
    last = np.flatnonzero(end)
    # least hashes crowd the low ranges: mixed again, they spread
    out = Segments(doc[first], first, last, mix(grams[place[first]]), none, none, prefix)
    out.content, out.check = out.hashes(first, last + width)
    return out


def _mark(found: list[np.ndarray], keys: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each segment (in the order of keys, equal ones together) whether each of its strings also starts elsewhere among them."""
    out: list[np.ndarray] = []
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist() + [len(keys)] if len(keys) else []
    start = 0
    size = np.cumsum([0] + [len(s) + 1 for s in found])
    for e, following in zip(edge[1:], edge[2:] + [None], strict=True):
        if following is None or size[following] - size[start] > INDEX_BYTES:
            match = RunLengthIndex.of(found[start:e]).matching_statistics() >= width
            for k in range(start, e):
                s = size[k] - size[start]
                out.append(match[s : s + len(found[k]) - width + 1])
            start = e
    return out


def remove_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int | None = None, crowd: int = CROWD, buckets: int | None = None, kept: bool = False) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and spans (their byte ranges) of each row; with ``kept`` the remaining text, without the rest of a character that a removed run cuts.

    Strings are taken from the input, in any text, the same included, never across texts; repeated rows are texts of their own, so their
    strings repeat. Null texts are empty; texts shorter than ``width`` bytes stay. Ids are only passed on.
    """
    gram = gram or max(1, width // 2)
    table = ex.chunk_table(docs, id_col, text_col, "chunks")
    buckets = buckets or ex.ranges(table)

    def local(buf: np.ndarray, at: np.ndarray) -> tuple:
        """Segments; the different ones (name, an example, and to which each belongs); the different anchors, and to which each different segment belongs."""
        s = segments(buf, at, width, gram)
        names = mix(s.key * np.uint64(3) ^ s.content)
        example, inv = ex.distinct(names, s.check)
        anchor, of = np.unique(s.key[example], return_inverse=True)
        return s, names[example], example, inv, anchor, of

    def ask(buf: np.ndarray, at: np.ndarray, *_) -> Iterator[tuple[int, int, bytes]]:
        s, name, example, inv, anchor, of = local(buf, at)
        more = np.bincount(inv, minlength=len(name)) > 1
        for b, x, y in ex.parts(name, buckets):
            yield b, 1, ex.squeeze(ex.deltas(name[x:y]), s.check[example[x:y]], np.packbits(more[x:y]))
        # of each anchor the least hashes of its different segments, as many as tell whether it is crowded
        by = np.lexsort((s.content[example], of))
        head = np.searchsorted(of[by], np.arange(len(anchor) + 1))
        by = by[np.arange(len(by)) - head[of[by]] <= crowd]
        content, cut = s.content[example[by]], np.searchsorted(of[by], np.arange(len(anchor) + 1))
        for b, x, y in ex.parts(anchor, buckets):
            yield b, 2, ex.squeeze(ex.deltas(anchor[x:y]), np.diff(cut[x : y + 1]).astype(np.uint32), content[cut[x] : cut[y]])

    def reply(kind: int, got: list[tuple[int, bytes]]) -> list[bytes]:
        each = [ex.expand(body) for _, body in got]
        keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in each])
        if kind in (1, 4):
            u, inv = ex.distinct(keys, np.concatenate([p[1] for p in each]))
            more = np.concatenate([np.unpackbits(p[2], count=len(p[0])) for p in each]).astype(np.int64) + 1
            again = (np.bincount(inv, more, len(u)) > 1)[inv]
            first = np.zeros(len(inv), bool)
            first[u] = True  # one chunk that has it
            bits = (again, first) if kind == 1 else (again,)
        else:
            u, inv = np.unique(keys, return_inverse=True)
            of = np.repeat(inv, np.concatenate([p[1] for p in each]).astype(np.int64))
            kinds = np.bincount(of[ex.distinct(of, np.concatenate([p[2] for p in each]))[0]], minlength=len(u))
            bits = ((kinds > 1)[inv], (kinds > crowd)[inv])
        cut = np.cumsum([0] + [len(p[0]) for p in each])
        return [b"".join(np.packbits(x[s:e]).tobytes() for x in bits) for s, e in zip(cut[:-1], cut[1:], strict=True)]

    def read(got: dict, kind: int, sorted_keys: np.ndarray, n: int) -> list[np.ndarray]:
        """The answers' bits for each key."""
        out = [np.zeros(len(sorted_keys), bool) for _ in range(n)]
        for b, x, y in ex.parts(sorted_keys, buckets):
            raw = np.frombuffer(got[(kind, b)], np.uint8).reshape(n, -1)
            for o, r in zip(out, raw, strict=True):
                o[x:y] = np.unpackbits(r, count=y - x)
        return out

    def state(buf: np.ndarray, at: np.ndarray, b: pa.RecordBatch, row: int) -> tuple:
        """What a chunk knows after the first answers: segments, inverse, examples, which different segments repeat as a whole, and which to compare by index or by strings (in the order of keys)."""
        s, name, example, inv, anchor, of = local(buf, at)
        got = ex.bodies(b, "first_answers", row)
        again, own = read(got, 1, name, 2)
        mixed, crowded = read(got, 2, anchor, 2)
        ship = own & mixed[of]
        by = np.argsort(s.key[example], kind="stable")
        by = by[ship[by]]
        return s, inv, example, again, by[~crowded[of][by]], by[crowded[of][by]]

    def strings(s: Segments, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bytes of all strings of these segments, and to which segment each belongs."""
        n = s.last[pick] - s.first[pick] + 1
        return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s.first[pick], n), np.repeat(np.arange(len(pick)), n)

    def crowds(s: Segments, pick: np.ndarray) -> tuple:
        """First bytes of the strings of crowded segments, their two hashes, an example of each different string in order, and to which each belongs."""
        first, _ = strings(s, pick)
        h, check = s.hashes(first, first + width)
        return first, h, check, *ex.distinct(h, check)

    def compare(buf: np.ndarray, at: np.ndarray, b: pa.RecordBatch, row: int) -> Iterator[tuple[int, int, bytes]]:
        s, _, example, again, index, crowded = state(buf, at, b, row)
        key = s.key[example[index]]
        for k, x, y in ex.parts(key, buckets):
            own = example[index[x:y]]
            text = np.concatenate([buf[i : j + width] for i, j in zip(s.first[own].tolist(), s.last[own].tolist(), strict=True)])
            yield k, 3, ex.squeeze(ex.deltas(s.key[own]), (s.last[own] - s.first[own] + width).astype(np.uint32), again[index[x:y]], text)
        h, check, one, inv = crowds(s, example[crowded])[1:]
        more = np.bincount(inv, minlength=len(one)) > 1
        for k, x, y in ex.parts(h[one], buckets):
            yield k, 4, ex.squeeze(ex.deltas(h[one[x:y]]), check[one[x:y]], np.packbits(more[x:y]))

    def judge(kind: int, got: list[tuple[int, bytes]]) -> list[bytes]:
        if kind == 4:
            return reply(4, got)
        found, keys, need, owner = [], [], [], []
        for k, (_, body) in enumerate(got):
            key, size, again, text = ex.expand(body)
            cut = np.cumsum(np.append(0, size.astype(np.int64)))
            found += [text[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
            keys.append(np.cumsum(key))
            need.append(~again.astype(bool))
            owner.append(np.full(len(key), k))
        keys, need, owner = np.concatenate(keys), np.concatenate(need), np.concatenate(owner)
        by = np.argsort(keys, kind="stable")
        flags = _mark([found[i] for i in by.tolist()], keys[by], width)
        out: list[list[np.ndarray]] = [[] for _ in got]
        for i, f in zip(by.tolist(), flags, strict=True):
            if need[i]:
                out[owner[i]].append(f)  # within a message, segments are in the order of keys
        return [np.packbits(np.concatenate(x)).tobytes() if x else b"" for x in out]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                buf, at = ex.unpacked(b, row)
                s, inv, example, again, index, crowded = state(buf, at, b, row)
                got = ex.bodies(b, "answers", row)
                edge = np.zeros(len(buf) + 1, np.int64)
                whole = np.flatnonzero(again[inv])
                np.add.at(edge, s.first[whole], 1)
                np.add.at(edge, s.last[whole] + width, -1)
                for k, x, y in ex.parts(s.key[example[index]], buckets):
                    own = example[index[x:y][~again[index[x:y]]]]
                    if len(own):
                        first, _ = strings(s, own)
                        hit = first[np.unpackbits(np.frombuffer(got[(3, k)], np.uint8), count=len(first)).astype(bool)]
                        np.add.at(edge, hit, 1)
                        np.add.at(edge, hit + width, -1)
                if len(crowded):
                    first, h, _, one, of = crowds(s, example[crowded])
                    hit = first[read(got, 4, h[one], 1)[0][of]]
                    np.add.at(edge, hit, 1)
                    np.add.at(edge, hit + width, -1)
                gone = np.cumsum(edge)[:-1] > 0
                total = np.append(0, np.cumsum(gone))
                cutoff = np.zeros(len(buf) + 1, bool)
                cutoff[at] = True
                start = np.flatnonzero(gone & (np.append(True, ~gone[:-1]) | cutoff[:-1])[: len(gone)])
                end = np.flatnonzero(gone & (np.append(~gone[1:], True) | cutoff[1:])[: len(gone)]) + 1
                of = np.searchsorted(start, at)
                text, clean = [], []
                for d in range(len(at) - 1):
                    x, y = at[d], at[d + 1]
                    part = buf[x:y]
                    text.append(part[~gone[x:y]].tobytes() if of[d + 1] > of[d] else part.tobytes())
                    if kept:
                        # what is left of a character cut by a run can't be decoded
                        bounds = np.concatenate([[x], np.stack([start[of[d] : of[d + 1]], end[of[d] : of[d + 1]]], 1).ravel(), [y]]).reshape(-1, 2)
                        clean.append("".join(buf[u:v].tobytes().decode("utf-8", "ignore") for u, v in bounds))
                base = np.repeat(at[:-1], np.diff(of))
                spans = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], names=["start", "end"]))
                cols = [b.column("ids")[row].values, pa.array(np.diff(at)), pa.array(total[at[1:]] - total[at[:-1]]), pa.array(np.diff(of)), pa.array([hashlib.sha256(t).hexdigest() for t in text]), spans]
                names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
                if kept:
                    cols.append(pa.array(clean, pa.string()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    one = ex.answered(table, ex.answer(ex.send(table, ask), buckets, reply), "first_answers")
    two = ex.answered(one, ex.answer(ex.send(one, compare), buckets, judge), "answers")
    kind = docs.schema[id_col].dataType.simpleString()
    got = two.mapInArrow(finish, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>" + ", kept string" * kept)
    return got.withColumnRenamed("id", id_col)


def op1_suffix_rindex(spark, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that start again anywhere removed from every whole text of documents."""
    return remove_matches(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
