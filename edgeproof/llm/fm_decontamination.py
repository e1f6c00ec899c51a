"""Benchmark decontamination: an FM-index per training shard.

A shard is a slice of documents. Its words become symbols: those of the test phrases their own, all others one separator, and
stretches shorter than the shortest phrase are left out, as no phrase can lie there. Over this text stands an FM-index: Burrows-
Wheeler transform, wavelet-matrix ranks, and suffix positions sampled by text position. All phrases are searched backward at
once, occurrences are located by walking to a sampled position, and their word ranges merged into removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import chunks, text_buffer, word_bounds, word_hashes

#: Words of a phrase; a shorter item is one phrase.
WINDOW = 13
#: A document is contaminated from one hit word in so many.
PART = 20
#: Test texts are searched in blocks of about so many bytes, one broadcast and one pass over the documents for each.
BLOCK_BYTES = 8 << 20
#: Every so many-th position of the text is sampled.
SAMPLE = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[97:123] = _BREAK[128:] = False


def words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of the lower-cased texts, and the first word of each text."""
    low = _LOWER[buf]
    start, end, first = word_bounds(low, at, _BREAK)
    return start, end, word_hashes(low, start, end), first


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; the last symbol must be the smallest and occur once."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.append(False, key[order][1:] != key[order][:-1]))
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search and location over a text of symbols from 1 on (0 is the end marker)."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE) -> None:
        text = np.append(text, 0)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.levels = max(1, int(text.max()).bit_length())
        # wavelet matrix: of each level, from the highest bit, how many ones stand before each place
        self.ones, self.zeros, now = [], [], bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.append(0, np.cumsum(bit)).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.count = np.append(0, np.cumsum(np.bincount(text, minlength=1 << self.levels)))
        self.base = self._down(np.arange(1 << self.levels), np.zeros(1 << self.levels, np.int64))
        at = np.flatnonzero(sa % sample == 0)
        self.place, self.value, self.marked = at, sa[at], np.zeros(len(sa), bool)
        self.marked[at] = True
        self.size = len(sa)

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ones[i]
            i = np.where((symbol >> (self.levels - 1 - k)) & 1, zeros + one, i - one)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i of the transform."""
        return self._down(symbol, i) - self.base[symbol]

    def back(self, i: np.ndarray) -> np.ndarray:
        """The places of the suffixes one symbol longer."""
        symbol = np.zeros(len(i), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one = ones[i]
            bit = ones[i + 1] - one
            symbol = symbol * 2 + bit
            i = np.where(bit, zeros + one, i - one)
        return self.count[symbol] + i - self.base[symbol]

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of places whose suffixes start with each pattern (rows, of ``length`` symbols, all below the largest of the levels)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for k in range(patterns.shape[1]):
            live = np.flatnonzero((k < length) & (lo < hi))
            if not len(live):
                break
            symbol = patterns[live, length[live] - 1 - k]
            lo[live] = self.count[symbol] + self.rank(symbol, lo[live])
            hi[live] = self.count[symbol] + self.rank(symbol, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes at places i."""
        i, out, walked = i.copy(), np.full(len(i), -1, np.int64), np.zeros(len(i), np.int64)
        todo = np.arange(len(i))
        while len(todo):
            here = self.marked[i[todo]]
            done = todo[here]
            out[done] = self.value[np.searchsorted(self.place, i[done])] + walked[done]
            todo = todo[~here]
            i[todo] = self.back(i[todo])
            walked[todo] += 1
        return out


@dataclass
class Phrases:
    """Different phrases of a block of test items: vocabulary (sorted hashes), symbols by row, lengths, and their items (by phrase, from first)."""

    vocabulary: np.ndarray
    rows: np.ndarray
    length: np.ndarray
    items: np.ndarray
    first: np.ndarray
    names: list[str]

    @staticmethod
    def of(items: list[tuple[str | None, str]], window: int = WINDOW) -> Phrases:
        names = sorted({i for i, _ in items if i is not None})
        number = {n: k for k, n in enumerate(names)}
        data = [t.encode() for _, t in items]
        _, _, h, first = words(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64))
        vocabulary = np.unique(h)
        symbol = np.searchsorted(vocabulary, h) + 2
        found: dict[tuple, set[int]] = {}
        for (name, _), s, e in zip(items, first[:-1].tolist(), first[1:].tolist(), strict=True):
            for k in range(s, max(s + 1, e - window + 1) if e > s else s):
                found.setdefault(tuple(symbol[k : min(e, k + window)].tolist()), set()).update([] if name is None else [number[name]])
        phrases = sorted(found)
        length = np.array([len(p) for p in phrases], np.int64)
        rows = np.zeros((len(phrases), int(length.max()) if len(phrases) else 0), np.int64)
        for k, p in enumerate(phrases):
            rows[k, : len(p)] = p
        own = [sorted(found[p]) for p in phrases]
        return Phrases(vocabulary, rows, length, np.array([i for o in own for i in o], np.int64), np.concatenate([[0], np.cumsum([len(o) for o in own])]).astype(np.int64), names)

    def find(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]], tuple[np.ndarray, np.ndarray]]:
        """Of a shard: first word of each text, hit words, their owners, names of the items found by text, and the words' byte ranges."""
        start, end, h, first = words(buf, at)
        texts = len(at) - 1
        names: list[list[str]] = [[] for _ in range(texts)]
        hit = np.zeros(len(h), bool)
        doc = np.repeat(np.arange(texts), np.diff(first))
        if len(self.length) and len(h):
            k = np.searchsorted(self.vocabulary, h)
            k[k == len(self.vocabulary)] = 0
            known = self.vocabulary[k] == h
            # stretches of known words of one text, at least as long as the shortest phrase
            joined = known & np.append(False, known[:-1] & (doc[1:] == doc[:-1]))
            head = np.flatnonzero(known & ~joined)
            size = np.add.reduceat(known.astype(np.int64), head) if len(head) else np.zeros(0, np.int64)
            long = size >= int(self.length.min())
            head, size = head[long], size[long]
            if len(head):
                total = size + 1
                stop = np.cumsum(total)
                where = np.arange(stop[-1]) - np.repeat(stop - total, total) + np.repeat(head, total)
                text = np.where(np.arange(stop[-1]) == np.repeat(stop - 1, total), 1, k[np.minimum(where, len(h) - 1)] + 2)
                index = FMIndex(text)
                fits = np.flatnonzero(self.rows.max(axis=1) < 1 << index.levels)
                lo, hi = index.search(self.rows[fits], self.length[fits])
                n = hi - lo
                phrase = np.repeat(fits, n)
                place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                at_word = where[index.locate(place)]
                edge = np.zeros(len(h) + 1, np.int64)
                np.add.at(edge, at_word, 1)
                np.add.at(edge, at_word + self.length[phrase], -1)
                hit = np.cumsum(edge)[:-1] > 0
                many = np.diff(self.first)[phrase]
                item = self.items[np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[:-1][phrase], many)]
                pair = np.unique(np.repeat(doc[at_word], many) * max(1, len(self.names)) + item)
                for d, i in zip((pair // max(1, len(self.names))).tolist(), (pair % max(1, len(self.names))).tolist(), strict=True):
                    names[d].append(self.names[i])
        return first, hit, doc, names, (start, end)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _blocks(bench: DataFrame, item_col: str, text_col: str, block_bytes: int, window: int) -> Iterator[Phrases]:
    """Phrases of the test items, a bounded block at a time."""
    own = bench.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = own.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else own
        yield Phrases.of([(r["item"], r["text"]) for r in part.collect()], window)


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, part: int = PART, block_bytes: int = BLOCK_BYTES, keep: bool = False) -> DataFrame:
    """id, n_words, n_hit, items (sorted names), spans (merged byte ranges to remove) and contaminated of each row of ``docs``; with ``keep`` its columns as struct ``row``, too.

    One row for each input row, no shuffle. Null and empty texts have no words and are not contaminated; null or wordless items match
    nothing; items of one id count once, and those of a null id mark words but are named nowhere. The test set is taken in blocks of
    bounded size, so it is never whole in one broadcast; documents are never joined with it.
    """
    sc = docs.sparkSession.sparkContext
    own = [F.col(id_col).alias("id"), F.col(text_col).alias("text")] + ([F.struct("*").alias("row")] if keep else [])
    now = docs.select(*own, F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<bigint>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))
    for phrases in _blocks(bench, item_col, item_text_col, block_bytes, window):
        shared = sc.broadcast(phrases)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in chunks(whole):
                    buf, at = text_buffer(b.column("text"))
                    first, hit, doc, names, (start, end) = shared.value.find(buf, at)
                    before, named = b.column("hits"), b.column("items")
                    if len(before.flatten()):
                        flat = before.flatten().to_numpy()
                        hit[first[np.repeat(np.arange(b.num_rows), np.array(before.value_lengths()))] + flat] = True
                        names = [sorted({*n, *m}) for n, m in zip(names, named.to_pylist(), strict=True)]
                    where = np.flatnonzero(hit)
                    edge = np.searchsorted(where, first).astype(np.int32)
                    local = where - first[doc[where]]
                    head = np.flatnonzero(np.append(True, (np.diff(where) > 1) | (np.diff(doc[where]) > 0))) if len(where) else where
                    tail = np.append(head[1:], len(where))[: len(head)] - 1
                    base = at[doc[where[head]]]
                    spans = pa.StructArray.from_arrays([pa.array(start[where[head]] - base), pa.array(end[where[tail]] - base)], names=["start", "end"])
                    cols = {
                        "n_words": pa.array(np.diff(first)),
                        "hits": pa.ListArray.from_arrays(pa.array(edge), pa.array(local)),
                        "items": pa.array(names, pa.list_(pa.string())),
                        "spans": pa.ListArray.from_arrays(pa.array(np.searchsorted(head, edge).astype(np.int32)), spans),
                    }
                    yield pa.RecordBatch.from_arrays([cols[c] if c in cols else b.column(c) for c in b.schema.names], names=b.schema.names)

        now = now.mapInArrow(run, now.schema)
    n_hit = F.size("hits").cast("long")
    return now.select("id", *(["row"] if keep else []), "n_words", n_hit.alias("n_hit"), "items", "spans", ((n_hit > 0) & (part * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, as they are."""
    return contamination(docs, bench, keep=True, **options).where(~F.col("contaminated")).select("row.*")


def op4_fm_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contamination of every whole text of documents by the whole benchmark."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = contamination(docs, bench)
    return got.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hw.n_hit, 0) AS n_hit, coalesce(hi.n_items, 0) AS n_items,
  sha256(coalesce(hi.ids, '')) AS items_sha256,
  coalesce(hw.n_hit, 0) > 0 AND 20 * coalesce(hw.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
"""
