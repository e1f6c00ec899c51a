"""LM scoring: a log-frequency Bloom filter of quantised n-gram counts, in parts by hash range.

Words and word pairs of the training texts are counted exactly: tasks send sorted arrays of hashes and counts, dealt out by
hash range, so no frequent word is a hot key. A word or pair with count c is stored at the levels 1..q of its range's part of a Bloom
filter, q = 1 + floor(log_b(c / least)); its quantised count is read back by probing level after level until one is missing. The
text's probability interpolates pair and word estimates from these counts. The filter grows with its entries, so it is never
gathered or broadcast: chunks of texts ask each range for their pairs and rarer words, and the range answers.

The base score needs exact counts of every token. The most frequent ones fit a table of bounded size, which is broadcast; tokens
beyond it are asked for with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import chunks, mix, text_buffer, word_bounds, word_hashes, written
from ._exchange import MESSAGE, RANGE_BYTES, answered, bodies, chunk_table, deltas, expand, messages, parts, range_of, send, squeeze, unpacked

#: Most words in the exact table; bits an entry and level of the filter; and the base of the quantisation.
HEAD = 1 << 19
BITS = 16
BASE = 1.5
#: Words and pairs seen less often are not stored, at any size: from 1 on, level 1 means seen.
LEAST = 1
#: Weight of the pair estimate: TOP * c / (c + KAPPA) for a first word of count c.
TOP, KAPPA = 0.2, 2.0
#: Words gathered before they are sent.
GATHER = 3 << 19
#: Bytes of text that ask together.
ASK = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BEGIN, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def tokens(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and the first of each text."""
    low = _LOWER[buf]
    start, end, first = word_bounds(low, at)
    return word_hashes(low, start, end), first


def pairs(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's words and end: the word before (or the begin), the token, and the hash of both. A text has one more than words."""
    texts = len(first) - 1
    at = first[1:] + np.arange(texts)
    now = np.insert(h, first[1:], _END)
    before = np.empty_like(now)
    before[1:] = now[:-1]
    start = np.append(0, at[:-1] + 1) if texts else at
    before[start] = _BEGIN
    return before, now, mix(before * np.uint64(3) + now)


def _packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").tobytes()


def _summed(each: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not each:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, n = (np.concatenate(x) for x in zip(*each, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[new], np.add.reduceat(n, new) if len(new) else n


def count_ngrams(docs: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """bucket, keys (sorted hashes of words), counts, bits (of the filter of words and pairs), texts and tokens; one row a bucket with anything."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {1: [], 2: []}
        texts, size = 0, 0

        def flush() -> pa.RecordBatch:
            rows = []
            for kind, own in held.items():
                keys, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                small = np.minimum(n, 255).astype(np.uint8)
                for b, s, e in parts(keys, buckets):
                    large = np.flatnonzero(n[s:e] >= 255)
                    rows.append((b, kind, _packed(keys[s:e]), small[s:e].tobytes(), n[s:e][large].astype("<i8").tobytes(), 0))
                own.clear()
            rows.append((0, 0, b"", b"", b"", texts))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["bucket", "kind", "keys", "small", "large", "texts"])

        for whole in batches:
            for b in chunks(whole):
                h, first = tokens(*text_buffer(b.column("text")))
                held[1].append(h)
                held[2].append(pairs(h, first)[2])
                texts += b.num_rows
                size += len(h)
                if size >= GATHER:
                    yield flush()
                    texts = size = 0
        if texts:
            yield flush()

    def gather(table: pa.Table) -> pa.Table:
        of = {1: _summed([]), 2: _summed([])}
        for kind in of:
            own = table.filter(pa.compute.equal(table["kind"], kind))
            each = []
            for keys, small, large in zip(own["keys"].to_pylist(), own["small"].to_pylist(), own["large"].to_pylist(), strict=True):
                n = np.frombuffer(small, np.uint8).astype(np.int64)
                n[n == 255] = np.frombuffer(large, "<i8")
                each.append((np.frombuffer(keys, "<u8"), n))
            of[kind] = _summed(each)
        keys, n = (np.concatenate(x) for x in zip(*of.values(), strict=True))
        keys, n = keys[n >= LEAST], n[n >= LEAST]
        bits = _filter_part(keys, n, LEAST, BASE, BITS).tobytes() if len(keys) else b""
        row = (table["bucket"][0].as_py(), _packed(of[1][0]), of[1][1].astype("<i8").tobytes(), bits, int(pa.compute.sum(table["texts"]).as_py()), int(of[1][1].sum()))
        return pa.table([pa.array([x], k) for x, k in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["bucket", "keys", "counts", "bits", "texts", "tokens"])

    sent = docs.select(F.col(text_col).alias("text")).mapInArrow(send, "bucket long, kind long, keys binary, small binary, large binary, texts long")
    return sent.groupBy("bucket").applyInArrow(gather, "bucket long, keys binary, counts binary, bits binary, texts long, tokens long")


#: Counts 1..EXACT have a cell of their own in histograms; beyond, one cell each power of two.
_EXACT = 1 << 12


def _cell(n: np.ndarray) -> np.ndarray:
    return np.where(n <= _EXACT, n, _EXACT + np.log2(np.maximum(n, 1)).astype(np.int64))


def _histogram(counted: DataFrame) -> np.ndarray:
    """How many words have a count in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_EXACT + 64, np.int64)
        for b in batches:
            for counts in b.column("counts").to_pylist():
                total += np.bincount(_cell(np.frombuffer(counts, "<i8")), minlength=_EXACT + 64)
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i])], names=["cell", "n"])

    out = np.zeros(_EXACT + 64, np.int64)
    for r in counted.select("counts").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def _levels(n: np.ndarray, least: int, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(n, least) / least) / np.log(base) + 1e-9).astype(np.int64)


def _probe(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each key at a level: where in its part of the filter, and the four bits of a 64-bit word."""
    g = mix(h + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    one, six = np.uint64(1), np.uint64(63)
    bits = one << (g & six) | one << ((g >> np.uint64(6)) & six) | one << ((g >> np.uint64(12)) & six) | one << ((g >> np.uint64(18)) & six)
    return g >> np.uint64(24), bits


@dataclass
class Model:
    """N and V of the training tokens, ends counted; exact counts of the most frequent words; a filter, in parts by hash range."""

    total: int
    kinds: int
    ends: int
    head: np.ndarray
    head_n: np.ndarray
    least: int = 2
    base: float = BASE
    start: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    size: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    buckets: int = 1

    def head_counts(self, h: np.ndarray) -> np.ndarray:
        """Exact counts; -1 for words that are not in the table."""
        if not len(self.head):
            return np.full(len(h), -1)
        at = np.searchsorted(self.head, h)
        at[at == len(self.head)] = 0
        return np.where(self.head[at] == h, self.head_n[at], -1)

    def quantised(self, h: np.ndarray) -> np.ndarray:
        """Lower bounds of the counts that the filter holds; 0 where it has none."""
        out = np.zeros(len(h))
        if not len(self.words):
            return out
        part = range_of(h, len(self.size))
        live, level, value = np.flatnonzero(self.size[part] > 0), 1, float(self.least)
        while len(live):
            own = part[live]
            at, bits = _probe(h[live], level)
            word = self.words[self.start[own] + (at % self.size[own].astype(np.uint64)).astype(np.int64)]
            live = live[(word & bits) == bits]
            out[live] = value
            level, value = level + 1, value * self.base
            if level > 200:
                break
        return out


def _filter_part(keys: np.ndarray, n: np.ndarray, least: int, base: float, bits: int) -> np.ndarray:
    q = _levels(n, least, base)
    words = np.zeros(max(1, -(-int(q.sum()) * bits // 64)), np.uint64)
    for level in range(1, int(q.max()) + 1):
        at, mask = _probe(keys[q >= level], level)
        np.bitwise_or.at(words, (at % np.uint64(len(words))).astype(np.int64), mask)
    return words


def train(docs: DataFrame, text_col: str, head: int = HEAD, buckets: int | None = None) -> tuple[Model, DataFrame]:
    """The model of all rows of ``docs`` without its filter, and the table of exact word counts and parts of the filter by hash range."""
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    counted = written(count_ngrams(docs, text_col, buckets), "ngrams")
    facts = counted.agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"), F.sum(F.octet_length("counts") / 8).cast("long").alias("keys")).first()
    ends = facts["texts"] or 0
    total, kinds = ends + (facts["tokens"] or 0), (1 if ends else 0) + (facts["keys"] or 0)
    cells = np.arange(_EXACT + 64)
    low = np.where(cells <= _EXACT, cells, 2 ** np.clip(cells - _EXACT, 0, 62))
    above = np.cumsum(_histogram(counted)[::-1])[::-1]
    floor = int(low[np.flatnonzero(above <= head)[0]]) if len(np.flatnonzero(above <= head)) else int(low[-1])
    floor = max(1, floor)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, counts in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
                k, n = np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<i8")
                some = n >= floor
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (k[some], n[some])], names=["keys", "counts"])

    most = counted.select("keys", "counts").mapInArrow(part, "keys binary, counts binary").collect()
    keys, n = _summed([(np.frombuffer(r["keys"], "<u8"), np.frombuffer(r["counts"], "<i8")) for r in most])
    return Model(total, kinds, ends, keys, n, LEAST, buckets=buckets), counted.select("bucket", "keys", "counts", "bits")


def _asked(m: Model, buf: np.ndarray, at: np.ndarray) -> tuple:
    """Of a chunk: tokens and the first of each text, different words, their place by token and counts (-1 not in the table), different pairs, their place by token."""
    h, first = tokens(buf, at)
    u, inv = np.unique(h, return_inverse=True)
    pair, joint = np.unique(pairs(h, first)[2], return_inverse=True)
    return h, first, u, inv, m.head_counts(u), pair, joint


def score(docs: DataFrame, model: Model, exact: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_known, base_score and score of each row.

    A null text is empty and has its end alone; null ids and repeated rows each give a row; without training rows every token has
    probability 1 for the base, and 1 for the model.
    """
    buckets = model.buckets
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType
    table = chunk_table(docs, id_col, text_col, "lm", ASK)

    def ask(buf: np.ndarray, at: np.ndarray, batch: pa.RecordBatch, row: int) -> Iterator[tuple[int, int, bytes]]:
        _, _, u, _, c, pair, _ = _asked(shared.value, buf, at)
        for kind, keys in ((1, u[c < 0]), (2, pair)):
            for b, x, y in parts(keys, buckets):
                yield b, kind, squeeze(deltas(keys[x:y]))

    def resolve(left: pa.Table, right: pa.Table) -> pa.Table:
        """Quantised counts of the keys of each message, and of words the exact ones."""
        m = Model(0, 0, 0, *(np.concatenate([np.frombuffer(x, t) for x in right[c].to_pylist()] or [np.zeros(0, t)]) for c, t in (("keys", "<u8"), ("counts", "<i8"))), LEAST)
        m.words = np.concatenate([np.frombuffer(x, "<u8") for x in right["bits"].to_pylist()] or [m.words])
        m.size, m.start = np.array([len(m.words)]), np.zeros(1, np.int64)
        rows = []
        for bucket, chunk, kind, body in zip(*(left[c].to_pylist() for c in ("bucket", "chunk", "kind", "body")), strict=True):
            keys = np.cumsum(expand(body)[0], dtype=np.uint64)
            got = m.quantised(keys)
            level = np.where(got > 0, 1 + np.rint(np.log(np.maximum(got, LEAST) / LEAST) / np.log(BASE)), 0).astype(np.uint8)
            rows.append((bucket, chunk, kind, squeeze(level, np.maximum(m.head_counts(keys), 0)) if kind == 1 else squeeze(level)))
        return pa.Table.from_batches([messages(rows)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scale = np.log10(m.total + m.kinds + 1.0)
        value = np.append(0.0, LEAST * BASE ** np.arange(255.0))
        for b in batches:
            for row in range(b.num_rows):
                h, first, u, inv, c, pair, joint_at = _asked(m, *unpacked(b, row))
                got = bodies(b, "got", row)
                of = {k: [expand(got[key]) for key in sorted(got) if key[0] == k] for k in (1, 2)}
                texts, n = len(first) - 1, np.diff(first)
                doc = np.repeat(np.arange(texts), n)
                inside = c >= 0
                # counts of words from the table, or exact and quantised ones from the range
                count, word = np.maximum(c, 0), np.where(inside, c, 0).astype(float)
                if of[1]:
                    count[~inside] = np.concatenate([x[1] for x in of[1]])
                    word[~inside] = value[np.concatenate([x[0] for x in of[1]])]
                joint = value[np.concatenate([x[0] for x in of[2]])][joint_at]
                known = np.bincount(doc, (count > 0)[inv], texts) + bool(m.ends)
                base = np.bincount(doc, np.log10(count + 1.0)[inv], texts) + np.log10(m.ends + 1.0) - scale * (n + 1)
                end_at = first[1:] + np.arange(texts)
                now_n = np.insert(word[inv], first[1:], m.ends)
                # a quantised count is a lower bound: as a divisor its upper one is taken
                upper = np.insert(np.where(inside, word, word * m.base)[inv], first[1:], m.ends)
                prev_n = np.empty_like(upper)
                prev_n[1:] = upper[:-1]
                prev_n[np.append(0, end_at[:-1] + 1) if texts else end_at] = m.ends
                prev_n = np.maximum(prev_n, joint)
                weight = np.where(prev_n > 0, TOP * prev_n / (prev_n + KAPPA), 0.0)
                p = weight * np.where(prev_n > 0, joint / np.maximum(prev_n, 1.0), 0.0) + (1 - weight) * (now_n + 1.0) / (m.total + m.kinds + 1.0)
                owner = np.repeat(np.arange(texts), n + 1)
                ids = b.column("ids").slice(row, 1).flatten()
                cols = [ids, pa.array(n + 1), pa.array(np.round(known).astype(np.int64)), pa.array(np.round(base, 6)), pa.array(np.round(np.bincount(owner, np.log10(p), texts), 6))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", "n_known", "base_score", "score"])

    solved = send(table, ask).groupBy("bucket").cogroup(exact.groupBy("bucket")).applyInArrow(resolve, MESSAGE)
    got = answered(table, solved, "got").select("ids", "at", "text", "got").mapInArrow(finish, f"id {kind.simpleString()}, n_tokens long, n_known long, base_score double, score double")
    return got.withColumnRenamed("id", id_col)


def held_out(c: F.Column) -> F.Column:
    """The fold that is never learned from; a null id is not in it."""
    return F.coalesce(F.crc32(c.cast("string")) % 7 == 2, F.lit(False))


def op7_lm_bloom(spark, sf_dir: str) -> DataFrame:
    """Base and model scores of every whole text of documents, learned from all but the held-out seventh."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, exact = train(docs.where(~held_out(F.col("doc_id"))), "text")
    got = score(docs, model, exact)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
