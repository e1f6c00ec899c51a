"""SimHash near-dedup: pigeonhole blocks.

A text's fingerprint has a bit set where over half of its shingles' hashes have it. Fingerprints that differ in at most d
bits share at least B - d of B blocks, so pairs are joined on every choice of B - d blocks and their Hamming distance is
verified. Blocks that many different fingerprints share are left to an exact way of linear size: two fingerprints at one or
two bits have a common neighbour at one bit, so each gives its 65 neighbours and is linked to the least giver of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import chunks, mix, prefix_hash, range_hash, text_buffer, word_bounds, word_hashes, written
from ._exchange import press, release
from .components import components

SEED = 42
#: Fingerprints are cut into so many blocks of 64 / BLOCKS bits.
BLOCKS = 4
#: Most different fingerprints of a block choice that are compared pair by pair.
PAIRWISE = 64
#: Bytes of text worked on at once.
PIECE = 1 << 20


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, in lists of about PIECE bytes."""
    start = 0
    while start < len(text):
        end = start + PIECE
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        if words := text[start:end].lower().split():
            yield words
        start = end


def fingerprint(text: bytes, width: int = 3, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a whole text; 0 without words."""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    hash_ = xxhash.xxh64_intdigest
    for words in _words(text):
        words = tail + words
        tail = words[-(width - 1) :] if width > 1 else []
        if len(words) < width:
            continue
        flat = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        end = np.cumsum(size) - 1
        ends = end[width - 1 :].tolist()
        starts = (end - size + 1)[: len(ends)].tolist()
        h = np.fromiter([hash_(flat[s:e], seed) for s, e in zip(starts, ends, strict=True)], np.uint64, len(ends))
        total += len(h)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    if not total:
        if not tail:
            return 0
        h = hash_(b" ".join(tail), seed)
        return h
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """id and fp (the fingerprint as a signed long) of each row; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint((x.as_py() or "").encode(), width) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def links(distinct: DataFrame, distance: int = 2, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges (u, v) between different fingerprints (column fp) whose components are those of all pairs at ``distance`` (1 or 2) or fewer bits."""
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    fp, size = F.col("fp"), 64 // BLOCKS
    block = [F.shiftrightunsigned(fp, size * i).bitwiseAND((1 << size) - 1) for i in range(BLOCKS)]
    keys = []
    for k, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - distance)):
        key = F.lit(k).cast("long")
        for i in chosen:
            key = key * (1 << size) + block[i]
        keys.append(key)
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > pairwise).select("key")
    rows_cold = rows.join(hot, "key", "left_anti")
    a, b = rows_cold.alias("a"), rows_cold.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    cold = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    # of hot blocks: neighbours at one bit (at distance 1 both ends are themselves such neighbours)
    crowd = rows.join(hot, "key", "left_semi").select("fp").distinct()
    flips = F.array(fp, *(fp.bitwiseXOR(F.lit((1 << i) - ((1 << 64) if i == 63 else 0)).cast("long")) for i in range(64)))
    if distance == 2:
        around = crowd.select("fp", F.explode(flips).alias("near"))
        least = around.groupBy("near").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where(F.col("n") > 1).select("near", "v")
        warm = around.join(least, "near").select(F.col("fp").alias("u"), "v")
    else:
        warm = crowd.select(fp.alias("u"), F.explode(flips).alias("fp")).join(crowd, "fp").select("u", F.col("fp").alias("v"))
    return cold.unionAll(warm).where(F.col("u") != F.col("v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2, pairwise: int = PAIRWISE) -> DataFrame:
    """id_col, fingerprint (16 hexadecimal digits) and component_id of each row.

    Rows whose fingerprints differ in at most ``distance`` bits are linked; component_id is the smallest id reachable, a row's own
    included, null ids aside (null where all are). Repeated rows and ids each give their row; texts without words (null, empty) have
    fingerprint zero and are linked like any other. Fingerprints are reduced to distinct ones before any join.
    """
    fps = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = written(components(links(distinct, distance, pairwise)), "roots").withColumnRenamed("node", "fp")
    of = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    names = of.select("fp", "root").join(named, "root").select("fp", "component_id")
    out = fps.join(names, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- close copies by similarity ----

#: Words of a shingle and parts of a wide fingerprint that make blocks; shingles a part holds at most on average; the wide fingerprint's 64-bit words.
CLOSE_WIDTH, PARTS, PART_SIZE, WIDE = 5, 24, 8, 8
#: Similarity (Jaccard, of shingle sets) of close copies, and most differing bits: at 0.8 a mean of 77 of 512 differ, with a deviation of 8.
SIMILAR, CLOSE_BITS = 0.8, 112
#: Texts of fewer shingles differ in more bits; their pairs go to the exact check whatever the fingerprints.
FEW_SHINGLES = 64
#: Cells and parts of the sketch of how many sets have a hash.
CELLS, CELL_PARTS = 1 << 20, 64
#: Leaders that the members of a crowded block are compared with at first.
LEADERS = 2
#: Times that members of crowded blocks of several groups meet the most central member, before what is left is compared exactly.
CENTRAL = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _majority(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """SimHash of each run of hashes."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, start, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingles(buf: np.ndarray, at: np.ndarray, width: int = CLOSE_WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of each text, in order, and the text of each; a shorter text is one shingle."""
    low = _LOWER[buf]
    start, end, first = word_bounds(low, at)
    h = word_hashes(low, start, end)
    texts, n = len(at) - 1, np.diff(first)
    base = 0x27D4EB2F165667C5
    prefix = prefix_hash(h, base)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    own = np.repeat(np.arange(texts), count)
    s = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    g = range_hash(prefix, s, np.minimum(s + width, np.repeat(first[1:], count)), base)
    order = np.lexsort((g, own))
    g, own = g[order], own[order]
    once = np.append(True, (g[1:] != g[:-1]) | (own[1:] != own[:-1]))[: len(g)]
    return g[once], own[once]


def wide_fingerprints(buf: np.ndarray, at: np.ndarray, width: int = CLOSE_WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: WIDE words of SimHash over its different shingles, and their number; and blocks, as (text, key).

    A block is the SimHash of the shingles of one hash class. Classes hold a few shingles, so an edit changes few of them, and copies that
    share four fifths of their shingles share a block with near certainty. The number of classes doubles with a text's size, and a text near
    such a border has the blocks of both sides. Texts without words share one block.
    """
    texts = len(at) - 1
    g, own = shingles(buf, at, width)
    size = np.bincount(own, minlength=texts)
    wide = np.zeros((texts, WIDE), np.uint64)
    some = np.flatnonzero(size)
    head = (np.cumsum(size) - size)[some]
    if len(some):
        for r in range(WIDE):
            wide[some, r] = _majority(mix(g + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))), head, size[some])
    level = np.maximum(4, np.ceil(np.log2(np.maximum(size, 1) / PART_SIZE))).astype(np.int64)
    rows, keys = [np.flatnonzero(size == 0)], [np.full(int((size == 0).sum()), 1, np.uint64)]
    for up in (0, 1):
        near = size > 0 if not up else size * 1.25 > PART_SIZE * (1 << level)
        pick = np.flatnonzero(near[own])
        if not len(pick):
            continue
        k = level[own[pick]] + up
        part = (mix(g[pick] ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(20)).astype(np.int64) & ((1 << k) - 1)
        pick, k, part = pick[part < PARTS], k[part < PARTS], part[part < PARTS]
        if not len(pick):
            continue
        by = np.lexsort((part, own[pick]))
        pick, k, part = pick[by], k[by], part[by]
        new = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (own[pick][1:] != own[pick][:-1])))
        sim = _majority(np.ascontiguousarray(g[pick]), new, np.diff(np.append(new, len(pick))))
        rows.append(own[pick][new])
        keys.append(mix(sim ^ ((part[new] << 8) + k[new]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return wide, size, np.concatenate(rows), np.concatenate(keys)


def node_of(text_col: str) -> F.Column:
    """A hash of the text (null: empty)."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def second_of(text_col: str) -> F.Column:
    """Another one."""
    return F.xxhash64(F.lit(SEED), F.coalesce(F.col(text_col), F.lit("")))


def close_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = CLOSE_WIDTH, similar: float = SIMILAR, bits: int = CLOSE_BITS, pairwise: int = PAIRWISE) -> tuple[DataFrame, DataFrame]:
    """(id, node) of each row, node a hash of its text, so exact copies are one node; and (node, root) of those with a close copy, roots marking groups.

    Texts of one node must agree in a second 64-bit hash; of those that do not, the rows of all but one are left out, and so in no group.

    Texts whose shingle sets are similar by 0.8 or more differ in few bits of a wide fingerprint, and share a block. Blocks of up to
    ``pairwise`` rows are compared pair by pair; those of a more crowded one with some leaders, chosen by hash. Pairs within ``bits``, or of few shingles, whose shingle sets are ``similar`` are links.
    Of crowded blocks whose members are not all in one group by then, the members meet the most central ones (see ``ranked``), and those that
    are still apart are compared exactly: see ``crowded_pairs``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, most=1 << 20):
                wide, size, rows, keys = wide_fingerprints(*text_buffer(b.column("text")), width)
                by = np.argsort(rows, kind="stable")
                cut = np.searchsorted(rows[by], np.arange(b.num_rows + 1)).astype(np.int32)
                lists = lambda v, at: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("node"), b.column("second"), lists(wide.ravel(), np.arange(0, wide.size + 1, WIDE)), lists(np.ascontiguousarray(keys[by]), cut), pa.array(size.astype(np.int64))], names=["id", "node", "second", "wide", "blocks", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), node_of(text_col).alias("node"), second_of(text_col).alias("second"), F.col(text_col).alias("text"))
    made = written(own.mapInArrow(run, f"id {kind}, node long, second long, wide array<long>, blocks array<long>, n long"), "wide")
    clash = made.groupBy("node").agg(F.min("second").alias("second"), F.max("second").alias("most")).where("second <> most").drop("most")
    if not clash.isEmpty():
        keep = F.col("kept").isNull() | (F.col("kept") == F.col("second"))
        made, own = (df.join(clash.withColumnRenamed("second", "kept"), "node", "left").where(keep).drop("kept") for df in (made, own))
    nodes = made.select("node", "wide", "blocks", "n").dropDuplicates(["node"])
    nodes = written(nodes, "nodes")
    rows = nodes.select("node", F.explode(F.array_distinct("blocks")).alias("block"))
    size = rows.groupBy("block").agg(F.count("*").alias("n"), *(F.min_by("node", F.xxhash64("node", F.lit(k))).alias(f"l{k}") for k in range(LEADERS))).where("n > 1")
    size = written(size, "blocks")
    few = rows.join(size.where(F.col("n") <= pairwise).select("block"), "block", "left_semi")
    a, b = few.select("block", F.col("node").alias("u")), few.select("block", F.col("node").alias("v"))
    pairs = a.join(b, "block").where("u < v").select("u", "v")
    lead = size.where(F.col("n") > pairwise).select("block", F.explode(F.array_distinct(F.array(*(f"l{k}" for k in range(LEADERS))))).alias("v"))
    star = rows.withColumnRenamed("node", "u").join(lead, "block").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    pairs = written(pairs.unionAll(star).distinct(), "pairs")
    both = pairs.join(nodes.select(F.col("node").alias("u"), F.col("wide").alias("x"), F.col("n").alias("m")), "u").join(nodes.select(F.col("node").alias("v"), F.col("wide").alias("y"), "n"), "v")
    differ = sum((F.bit_count(F.col("x")[k].bitwiseXOR(F.col("y")[k])) for k in range(WIDE)), F.lit(0))
    # sizes that differ by more cannot be similar
    sized = F.least("m", "n") >= similar * F.greatest("m", "n") - 1e-9
    near = written(both.where(((differ <= bits) | (F.least("m", "n") < FEW_SHINGLES)) & sized).select("u", "v"), "near")
    hot = rows.join(size.where(F.col("n") > pairwise).select("block").hint("merge"), "block", "left_semi")
    used = near.select(F.col("u").alias("node")).unionAll(near.select(F.col("v").alias("node"))).unionAll(hot.select("node")).distinct()
    # merged at every size: what is used, and below what goes, grows with the corpus and must not be broadcast
    # copies of a text are reduced before they are dealt out by node
    text = own.select("node", "text").dropDuplicates(["node"]).join(used.hint("merge"), "node", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole):
                g, of = shingles(*text_buffer(b.column("text")), width)
                cut = np.searchsorted(of, np.arange(b.num_rows + 1))
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([g[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["node", "set"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                same = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                good.append(x == y or same >= similar * (len(x) // 8 + len(y) // 8 - same))
            yield b.filter(pa.array(good, pa.bool_())).select(["u", "v"])

    of = written(text.mapInArrow(sets, "node long, set binary"), "sets")

    def close(pairs: DataFrame) -> DataFrame:
        pair = pairs.join(of.select(F.col("node").alias("u"), F.col("set").alias("x")), "u").join(of.select(F.col("node").alias("v"), F.col("set").alias("y")), "v")
        return written(pair.select("u", "v", "x", "y").mapInArrow(alike, "u long, v long"), "close")

    found = close(near)
    roots = written(components(found), "roots")
    # what a group is made from is most like its copies: first the members of crowded blocks meet the most central ones, which is linear
    odd = None
    for turn in range(CENTRAL):
        mixed = written(hot.join(roots.hint("merge"), "node", "left").select("block", "node", F.coalesce("root", "node").alias("root")), "hot")
        parted = mixed.groupBy("block", "root").agg(F.count("*").alias("k")).groupBy("block").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
        torn = written(mixed.join(parted.hint("merge"), "block"), "torn")
        if torn.isEmpty():
            return made.select("id", "node"), roots
        if odd is None:
            odd = written(ranked(of.join(torn.select("node").distinct().hint("merge"), "node", "left_semi"), similar), "odd")
        lead = torn.where("root <> main") if turn else torn
        lead = lead.join(odd.select("node", "odd").hint("merge"), "node").groupBy("block").agg(F.min_by(F.struct("node", "root"), F.struct("odd", "node")).alias("lead"))
        met = torn.join(lead.hint("merge"), "block").where("root <> lead.root").select(F.least("node", "lead.node").alias("u"), F.greatest("node", "lead.node").alias("v"))
        more = close(written(met.distinct(), "met"))
        if more.isEmpty():
            break
        roots = written(components(more.unionAll(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))), "roots")
    mixed = written(hot.join(roots.hint("merge"), "node", "left").select("block", "node", F.coalesce("root", "node").alias("root")), "hot")
    torn = mixed.groupBy("block").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("block")
    crowd = mixed.join(torn, "block", "left_semi").select("node", "root").distinct()
    left = close(crowded_pairs(odd.join(crowd.hint("merge"), "node"), similar))
    return made.select("id", "node"), roots if left.isEmpty() else components(left.unionAll(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))


def frequencies(sets: DataFrame, cells: int = CELLS, parts: int = CELL_PARTS) -> np.ndarray:
    """How many of the ``sets``' hashes lie in each cell: never less than how many sets have a hash of the cell. Of fixed size; tasks' counts are added up part by part."""
    span, shift = cells // parts, np.uint64(64 - (cells.bit_length() - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(cells, np.int64)
        for b in batches:
            raw, _ = text_buffer(b.column("set"))
            own += np.bincount((mix(np.frombuffer(raw.tobytes(), np.uint64)) >> shift).astype(np.int64), minlength=cells)
        some = np.flatnonzero(own.reshape(parts, span).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([press(own[k * span : (k + 1) * span].tobytes()) for k in some], pa.binary())], names=["part", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(span, np.int64)
        for x in table["n"].to_pylist():
            total += np.frombuffer(release(x), np.int64)
        return pa.table({"part": table["part"][:1], "n": pa.array([total.tobytes()], pa.binary())})

    kind, out = "part long, n binary", np.zeros(cells, np.int64)
    for r in sets.select("set").mapInArrow(count, kind).groupBy("part").applyInArrow(add, kind).collect():
        out[r["part"] * span : (r["part"] + 1) * span] = np.frombuffer(r["n"], np.int64)
    return np.minimum(out, np.iinfo(np.uint32).max).astype(np.uint32)


def ranked(sets: DataFrame, similar: float = SIMILAR, cells: int = CELLS) -> DataFrame:
    """(node, n, odd, first, at) of ``sets`` (node, set: different 64-bit hashes) of which another set may have a hash.

    All hashes have one order: by the estimate of how many sets have them (``frequencies``, broadcast at its fixed size), then by value. first
    and at: the hashes that a ``similar`` set's must begin with, and their places in the set, but for those that no other set can have. odd:
    how much of the set few others have, small for what many are copies of. A coarse estimate costs candidates, never a pair.
    """
    shift = np.uint64(64 - (cells.bit_length() - 1))
    shared = sets.sparkSession.sparkContext.broadcast(frequencies(sets, cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for b in batches:
            rows = []
            for node, x in zip(b.column("node").to_pylist(), b.column("set").to_pylist(), strict=True):
                h = np.frombuffer(x, np.uint64)
                e = often[(mix(h) >> shift).astype(np.int64)]
                by = np.lexsort((h, e))[: max(0, len(h) - int(np.ceil(similar * len(h) - 1e-6)) + 1)]
                at = np.flatnonzero(e[by] > 1)
                rows.append((node, len(h), float((1 / e).sum() / max(1, len(h))), h[by][at].view(np.int64), at))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["node", "n", "odd", "first", "at"])

    return sets.select("node", "set").mapInArrow(run, "node long, n long, odd double, first array<long>, at array<long>")


def crowded_pairs(sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Pairs (u, v) of ``sets`` (as ``ranked``, with root) of different roots, among them all that are ``similar``.

    Sets similar by s share one of the first (1 - s) of either's hashes, in one order of all hashes (the prefix filter, which is exact). Where
    a set of n hashes meets one of m first at its place p (from 0), they share at most n - p, and need s / (1 + s) of n + m: so m is at most ``reach``
    there, on both sides. The smaller set thus has a reach of its own size or more, and a hash that no set reaches so far is left out, as are
    the sets out of reach of those that do. Members of a dense group below the threshold have too many hashes of their own before the shared
    ones, so they are not paired at all. Of those that share a hash, all but the ones of its most frequent root meet all: a pair of different
    roots has one of them.
    """
    rows = sets.select("node", "root", "n", F.explode(F.arrays_zip("first", "at")).alias("x")).select("node", "root", "n", F.col("x.first").alias("h"), F.col("x.at").alias("at"))
    # a little more than exact, against rounding: the sets are compared afterwards
    reach = (F.col("n") - F.col("at")) * ((1 + similar) / similar) - F.col("n") + 1e-6
    first = written(rows.select("h", "node", "root", "n", reach.alias("reach")), "prefixes")
    met = first.where("reach >= n").groupBy("h").agg(F.min("n").alias("least"), F.max("reach").alias("most"))
    first = written(first.join(met.hint("merge"), "h").where("reach >= least and n <= most").drop("least", "most"), "reached")
    by_root = first.groupBy("h", "root").agg(F.count("*").alias("k"))
    main = by_root.groupBy("h").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("h", "main")
    rest = first.join(main.hint("merge"), "h").where("root <> main").select("h", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("reach").alias("reach_a"))
    pair = rest.join(first.hint("merge"), "h").where((F.col("ra") != F.col("root")) & (F.col("reach") >= F.col("na")) & (F.col("reach_a") >= F.col("n")))
    return written(pair.select(F.least("a", "node").alias("u"), F.greatest("a", "node").alias("v")).distinct(), "crowded")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = CLOSE_WIDTH, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs``, one of each group of close copies: the one of the smallest id (null ids last), of several those the first by a hash of the text; of rows equal in both, one."""
    rows, roots = close_copies(docs, id_col, text_col, width, similar)
    rank = F.struct(F.col("id").isNull().alias("null"), F.col("id").alias("id"), F.col("node").alias("node"))
    ranked = rows.select("node", rank.alias("rank")).join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "rank")
    # a text's own copies are summed up first, so that no group is gathered
    best = ranked.groupBy("root").agg(F.min("rank").alias("best"), F.count("*").alias("n")).where("n > 1")
    best = written(best.select("root", "best"), "best")
    gone = ranked.join(best, "root").where(F.col("rank") != F.col("best")).select(F.col("rank.id").alias("__gone_id"), F.col("rank.node").alias("__gone_node"))
    gone = written(gone.distinct(), "gone")
    kept = docs.withColumn("__node", node_of(text_col)).join(gone.hint("merge"), F.col(id_col).eqNullSafe(F.col("__gone_id")) & (F.col("__node") == F.col("__gone_node")), "left_anti")
    once = rows.groupBy("id", "node").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return (kept if once else kept.dropDuplicates([id_col, "__node"])).drop("__node")


def op9_simhash_neardup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole text of documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
