"""Phrase collocation mining.

Identical pieces of text are one row with their number, so a line that stands in a third of all documents is counted once, with its
weight. Chunks of different pieces put their n-grams by hash range, pairs only of frequent words and longer ones only of frequent
pairs (no phrase is more frequent than a part of it, so none is lost); each different one is sent once a chunk, with its weight. duckdb
counts the n-grams of a bucket of hashes, out of core; every chunk hears which of its own are frequent, and the first that has one hears its
count too and gives the phrase's text. What a score needs of a candidate's parts is looked up by requests shuffled to the parts' own
buckets. N-grams are told apart by 64-bit hashes of language and words.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _exchange as ex
from ._arrow import mix, word_bounds, word_hashes, written

#: Least count of a candidate, words of the longest, and rows of a language in the result.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of pieces that ask together, and memory of duckdb in a task; beyond it, it spills.
ASK, MEMORY = 4 << 20, "256MB"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09]] = True


@contextmanager
def bucket_engine() -> Iterator[duckdb.DuckDBPyConnection]:
    """A duckdb of one thread and bounded memory; what it spills lies in the task's own scratch folder and goes with it."""
    with tempfile.TemporaryDirectory(prefix="phrases-") as scratch, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": scratch, "preserve_insertion_order": False}) as con:
        yield con


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, n): the different pieces of all texts that have a word, and how often each occurs. A null language is `und`, a null text empty."""
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    each = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(low, r"[.,;:!?\n-\r]", -1)).alias("piece"))
    each = each.select("lang", F.expr(r"btrim(piece, ' \t')").alias("piece")).where("piece <> ''")
    return each.groupBy("lang", "piece").agg(F.count("*").alias("n"))


class Chunk:
    """Words of a chunk of pieces: hash (with the language), piece and weight of each; n-grams as hashes of their first words."""

    def __init__(self, buf: np.ndarray, at: np.ndarray, b: pa.RecordBatch, row: int):
        self.raw = buf
        self.start, self.end, first = word_bounds(buf, at, _GAP)
        rows = b.column("ids")[row].values
        self.langs = rows.field("lang").dictionary_encode()
        seed = np.array([int.from_bytes(x.encode()[:4096], "little") % ((1 << 61) - 1) for x in self.langs.dictionary.to_pylist()], np.uint64)
        self.piece = np.repeat(np.arange(len(at) - 1), np.diff(first))
        self.lang = self.langs.indices.to_numpy()
        self.weight = rows.field("n").to_numpy()[self.piece]
        self.hash = {1: mix(word_hashes(buf, self.start, self.end) ^ mix(seed)[self.lang[self.piece]])}
        self.good: dict[int, np.ndarray] = {}

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the k-grams whose words and pairs (words, of a pair) are all good, and their hashes: the same when asked and when answered."""
        n = max(0, len(self.start) - k + 1)
        if k not in self.hash:
            if k - 1 not in self.hash:
                self.grams(k - 1)
            self.hash[k] = mix(self.hash[k - 1][:n] * np.uint64(0x9E3779B97F4A7C15) + self.hash[1][k - 1 :])
        whole = self.piece[:n] == self.piece[k - 1 :]
        if width := min(k - 1, 2):
            good = self.good[width]
            for i in range(k - width + 1):
                whole &= good[i : i + n]
        pick = np.flatnonzero(whole)
        return pick, self.hash[k][pick]

    def distinct(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different hashes of k-grams in order, their weights and a first word of each; and all their first words, by hash."""
        pick, h = self.grams(k)
        by = np.argsort(h)
        h, pick = h[by], pick[by]
        edge = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
        total = np.add.reduceat(self.weight[pick], edge) if len(edge) else np.zeros(0, np.int64)
        return h[edge], total, edge, pick

    def learn(self, k: int, b: pa.RecordBatch, row: int, name: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Takes the answers in column ``name``: which k-grams are frequent is ``good`` from now on. First words and counts of those whose text this chunk gives."""
        u, _, edge, pick = self.distinct(k)
        got, often, own, counts = ex.bodies(b, name, row), np.zeros(len(u), bool), [], []
        for r, s, e in ex.parts(u, buckets):
            bits, places, f = ex.expand(got[(k, r)])
            often[s:e] = np.unpackbits(bits, count=e - s)
            own.append(places.astype(np.int64) + s)
            counts.append(f)
        good = np.zeros(len(self.start) + LONGEST, bool)
        good[pick] = np.repeat(often, np.diff(np.append(edge, len(pick))))
        self.good[k] = good
        if not own:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return pick[edge][np.concatenate(own)], np.concatenate(counts)


def asked(chunk: Chunk, lengths: tuple[int, ...], buckets: int) -> Iterator[tuple[int, int, bytes]]:
    for k in lengths:
        u, total, _, _ = chunk.distinct(k)
        small = np.min_scalar_type(int(total.max(initial=0)))
        for r, s, e in ex.parts(u, buckets):
            yield r, k, ex.squeeze(ex.deltas(u[s:e]), total[s:e].astype(small))


def frequent(got: list[tuple[int, bytes]], least: int) -> list[bytes]:
    """Of each message's hashes, which reach the least count over all messages, and those of them that no message before has, with their counts."""
    each = [ex.expand(body) for _, body in got]
    keys = [np.cumsum(p[0], dtype=np.uint64) for p in each]
    number = np.repeat(np.arange(len(keys), dtype=np.int32), [len(h) for h in keys])
    rows = pa.table({"h": np.concatenate(keys), "w": np.concatenate([p[1].astype(np.int64) for p in each]), "m": number})
    with bucket_engine() as con:
        con.register("parts", rows)
        found = con.sql(f"SELECT h, CAST(sum(w) AS BIGINT) AS f, min(m) AS m FROM parts GROUP BY h HAVING sum(w) >= {least} ORDER BY m, h").fetchnumpy()
    h, f, m = (np.asarray(found[c]) for c in "hfm")
    every, cut, out = np.sort(h), np.searchsorted(m, np.arange(len(keys) + 1)), []
    for k, own in enumerate(keys):
        at = np.searchsorted(every, own)
        often = np.zeros(len(own), bool)
        inside = at < len(every)
        often[inside] = every[at[inside]] == own[inside]
        first = slice(cut[k], cut[k + 1])
        out.append(ex.squeeze(np.packbits(often), np.searchsorted(own, h[first]).astype(np.uint32), f[first]))
    return out


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, buckets: int | None = None) -> DataFrame:
    """(lang, words, phrase, f): all phrases of up to ``longest`` words that occur ``least`` times or more in pieces of a language, words joined by one space; and with words 0 and phrase '' each language's number of words. Written."""
    own = pieces(docs, text_col, lang_col).select(F.struct("lang", "n").alias("row"), "piece")
    table = ex.chunk_table(own, "row", "piece", "pieces", ASK, gather=True)
    buckets = buckets or ex.ranges(table)
    rounds = [(1,), (2,), tuple(range(3, longest + 1))][: min(longest, 3)]

    def known(buf: np.ndarray, at: np.ndarray, b: pa.RecordBatch, row: int, upto: int) -> Chunk:
        """A chunk that has learned the answers of the first rounds."""
        chunk = Chunk(buf, at, b, row)
        for i in range(upto):
            for k in rounds[i]:
                chunk.learn(k, b, row, f"often{i}", buckets)
        return chunk

    for i, lengths in enumerate(rounds):
        ask = lambda buf, at, b, row, i=i, lengths=lengths: asked(known(buf, at, b, row, i), lengths, buckets)
        replies = ex.answer(ex.send(table, ask), buckets, lambda _, got: frequent(got, least))
        table = written(ex.answered(table, replies, f"often{i}"), f"often{i}")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                buf, at = ex.unpacked(b, row)
                chunk = known(buf, at, b, row, 0)
                names, raw = chunk.langs.dictionary, buf.tobytes()
                total = np.zeros(len(names), np.int64)
                np.add.at(total, chunk.lang[chunk.piece], chunk.weight)
                yield _rows(names, np.arange(len(names)), 0, [b""] * len(names), total)
                for i, lengths in enumerate(rounds):
                    for k in lengths:
                        first, f = chunk.learn(k, b, row, f"often{i}", buckets)
                        bounds = [(chunk.start[first + j].tolist(), chunk.end[first + j].tolist()) for j in range(k)]
                        texts = [b" ".join(p) for p in zip(*([raw[s:e] for s, e in zip(*x, strict=True)] for x in bounds), strict=True)]
                        yield _rows(names, chunk.lang[chunk.piece[first]], k, texts, f)

    sent = table.mapInArrow(emit, "lang string, words int, phrase string, f long")
    return written(sent.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")), "phrases")


def _rows(names: pa.Array, lang: np.ndarray, words: int, phrases: list[bytes], w: np.ndarray) -> pa.RecordBatch:
    cols = [names.take(pa.array(lang)), pa.array(np.full(len(lang), words, np.int32)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(w, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=["lang", "words", "phrase", "f"])


def _part(start: Column, words: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), start, words), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of all candidates, by their lowest-scoring cut; the first cut of those that score the same."""
    phrases = counts.where("words > 0")
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    cuts = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    asks = cuts.withColumn("left", _part(F.lit(1), F.col("cut"))).withColumn("right", _part(F.col("cut") + 1, F.col("words") - F.col("cut")))
    for side, f in (("left", "l"), ("right", "r")):
        asks = asks.join(phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(f)), ["lang", side])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    asks = asks.join(totals, "lang").withColumn("num", F.lit(1000).cast("decimal(4,0)") * (big("a") * big("n")).cast("decimal(34,0)")).withColumn("den", big("l") * big("r"))
    asks = asks.withColumn("score", F.expr("num div den"))
    best = asks.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "words", "a", "best.l", "best.r", "n", "best.score")


def maximal(candidates: DataFrame) -> DataFrame:
    """Candidates without those whose words lie inside a longer candidate that is as frequent."""
    spans = candidates.where("words > 2").select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = spans.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    longer = inner.select("lang", _part(F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return candidates.join(longer, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * a").drop("longer")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, buckets: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two words or more.

    A null language is `und` and is counted with a language of that name; null, empty and blank texts have no words; repeated rows count
    as often as they occur; an empty table has no rows. Ties go by count, then phrase (bytes of UTF-8).
    """
    candidates = written(scored(phrase_counts(docs, text_col, lang_col, least, longest, buckets)), "candidates")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = maximal(candidates).withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language of documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
q AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w, count(*) AS c FROM p GROUP BY ALL),
s AS (SELECT lang, w, c, unnest(range(1, len(w) + 1)) AS i FROM q),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, CAST(sum(c) AS BIGINT) AS f FROM s, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING sum(c) >= 100),
n AS (SELECT lang, CAST(sum(len(w) * c) AS BIGINT) AS n FROM q GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
cut AS (SELECT c.*, unnest(range(1, k)) AS j FROM c),
sc AS (SELECT cut.*, g1.f AS l, g2.f AS r, n.n, CAST(1000::HUGEINT * a * n.n // (g1.f::HUGEINT * g2.f) AS BIGINT) AS score FROM cut JOIN n ON n.lang = cut.lang
  JOIN g g1 ON g1.lang = cut.lang AND g1.phrase = array_to_string(w[1:j], ' ') JOIN g g2 ON g2.lang = cut.lang AND g2.phrase = array_to_string(w[j + 1:cut.k], ' ')),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
x AS (SELECT lang, k, a, w, unnest(range(2, k)) AS m FROM c), y AS (SELECT *, unnest(range(1, k - m + 2)) AS i FROM x),
z AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM y GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN z USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
