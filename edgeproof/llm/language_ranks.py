"""Language ID: rank-order profiles.

A text's words are its runs of letters, in lower case; its n-grams are those of one to three signs of the words, a blank standing at either
end of a word. A language's profile is its most frequent n-grams over all texts to learn from, by rank; a text is compared with each
profile by the out-of-place distance, the sum over its own most frequent n-grams of how far their ranks lie apart, an n-gram that the
profile lacks counting as the profile's length. The nearest profile is the prediction. N-grams are numbers that hold their code points, so
counts are exact; a task sums its own counts before any are sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._arrow import CHUNK, chunks, text_buffer

#: N-grams of a profile, and of a text.
RANKS = 400
#: Languages that may be learned; with more, fitting fails: the profiles of all are held by every worker.
LANGUAGES = 10_000
#: Different n-grams a task holds before it sends their counts on.
HELD = 1 << 20
#: What a text without letters is said to be.
UNKNOWN = "und"
_BITS = 21


@cache
def letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


def code_points(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, and where each text starts and the last ends; bytes that are not UTF-8 are replaced."""
    try:
        whole = buf.tobytes().decode()
        starts = np.append(0, np.cumsum((buf & 0xC0) != 0x80))[at]
    except UnicodeDecodeError:
        texts = [buf[s:e].tobytes().decode(errors="replace") for s, e in zip(at[:-1], at[1:], strict=True)]
        whole, starts = "".join(texts), np.cumsum([0, *map(len, texts)])
    return np.frombuffer(whole.encode("utf-32-le"), np.uint32), starts


def gram_counts(buf: np.ndarray, at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count), by owner and n-gram, of the n-grams of texts; owners are numbers of texts or of what they belong to."""
    points, starts = code_points(buf, at)
    sign = np.zeros(len(points) + len(at), np.uint32)  # a blank before each text and one after the last
    text = np.repeat(np.arange(len(at) - 1), np.diff(starts))
    place = np.arange(len(points)) + text + 1
    sign[place] = letters()[points]
    own = np.zeros(len(sign), np.int64)
    own[place] = owner[text]
    keep = sign != 0
    keep[1:] |= sign[:-1] != 0
    keep[0] = True
    sign, own = sign[keep], own[keep]
    seen = np.zeros(0x110000, bool)
    seen[sign] = True
    alphabet = np.flatnonzero(seen)  # the first is the blank
    bits = int(len(alphabet)).bit_length()
    if 3 * bits + int(owner.max(initial=0)).bit_length() > 63:  # too many owners and signs for one number: work on halves
        half, parts = max(1, (len(at) - 1) // 2), []
        for s, e in ((0, half), (half, len(at) - 1)):
            if s < e:
                names, dense = np.unique(owner[s:e], return_inverse=True)
                o, g, n = gram_counts(buf[at[s] : at[e]], at[s : e + 1] - at[s], dense)
                parts.append((names[o], g, n))
        return _summed(*(np.concatenate(p) for p in zip(*parts, strict=True)))
    number = np.zeros(0x110000, np.int64)
    number[alphabet] = np.arange(1, len(alphabet) + 1)  # 0 stands after the end of an n-gram
    x = number[sign]
    key, n = _runs(np.sort((own[1:-1] << (3 * bits) | x[:-2] << (2 * bits) | x[1:-1] << bits | x[2:])[sign[1:-1] != 0]))
    low = (1 << bits) - 1
    own, a, b, c = key >> (3 * bits), key >> (2 * bits) & low, key >> bits & low, key & low
    # each letter is the middle of one triple, so pairs and single letters are sums of triples
    last = c == 1
    own, n = (np.concatenate([v, v, v, v[last]]) for v in (own, n))
    zero = np.zeros_like(a)
    key = own << (3 * bits) | np.concatenate([a, a, b, b[last]]) << (2 * bits) | np.concatenate([b, b, zero, c[last]]) << bits | np.concatenate([c, zero, zero, zero[last]])
    by = np.argsort(key)
    key, edge = _runs_at(key[by])
    n = np.add.reduceat(n[by], edge) if len(edge) else n
    full = np.append(0, alphabet + 1).astype(np.int64)
    gram = full[key >> (2 * bits) & low] << (2 * _BITS) | full[key >> bits & low] << _BITS | full[key & low]
    return key >> (3 * bits), gram, n


def _runs_at(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])[: len(sorted_keys)])
    return sorted_keys[edge], edge


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, edge = _runs_at(sorted_keys)
    return keys, np.diff(np.append(edge, len(sorted_keys)))


def _summed(owner: np.ndarray, gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the same owner and n-gram added up, in order."""
    if not len(owner):
        return owner, gram, n
    by = np.lexsort((gram, owner))
    owner, gram, n = owner[by], gram[by], n[by]
    edge = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])))
    return owner[edge], gram[edge], np.add.reduceat(n, edge)


@dataclass
class Profiles:
    """Languages in order; all n-grams of their profiles in order, and of the k-th its languages and ranks: from start[k] to start[k + 1]."""

    names: list[str]
    gram: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    rank: np.ndarray
    ranks: int


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", ranks: int = RANKS) -> Profiles:
    """Profiles of all languages of ``docs``. Rows without a language, and texts without letters, teach nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held = tuple(np.zeros(0, np.int64) for _ in range(3))

        def sent() -> pa.RecordBatch:
            cols = [pa.array(list(names), pa.string()).take(pa.array(held[0])), pa.array(held[1]), pa.array(held[2])]
            return pa.RecordBatch.from_arrays(cols, names=["lang", "gram", "n"])

        for whole in batches:
            for b in chunks(whole):
                owner = np.array([names.setdefault(x, len(names)) for x in b.column("lang").to_pylist()], np.int64)
                got = gram_counts(*text_buffer(b.column("text")), owner)
                held = _summed(*(np.concatenate(p) for p in zip(held, got, strict=True)))
                if len(held[0]) > HELD:
                    yield sent()
                    held = tuple(x[:0] for x in held)
        yield sent()

    own = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = own.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(by) - 1).where(F.col("rank") < ranks)
    rows = top.select("lang", "gram", "rank").limit(LANGUAGES * ranks + 1).collect()
    names = sorted({r["lang"] for r in rows})
    if len(names) > LANGUAGES or len(rows) > LANGUAGES * ranks:
        raise ValueError(f"more than {LANGUAGES} languages")
    number = {x: k for k, x in enumerate(names)}
    rows = sorted((r["gram"], number[r["lang"]], r["rank"]) for r in rows)
    every = np.array(rows, np.int64).reshape(-1, 3)
    gram, start = np.unique(every[:, 0], return_index=True)
    return Profiles(names, gram, np.append(start, len(every)), every[:, 1], every[:, 2], ranks)


def nearness(text: np.ndarray, rank: np.ndarray, gram: np.ndarray, texts: int, p: Profiles) -> np.ndarray:
    """For each text and language, what the text's n-grams of these ranks save of the greatest distance."""
    k = np.searchsorted(p.gram, gram)
    k[k == len(p.gram)] = 0
    hit = np.flatnonzero(p.gram[k] == gram)
    k = k[hit]
    many = p.start[k + 1] - p.start[k]
    each = np.repeat(hit, many)
    at = np.repeat(p.start[k] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(len(each))
    saved = np.maximum(p.ranks - np.abs(rank[each] - p.rank[at]), 0)
    size = len(p.names)
    return np.bincount(text[each] * size + p.lang[at], saved, texts * size).astype(np.int64).reshape(texts, size)


def predicted(buf: np.ndarray, at: np.ndarray, p: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest language of each text (-1 for none) and its score."""
    n = len(at) - 1
    best, score = np.full(n, -1), np.zeros(n)
    text, gram, count = gram_counts(buf, at, np.arange(n))
    if not len(text) or not p.names:
        return best, score
    by = np.lexsort((-count, text))  # ties stay in order of n-grams
    text, gram = text[by], gram[by]
    first = np.searchsorted(text, np.arange(n + 1))
    rank = np.arange(len(text)) - first[text]
    keep = rank < p.ranks
    saved = nearness(text[keep], rank[keep], gram[keep], n, p)
    most = np.minimum(np.diff(first), p.ranks) * p.ranks
    away = most[:, None] - saved
    has = most > 0
    best[has] = away[has].argmin(axis=1)
    near = away[np.arange(n), np.maximum(best, 0)]
    if len(p.names) > 1:
        away[np.arange(n), np.maximum(best, 0)] = np.iinfo(np.int64).max
        most = away.min(axis=1)
    score[has] = (most[has] - near[has]) / np.maximum(most[has], 1)
    return best, score


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score.

    lang_pred is the language of the nearest profile, the first by code point of those equally near; `und` with score 0 where the text is
    null or has no letter, or no language was learned. score is by what share of the next distance the nearest one is less (of the greatest one,
    if a single language was learned): 0 at a tie, near 1 if no other language is close. Other columns are kept, but for two of these names.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    sc = docs.sparkSession.sparkContext.broadcast(profiles)
    most = max(1, (1 << 23) // max(1, len(profiles.names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sc.value
        names = pa.array([*p.names, UNKNOWN], pa.string())
        for whole in batches:
            for part in chunks(whole, "_text", CHUNK):
                for s in range(0, part.num_rows, most):
                    b = part.slice(s, most)
                    best, score = predicted(*text_buffer(b.column("_text")), p)
                    pred = names.take(pa.array(np.where(best < 0, len(p.names), best)))
                    yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pred, pa.array(score)], names=[*(f"c{i}" for i in range(len(kept))), "lang_pred", "score"])

    own = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.col(text_col).alias("_text"))
    kinds = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)]
    out = own.mapInArrow(run, ", ".join([*kinds, "lang_pred string", "score double"]))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), "lang_pred", "score")


def held_out(id_col: str = "doc_id", parts: int = 5) -> Column:
    """Whether nothing is learned from a row: its crc32 of the decimal id is divisible by ``parts``. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == 0, F.lit(False))


def op12_language_ranks(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every whole text of documents, learned from four fifths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", held_out().alias("held_out"), "text", "lang")
    profiles = fit(docs.where(~F.col("held_out")))
    return identify(docs, profiles).select("doc_id", "held_out", "lang_pred", "score")
