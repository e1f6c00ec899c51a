"""Toxicity: a linear-chain conditional random field tags toxic spans.

Labels mark whole documents, so the tags of the tokens are hidden: a document is toxic if a token of it is, but for label noise (the
shares ``miss`` of toxic labels without a toxic token, and ``slip`` of documents with one that are labelled 0). The field has two states,
transitions, and weights of hashed features of every token and its neighbours (the word, its first four to seven bytes, its last five, the
words before and after); no feature is chosen by the labels. In two thirds of the training documents each round tags tokens softly, by
their posterior given the document's label, and moves weights, transitions and noise towards these tags: the marginal likelihood of the
labels grows. Forward-backward marginals over every token of a text give the offending offsets and three statistics of the document;
a logistic calibration of them, fitted on the other third, gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import BYTE, chunks, mix, prefix_hash, range_hash, text_buffer, word_bounds

#: At most so many labelled rows of each class are learned from, those first by a hash of their id; and texts of at most so many bytes.
SAMPLE_ROWS = 2500
SAMPLE_BYTES = 1 << 15
CHUNK = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False
_BASE = 0x9E3779B97F4A7C15
#: Weights of the field: features share them by the first bits of their hashes.
BITS = 20
#: A feature in fewer different training texts has no weight.
SUPPORT = 3


@dataclass
class Tokens:
    """Tokens of some texts: where they are, to which text they belong, and the slots of their features (kind by token), 0 for none."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    features: list[np.ndarray]


def slot(h: np.ndarray, kind: int) -> np.ndarray:
    """Where the weight of a feature is; slot 0 stays empty."""
    at = (mix(h ^ np.uint64((kind + 1) * _BASE % (1 << 64))) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.maximum(at, 1)


def tokens(buf: np.ndarray, at: np.ndarray) -> Tokens:
    """Kinds of features: the word, first 4, 5, 6 and 7 bytes of longer words, last 5, the word before, the word after."""
    low = _LOWER[buf]
    start, end, first = word_bounds(low, at, _BREAK)
    size, pre = end - start, prefix_hash(BYTE[low], _BASE)
    word = range_hash(pre, start, end, _BASE)
    out = [slot(word, 0)]
    for n in (4, 5, 6, 7):
        out.append(np.where(size > n, slot(range_hash(pre, start, np.minimum(start + n, end), _BASE), n), 0))
    out.append(np.where(size > 5, slot(range_hash(pre, np.maximum(end - 5, start), end, _BASE), 8), 0))
    before, after = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
    before[1:], after[:-1] = slot(word[:-1], 9), slot(word[1:], 10)
    some = np.diff(first) > 0
    before[first[:-1][some]] = 0
    after[first[1:][some] - 1] = 0
    return Tokens(start, end, first, [*out, before, after])


@dataclass
class Lanes:
    """Order of tokens by place within their text, then text, longest text first; texts with tokens only (``rows``)."""

    order: np.ndarray
    base: np.ndarray
    rows: np.ndarray

    @staticmethod
    def of(first: np.ndarray) -> Lanes:
        size = np.diff(first)
        rows = np.argsort(-size, kind="stable")
        rows = rows[: int((size > 0).sum())]
        if not len(rows):
            return Lanes(np.zeros(0, np.int64), np.zeros(1, np.int64), rows)
        longest = int(size[rows[0]])
        live = np.searchsorted(-size[rows], -np.arange(longest), "left")  # texts with more than t tokens
        base = np.concatenate([[0], np.cumsum(live)])
        t = np.repeat(np.arange(longest), live)
        lane = np.arange(base[-1]) - base[t]
        return Lanes(first[:-1][rows][lane] + t, base, rows)


@dataclass
class Field:
    """The fitted field. weight: of each slot for state 1; trans: log transition scores; miss, slip: noise of the labels; cal: the calibration."""

    weight: np.ndarray
    bias: float
    trans: np.ndarray
    miss: float
    slip: float
    cal: np.ndarray

    def emission(self, t: Tokens) -> np.ndarray:
        return self.bias + sum(self.weight[i] for i in t.features)


def marginals(emit: np.ndarray, lanes: Lanes, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(state 1) of each token, -log P(no token has state 1) of each text of ``lanes``; with pairs each text's expected transitions (by from, to), too."""
    e, base = np.exp(np.clip(emit[lanes.order], -30, 30)), lanes.base
    m = np.exp(trans)
    (m00, m01), (m10, m11) = m.tolist()
    steps, a1, b1 = len(base) - 1, np.empty(len(e)), np.empty(len(e))
    none = np.zeros(len(lanes.rows))
    both = np.zeros((4, len(lanes.rows) if pairs else 0))
    prev = None
    for t in range(steps):
        x = e[base[t] : base[t + 1]]
        n = len(x)
        if prev is None:
            f1, f0, calm = x, np.ones(n), 1.0
        else:
            p = prev[:n]
            f1 = x * (m01 + (m11 - m01) * p)
            f0 = m00 + (m10 - m00) * p
            calm = m00
        z = f0 + f1
        prev = f1 / z
        a1[base[t] : base[t + 1]] = prev
        none[:n] += np.log(z / calm)
    nxt = None
    for t in range(steps - 1, -1, -1):
        n = base[t + 1] - base[t]
        b = np.full(n, 0.5)
        if nxt is not None:
            k = len(nxt)
            x = e[base[t + 1] : base[t + 2]] * nxt
            g0, g1 = m00 * (1 - nxt) + m01 * x, m10 * (1 - nxt) + m11 * x
            b[:k] = g1 / (g0 + g1)
            if pairs:
                a = a1[base[t] : base[t] + k]
                q = np.stack([(1 - a) * m00 * (1 - nxt), (1 - a) * m01 * x, a * m10 * (1 - nxt), a * m11 * x])
                both[:, :k] += q / q.sum(axis=0)
        b1[base[t] : base[t + 1]] = nxt = b
    top = a1 * b1
    out = np.empty(len(emit))
    out[lanes.order] = top / (top + (1 - a1) * (1 - b1))
    return out, np.maximum(none, 1e-12), both


def responsibility(none: np.ndarray, toxic: np.ndarray, miss: float, slip: float) -> np.ndarray:
    """P(some token is toxic) of texts with these labels, from ``none`` = -log P(no token is)."""
    free, some = np.exp(-none), -np.expm1(-none)
    hit = some * np.where(toxic, 1 - slip, slip)
    return hit / (hit + free * np.where(toxic, miss, 1 - miss))


def pull(none: np.ndarray, toxic: np.ndarray, miss: float, slip: float) -> tuple[np.ndarray, np.ndarray]:
    """By how much a text's expectations given its label exceed the field's own, as a share of these; and P(some token is toxic) given the label.

    Given that some token is toxic they are those of the field over P(some), less the calm path's part in the transitions.
    """
    r = responsibility(none, toxic, miss, slip)
    return r / -np.expm1(-none) - 1, r


def fit_field(t: Tokens, toxic: np.ndarray, rounds: int = 60, l2: float = 0.1, rate: float = 0.15) -> Field:
    """Penalised marginal likelihood of the labels of the texts by Adam steps; tags and label noise are posteriors, new each round."""
    f = Field(np.zeros(1 << BITS), -6.0, np.zeros((2, 2)), 0.02, 0.02, np.zeros(4))
    lanes = Lanes.of(t.first)
    doc = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    # slots in enough texts
    live = np.zeros(1 << BITS, bool)
    for i in t.features:
        pairs = np.unique(i * np.int64(len(toxic)) + doc) // len(toxic)
        live |= np.bincount(pairs, minlength=len(live)) >= SUPPORT
    live[0] = False
    names = np.flatnonzero(live)
    n = len(names)
    place = np.full(1 << BITS, n, np.int32)
    place[names] = np.arange(n, dtype=np.int32)
    ids = [place[i] for i in t.features]
    bad = toxic[lanes.rows].astype(bool)
    theta = np.zeros(n + 5)
    theta[n] = f.bias
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    keep = np.full(n + 5, l2)
    keep[n] = 0.0
    calm = np.maximum(np.diff(t.first)[lanes.rows] - 1, 0)
    for step in range(1, rounds + 1):
        w = np.append(theta[:n], 0.0)
        f.bias, f.trans = float(theta[n]), theta[n + 1 :].reshape(2, 2)
        p, none, both = marginals(f.bias + sum(w[i] for i in ids), lanes, f.trans, pairs=True)
        gain, r = pull(none, bad, f.miss, f.slip)
        up = np.zeros(len(toxic))
        up[lanes.rows] = gain
        d = p * up[doc]
        g = sum(np.bincount(i, d, n + 1) for i in ids)[:n]
        turn = both @ gain
        turn[0] -= float((gain * calm).sum())
        grad = np.concatenate([g, [d.sum()], turn]) - keep * theta
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad * grad
        theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-9)
        if step > rounds // 6:  # the first rounds know too little for noise
            f.miss = float(((1 - r) * bad).sum() + 1) / float((1 - r).sum() + 2)
            f.slip = float((r * ~bad).sum() + 1) / float(r.sum() + 2)
    f.weight[names], f.bias, f.trans = theta[:n], float(theta[n]), theta[n + 1 :].reshape(2, 2)
    return f


def statistics(p: np.ndarray, none: np.ndarray, lanes: Lanes, first: np.ndarray) -> np.ndarray:
    """Of each text: the log odds of a toxic token, log(1 + expected toxic tokens), and the root of their share; a text without tokens has (-12, 0, 0)."""
    size = np.diff(first)
    some = size > 0
    out = np.zeros((len(size), 3))
    out[:, 0] = -12
    if some.any():
        out[lanes.rows, 0] = np.clip(none + np.log(-np.expm1(-none)), -12, 12)
        total = np.add.reduceat(p, first[:-1][some])
        out[some, 1] = np.log1p(total)
        out[some, 2] = np.sqrt(total / size[some])
    return out


def judged(f: Field, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each token, and the statistics of each text."""
    lanes = Lanes.of(t.first)
    p, none, _ = marginals(f.emission(t), lanes, f.trans)
    return p, statistics(p, none, lanes, t.first)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Penalised logistic regression by Newton steps; the constant first."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + l2 * np.eye(len(w))
        w = w + np.linalg.solve(hess, z.T @ (y - p) - l2 * w)
    return w


def fit(texts: list[bytes], toxic: np.ndarray, fold: np.ndarray) -> Field:
    """texts with labels; fold 0 fits the field, fold 1 calibrates. Without toxic rows every score is the share of toxic rows."""
    prior = (float(toxic.sum()) + 0.5) / (len(toxic) + 1.0)
    flat = Field(np.zeros(1 << BITS), -6.0, np.zeros((2, 2)), 0.0, 0.0, np.array([np.log(prior / (1 - prior)), 0, 0, 0]))

    def toks(rows: np.ndarray) -> Tokens:
        """Features of these texts, a few hundred texts at a time; offsets are left out."""
        out, first = [], [np.zeros(1, np.int64)]
        for k in range(0, len(rows), 256):
            part = [texts[i] for i in rows[k : k + 256]]
            t = tokens(np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int64))
            out.append([i.astype(np.int32) for i in t.features])
            first.append(t.first[1:] + first[-1][-1])
        none = np.zeros(0, np.int64)
        return Tokens(none, none, np.concatenate(first), [np.concatenate(x) for x in zip(*out, strict=True)])

    own, other = np.flatnonzero(fold == 0), np.flatnonzero(fold == 1)
    if not toxic[own].any() or toxic[own].all() or not len(other):
        return flat
    # each distinct text counts once
    _, once = np.unique(np.array([hash_text(texts[i]) for i in own], np.uint64), return_index=True)
    own = own[np.sort(once)]
    f = fit_field(toks(own), toxic[own].astype(np.int64))
    f.cal = fit_logistic(judged(f, toks(other))[1], toxic[other].astype(np.float64))
    return f


def hash_text(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, training: F.Column, rows: int = SAMPLE_ROWS) -> Field:
    """Fit on at most ``rows`` labelled rows of each class whose id fulfils ``training``; a null label or id is no labelled row. Which rows: those first by a hash of the id; of a repeated id the least text that is short enough, toxic if any of its labels says so."""
    from functools import reduce

    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull())
    own = own.where(training(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    key = F.xxhash64("id", F.lit(5))
    picked = reduce(DataFrame.unionAll, [own.where(F.col("y") == v).orderBy(key, "id").limit(rows) for v in (0, 1)])
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    got = text.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    got = got.select("id", "y", F.encode("text", "UTF-8").alias("text"), (F.pmod(F.xxhash64("id", F.lit(6)), F.lit(3)) == 2).cast("int").alias("fold"))
    got = sorted(((r["id"], bytes(r["text"]), r["y"], r["fold"]) for r in got.collect()), key=lambda r: (r[0], r[1]))
    field = fit([r[1] for r in got], np.array([r[2] for r in got], np.int64), np.array([r[3] for r in got], np.int64))
    kept = [sum(r[2] == v for r in got) for v in (0, 1)]
    if all(kept):  # the sample holds the classes in another proportion than the labels
        field.cal[0] += np.log(max(counts.get(1, 0), 0.5) / max(counts.get(0, 0), 0.5)) - np.log(kept[1] / kept[0])
    return field


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, threshold: float = 0.5) -> DataFrame:
    """id_col and score of each row, by the whole text; with ``spans`` the byte ranges whose tokens have marginals from ``threshold`` on, next to each other ones joined.

    One row for each input row, no shuffle. A null text is empty, and an empty text gets the score of one without toxic tokens. Null
    ids and repeated rows pass; other columns are not returned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for whole in batches:
            for b in chunks(whole, most=CHUNK):
                buf, at = text_buffer(b.column("text"))
                t = tokens(buf, at)
                p, x = judged(f, t)
                value = 1 / (1 + np.exp(-np.clip(f.cal[0] + x @ f.cal[1:], -30, 30)))
                cols, names = [b.column("id"), pa.array(np.round(value, 9))], ["id", "score"]
                if spans:
                    hot = p >= threshold
                    doc = np.repeat(np.arange(len(at) - 1), np.diff(t.first))
                    first = np.flatnonzero(hot & ~(np.append(False, hot[:-1]) & (np.append(-1, doc[:-1]) == doc)))
                    last = np.flatnonzero(hot & ~(np.append(hot[1:], False) & (np.append(doc[1:], -1) == doc)))
                    rows: list[list[dict]] = [[] for _ in range(b.num_rows)]
                    for i, j in zip(first.tolist(), last.tolist(), strict=True):
                        rows[doc[i]].append({"start": int(t.start[i] - at[doc[i]]), "end": int(t.end[j] - at[doc[i]])})
                    cols.append(pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double" + ", spans array<struct<start:bigint,end:bigint>>" * spans)
    return got.withColumnRenamed("id", id_col)


def op5_toxicity_crf(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of documents, learned from labels.toxic outside the held-out quarter."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = lambda c: F.coalesce(F.crc32(c.cast("string")) % 4 == 2, F.lit(False))
    field = train(docs, labels, "doc_id", "text", "toxic", lambda c: ~held(c))
    got = score(docs, field)
    return got.select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
