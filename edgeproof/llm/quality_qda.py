"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics; each class has a mean and a covariance, shrunk towards the pooled one and
its diagonal. The score is the posterior of class 1, from Mahalanobis log-density differences with cached Cholesky factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import chunks, mix, text_buffer, word_bounds, word_hashes, written

#: Weights of the pooled covariance and of its diagonal in a class's, to choose from; under one, so that classes keep covariances of their own.
SHRINKAGES = tuple((pooled, diagonal) for pooled in (0.0, 0.05, 0.2, 0.5, 0.8) for diagonal in (0.1, 0.3, 0.6))
#: Folds of the labelled rows, bins of log odds, and the ridge of the logistic fit.
FOLDS, BINS, RIDGE = 5, 4000, 1e-3

#: Of one class: count, sum of x, sum of x x'.
Moments = tuple[float, np.ndarray, np.ndarray]

_GROUPS = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "high": range(128, 256),
    "space": (9, 10, 11, 12, 13, 32),
    "stop": b".,;:'\"()-",
    "loud": b"!?",
    "table": b"|_=+\\/",
    "sign": b"#$%&*@^~<>{}[]`",
    "line": (10,),
}
_TABLE = np.zeros((256, len(_GROUPS)))
for _k, _bytes in enumerate(_GROUPS.values()):
    _TABLE[list(_bytes), _k] = 1

#: The statistics, in order.
FEATURES = ("log_bytes", *(f"share_{g}" for g in _GROUPS), "entropy", "word_length", "word_spread", "distinct", "top_word", "pair_again", "line_again", "capital_words", "odd_ends")
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_END = _LETTER.copy()
_END[48:58] = True
_END[list(b".,;:!?")] = True


def _again(doc: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: number of its hashes, of distinct ones, and the most repeats of one."""
    n = np.bincount(doc, minlength=rows)
    if not len(h):
        return n, np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    own = (key[cut] >> np.uint64(44)).astype(np.int64)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, own, np.diff(np.append(cut, len(key))))
    return n, np.bincount(own, minlength=rows), top


def statistics(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; shares are transformed by the arcsine of their root, counts by logarithms. An empty text has zeros."""
    rows, size = len(at) - 1, np.diff(at)
    out = np.zeros((rows, len(FEATURES)))
    if not rows:
        return out
    doc = np.repeat(np.arange(rows), size)
    hist = np.bincount(doc * 256 + buf, minlength=rows * 256).reshape(rows, 256)
    n = np.maximum(size, 1)[:, None]
    share = lambda x: np.arcsin(np.sqrt(np.clip(x, 0, 1)))
    p = hist / n
    out[:, 0] = np.log1p(size)
    k = 1 + len(_GROUPS)
    out[:, 1:k] = share(hist @ _TABLE / n)
    out[:, k] = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    start, end, first = word_bounds(buf, at)
    long = end - start
    own = np.repeat(np.arange(rows), np.diff(first))
    words = np.maximum(np.diff(first), 1)
    mean = np.bincount(own, long, rows) / words
    out[:, k + 1] = np.log1p(mean)
    out[:, k + 2] = np.log1p(np.sqrt(np.maximum(np.bincount(own, long.astype(float) ** 2, rows) / words - mean**2, 0)))
    h = word_hashes(buf, start, end)
    count, kinds, top = _again(own, h, rows)
    some = np.maximum(count, 1)
    out[:, k + 3] = np.log1p(kinds) - np.log1p(count)
    out[:, k + 4] = share(top / some)
    pair = np.flatnonzero(own[1:] == own[:-1]) if len(own) else np.zeros(0, np.int64)
    count2, kinds2, _ = _again(own[pair], mix(h[pair] * np.uint64(3) + h[pair + 1]), rows)
    out[:, k + 5] = share(1 - kinds2 / np.maximum(count2, 1)) * (count2 > 0)
    ls, le, lf = word_bounds(buf, at, _NEWLINE)
    count3, kinds3, _ = _again(np.repeat(np.arange(rows), np.diff(lf)), word_hashes(buf, ls, le), rows)
    out[:, k + 6] = share(1 - kinds3 / np.maximum(count3, 1)) * (count3 > 0)
    if len(start):
        cap = (buf[start] >= 65) & (buf[start] < 91)
        out[:, k + 7] = share(np.bincount(own, cap, rows) / words)
        out[:, k + 8] = share(np.bincount(own, ~_END[buf[end - 1]], rows) / words)
    return out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id and x (array of FEATURES) of each row, with the columns ``keep`` under names c0, c1, ...; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole):
                x = statistics(*text_buffer(b.column("text")))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)), pa.array(np.round(x.ravel(), 9)))
                yield pa.RecordBatch.from_arrays([b.column("id"), flat, *(b.column(f"c{i}") for i in range(len(keep)))], names=["id", "x", *(f"c{i}" for i in range(len(keep)))])

    kind = lambda c: docs.schema[c].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)))
    return own.mapInArrow(run, f"id {kind(id_col)}, x array<double>" + "".join(f", c{i} {kind(c)}" for i, c in enumerate(keep)))


@dataclass
class Model:
    """prior: log odds of class 1; mean, inverse Cholesky factor and half log determinant of each class; scale and shift of the log odds, as
    densities of dependent statistics are surer than they ought to be."""

    prior: float
    mean: list[np.ndarray]
    inverse: list[np.ndarray]
    halflog: list[float]
    scale: float = 1.0
    shift: float = 0.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        density = [-0.5 * (((x - self.mean[c]) @ self.inverse[c].T) ** 2).sum(1) - self.halflog[c] for c in (0, 1)]
        return self.prior + density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.odds(x) + self.shift, -700, 700)))


def fit(moments: dict[int, Moments], pooled: float, diagonal: float) -> Model:
    """moments: of each class the count, the sum of x and the sum of x x'. A class without rows takes the other's shape; without any rows every score is a half."""
    d = len(FEATURES)
    n = [moments[c][0] if c in moments else 0.0 for c in (0, 1)]
    prior = float(np.log(n[1] + 0.5) - np.log(n[0] + 0.5))
    if not all(n):
        return Model(prior, [np.zeros(d)] * 2, [np.eye(d)] * 2, [0.0, 0.0])
    mean = [moments[c][1] / n[c] for c in (0, 1)]
    cov = [moments[c][2] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    both = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    out = Model(prior, mean, [], [])
    for c in (0, 1):
        a = pooled + (1 - pooled) * d / (d + n[c])  # few rows: more of the pooled one
        s = (1 - a) * cov[c] + a * both
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(both)) + 1e-4 * np.eye(d)
        low = np.linalg.cholesky(s)
        out.inverse.append(np.linalg.inv(low))
        out.halflog.append(float(np.log(np.diag(low)).sum()))
    return out


def labelled(x: DataFrame, labels: DataFrame, id_col: str, label_col: str, training: F.Column) -> DataFrame:
    """(x, y, fold) of all labelled rows whose id fulfils ``training``. A null label or id is no labelled row; of several labels of an id the largest counts."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    own = own.where(training(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    fold = (F.crc32(F.concat(F.lit("f"), F.col("id").cast("string"))) % FOLDS).cast("int").alias("fold")
    return x.join(own, "id").select("x", "y", fold)


def moments(rows: DataFrame) -> dict[int, dict[int, Moments]]:
    """Of each fold and class of ``labelled`` rows the count, the sum of x and the sum of x x'; partitions send sums, not rows."""
    d = len(FEATURES)
    size = 1 + d + d * d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * FOLDS, size))
        for b in batches:
            v = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            k = b.column("fold").to_numpy(zero_copy_only=False) * 2 + b.column("y").to_numpy(zero_copy_only=False)
            for c in range(2 * FOLDS):
                w = v[k == c]
                total[c] += np.concatenate([[len(w)], w.sum(0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    total = np.zeros(2 * FOLDS * size)
    for r in rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        total[r["i"]] = r["v"]
    total = total.reshape(FOLDS, 2, size)
    return {k: {c: (t[0], t[1 : 1 + d], t[1 + d :].reshape(d, d)) for c, t in enumerate(total[k]) if t[0] > 0} for k in range(FOLDS)}


def _sum(parts: list[dict[int, Moments]]) -> dict[int, Moments]:
    return {c: tuple(sum(p[c][i] for p in parts if c in p) for i in range(3)) for c in (0, 1) if any(c in p for p in parts)}


def logistic(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Scale and shift of the log odds z of labels y, each n times, by damped Newton steps on the log loss with a slight ridge; and that loss a row."""
    if not len(z) or not 0 < (n * y).sum() < n.sum():
        return 1.0, 0.0, float("inf")
    unit = max(float(np.sqrt((n * z**2).sum() / n.sum())), 1e-9)
    a, w = np.stack([z / unit, np.ones(len(z))], 1), np.array([1.0, 0.0])
    loss = lambda w: float((n * (np.logaddexp(0, a @ w) - y * (a @ w))).sum() + RIDGE / 2 * w @ w)
    for _ in range(100):
        p = 0.5 + 0.5 * np.tanh(a @ w / 2)
        step = np.linalg.solve((a.T * (n * p * (1 - p))) @ a + RIDGE * np.eye(2), a.T @ (n * (p - y)) + RIDGE * w)
        t = 1.0
        while t > 1e-6 and loss(w - t * step) > loss(w):
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-9:
            break
    return max(float(w[0]) / unit, 1e-9), float(w[1]), loss(w) / float(n.sum())


def trained(rows: DataFrame) -> Model:
    """The model of ``labelled`` rows: its shrinkage is the one of SHRINKAGES under which rows of each fold, scored from the other folds, have the
    least log loss, and the scale and shift of its log odds are those that give that loss. Odds meet the driver as counts in BINS bins a class."""
    by_fold = moments(rows)
    models = [[fit(_sum([m for j, m in by_fold.items() if j != k]), *s) for k in range(FOLDS)] for s in SHRINKAGES]
    shared = rows.sparkSession.sparkContext.broadcast(models)
    shape = (len(SHRINKAGES), 2, BINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(shape), np.zeros(shape)
        for b in batches:
            v = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            y, fold = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold"))
            for s in range(len(SHRINKAGES)):
                for k in np.unique(fold):
                    z = shared.value[s][k].odds(v[fold == k])
                    at = (y[fold == k], np.clip((np.arcsinh(z) + 20) * (BINS / 40), 0, BINS - 1).astype(int))
                    np.add.at(count[s], at, 1)
                    np.add.at(total[s], at, z)
        i = np.flatnonzero(count.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(count.ravel()[i]), pa.array(total.ravel()[i])], names=["i", "n", "z"])

    count, total = np.zeros(shape), np.zeros(shape)
    for r in rows.mapInArrow(run, "i long, n double, z double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("z").alias("z")).collect():
        count.ravel()[r["i"]], total.ravel()[r["i"]] = r["n"], r["z"]
    told = []
    for s in range(len(SHRINKAGES)):
        y, at = np.nonzero(count[s])
        n = count[s][y, at]
        told.append(logistic(total[s][y, at] / n, y.astype(float), n))
    best = min(range(len(told)), key=lambda s: told[s][2])
    return replace(fit(_sum(list(by_fold.values())), *SHRINKAGES[best]), scale=told[best][0], shift=told[best][1])


def score(x: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """id and score of each row of ``features``, beside its columns ``keep``."""
    shared = x.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(b.column(c) for c in keep), pa.array(shared.value.score(v))], names=["id", *keep, "score"])

    kind = lambda c: x.schema[c].dataType.simpleString()
    return x.select("id", "x", *keep).mapInArrow(run, f"id {kind('id')}" + "".join(f", {c} {kind(c)}" for c in keep) + ", score double")


def held_out(c: F.Column) -> F.Column:
    """The fold that is never learned from; a null id is not in it."""
    return F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id_col, held_out, score (posterior of label 1) of each row of ``docs``.

    One row for each input row, repeated ones too; null and empty texts are scored as texts of no bytes. Statistics are computed
    once, written to the shared folder, joined to the labels for the class moments and again for the odds by fold, and scored. Scores are not rounded: they keep the order of the
    log-density differences.
    """
    x = written(features(docs, id_col, text_col), "quality")
    model = trained(labelled(x, labels, id_col, label_col, lambda c: ~held_out(c)))
    return score(x, model).select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, as they are; learned from the labelled rows outside the held-out fold. Text stays in its partition."""
    x = written(features(docs, id_col, text_col), "quality")
    shared = docs.sparkSession.sparkContext.broadcast(trained(labelled(x, labels, id_col, label_col, lambda c: ~held_out(c))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole):
                yield b.filter(pa.array(shared.value.score(np.round(statistics(*text_buffer(b.column("text"))), 9)) >= threshold)).select(["row"])

    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")


def op6_quality_qda(spark, sf_dir: str) -> DataFrame:
    """Quality of every whole text of documents, learned from labels.quality outside the held-out fifth."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels).select("*", (F.col("score") >= 0.3).cast("int").alias("predicted"))
