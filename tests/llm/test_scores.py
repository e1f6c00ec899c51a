import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from edgeproof.llm import lm_bloom as lm
from edgeproof.llm import quality_qda as qda
from edgeproof.llm import toxicity_crf as crf


def labelled(seed, n=600):
    """Texts of two kinds: toxic ones with insults among the words, poor ones in capitals."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 80))]
        toxic, good = i % 5 == 0, i % 4 != 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["vilexa", "vilexum", "dreckon"]))
        text = " ".join(w)
        rows.append((i, text if good else text.upper().replace(" ", "!! "), int(good), int(toxic)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")


def test_field_finds_toxic_texts_and_spans(spark):
    rows = labelled(1)
    docs, labels = frames(spark, rows)
    from pyspark.sql import functions as F

    held = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2}
    f = crf.train(docs, labels, "doc_id", "text", "toxic", lambda c: F.crc32(c.cast("string")) % 4 != 2)
    got = {r["doc_id"]: r for r in crf.score(docs, f, spans=True).collect()}
    wrong = sum((got[i]["score"] >= 0.3) != (rows[i][3] == 1) for i in held)
    assert wrong <= 0.03 * len(held)
    i = next(i for i in sorted(held) if rows[i][3])
    text = rows[i][1].encode()
    assert {w for s in got[i]["spans"] for w in text[s["start"] : s["end"]].decode().lower().replace("!", "").split()} <= {"vilexa", "vilexum", "dreckon"} and got[i]["spans"]


def test_marginals_against_brute_force():
    rng = np.random.default_rng(3)
    emit, trans, first = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 4, 4, 9])
    lanes = crf.Lanes.of(first)
    got, none, both = crf.marginals(emit, lanes, trans, pairs=True)
    want, calm, pair = np.zeros(9), {}, np.zeros((2, 2))
    for s, e in ((0, 4), (4, 9)):
        ways = []
        for bits in range(1 << (e - s)):
            y = [bits >> k & 1 for k in range(e - s)]
            ways.append((y, math.exp(sum(emit[s + k] * y[k] for k in range(e - s)) + sum(trans[a, b] for a, b in zip(y, y[1:])))))
        z = sum(w for _, w in ways)
        calm[int(np.flatnonzero(first[:-1] == s)[-1])] = math.log(z) - math.log(ways[0][1])
        for y, w in ways:
            want[s:e] += np.array(y) * w / z
            for a, b in zip(y, y[1:]):
                pair[a, b] += w / z
    assert np.allclose(got, want) and np.allclose(none, [calm[r] for r in lanes.rows]) and np.allclose(both.sum(axis=1).reshape(2, 2), pair)


def label_odds(emit, trans, miss, slip, toxic):
    """Log probability of a label, by all taggings of one text."""
    ways = {}
    for bits in range(1 << len(emit)):
        y = [bits >> k & 1 for k in range(len(emit))]
        ways[bits] = math.exp(sum(e * v for e, v in zip(emit, y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
    free = ways[0] / sum(ways.values())
    return math.log(free * (miss if toxic else 1 - miss) + (1 - free) * (1 - slip if toxic else slip))


def test_soft_tags_raise_the_likelihood_of_the_label():
    """The pull of tags is the slope of the label's log probability, for emissions and transitions, by differences over all taggings."""
    rng = np.random.default_rng(4)
    emit, trans, first = rng.normal(size=6) - 1, rng.normal(size=(2, 2)), np.array([0, 6])
    lanes = crf.Lanes.of(first)
    p, none, both = crf.marginals(emit, lanes, trans, pairs=True)
    for toxic in (0, 1):
        gain, _ = crf.pull(none, np.array([toxic]), 0.1, 0.05)
        slope = (both @ gain).reshape(2, 2)
        slope[0, 0] -= gain[0] * 5
        at = lambda e, t: label_odds(e, t, 0.1, 0.05, toxic)
        for k in range(6):
            step = np.eye(6)[k] * 1e-5
            assert np.isclose((at(emit + step, trans) - at(emit - step, trans)) / 2e-5, p[k] * gain[0], atol=1e-6)
        for k in range(4):
            step = np.eye(4)[k].reshape(2, 2) * 1e-5
            assert np.isclose((at(emit, trans + step) - at(emit, trans - step)) / 2e-5, slope.flat[k], atol=1e-6)


def test_token_features_against_plain_python():
    texts = ["Grob grobian, GROBIANISMUS!", "", "x", "  grob--über dernière grobian ", "überaus grobianism"]
    data = [t.encode() for t in texts]
    t = crf.tokens(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64))
    want = []
    for d in data:
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in d)
        words = re.findall(rb"[0-9a-z\x80-\xff]+", low)
        for k, w in enumerate(words):
            pre = [w[:n] if len(w) > n else None for n in (4, 5, 6, 7)]
            want.append([w, *pre, w[-5:] if len(w) > 5 else None, words[k - 1] if k else None, words[k + 1] if k + 1 < len(words) else None])
    assert len(want) == t.first[-1] and all(len(f) == len(want) for f in t.features)
    slots = {}
    for kind, f in enumerate(t.features):
        for row, at in zip(want, f.tolist()):
            assert (at == 0) == (row[kind] is None)
            if at:
                assert slots.setdefault((kind, row[kind]), at) == at
    assert len(set(slots.values())) == len(slots)


def test_score_against_all_taggings(spark):
    """Statistics, score and spans of short texts, with the field's weights looked up word by word."""
    rng = np.random.default_rng(5)
    f = crf.Field(rng.normal(size=1 << crf.BITS), -1.5, rng.normal(size=(2, 2)), 0.01, 0.01, np.array([-1.0, 0.7, 0.5, 0.3]))
    texts = ["vile scum of earth", "", None, "calm", "one two three four five six seven", "one two three four five six seven"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in crf.score(docs, f, spans=True).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        t = crf.tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        emit = [f.bias + sum(f.weight[k[j]] for k in t.features) for j in range(len(t.start))]
        ways = []
        for bits in range(1 << len(emit)):
            y = [bits >> k & 1 for k in range(len(emit))]
            ways.append((y, math.exp(sum(e * v for e, v in zip(emit, y)) + sum(f.trans[a, b] for a, b in zip(y, y[1:])))))
        z = sum(w for _, w in ways)
        p = [sum(w for y, w in ways if y[k]) / z for k in range(len(emit))]
        odds = math.log((z - ways[0][1]) / ways[0][1]) if emit else -12
        share = math.sqrt(sum(p) / len(p)) if p else 0
        value = f.cal @ [1, max(-12, min(12, odds)), math.log1p(sum(p)), share]
        assert math.isclose(got[i]["score"], 1 / (1 + math.exp(-value)), abs_tol=1e-8)
        inside = [any(s["start"] <= a and b <= s["end"] for s in got[i]["spans"]) for a, b in zip(t.start, t.end)]
        assert inside == [v >= 0.5 for v in p]


def test_span_of_a_word_that_no_training_text_has(spark):
    """Insults here are one stem with many ends, so its first bytes carry weight."""
    rng, ends = random.Random(8), ["a", "um", "or", "inka", "eto", "yr", "ossa", "uld"]
    rows = [(i, re.sub("vilexa|vilexum|dreckon", lambda m: "vilex" + rng.choice(ends), text), good, toxic) for i, text, good, toxic in labelled(6)]
    docs, labels = frames(spark, rows)
    from pyspark.sql import functions as F

    f = crf.train(docs, labels, "doc_id", "text", "toxic", lambda c: F.lit(True))
    texts = ["w1 w2 w3 vilexatron w5 w6 w7 w8", "w1 w2 w3 verbatron w5 w6 w7 w8"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bad, good = crf.score(docs, f, spans=True, threshold=0.003).orderBy("doc_id").collect()
    # two of its five features are known, so its marginal is small, but alone in the text
    assert [texts[0][s["start"] : s["end"]] for s in bad["spans"]] == ["vilexatron"] and good["spans"] == []
    assert bad["score"] > 2 * good["score"]


def test_discriminant_on_held_out_rows(spark):
    rows = labelled(2)
    docs, labels = frames(spark, rows)
    got = qda.classify(docs, labels).collect()
    assert {r["doc_id"] for r in got if r["held_out"]} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}
    assert all((r["score"] >= 0.3) == (rows[r["doc_id"]][2] == 1) for r in got if r["held_out"])
    assert {r["doc_id"] for r in qda.keep_good(docs, labels).collect()} == {r["doc_id"] for r in got if r["score"] >= 0.3}


def test_density_difference_is_that_of_gaussians():
    rng = np.random.default_rng(0)
    d = len(qda.FEATURES)
    x = [rng.normal(size=(500, d)), rng.normal(1.0, 2.0, size=(400, d))]
    m = qda.fit({c: (float(len(v)), v.sum(0), v.T @ v) for c, v in enumerate(x)}, 0.0, 0.0)
    probe = rng.normal(size=(5, d))
    for c in (0, 1):
        cov = np.linalg.inv(m.inverse[c]) @ np.linalg.inv(m.inverse[c]).T
        dist = np.einsum("ij,jk,ik->i", probe - m.mean[c], np.linalg.inv(cov), probe - m.mean[c])
        assert np.allclose(dist, (((probe - m.mean[c]) @ m.inverse[c].T) ** 2).sum(1)) and np.isclose(m.halflog[c], 0.5 * np.linalg.slogdet(cov)[1])


@pytest.mark.parametrize("head", [lm.HEAD, 5])
def test_base_score_against_brute_force(spark, head):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["The", "of", f"w{rng.randrange(60)}"]) for _ in range(rng.randint(0, 50))) for i in range(120)}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    words = {i: t.lower().split() for i, t in texts.items()}
    c = Counter(w for i in texts if i not in held for w in [*words[i], None])
    n, v = sum(c.values()), len(c)
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    model, exact = lm.train(df.where(~lm.held_out(F.col("doc_id"))), "text", head=head)
    assert (model.total, model.kinds) == (n, v)
    for r in lm.score(df, model, exact).collect():
        w = [*words[r["doc_id"]], None]
        assert (r["n_tokens"], r["n_known"]) == (len(w), sum(c[x] > 0 for x in w))
        assert abs(r["base_score"] - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-5
        assert r["score"] < 0


def test_filter_loses_nothing_and_quantises_from_below():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    n = rng.integers(2, 5000, len(keys))
    m = lm.Model(0, 0, 0, keys[:0], n[:0])
    m.words = lm._filter_part(keys, n, 2, lm.BASE, lm.BITS)
    m.size, m.start = np.array([len(m.words)]), np.zeros(1, np.int64)
    got = m.quantised(keys)
    assert (got > 0).all() and (got >= n / lm.BASE * 0.999).all() and (got <= n * 1.001).mean() > 0.98
    other = np.setdiff1d(rng.integers(0, 1 << 63, 20000).astype(np.uint64), keys)
    assert (m.quantised(other) > 0).mean() < 0.02


def test_awkward_tables(spark, awkward, empty):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (5, None, None), (6, 0, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    for d in (awkward, empty):
        for l in (labels, labels.limit(0)):
            f = crf.train(d, l, "doc_id", "text", "toxic", lambda c: F.lit(True))
            for got in (crf.score(d, f), qda.classify(d, l)):
                rows = got.collect()
                assert len(rows) == d.count() and all(0 <= r["score"] <= 1 for r in rows)
            assert qda.keep_good(d, l).columns == d.columns
        model, exact = lm.train(d, "text")
        got = lm.score(d, model, exact).collect()
        assert len(got) == d.count() and all(r["n_tokens"] >= 1 for r in got)
    model, exact = lm.train(empty, "text")
    assert lm.score(awkward, model, exact).count() == awkward.count()


def test_filter_grows_with_its_entries(spark):
    """No cap: every pair of the least count is scored as seen, and nothing of the filter is in the model that is broadcast."""
    rng = random.Random(8)
    words = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(300)]
    df = spark.createDataFrame([(i, words[i // lm.LEAST]) for i in range(300 * lm.LEAST)], "doc_id long, text string").repartition(3)
    model, exact = lm.train(df, "text")
    assert model.least == lm.LEAST and not len(model.words)
    bits = sum(len(r["bits"]) for r in exact.collect())
    assert bits >= (len({tuple(p) for t in words for p in zip(["^", *t.split()], [*t.split(), "$"])}) * lm.BITS) // 8
    c = Counter(w for t in words for w in t.split() for _ in range(lm.LEAST))
    ends = 300 * lm.LEAST
    total, kinds = sum(c.values()) + ends, len(c) + 1
    got = {r["doc_id"]: r["score"] for r in lm.score(df, model, exact).collect()}
    close = 0
    for i, s in got.items():
        w, want = words[i // lm.LEAST].split(), 0.0
        for a, b in zip([None, *w], [*w, None]):
            prev, now = ends if a is None else c[a], ends if b is None else c[b]
            weight = lm.TOP * prev / (prev + lm.KAPPA)
            want += math.log10(weight * lm.LEAST / prev + (1 - weight) * (now + 1) / (total + kinds + 1))
        close += abs(s - want) < 0.02 * abs(want)
    assert close >= 0.95 * len(got)


def test_pairs_seen_once_count(spark):
    """A text learned once scores better than its words in another order."""
    rng = random.Random(9)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(20)] for _ in range(200)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string").repartition(3)
    model, exact = lm.train(df, "text")
    mixed = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)] + [(200 + i, " ".join(w[::-1])) for i, w in enumerate(words)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score(mixed, model, exact).collect()}
    assert sum(got[i] > got[200 + i] + 10 for i in range(200)) >= 195


def plain_statistics(text):
    """The statistics of one text in plain Python."""
    b = text.encode()
    n, share = max(len(b), 1), lambda v: math.asin(math.sqrt(min(max(v, 0), 1)))
    out = [math.log1p(len(b))] + [share(sum(c in set(g) for c in b) / n) for g in qda._GROUPS.values()]
    out.append(-sum(k / n * math.log2(k / n) for k in Counter(b).values()))
    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    m = max(len(w), 1)
    mean = sum(map(len, w)) / m
    out += [math.log1p(mean), math.log1p(math.sqrt(max(sum(len(x) ** 2 for x in w) / m - mean**2, 0)))]
    out += [math.log1p(len(set(w))) - math.log1p(len(w)), share(max(Counter(w).values(), default=0) / m)]
    for part in (list(zip(w, w[1:])), [x for x in b.split(b"\n") if x]):
        out.append(share(1 - len(set(part)) / len(part)) if part else 0.0)
    good = set(range(48, 58)) | set(range(65, 91)) | set(range(97, 123)) | set(range(128, 256)) | set(b".,;:!?")
    return out + [share(sum(65 <= x[0] < 91 for x in w) / m), share(sum(x[-1] not in good for x in w) / m)]


def test_statistics_against_plain_python():
    from edgeproof.llm._arrow import text_buffer

    rng = random.Random(8)
    texts = ["", " ", "\n\n", "one", "a b a b a b", "line\nline\nother\n\nline", "Große WÖRTER, 12|34 = $5!?", "x" * 5000]
    texts += ["".join(rng.choice(["The ", "the ", "zoo. ", "\n", "A1, ", "é ", "|_ ", "\t", "#$", "end! "]) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    got = qda.statistics(*text_buffer(pa.array([*texts, None])))
    want = np.array([plain_statistics(t) for t in [*texts, ""]])
    assert want.shape[1] == len(qda.FEATURES)
    for k, name in enumerate(qda.FEATURES):
        assert np.allclose(got[:, k], want[:, k], atol=1e-6), name


def test_scores_keep_the_order_of_the_odds(spark):
    docs, labels = frames(spark, labelled(5))
    got = [r["score"] for r in qda.classify(docs, labels).collect()]
    assert len(set(got)) > 0.9 * len(got) and all(0 <= s <= 1 for s in got)


def test_logistic_fit_finds_scale_and_shift():
    rng = np.random.default_rng(1)
    z = rng.normal(size=200_000) * 50
    y = (rng.random(len(z)) < 1 / (1 + np.exp(-(0.1 * z - 1)))).astype(float)
    scale, shift, loss = qda.logistic(z, y, np.ones(len(z)))
    assert abs(scale - 0.1) < 0.003 and abs(shift + 1) < 0.05
    p = 1 / (1 + np.exp(-(scale * z + shift)))
    assert np.isclose(loss, -np.mean(y * np.log(p) + (1 - y) * np.log1p(-p)), rtol=1e-4)
