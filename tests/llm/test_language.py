from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeproof.llm import language_ranks as lr

SF = "/root/testdata/sf0.001"


def plain_grams(text):
    """Counts of the n-grams of a text, as tuples of code points plus one; a blank is 1."""
    words, word, out = [], "", Counter()
    for c in text + " ":
        if c.isalpha():
            word += c.lower()[0]
        elif word:
            words.append(word)
            word = ""
    for w in words:
        s = [1, *(ord(c) + 1 for c in w), 1]
        out.update((x, 0, 0) for x in s[1:-1])
        out.update((*p, 0) for p in zip(s, s[1:]))
        out.update(zip(s, s[1:], s[2:]))
    return out


def ranking(counts, ranks):
    return {g: k for k, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:ranks])}


def plain_identify(rows, ranks):
    total = {}
    for r in rows:
        if r["text"] is not None and r["lang"] is not None and not (r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 5 == 0):
            total.setdefault(r["lang"], Counter()).update(plain_grams(r["text"]))
    profiles = {lang: ranking(c, ranks) for lang, c in total.items() if c}
    out = []
    for r in rows:
        own = ranking(plain_grams(r["text"] or ""), ranks)
        away = sorted((sum(min(ranks, abs(k - p[g])) if g in p else ranks for g, k in own.items()), lang) for lang, p in profiles.items())
        if not own or not away:
            out.append((r["doc_id"], "und", 0.0))
        else:
            beyond = away[1][0] if len(away) > 1 else len(own) * ranks
            out.append((r["doc_id"], away[0][1], (beyond - away[0][0]) / max(beyond, 1)))
    return out


def identified(docs, ranks):
    own = docs.withColumn("held", lr.held_out())
    return lr.identify(own, lr.fit(own.where(~F.col("held")), ranks=ranks))


@pytest.mark.parametrize("ranks", [400, 25])
def test_predictions_agree_with_plain_python(spark, ranks):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identified(docs, ranks).collect()}
    want = plain_identify([r.asDict() for r in docs.collect()], ranks)
    assert len(got) == len(want)
    for i, lang, score in want:
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-12)


def test_held_out_texts_are_told_right(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identified(docs, lr.RANKS).where("held and lang is not null").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("right")).agg(F.avg("right"), F.count("*")).first()
    assert got[1] > 100 and got[0] > 0.97


def test_awkward_rows(spark, awkward, empty):
    docs = awkward.withColumn("lang_pred", F.lit("x")).withColumn("_text", F.lit("y")).withColumn("c0", F.lit(0))
    got = identified(docs, 400)
    assert set(got.columns) == {*docs.columns, "held", "score"}
    want = plain_identify([r.asDict() for r in awkward.collect()], 400)
    assert sorted(((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in got.collect()), key=str) == sorted(((i, x, round(s, 9)) for i, x, s in want), key=str)
    assert identified(empty, 400).count() == 0
    assert {(r["lang_pred"], r["score"]) for r in identified(awkward.withColumn("lang", F.lit(None).cast("string")), 400).collect()} == {("und", 0.0)}


def test_one_language_and_ties(spark):
    docs = spark.createDataFrame([(1, "abc", "zz"), (2, "abc", None), (3, "7 ...", None), (4, "qqq", None), (6, "abc", "aa")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lr.identify(docs, lr.fit(docs)).collect()}
    assert got[2] == ("aa", 0.0) and got[3] == ("und", 0.0)
    one = lr.identify(docs, lr.fit(docs.where("doc_id = 1")))
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in one.collect()}[2] == ("zz", 1.0)


def test_too_many_languages_fail(spark, monkeypatch):
    monkeypatch.setattr(lr, "LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        lr.fit(spark.createDataFrame([(x, x) for x in "abc"], "text string, lang string"))


def test_many_signs_and_bytes_that_are_no_utf8():
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 9000))) for _ in range(40)]
    raw = [t.encode() for t in texts]
    buf, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    owner = np.arange(40) << 20
    o, g, n = lr.gram_counts(buf, at, owner)
    for k in (0, 17, 39):
        assert dict(zip(zip((g[o == owner[k]] >> 42).tolist(), (g[o == owner[k]] >> 21 & 0x1FFFFF).tolist(), (g[o == owner[k]] & 0x1FFFFF).tolist()), n[o == owner[k]].tolist(), strict=True)) == plain_grams(texts[k])
    bad = np.frombuffer(b"ab\xffcd" + b"ef", np.uint8)
    o, g, n = lr.gram_counts(bad, np.array([0, 5, 7]), np.array([0, 1]))
    assert n[o == 0].sum() == sum(plain_grams("ab cd").values()) and n[o == 1].sum() == sum(plain_grams("ef").values())
