import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from edgeproof.llm import phrase_collocations as pc


def plain(rows, least, longest=5, top=2000):
    """Collocations of (text, lang) rows by plain Python integers."""
    count, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                count.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in often.items():
            inside = any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items())
            if not inside:
                score, _, left, right = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, t.decode(), -a, left, right, total[lang], -s) for r, (s, a, t, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def rows_of(n, seed):
    rng = random.Random(seed)
    words = ["a", "B", "c", "Dé", "éE", "漢", "x y", "z-z"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!?"]) for _ in range(rng.randrange(40)))
    rows = [(text(), rng.choice(["en", "de", None])) for _ in range(n)]
    return [*rows, *[("The same LINE of words again\nthe same line of words again", "en")] * 30, *[("one two three four five six, one two three", "de")] * 11]


@pytest.mark.parametrize(("least", "longest", "top"), [(12, 5, 2000), (3, 5, 25), (12, 2, 2000), (20, 3, 7)])
def test_agrees_with_plain_integers(spark, least, longest, top):
    rows = rows_of(120, least)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    got = sorted(map(tuple, pc.collocations(docs, least=least, longest=longest, top=top).collect()))
    assert len(got) >= 3 and got == plain(rows, least, longest, top)


def test_small_chunks_and_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(pc, "ASK", 300)
    rows = rows_of(150, 5)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert sorted(map(tuple, pc.collocations(docs, least=9, buckets=13).collect())) == plain(rows, 9)


def test_products_beyond_64_bits(spark):
    n = 10**13
    counts = spark.createDataFrame([("en", 0, "", n), ("en", 1, "a", 10**12), ("en", 1, "b", 3 * 10**11 + 7), ("en", 2, "a b", 10**11 + 3)], "lang string, words int, phrase string, f long")
    assert tuple(pc.scored(counts).first()) == ("en", "a b", 2, 10**11 + 3, 10**12, 3 * 10**11 + 7, n, 1000 * (10**11 + 3) * n // (10**12 * (3 * 10**11 + 7)))


def test_awkward_rows(spark, awkward, empty):
    docs = awkward.withColumn("piece", F.lit("p")).withColumn("n", F.lit(1)).withColumn("phrase", F.lit("q"))
    got = sorted(map(tuple, pc.collocations(docs, least=2).collect()))
    assert got == plain([(r["text"], r["lang"]) for r in awkward.collect()], 2)
    assert pc.collocations(empty).count() == 0
    assert pc.collocations(awkward.where("text is null or text = ''")).count() == 0


def test_identical_pieces_are_one_row(spark):
    docs = spark.createDataFrame([("Ab c. ab c,x", "en"), ("ab c ", "en"), ("ab c", None), (None, "en")], "text string, lang string")
    assert {tuple(r) for r in pc.pieces(docs).collect()} == {("en", "ab c", 3), ("en", "x", 1), ("und", "ab c", 1)}
