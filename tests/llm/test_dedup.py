import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash

from edgeproof.llm import _exchange as ex
from edgeproof.llm import simhash_neardup as sh
from edgeproof.llm.components import components
from edgeproof.llm.substring_countmin import remove_repeats
from edgeproof.llm.suffix_rindex import RunLengthIndex, remove_matches


def corpus(seed, n=120):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcdé ") for _ in range(90)) for _ in range(3)]
    out = []
    for i in range(n):
        x = "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 120)))
        if i % 3 == 0:
            x += shared[i % 3] + x[:40]
        if i % 5 == 0:
            x = shared[0] + x
        if i % 7 == 0 and out:
            x = out[-1]
        if i % 11 == 0:
            x = (x or "ab")[:7] * 20
        out.append(x)
    return out


def test_matching_statistics_are_longest_other_matches():
    rng = np.random.default_rng(0)
    for t in range(20):
        segments = [rng.integers(97, 99 + t % 3, rng.integers(1, 50)).astype(np.uint8) for _ in range(rng.integers(1, 6))]
        index = RunLengthIndex.of(segments)
        text, got = index.text.tolist(), index.matching_statistics()
        n = len(text)
        for i in range(n - 1):
            want = max((next(k for k in range(n) if i + k >= n or j + k >= n or text[i + k] != text[j + k]) for j in range(n) if j != i), default=0)
            assert got[i] == want
        assert len(index.head) <= n


def test_anchors_hang_on_the_window_alone(monkeypatch):
    """Equal runs choose alike wherever they stand, also across the pieces of a long array."""
    monkeypatch.setattr(ex, "PLACE", 8)
    rng = np.random.default_rng(4)
    gram = np.concatenate([rng.integers(0, 1 << 63, 700).astype(np.uint64), np.repeat(rng.integers(0, 1 << 63, 40).astype(np.uint64), 9)])
    got = ex.anchors(gram, 20)
    low = gram >> np.uint64(8)
    assert got.tolist() == [i + int(np.argmin(low[i : i + 20])) for i in range(len(gram) - 19)]


def test_equal_first_hashes_are_told_apart_by_the_second():
    one, inv = ex.distinct(np.array([5, 5, 3, 5], np.uint64), np.array([1, 2, 1, 1], np.uint64))
    assert one.tolist() == [2, 0, 1] and inv.tolist() == [1, 2, 0, 1]


@pytest.mark.parametrize("crowd", [1000, 2])
def test_rindex_against_brute_force(spark, crowd):
    width, texts = 40, [t.encode() for t in corpus(3)] + [b""]
    count = collections.Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    want = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        want.append((len(t), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = remove_matches(df, width=width, crowd=crowd, kept=True).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == want
    assert all(len(r["kept"].encode()) <= r["n_bytes"] - r["n_removed"] for r in got)


@pytest.mark.parametrize("cells", [None, 64])
def test_countmin_against_brute_force(spark, cells):
    """A sketch of a few cells estimates everything repeated; the result stays exact."""
    width, rng = 5, random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(80)]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        w = t.split()
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in seen:
                gone[k : k + width] = [True] * width
            seen.add(key)
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in remove_repeats(df, width=width, cells=cells).collect()}
    assert got == want


def brute_fingerprint(text, width=3):
    w = text.encode().lower().split()
    parts = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def groups(nodes, linked):
    at = {n: n for n in nodes}

    def find(n):
        while at[n] != n:
            n = at[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b) and find(a) != find(b):
                at[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_simhash_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for i in range(150)}
    for i in range(150, 200):
        w = texts[i - 150].split()
        texts[i] = " ".join(w[:-1] if i % 2 else w)
    texts[200] = "A\tb\x0bC  d" * 60000
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = groups(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = sh.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), pairwise=2).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


@pytest.mark.parametrize("pairwise", [0, 5, 10000])
def test_links_give_the_same_components_however_crowded(spark, pairwise):
    rng = random.Random(1)
    base, fps = [rng.getrandbits(64) for _ in range(4)], set()
    for _ in range(300):
        f = rng.choice(base)
        for _ in range(rng.randint(0, 4)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    root = {r["node"] & (1 << 64) - 1: r["root"] for r in components(sh.links(df, 2, pairwise)).collect()}
    want = groups(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 2)
    pairs = collections.defaultdict(set)
    for f in fps:
        pairs[want[f]].add(root.get(f, ("alone", f)))
    assert all(len(v) == 1 for v in pairs.values()) and len({next(iter(v)) for v in pairs.values()}) == len(pairs)


def test_close_copies_are_found_and_others_left_alone(spark):
    rng = random.Random(2)
    sets = lambda t: frozenset(zip(*(t.split()[k:] for k in range(5))))
    rows, n = [], 0
    for _ in range(60):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        for edits in (0, 0, 1, rng.randint(1, 8)):
            v = list(w)
            for _ in range(edits):
                v[rng.randrange(len(v))] = f"new{rng.randrange(10**6)}"
            rows.append((n, " ".join(v)))
            n += 1
    kept = {r["doc_id"] for r in sh.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    s = {i: sets(t) for i, t in rows}
    alike = lambda a, b: len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])
    root = groups(sorted(s), lambda a, b: a // 4 == b // 4 and alike(a, b))
    want = {i for i in s if root[i] == i}
    assert len(kept ^ want) <= 0.02 * len(want) and kept >= want - {i for i in want if i % 4}


def test_large_group_of_close_copies_against_brute_force(spark):
    """Copies similar to the base, less so to each other: every block is crowded, and leaders alone leave some apart."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        v = list(base)
        for p in rng.sample(range(10, 290), rng.randint(5, 7)):
            v[p] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(v)))
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    root = groups(range(400), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = {r["doc_id"] for r in sh.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert kept == {i for i in root if root[i] == i}


def test_crowded_pairs_hold_all_similar_ones_and_few_others(spark):
    """Sets of all sizes around the threshold, and a dense group below it that must not be paired member by member."""
    rng = random.Random(3)
    sets = []
    for _ in range(40):
        base = rng.sample(range(10**6), rng.choice([1, 2, 4, 5, 9, 10, 45, 50]))
        for _ in range(6):
            kept = rng.sample(base, max(1, len(base) - rng.randint(0, max(1, len(base) // 5))))
            sets.append(frozenset(kept) | {rng.randrange(10**6) for _ in range(rng.randint(0, len(base) // 6))})
    core = rng.sample(range(10**6), 80)
    dense = range(len(sets), len(sets) + 300)
    sets += [frozenset(rng.sample(core, 70)) | {rng.randrange(10**9) for _ in range(13)} for _ in dense]
    rows = [(i, i % 7 if i < dense[0] else i, np.array(sorted(x), np.int64).tobytes()) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, root long, set binary")
    got = {(r["u"], r["v"]) for r in sh.crowded_pairs(sh.ranked(df).join(df.select("node", "root"), "node")).collect()}
    alike = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if rows[a][1] != rows[b][1] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(alike) > 100 and got >= alike
    assert sum(u in dense and v in dense for u, v in got - alike) <= 10


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    """Texts that share the first hash are no copies, and none of them goes."""
    monkeypatch.setattr(sh, "node_of", lambda c: sh.F.lit(3).cast("long"))
    rows = [(0, "a b c d e f g"), (1, "h i j k l m n"), (2, "h i j k l m n o"), (3, "p q r s t u v"), (4, "a b c d e f g")]
    kept = {r["doc_id"] for r in sh.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= {0, 1, 2, 3}


def test_short_copies_are_found(spark):
    """Eight words and the same with one added, four fifths similar: more differing bits than longer texts have, and every pair is found."""
    rng = random.Random(11)
    rows = []
    for i in range(1500):
        w = [f"w{rng.randrange(10**6)}" for _ in range(9)]
        rows += [(2 * i, " ".join(w[:8])), (2 * i + 1, " ".join(w))]
    got = sorted(r["doc_id"] for r in sh.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id").collect())
    assert got == [2 * i for i in range(1500)]


def test_awkward_tables(spark, awkward, empty):
    for f in (lambda d: remove_matches(d), lambda d: remove_repeats(d), lambda d: sh.near_duplicates(d)):
        assert f(awkward).count() == awkward.count()
        assert f(empty).count() == 0
    one = {r["doc_id"]: r for r in remove_matches(awkward).where("doc_id > 1").collect()}
    assert one[2]["n_bytes"] == 0 and one[5]["n_removed"] == one[5]["n_bytes"] == one[6]["n_removed"] and one[8]["n_removed"] == 0
    two = {r["doc_id"]: r["n_removed"] for r in remove_repeats(awkward).where("doc_id > 1").collect()}
    assert two[5] == 0 and two[6] == 30000
    near = {r["doc_id"]: r["component_id"] for r in sh.near_duplicates(awkward).where("doc_id > 1").collect()}
    assert near[2] == near[3] == near[4] == 2 and near[6] == near[5] == 5
    kept = sh.keep_one(awkward)
    assert kept.columns == awkward.columns and sh.keep_one(empty).count() == 0
    got = sorted((r["doc_id"] or 0, r["text"] is None) for r in kept.collect())
    assert got == sorted([(1, False), (1, False), (0, False), (2, True), (5, False), (7, False), (8, False), (9, False)])
