import hashlib
import random
import zlib
from collections import Counter

import numpy as np

from edgeproof.llm import fm_decontamination as fm
from edgeproof.llm import media_jpeg as jpeg
from edgeproof.llm import source_mixing as mixing


def brute_targets(sizes):
    """Shares by weight, the excess over twice a source shared anew among the others, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over


def mixed_docs(spark, seed=0):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice(["a", "a", "a", "a", "b", "c", "é", "zz", None])) for i in range(900)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_meets_targets_and_reruns_agree(spark):
    rows, df = mixed_docs(spark)
    got = {r["doc_id"]: r for r in mixing.quotas_taken(df.repartition(3)).collect()}
    sizes, taken = Counter(), Counter()
    for i, t, s in rows:
        sizes[s] += len(t.split())
        taken[s] += got[i]["taken"]
        assert got[i]["size"] == len(t.split()) and got[i]["taken"] in {0, got[i]["size"], 2 * got[i]["size"]}
    want = brute_targets(sizes)
    for i, _, s in rows:
        assert got[i]["source_size"] == sizes[s] and abs(got[i]["target"] - want[s]) < 1e-4
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    again = {r["doc_id"]: r["taken"] for r in mixing.quotas_taken(df.repartition(5)).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}
    m = mixing.mix(df, shards=5).collect()
    times = Counter(r["doc_id"] for r in m)
    assert all(times[i] * r["size"] == r["taken"] for i, r in got.items())
    assert len({(r["doc_id"], r["mix_pass"]) for r in m}) == len(m) and {r["mix_shard"] for r in m} <= set(range(5))


def test_tree_keeps_quotas_and_evens_shards(spark):
    q = spark.createDataFrame([("a", 1, 101), ("b", 2, 7), ("c", 3, 0)], "src string, rank int, quota long")
    rows = mixing.tree(q, 5).collect()
    by_source, by_shard = Counter(), Counter()
    for r in rows:
        by_source[r["src"]] += r["quota"]
        by_shard[r["shard"]] += r["quota"]
    assert by_source == {"a": 101, "b": 7, "c": 0} and set(by_shard) == set(range(5)) and max(by_shard.values()) - min(by_shard.values()) <= 2


def words_of(text):
    out, now = [], ""
    for c in text + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) >= 128:
            now += c
        elif now:
            out.append(now)
            now = ""
    return out


def test_fm_index_against_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["A", "b", "C", "d,e", "x9", "é", f"u{rng.randrange(9)}"]) for _ in range(rng.randint(0, 120)))) for i in range(150)] + [(900, None)]
    bench = [("i1", "a b c d e"), ("i2", "b  A!"), ("i3", ""), ("i4", None), (None, "x9 x9 b c"), ("i2", "é é é"), ("i5", "c c c c c c c")]
    window, want = 4, {}
    wins = [(n, tuple(w[k : k + window])) for n, t in bench for w in [words_of(t or "")] for k in range(max(1, len(w) - window + 1) if w else 0)]
    for i, t in docs:
        w = words_of(t or "")
        hit, names = [False] * len(w), set()
        for n, g in wins:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit[k : k + len(g)] = [True] * len(g)
                    names |= {n} - {None}
        want[i] = (len(w), sum(hit), sorted(names), sum(hit) > 0 and 20 * sum(hit) >= len(w))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(bench, "item_id string, text string")
    for size in (1 << 20, 12):
        rows = fm.contamination(d, b, window=window, block_bytes=size).collect()
        assert {r["id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in rows} == want
    for r in rows:
        text = (dict(docs)[r["id"]] or "").encode()
        assert sum(len(words_of(text[s["start"] : s["end"]].decode())) for s in r["spans"]) == r["n_hit"]
    assert {r["doc_id"] for r in fm.drop_contaminated(d, b, window=window).collect()} == {i for i, x in want.items() if not x[3]}


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 5, 400)
    index = fm.FMIndex(text)
    pats = np.array([[1, 2, 0], [3, 3, 3], [4, 1, 2], [2, 0, 0]])
    length = np.array([2, 3, 3, 1])
    lo, hi = index.search(pats, length)
    for p, n, a, z in zip(pats, length, lo, hi):
        want = [i for i in range(400 - n + 1) if (text[i : i + n] == p[:n]).all()]
        assert sorted(index.locate(np.arange(a, z)).tolist()) == want


def test_jpeg_round_trip():
    rng = np.random.default_rng(1)
    cases = [b"", b"a", b"\xff" * 400, b"x" * 192, rng.integers(0, 256, 5000, dtype=np.uint8).tobytes(), rng.integers(0, 256, 192 * 8200, dtype=np.uint8).tobytes()]
    padded = [jpeg.pad(c) for c in cases]
    assert all(len(p) % 192 == 0 and p for p in padded)
    files = jpeg.encode(padded)
    for p, f, got in zip(padded, files, jpeg.decode(files)):
        assert jpeg.payload(*got) == p and f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9"
        assert jpeg.thumbnail(*got).size >= len(p) // 192


def test_jpeg_decoder_reads_runs_subsampling_and_one_segment():
    """A file made by hand: 4:2:0, no restarts, runs, and end of block before the last coefficient."""
    codes = [(2, 0), (2, 5), (3, 0x03), (3, 0xF0), (3, 0x12)]
    table = {s: (n, c) for (n, s), c in zip(codes, (0b00, 0b01, 0b100, 0b101, 0b110))}
    tables = jpeg._huffman(0, 0, codes) + jpeg._huffman(1, 0, codes)
    bits = ""

    def put(symbol, value=None):
        nonlocal bits
        n, c = table[symbol]
        bits += f"{c:0{n}b}"
        size = symbol & 15
        if value is not None:
            bits += f"{value if value > 0 else value + (1 << size) - 1:0{size}b}"

    for block in range(6):
        put(5, 17 if block < 4 else -20)  # a DC difference
        put(0x12, 3)  # after one zero
        put(0xF0)
        put(0x03, -7)
        put(0)
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    frame = bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    file = b"\xff\xd8" + jpeg._segment(0xE0, b"JFIF\0") + jpeg._segment(0xDB, bytes([0]) + bytes([2] * 64)) + jpeg._segment(0xC0, frame) + tables + jpeg._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + data + b"\xff\xd9"
    h, coef = jpeg.decode([file, b"no jpeg", file[:-9]])[0]
    assert coef[0].shape == (1, 4, 64) and coef[0][0, :, 0].tolist() == [17, 34, 51, 68] and coef[1][0, 0, 0] == -20 and coef[2][0, 0, 0] == -20
    assert coef[0][0, 0, 2] == 3 and coef[0][0, 0, 19] == -7 and (h.width, h.height) == (16, 16)
    assert jpeg.thumbnail(h, coef).tolist() == [[132, 137], [141, 145]]
    assert jpeg.decode([b"no jpeg", file[:-9]]) == [None, None]


def test_stored_texts(spark, awkward, empty):
    rows = jpeg.store_texts(awkward, with_media=True).collect()
    assert len(rows) == awkward.count() and jpeg.store_texts(empty).count() == 0
    texts = {r["doc_id"]: r["text"] for r in awkward.where("doc_id > 1").collect()}
    for r in rows:
        if r["doc_id"] in texts:
            p = jpeg.pad((texts[r["doc_id"]] or "").encode())
            assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["payload_bytes"] == len(p) and r["tail_crc32"] == zlib.crc32(p[-16:]) and r["media_bytes"] == len(r["media"])
    df = spark.createDataFrame([(1, bytes(rows[0]["media"]), 3), (2, None, 3), (3, b"junk", 3)], "k int, content binary, media_width int")
    got = {r["k"]: r for r in jpeg.thumbnails(df).collect()}
    assert got[1]["media_feature"] == rows[0]["feature"] and got[2]["media_width"] is None and got[3]["media_thumbnail"] is None


def test_awkward_tables(spark, awkward, empty):
    bench = spark.createDataFrame([(1, "a b c d e f"), (None, None), (2, "")], "item_id long, text string")
    for d in (awkward, empty):
        assert mixing.quotas_taken(d).count() == d.count()
        assert set(mixing.mix(d).columns) == {*d.columns, "mix_pass", "mix_shard"}
        for b in (bench, bench.limit(0)):
            assert fm.contamination(d, b).count() == d.count()
            assert fm.drop_contaminated(d, b).columns == d.columns
    got = mixing.quotas_taken(awkward).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in got) and sum(r["taken"] for r in got) > 0
    assert fm.drop_contaminated(awkward, bench).count() == awkward.count() - 2
