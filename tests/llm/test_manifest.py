import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from edgeproof.llm import merkle_manifest as mm


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def plain_tree(nodes, fanout):
    """Root of a list of digests, and for each the siblings left and right, level by level."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(own):
            s = a - a % fanout
            paths[i].append(("".join(nodes[s:a]), "".join(nodes[a + 1 : s + fanout])))
        own = [a // fanout for a in own]
        nodes = [digest(*nodes[s : s + fanout]) for s in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plain_manifest(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names, out = sorted(groups, key=lambda s: (s is not None, (s or "").encode())), []
    for s in names:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
    inner = [plain_tree([leaf_of(r, r["text"]) for r in groups[s]], fanout) for s in names]
    root, tops = plain_tree([sub for sub, _ in inner], fanout) if inner else (None, [])
    for s, (sub, paths), top in zip(names, inner, tops, strict=True):
        for r, path in zip(groups[s], paths, strict=True):
            text, path = r["text"], path + top
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            h = leaf_of(r, text)
            for left, right in path:
                h = digest(left, h, right)
            out.append((r["doc_id"], leaf_of(r, r["text"]), sub, root, digest(*(x + y for x, y in path)), h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize(("fanout", "levels", "sizes"), [(16, 2, (1, 16, 17, 300)), (2, 2, (1, 2, 3, 4, 5, 37)), (3, 1, (1, 9, 10, 28)), (2, 3, (64, 65))])
def test_trees_of_every_size_agree_with_a_plain_one(spark, fanout, levels, sizes):
    rows = [{"doc_id": 1000 * k + i, "source": f"s{k}", "lang": "en", "n_chars": i, "text": f"Text {i} É"} for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = sorted(map(tuple, mm.manifest(docs, fanout=fanout, levels=levels).collect()), key=str)
    assert got == plain_manifest(rows, fanout)


def test_awkward_rows(spark, awkward, empty):
    got = mm.manifest(awkward.withColumn("grp", F.lit(1)).withColumn("leaf", F.lit("x")).withColumn("pos", F.lit(3)).withColumn("root", F.lit("r")))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest([r.asDict() for r in awkward.collect()], 16)
    assert mm.manifest(empty).count() == 0


def test_one_group_and_null_group_alone(spark):
    docs = spark.createDataFrame([(5, None, None, None, "ABC")], "doc_id long, source string, lang string, n_chars long, text string")
    assert list(map(tuple, mm.manifest(docs).collect())) == plain_manifest([docs.first().asDict()], 16)


def test_sql_says_the_same(spark):
    rows = [(i, None if i % 7 == 0 else f"s{i % 3}", None if i % 5 == 0 else "de", i, None if i % 11 == 0 else f"Ab É {i}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, mm.manifest(docs).select(names).collect())) == sorted(con.sql(mm.OP11_SQL).select(*names).fetchall())
