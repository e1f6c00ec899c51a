import random

import pytest
from pyspark.sql import functions as F

from edgeproof.llm import warc_merkle as wm


def replica(spark, rows):
    return spark.createDataFrame(rows, "file string, seq long, offset long, length long, sha256 string")


def test_audit_finds_changed_missing_and_extra_records(spark):
    rng = random.Random(1)
    ours = [(f, k, 10 * k, 10, f"{rng.getrandbits(64):x}") for f in "ab" for k in range(300)] + [("c", 0, 0, 5, "x")]
    theirs = [list(r) for r in ours if r[:2] != ("b", 299)]
    for r in theirs:
        if (r[0], r[1]) in {("a", 0), ("a", 17), ("b", 150)}:
            r[4] = "bad"
    theirs += [["d", 0, 0, 1, "y"]]
    got = {tuple(r) for r in wm.mismatches(replica(spark, ours).repartition(3), replica(spark, theirs), fanout=4).collect()}
    assert got == {("a", 0, "changed"), ("a", 17, "changed"), ("b", 150, "changed"), ("b", 299, "missing"), ("d", 0, "extra")}
    assert wm.mismatches(replica(spark, ours), replica(spark, ours)).count() == 0
    assert wm.mismatches(replica(spark, []), replica(spark, [])).count() == 0


@pytest.mark.parametrize("packed", [False, True])
def test_files_and_their_replicas(spark, tmp_path, packed):
    texts = [f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(b.encode())}\r\n\r\n{b}\r\n\r\n" for b in ("", "é" * 50, "x\r\n\r\ny", "end")]
    for side in ("one", "two"):
        (tmp_path / side).mkdir()
        (tmp_path / side / "a.warc").write_bytes(wm.warc_bytes(texts, packed))
    changed = [*texts[:2], texts[2].replace("x", "z"), texts[3]]
    (tmp_path / "two" / "a.warc").write_bytes(wm.warc_bytes(changed, packed))
    ours, theirs = wm.read_warc(spark, f"{tmp_path}/one"), wm.read_warc(spark, f"{tmp_path}/two")
    rows = ours.orderBy("seq").collect()
    assert [r["type"] for r in rows] == ["response"] * 4
    assert all(a["offset"] + a["length"] == b["offset"] for a, b in zip(rows, rows[1:]))
    assert [(r["seq"], r["status"]) for r in wm.mismatches(ours, theirs).collect()] == [(2, "changed")]
    (tmp_path / "two" / "a.warc").write_bytes(wm.warc_bytes(texts, packed)[:-9])
    assert [r["type"] for r in wm.read_warc(spark, f"{tmp_path}/two").orderBy("seq").collect()] == ["response"] * 3 + ["damaged"]
    (tmp_path / "two" / "a.warc").write_bytes(b"")
    assert wm.read_warc(spark, f"{tmp_path}/two").count() == 0


def test_awkward_pages(spark):
    rows = [(1, "u", "x"), (1, "u", "x"), (None, "v", None), (None, None, ""), (2, None, "é" * 70000), (3, "w", "y" * 100)]
    pages = spark.createDataFrame([(*r, 1, "s", "f") for r in rows], "page_id long, url string, html string, key int, sha256 string, file string")
    got = wm.audit(wm.dealt(pages, damage=F.col("id") == 3)).orderBy("file", "seq").collect()
    assert len(got) == 6 and [r["id"] for r in got if r["corrupt"]] == [3]
    assert sum(r["length"] for r in got) == got[-1]["offset"] + got[-1]["length"] and got[0]["offset"] == 0
    assert wm.audit(wm.dealt(pages.limit(0), damage=F.col("id") == 3)).count() == 0
