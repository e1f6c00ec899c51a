import gzip
import random

import pytest

from edgeproof.sources import text


def test_lines_are_numbered_across_ranges_of_a_file(spark, tmp_path):
    rng = random.Random(3)
    want = [" ".join(["x" * rng.randrange(40), "\t", str(k)]) if rng.random() < 0.8 else "" for k in range(5000)]
    (tmp_path / "a.txt").write_bytes("".join(line + rng.choice(["\n", "\r\n"]) for line in want).encode())
    with gzip.open(tmp_path / "b.txt.gz", "wt") as f:
        f.write("\n".join(want))
    clean = [(k, line.replace("\t", " ").strip()) for k, line in enumerate(want) if line.strip()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = text.lines(spark, str(tmp_path / "a.txt"))
        assert spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 10
        assert sorted(map(tuple, got.collect())) == clean
        assert sorted(map(tuple, text.lines(spark, str(tmp_path / "b.txt.gz")).collect())) == clean
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_of_a_folder_follow_by_name_and_empty_files_have_none(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "part-1").write_text("a\n\nb\n")
    (tmp_path / "f" / "part-2").write_text("c\n")
    assert sorted(map(tuple, text.lines(spark, str(tmp_path / "f")).collect())) == [(0, "a"), (2, "b"), (3, "c")]
    (tmp_path / "empty").write_text("")
    assert text.lines(spark, str(tmp_path / "empty")).count() == 0


def test_tours_are_judged_without_the_driver(spark, tmp_path):
    def read(body, n=5):
        p = tmp_path / f"t{random.randrange(10**9)}"
        p.write_text(f"DIMENSION : {n}\nTOUR_SECTION\n{body}")
        return [tuple(r) for r in text.read_tour(spark, str(p), "g", n).orderBy("pos").collect()]

    assert read("3 1\n5\n\n2 4 -1\nEOF\n") == [("g", 0, 2), ("g", 1, 0), ("g", 2, 4), ("g", 3, 1), ("g", 4, 3)]
    for bad in ("3 1 5 2 4\n", "3 1 5 2 4 -1 6\n", "3 1 5 2 -1\n", "3 1 5 2 2 -1\n", "3 1 5 2 6 -1\n", "3 1 5 2 x -1\n", "0 1 2 3 4 -1\n", "3 1 5 2 4 -1 EOF EOF\n"):
        with pytest.raises(text.FormatError):
            read(bad)


def test_solution_files_that_are_wrong(spark, tmp_path):
    from edgeproof.sources import lp
    from edgeproof.sources import text as text_

    good = lp.solution_text("abc", {"status": "OPTIMAL", "reason": "two words"}, [0.5, 1.0], [2.0], [])
    (tmp_path / "good").write_text(good)
    got = {(r["field"], r["at"]): r["value"] for r in lp.read_solution(spark, str(tmp_path / "good")).collect()}
    assert got[("reason", None)] == "two words" and got[("model_hash", None)] == "abc"
    assert [float(got[("primal", k)]) for k in (0, 1)] == [0.5, 1.0] and float(got[("dual", 0)]) == 2.0 and len(got) == 6
    faults = [good.replace("END", ""), good.replace("primal 2", "primal 3"), good.replace("dual 1", "dual x"), good.replace("status OPTIMAL", "status"), good.replace("status", "reason"), "", good.replace("reduced_costs 0\n", "")]
    for k, text in enumerate(faults):
        (tmp_path / f"bad{k}").write_text(text)
        with pytest.raises(text_.FormatError):
            lp.read_solution(spark, str(tmp_path / f"bad{k}"))
