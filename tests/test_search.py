"""The Hamilton-Tutte search on the fixture; slow, so one run serves several checks."""

import json

import pytest
from pyspark.sql import functions as F

from edgeproof import cli
from edgeproof.operators import epochs, ht, ht_verify, kopt, wavefront
from edgeproof.plans import synth
from edgeproof.sources import proofs, text

OPTIONS = wavefront.Options(ht.RootOptions(0, 8, 0, 1000), kopt.Options(3, 1, 0), 1, 20000, 200000, 1000, 5, 5)


@pytest.fixture(scope="module")
def proven(spark):
    g = synth.fixture(spark)
    t = g.edges.where("u = 2 and v = 4").select("g", F.col("edge_id").alias("target"), "u", "v")
    outcome, proof = wavefront.prove(g, t, OPTIONS)
    return g, t, outcome.first(), proof


def test_golden_proof(proven):
    _, _, outcome, proof = proven
    nodes = proof.nodes.orderBy("node").collect()
    assert outcome["status"] == "proven" and len(nodes) == 4
    assert (nodes[0]["type"], nodes[0]["first"], nodes[0]["second"]) == ("cd", 0, 3) and {n["type"] for n in nodes[1:]} == {"point"}


def test_verifier_and_tampering(spark, proven):
    g, t, _, proof = proven
    assert ht_verify.verify(g, t, proof).first()["faults"] == []
    lost = wavefront.Proof(proof.nodes, proof.replies.where("not (node = 1 and reply = 0)"))
    assert "replies" in ht_verify.verify(g, t, lost).first()["faults"]
    moved = wavefront.Proof(proof.nodes.withColumn("first", F.when(F.col("node") == 1, F.lit(2)).otherwise(F.col("first"))), proof.replies)
    assert ht_verify.verify(g, t, moved).first()["faults"]
    with pytest.raises(epochs.ProofError):
        epochs.commit_proofs(g, t, lost, ht.MODES[0])


def test_text_round_trip_and_commit(spark, proven):
    g, t, _, proof = proven
    h = epochs.content_hash(g)["fix"]
    rows = lambda df: [r.asDict(True) for r in df.collect()]
    tree = proofs.tree_text(rows(proof.nodes), rows(proof.replies), 2, 4, h, ht.MODES[0], {})
    back = proofs.parse_tree(tree)
    assert (back["u"], back["v"], len(back["nodes"])) == (2, 4, 4)
    again = proofs.tree_frames(spark, [("fix", 14, back)])
    assert proofs.tree_text(rows(again.nodes), rows(again.replies), 2, 4, h, ht.MODES[0], {}) == tree
    for bad in (tree + "x", tree.replace("node_count 4", "node_count 5"), tree.replace("move_type cd", "move_type xx")):
        with pytest.raises(ValueError):
            proofs.parse_tree(bad)
    r = epochs.commit_proofs(g, t, again, ht.MODES[0])
    assert r.metrics[0]["committed"] == 1 and r.graph.active().count() == 27
    whole = proofs.proof_text(r, "fix", "spark", [tree])
    got = proofs.parse_proof(whole)
    assert got["records"][0]["method"] == "hamilton-tutte" and got["records"][0]["certificate_index"] == 0 and len(got["trees"]) == 1
    with pytest.raises(ValueError):
        proofs.parse_proof(whole + "more\n")


def test_files_and_commands(spark, tmp_path, capsys):
    pts = "\n".join(f"{i + 1} {x} {y}" for i, (x, y) in enumerate(synth.FIXTURE))
    (tmp_path / "a.tsp").write_text(f"NAME : a\nDIMENSION : 8\nEDGE_WEIGHT_TYPE : EUC_2D\nNODE_COORD_SECTION\n{pts}\nEOF\n")
    g = synth.fixture(spark)
    text.write_active_edges(g, f"{tmp_path}/edges")
    part = next((tmp_path / "edges").glob("part-*"))
    (tmp_path / "a.edg").write_text(part.read_text())
    (tmp_path / "a.tour").write_text("DIMENSION : 8\nTOUR_SECTION\n" + "\n".join(map(str, range(1, 9))) + "\n-1\nEOF\n")
    args = ["--tsp", f"{tmp_path}/a.tsp", "--edges", f"{tmp_path}/a.edg"]
    out = ["--output-root", str(tmp_path)]
    assert cli.run(spark, [*out, "tour-check", *args, "--tour", f"{tmp_path}/a.tour"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["cost"] == 395
    assert cli.run(spark, [*out, "eliminate", *args, "--out-edges", "o.edg", "--out-proof", "o.proof"]) == 0
    assert (tmp_path / "o.edg").read_text().startswith("8 21\n")
    assert cli.run(spark, [*out, "verify", *args, "--proof", f"{tmp_path}/o.proof"]) == 0
    (tmp_path / "bad.proof").write_text((tmp_path / "o.proof").read_text().replace("record 0", "record 1"))
    with pytest.raises(ValueError):
        cli.run(spark, [*out, "verify", *args, "--proof", f"{tmp_path}/bad.proof"])
    with pytest.raises(ValueError):
        cli.run(spark, [*out, "lp-example", "--out", "../x"])
    for bad in ("DIMENSION : 9", "DIMENSION : 8\nDIMENSION : 8", "EDGE_WEIGHT_TYPE : GEO"):
        name = bad.split(" ")[0]
        (tmp_path / "b.tsp").write_text((tmp_path / "a.tsp").read_text().replace("DIMENSION : 8" if name == "DIMENSION" else "EDGE_WEIGHT_TYPE : EUC_2D", bad))
        with pytest.raises(text.FormatError):
            text.read_points(spark, f"{tmp_path}/b.tsp", "b")
    with pytest.raises(text.FormatError):
        text.read_edges(spark, f"{tmp_path}/a.edg", "a", 7)
