"""Command line: python -m edgeproof.cli COMMAND ... Exit 0: done; 2: an error; 3: unresolved."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from edgeproof.operators import catalogs, epochs, ht, ht_verify, kopt, lp, tour, wavefront
from edgeproof.sources import lp as lp_files
from edgeproof.sources import proofs, reports, text

G = "graph"


def _read(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def _write(root: str, path: str, body: str) -> None:
    out = reports.checked_output(root, path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(body)


def _search(a: argparse.Namespace) -> wavefront.Options:
    root = ht.RootOptions(a.neighborhood, a.cd_candidates, a.candidate_degree, a.reply_combinations, a.cd_mode)
    leaf = kopt.Options(a.max_k, a.max_deletion_sets, a.exact_blocks)
    return wavefront.Options(root, leaf, a.depth, a.max_states, a.max_replies, a.replies_per_move, a.point, a.end)


def _trees(spark: SparkSession, proof: wavefront.Proof, hashes: dict[tuple[str, int], str], mode: str, order: list[tuple[str, int, int, int]]) -> list[str]:
    """Texts of the proofs of (g, target, u, v), in this order."""
    nodes, replies = ([r.asDict(True) for r in df.collect()] for df in (proof.nodes, proof.replies))
    return [proofs.tree_text([n for n in nodes if (n["g"], n["target"]) == (g, t)], [r for r in replies if (r["g"], r["target"]) == (g, t)], u, v, hashes[g, t], mode, {}) for g, t, u, v in order]


def _proof_text(spark: SparkSession, r: epochs.Result, mode: str) -> str:
    hts = r.records.where("method = 'hamilton-tutte'").orderBy("certificate_index").collect()
    trees = _trees(spark, r.proof, {(x["g"], x["edge_id"]): x["snapshot_hash"] for x in hts}, mode, [(x["g"], x["edge_id"], x["u"], x["v"]) for x in hts]) if hts else []
    return proofs.proof_text(r, G, "spark", trees)


def run(spark: SparkSession, argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="edgeproof")
    p.add_argument("--output-root", default=".")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *files: str, search: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for f in files:
            c.add_argument(f"--{f}", required=not f.endswith("?"), default=None) if not f.endswith("?") else c.add_argument(f"--{f[:-1]}", default=None)
        if search:
            for flag, default in (("neighborhood", 25), ("cd-candidates", 5), ("candidate-degree", 50), ("reply-combinations", 1_000_000), ("max-k", 5), ("max-deletion-sets", 100_000), ("exact-blocks", 0), ("depth", 2), ("max-states", 100_000), ("max-replies", 1_000_000), ("replies-per-move", 10_000), ("point", 3), ("end", 3)):
                c.add_argument(f"--{flag}", type=int, default=default)
            c.add_argument("--cd-mode", choices=ht.MODES, default=ht.MODES[0])
        return c

    for name in ("eliminate", "pipeline"):
        c = command(name, "tsp", "edges", "out-edges", "out-proof", "manifest?", "tour?")
        c.add_argument("--rounds", type=int, default=100)
    command("verify", "tsp", "edges", "proof")
    command("tour-check", "tsp", "edges", "tour")
    c = command("ht-prove", "tsp", "edges", "out-proof", search=True)
    c.add_argument("--u", type=int, required=True)
    c.add_argument("--v", type=int, required=True)
    command("ht-verify", "tsp", "edges", "proof")
    command("ht-commit", "tsp", "edges", "proof", "out-edges", "out-proof")
    c = command("ht-scan", "tsp", "edges", "out-edges", "out-proof", "report?", "tour?", search=True)
    c.add_argument("--order", choices=("canonical", "weight"), default="canonical")
    c.add_argument("--offset", type=int, default=0)
    c.add_argument("--limit", type=int, default=0)
    c = command("local-eliminate", "tsp", "edges", "out-edges", "out-proof", "report?", "tour?", search=True)
    c.add_argument("--order", choices=("canonical", "weight"), default="weight")
    c.add_argument("--limit", type=int, default=8)
    c.add_argument("--rounds", type=int, default=100)
    c.add_argument("--ht-epochs", type=int, default=100)
    c = command("path-table", "manifest?")
    c.add_argument("--paths", type=int, default=3)
    command("lp-solve", "epoch", "solution")
    command("lp-example", "out")
    a = p.parse_args(argv)
    say = lambda **x: print(json.dumps(x, sort_keys=True))

    if a.command == "lp-example":
        _write(a.output_root, a.out, lp_files.epoch_text(lp_files.example()))
        return 0
    if a.command == "lp-solve":
        e = lp_files.parse_epoch(_read(spark, a.epoch))
        m = lp_files.frames(spark, e)
        facts, x, y, rc = lp.solved(e, m)
        _write(a.output_root, a.solution, lp_files.solution_text(e["hash"], facts, x, y, rc))
        return 0
    if a.command == "path-table":
        m = a.paths
        facts = {"m": m, "outside": len(catalogs.outside(m)), "inside": len(catalogs.inside(m)), "compatible": sum(map(len, catalogs.compatible(m))), "hash": catalogs.table_hash(m)}
        say(**facts)
        if a.manifest:
            _write(a.output_root, a.manifest, json.dumps(facts))
        return 0

    graph = text.read_graph(spark, a.tsp, a.edges, G)
    protected = text.read_tour(spark, a.tour, G, graph.points.count()) if getattr(a, "tour", None) else None

    def whole(f) -> epochs.Result:
        return epochs.gated(graph, protected, f) if protected is not None else f(graph)

    def publish(r: epochs.Result, mode: str = ht.MODES[0]) -> None:
        _write(a.output_root, a.out_proof, _proof_text(spark, r, mode))
        rows = r.graph.active().orderBy("u", "v").collect()
        _write(a.output_root, a.out_edges, "\n".join([f"{graph.points.count()} {len(rows)}", *(f"{x['u']} {x['v']} {x['weight']}" for x in rows), ""]))

    if a.command in ("eliminate", "pipeline"):
        r = whole(lambda g: epochs.jv_fixed_point(g, a.rounds))
        publish(r)
        if a.manifest:
            _write(a.output_root, a.manifest, json.dumps({"final_hash": r.final_hash[G], "metrics": r.metrics, "status": r.status}))
        say(status=r.status, committed=sum(m["committed"] for m in r.metrics))
    elif a.command == "verify":
        got = proofs.parse_proof(_read(spark, a.proof))
        rec = proofs.records_frame(spark, got, G)
        keys = [(G, r["edge_id"], t) for r, t in zip(sorted((r for r in got["records"] if r["method"] == "hamilton-tutte"), key=lambda r: r["certificate_index"]), got["trees"], strict=True)]
        proof = proofs.tree_frames(spark, keys) if keys else None
        mode = keys[0][2]["mode"] if keys else ht.MODES[0]
        epochs.replay(graph, rec, {G: got["initial_hash"]}, {G: got["final_hash"]}, proof, mode)
        say(verified=len(got["records"]))
    elif a.command == "tour-check":
        t = text.read_tour(spark, a.tour, G, graph.points.count())
        r = tour.check_tour(graph, t).first()
        say(cost=r["cost"], missing_edges=r["missing_edges"], hash=tour.tour_hash(graph, t).first()["hash"])
    elif a.command == "ht-prove":
        u, v = min(a.u, a.v), max(a.u, a.v)
        t = graph.active().where((F.col("u") == u) & (F.col("v") == v)).select("g", F.col("edge_id").alias("target"), "u", "v")
        row = t.first()
        if row is None:
            raise ValueError("the target is no active edge")
        outcome, proof = wavefront.prove(graph, t, _search(a))
        if outcome.first()["status"] != "proven":
            say(status="unresolved")
            return 3
        h = epochs.content_hash(graph)[G]
        _write(a.output_root, a.out_proof, _trees(spark, proof, {(G, row["target"]): h}, a.cd_mode, [(G, row["target"], u, v)])[0])
        say(status="proven")
    elif a.command in ("ht-verify", "ht-commit"):
        tree = proofs.parse_tree(_read(spark, a.proof))
        t = graph.active().where((F.col("u") == tree["u"]) & (F.col("v") == tree["v"])).select("g", F.col("edge_id").alias("target"), "u", "v")
        row = t.first()
        if row is None or tree["snapshot"] != epochs.content_hash(graph)[G]:
            raise epochs.ProofError("the proof is of another snapshot")
        proof = proofs.tree_frames(spark, [(G, row["target"], tree)])
        if a.command == "ht-verify":
            wrong = ht_verify.verify(graph, t, proof, tree["mode"]).first()["faults"]
            if wrong:
                raise epochs.ProofError(", ".join(wrong))
            say(verified=True)
        else:
            r = epochs.commit_proofs(graph, t, proof, tree["mode"])
            publish(r, tree["mode"])
            say(committed=r.metrics[0]["committed"])
    else:
        told: dict = {}

        def scanned(g) -> epochs.Result:
            if a.command == "ht-scan":
                r, facts = epochs.scan(g, epochs.ScanOptions(_search(a), a.order, a.limit), a.offset)
                told.update(facts)
                return r
            out = epochs.local_elimination(g, epochs.ScanOptions(_search(a), a.order, a.limit), a.rounds, a.ht_epochs)
            told.update(termination=out.termination, stages=out.stages)
            return out.result

        r = whole(scanned)
        publish(r, a.cd_mode)
        if a.report:
            _write(a.output_root, a.report, json.dumps({"options": asdict(_search(a)), **told}))
        say(**told)
    return 0


def main() -> int:
    spark = SparkSession.builder.appName("edgeproof").getOrCreate()
    try:
        return run(spark, sys.argv[1:])
    except (ValueError, ArithmeticError) as x:
        print(f"error: {x}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
