"""Epochs: immutable snapshots, atomic commits, replayable records.

records(g, epoch, snapshot_hash, edge_id, u, v, method, witness, certificate_index, place). The driver holds counts and hashes, never edges.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeproof.functions import fnv
from edgeproof.plans.cut import cut

from . import commit, ht, ht_verify, jv, tour, wavefront
from .graph import Graph

RECORDS = "g string, epoch int, snapshot_hash string, edge_id int, u int, v int, method string, witness int, certificate_index bigint, place bigint"


class ProofError(ValueError):
    """A proof that does not hold."""


#: Rows of a snapshot that are hashed at once, as a power of two.
BLOCK_BITS = 14


def _blocks(rows: DataFrame, kind: int, id_: str, names: dict[str, str]) -> DataFrame:
    """(g, kind, block, n, effect): what the bytes of each run of ids do to a hash; ``names`` are the columns and their widths."""
    held = rows.groupBy("g", F.shiftright(id_, BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list(F.struct(id_, *names))).alias("rows"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            rows = b.column("rows")
            flat, n = rows.flatten(), rows.value_lengths().to_numpy(zero_copy_only=False)
            if any(flat.field(c).null_count for c in names):
                raise ValueError("a snapshot has null values")
            data = np.empty(len(flat), [(c, t) for c, t in names.items()])
            for c in names:
                data[c] = flat.field(c).to_numpy(zero_copy_only=False)
            parts = np.split(data, np.cumsum(n)[:-1])
            yield pa.RecordBatch.from_pydict({"g": b.column("g"), "kind": pa.array([kind] * len(n), pa.int32()), "block": b.column("block"), "n": pa.array(n, pa.int64()), "effect": pa.array([fnv.effect(p.tobytes()) for p in parts], pa.binary())})

    return held.mapInArrow(run, f"g string, kind int, block {dict(held.dtypes)['block']}, n bigint, effect binary")


def snapshot_hashes(graph: Graph) -> DataFrame:
    """(g, hash): the hash of each graph's points and edges, inactive ones included.

    The hash is sequential, but what a block of bytes does to it depends on the 256 values of its lowest byte only; so blocks of ids are
    worked out apart, and a graph's group holds one row of 2 KB a block.
    """
    p = _blocks(graph.points, 0, "id", {"ix": "<i8", "iy": "<i8"})
    e = _blocks(graph.edges, 1, "edge_id", {"u": "<i4", "v": "<i4", "weight": "<i8", "active": "u1"})
    whole = p.unionAll(e).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("kind", "block", "n", "effect"))).alias("blocks"))
    whole = whole.where("exists(blocks, b -> b.kind = 0) and exists(blocks, b -> b.kind = 1)")
    kind = graph.kind

    def run(batches):
        import pandas as pd

        for b in batches:
            heads = [fnv.graph_head(kind, True, sum(x["n"] for x in own if x["kind"] == 0)) for own in b["blocks"]]
            yield pd.DataFrame({"g": b["g"], "hash": [fnv.text(fnv.after(fnv.fnv1a(h), [x["effect"] for x in own])) for h, own in zip(heads, b["blocks"], strict=True)]})

    return whole.mapInPandas(run, "g string, hash string")


def content_hash(graph: Graph) -> dict[str, str]:
    return {r["g"]: r["hash"] for r in snapshot_hashes(graph).collect()}


@dataclass
class Result:
    graph: Graph
    records: DataFrame
    metrics: list[dict] = field(default_factory=list)
    proof: wavefront.Proof | None = None
    initial_hash: dict[str, str] = field(default_factory=dict)
    final_hash: dict[str, str] = field(default_factory=dict)
    status: str = ""


def _records(committed: DataFrame, hashes: dict[str, str], epoch: int, first: int | None) -> DataFrame:
    spark = committed.sparkSession
    h = spark.createDataFrame(list(hashes.items()), "g string, snapshot_hash string")
    index = F.lit(None).cast("bigint") if first is None else F.col("place") + first
    rows = committed.join(F.broadcast(h), "g")
    return rows.select("g", F.lit(epoch).alias("epoch"), "snapshot_hash", "edge_id", "u", "v", "method", F.col("witness").cast("int").alias("witness"), index.alias("certificate_index"), "place")


def _count(df: DataFrame) -> int:
    return df.agg(F.count("*")).first()[0]


def jv_fixed_point(graph: Graph, rounds: int = 100) -> Result:
    """Propose, verify, commit, until a round commits nothing, or so many rounds are done. A proposal that fails the verifier aborts."""
    empty = graph.points.sparkSession.createDataFrame([], RECORDS)
    out = Result(graph, empty, initial_hash=content_hash(graph))
    parts, hashes, done, proposed = [], out.initial_hash, None, None
    for epoch in range(rounds):
        before = _count(out.graph.active())
        proposed = cut(jv.candidates(out.graph) if done is None else jv.candidates_after(out.graph, proposed, done))
        verdict = jv.verify(out.graph, proposed).agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("bigint")).alias("ok")).first()
        n, ok = verdict["n"], verdict["ok"] or 0
        if ok < n:
            raise ProofError(f"{n - ok} proposals fail the verifier")
        done = cut(commit.commit(out.graph, proposed))
        k = _count(done)
        out.metrics.append({"epoch": epoch, "edges_before": before, "proposed": n, "verified": ok, "rejected": n - ok, "committed": k})
        if not k:
            out.status = "fixed-point"
            break
        parts.append(_records(done, hashes, epoch, None))
        out.graph = out.graph.with_edges(cut(commit.without(out.graph, done).edges))
        hashes = content_hash(out.graph)
    out.status = out.status or "round-limit"
    out.final_hash = hashes
    if parts:
        out.records = cut(reduce(DataFrame.unionByName, parts))
    return out


def commit_proofs(graph: Graph, targets: DataFrame, proof: wavefront.Proof, mode: str) -> Result:
    """One epoch of proven targets: all proofs are verified before anything changes, and one bad proof commits nothing."""
    out = Result(graph, graph.points.sparkSession.createDataFrame([], RECORDS), initial_hash=content_hash(graph))
    own = targets.join(proof.nodes.where("node = 0").select("g", "target"), ["g", "target"], "left_semi")
    known = own.join(graph.active().select("g", F.col("edge_id").alias("target"), "u", "v"), ["g", "target", "u", "v"], "left_semi")
    wrong = ht_verify.verify(graph, own, proof, mode).where(F.size("faults") > 0)
    n = _count(own)
    if _count(known) < n:
        raise ProofError("a target is no active edge of the snapshot")
    if first := wrong.first():
        raise ProofError(f"proof of {first['g']}/{first['target']}: {', '.join(first['faults'])}")
    done = cut(commit.commit(graph, own.select("g", F.col("target").alias("edge_id"), "u", "v", F.lit(-1).alias("witness")), "hamilton-tutte"))
    k = _count(done)
    out.metrics.append({"epoch": 0, "edges_before": _count(graph.active()), "proposed": n, "verified": n, "rejected": 0, "committed": k})
    out.final_hash = out.initial_hash
    if k:
        out.records = cut(_records(done, out.initial_hash, 0, 0))
        out.graph = graph.with_edges(cut(commit.without(graph, done).edges))
        out.final_hash = content_hash(out.graph)
    kept = done.select("g", F.col("edge_id").alias("target"))
    out.proof = wavefront.Proof(cut(proof.nodes.join(kept, ["g", "target"], "left_semi")), cut(proof.replies.join(kept, ["g", "target"], "left_semi")))
    return out


def smallest_proofs(serialized: DataFrame) -> DataFrame:
    """Of several texts of a target's proof (g, target, text), the least by bytes."""
    return serialized.groupBy("g", "target").agg(F.min("text").alias("text"))


@dataclass(frozen=True)
class ScanOptions:
    search: wavefront.Options = wavefront.Options()
    order: str = "canonical"
    limit: int = 0


def scan(graph: Graph, o: ScanOptions = ScanOptions(), offset: int = 0) -> tuple[Result, dict]:
    """One epoch over a slice of the targets: search all at once, verify, commit once; and the scan's metrics."""
    eligible = _count(graph.gated())
    targets = cut(ht.select_targets(graph, o.order, offset, o.limit).select("g", "target", "u", "v"))
    attempted = _count(targets)
    outcome, proof = wavefront.prove(graph, targets, o.search)
    sums = outcome.agg(F.sum((F.col("status") == "proven").cast("bigint")).alias("proven"), F.sum("candidates").alias("candidates"), F.sum("states").alias("states"), F.max("states").alias("most_states"), F.sum("replies").alias("replies")).first()
    got = commit_proofs(graph, targets, proof, o.search.root.mode)
    told = {"eligible": eligible, "offset": offset, "attempted": attempted, **{c: sums[c] or 0 for c in ("proven", "candidates", "states", "most_states", "replies")}, "committed": got.metrics[0]["committed"]}
    got.status = "scanned"
    return got, told


@dataclass
class Local:
    result: Result
    stages: list[dict]
    termination: str


def local_elimination(graph: Graph, o: ScanOptions = ScanOptions(), jv_rounds: int = 100, ht_epochs: int = 100) -> Local:
    """Quick elimination to its fixed point and Hamilton-Tutte slices in turn, for one graph.

    A slice that commits goes back to quick elimination and to the first target; one that does not moves on; a whole sweep without a commit
    converges. Records of all stages form one proof: epochs and certificates are numbered on.
    """
    spark = graph.points.sparkSession
    if not 1 <= jv_rounds <= 1_000_000 or not 1 <= ht_epochs <= 1_000_000:
        raise ValueError("budgets must be from 1 to 1000000")
    whole = Result(graph, spark.createDataFrame([], RECORDS), initial_hash=content_hash(graph))
    whole.final_hash = whole.initial_hash
    parts: list[DataFrame] = []
    nodes: list[DataFrame] = []
    replies: list[DataFrame] = []
    stages: list[dict] = []
    epoch = certificate = 0

    def append(r: Result) -> None:
        nonlocal epoch, certificate
        parts.append(r.records.withColumn("epoch", F.col("epoch") + epoch).withColumn("certificate_index", F.col("certificate_index") + certificate))
        for m in r.metrics:
            whole.metrics.append({**m, "epoch": m["epoch"] + epoch})
        used = sum(m["committed"] > 0 for m in r.metrics)
        epoch += used
        if r.proof is not None and r.metrics[0]["committed"]:
            nodes.append(r.proof.nodes)
            replies.append(r.proof.replies)
            certificate += r.metrics[0]["committed"]
        whole.graph, whole.final_hash = r.graph, r.final_hash

    def quick() -> bool:
        r = jv_fixed_point(whole.graph, jv_rounds)
        append(r)
        stages.append({"kind": "jv", "rounds": len(r.metrics), "committed": sum(m["committed"] for m in r.metrics)})
        return r.metrics[-1]["committed"] == 0

    def ended(why: str) -> Local:
        whole.records = cut(reduce(DataFrame.unionByName, parts))
        if nodes:
            whole.proof = wavefront.Proof(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, replies))
        whole.status = why
        return Local(whole, stages, why)

    if not quick():
        return ended("jv-round-limit")
    offset = 0
    for _ in range(ht_epochs):
        r, told = scan(whole.graph, o, offset)
        append(r)
        stages.append({"kind": "hamilton-tutte", **told})
        if told["committed"]:
            offset = 0
            if not quick():
                return ended("jv-round-limit")
            continue
        offset += told["attempted"]
        if offset >= told["eligible"]:
            return ended("converged")
    return ended("ht-epoch-limit")


def replay(graph: Graph, records: DataFrame, initial_hash: dict[str, str], final_hash: dict[str, str], proof: wavefront.Proof | None = None, mode: str = "active-incompatible") -> Graph:
    """The graph after a proof, every record of which is checked against its snapshot; raises ProofError at the first that fails, and changes nothing.

    Checked are: the initial hash, epochs from 0 without a gap, each record's snapshot hash, ends and verifier, that certificates and proofs
    match one to one, that commit in order yields exactly the records in their order, and the final hash.
    """
    if content_hash(graph) != initial_hash:
        raise ProofError("initial hash")
    epochs = [r["epoch"] for r in records.select("epoch").distinct().orderBy("epoch").collect()]
    if epochs != list(range(len(epochs))):
        raise ProofError("epochs are not contiguous")
    hts = records.where("method = 'hamilton-tutte'")
    if (proof is None) != hts.isEmpty():
        raise ProofError("records and proofs do not match")
    if proof is not None:
        pair = hts.select("g", F.col("edge_id").alias("target"), F.lit(1).alias("a")).join(proof.nodes.where("node = 0").select("g", "target", F.lit(1).alias("b")), ["g", "target"], "full_outer")
        index = hts.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("certificate_index").alias("k"), F.min("certificate_index").alias("low"), F.max("certificate_index").alias("high"))
        if not pair.where("a is null or b is null").isEmpty() or not index.where("n <> k or low <> 0 or high <> n - 1").isEmpty():
            raise ProofError("records and proofs do not match")
    if not records.where("method not in ('jv', 'hamilton-tutte') or (method = 'jv' and certificate_index is not null)").isEmpty():
        raise ProofError("method")
    now, hashes = graph, initial_hash
    for epoch in epochs:
        own = cut(records.where(F.col("epoch") == epoch))
        if any(hashes.get(r["g"]) != r["snapshot_hash"] for r in own.select("g", "snapshot_hash").distinct().collect()):
            raise ProofError(f"epoch {epoch}: snapshot hash")
        if own.select("method").distinct().count() > 1:
            raise ProofError(f"epoch {epoch}: methods")
        method = own.first()["method"]
        if not own.join(now.active().select("g", "edge_id", "u", "v"), ["g", "edge_id", "u", "v"], "left_anti").isEmpty():
            raise ProofError(f"epoch {epoch}: ends")
        if method == "jv":
            bad = jv.verify(now, own).where("not ok")
        else:
            t = own.select("g", F.col("edge_id").alias("target"), "u", "v")
            part = wavefront.Proof(*(df.join(t.select("g", "target"), ["g", "target"], "left_semi") for df in (proof.nodes, proof.replies)))
            bad = ht_verify.verify(now, t, part, mode).where(F.size("faults") > 0)
        if not bad.isEmpty():
            raise ProofError(f"epoch {epoch}: a record fails its verifier")
        done = cut(commit.commit(now, own, method))
        same = done.select("g", "edge_id", "place").exceptAll(own.select("g", "edge_id", "place")).isEmpty() and _count(done) == _count(own)
        if not same:
            raise ProofError(f"epoch {epoch}: commit order or degree")
        now = now.with_edges(cut(commit.without(now, done).edges))
        hashes = content_hash(now)
    if hashes != final_hash:
        raise ProofError("final hash")
    return now


def gated(graph: Graph, protected: DataFrame, run) -> Result:
    """run(graph) between two checks of a protected tour (g, pos, node): its cost must not change and none of its edges may go, else ProofError and no result."""
    before = {r["g"]: (r["cost"], r["missing_edges"]) for r in tour.check_tour(graph, protected).collect()}
    if not tour.faults(graph, protected).isEmpty() or any(m for _, m in before.values()):
        raise ProofError("the protected tour is not in the graph")
    out = run(graph)
    after = {r["g"]: (r["cost"], r["missing_edges"]) for r in tour.check_tour(out.graph, protected).collect()}
    if before != after:
        raise ProofError("the protected tour lost an edge")
    return out
