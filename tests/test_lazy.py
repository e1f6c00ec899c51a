"""The search that stops, against a plain depth-first prover and against the search of everything."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from edgeproof.functions.distance import plain
from edgeproof.operators import ht, ht_verify, kopt, lazy, paths, wavefront
from edgeproof.operators.graph import POINTS, complete_graph
from edgeproof.plans import synth

GOLDEN = wavefront.Options(ht.RootOptions(0, 8, 0, 1000), kopt.Options(3, 1, 0), 1, 20000, 200000, 1000, 5, 5)


class Plain:
    """A depth-first prover over one small graph, in plain Python."""

    def __init__(self, xy, edges, o):
        self.xy, self.edges, self.o = xy, {tuple(sorted(e)) for e in edges}, o
        self.near = {n: sorted({b for e in self.edges for a, b in (e, e[::-1]) if a == n}) for n in range(len(xy))}
        self.states = 0

    def d(self, a, b):
        return plain(*self.xy[a], *self.xy[b], "EUC_2D")

    def survives(self, t, a, b):
        own = self.d(*t) + self.d(a, b)
        return self.d(t[0], b) + self.d(t[1], a) >= own or self.d(t[0], a) + self.d(t[1], b) >= own

    def around(self, t, x):
        u, v = t
        if x in t:
            return []
        ok = [n for n in self.near[x] if self.survives(t, x, n)]
        pairs = [(a, b) for i, a in enumerate(ok) for b in ok[i + 1 :] if (a, b) != t]
        return [(a, b) for a, b in pairs if self.d(u, v) + self.d(x, a) + self.d(x, b) <= self.d(a, b) + self.d(u, x) + self.d(v, x)]

    def by_midpoint(self, t):
        (ax, ay), (bx, by) = self.xy[t[0]], self.xy[t[1]]
        return sorted((n for n in range(len(self.xy)) if n not in t), key=lambda n: ((2 * self.xy[n][0] - ax - bx) ** 2 + (2 * self.xy[n][1] - ay - by) ** 2, n))

    def prove(self, t):
        """(rank of the first candidate that succeeds, its tree) or None. A tree: ('leaf',) or (type, first, second, children)."""
        near = self.by_midpoint(t)[: self.o.root.neighborhood or None]
        pairs = [(c, d) for c in near for d in near if c < d and (c, d) in self.edges and not self.survives(t, c, d)]
        ranked = sorted((len(self.around(t, c)) * len(self.around(t, d)), c, d) for c, d in pairs)[: self.o.root.cd_candidates or None]
        for rank, (_, c, d) in enumerate(ranked, 1):
            replies = [[[a, c, b], [x, d, y]] for a, b in self.around(t, c) for x, y in self.around(t, d)]
            kids = self.all(t, [list(t)], replies, 0)
            if kids is not None:
                return rank, ("cd", c, d, kids)
        return None

    def all(self, t, own, replies, depth):
        out = []
        for more in replies:
            child = paths.grow(own, more)
            if child is not None:
                got = self.state(t, child, depth)
                if got is None:
                    return None
                out.append(got)
        return out

    def state(self, t, own, depth):
        self.states += 1
        if kopt.prove_leaf(own, kopt.Metric(dict(enumerate(self.xy))), t, self.o.leaf).proven:
            return ("leaf",)
        if depth >= self.o.depth:
            return None
        used = {n for p in own for n in p}
        points = sorted((len(self.around(t, n)), n) for n in [n for n in self.by_midpoint(t) if n not in used][: self.o.root.neighborhood or None])[: self.o.point]
        for _, n in points:
            kids = self.all(t, own, [[[a, n, b]] for a, b in self.around(t, n)], depth + 1)
            if kids is not None:
                return ("point", n, -1, kids)
        ends = sorted((len([x for x in self.near[e] if x != i]), e, i) for p in own for e, i in ((p[0], p[1]), (p[-1], p[-2])))[: self.o.end]
        for _, e, i in ends:
            kids = self.all(t, own, [[[e, x]] for x in self.near[e] if x != i], depth + 1)
            if kids is not None:
                return ("end", e, i, kids)
        return None


def shape(tree):
    return [tree] if tree == ("leaf",) else [tree[:3], *(x for k in tree[3] for x in shape(k))]


def found(spark, graph, xy, o, pick):
    t = graph.edges.where(F.col("edge_id").isin(pick)).select("g", F.col("edge_id").alias("target"), "u", "v")
    result, proof = lazy.prove(graph, t, o)
    nodes = {}
    for r in proof.nodes.orderBy("target", "node").collect():
        nodes.setdefault(r["target"], []).append(("leaf",) if r["type"] == "leaf" else (r["type"], r["first"], r["second"]))
    edges = {(r["u"], r["v"]) for r in graph.active().collect()}
    own = Plain(xy, edges, o)
    for r in t.collect():
        got = result.where(F.col("target") == r["target"]).first()
        want = own.prove((r["u"], r["v"]))
        assert got["status"] == ("proven" if want else "unresolved") and not got["exhausted"]
        if want:
            assert got["candidate"] == want[0] and nodes[r["target"]] == shape(want[1])
    return t, result, proof


def test_golden_proof_and_fewer_states(spark):
    g = synth.fixture(spark)
    t, result, proof = found(spark, g, synth.FIXTURE, GOLDEN, [g.edges.where("u = 2 and v = 4").first()["edge_id"]])
    nodes = proof.nodes.orderBy("node").collect()
    assert len(nodes) == 4 and (nodes[0]["type"], nodes[0]["first"], nodes[0]["second"]) == ("cd", 0, 3) and {n["type"] for n in nodes[1:]} == {"point"}
    assert ht_verify.verify(g, t, proof).first()["faults"] == []
    assert result.first()["states"] < 40  # the whole search makes hundreds


def test_random_graph_agrees_with_depth_first(spark):
    n = 10
    rng = random.Random(n)
    xy = [(rng.randrange(2000), rng.randrange(2000)) for _ in range(n)]
    g = complete_graph(spark.createDataFrame([("r", i, float(x), float(y), x, y) for i, (x, y) in enumerate(xy)], POINTS))
    o = wavefront.Options(ht.RootOptions(6, 3, 0, 1000), kopt.Options(3, 4, 0), 1, 0, 0, 1000, 2, 2)
    t, _, proof = found(spark, g, xy, o, [1, 5, 9, 14, 19])
    assert not [r for r in ht_verify.verify(g, t, proof).join(proof.nodes.select("g", "target").distinct(), ["g", "target"]).collect() if r["faults"]]


def test_budgets_bound_what_is_made(spark):
    g = synth.fixture(spark)
    t = g.edges.where("u = 2").select("g", F.col("edge_id").alias("target"), "u", "v")
    tight = replace(GOLDEN, states=12, replies=40)
    result, _ = lazy.prove(g, t, tight)
    rows = result.collect()
    assert any(r["exhausted"] for r in rows) and not all(r["exhausted"] for r in rows)
    for r in rows:
        assert r["states"] <= 12 and r["replies"] <= 40
        assert r["status"] == "unresolved" or not r["exhausted"]


def test_sums_are_cut_before_they_pass(spark):
    rows = spark.createDataFrame([("g", 1, 5, 9), ("g", 2, 6, 9), ("g", 3, 5, 11), ("g", 4, 7, 0)], "g string, target int, states long, replies long")
    used = spark.createDataFrame([("g", 1, 5, 1), ("g", 2, 5, 1)], "g string, target int, states long, replies long")
    total, over = lazy.within(rows, used, 10, 10)
    assert {tuple(r)[1:] for r in total.collect()} == {(1, 10, 10), (4, 7, 0)} and {r["target"] for r in over.collect()} == {2, 3}
    assert lazy.within(rows, used, 0, 0)[0].count() == 4
