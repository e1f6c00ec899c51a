import math
import random
from itertools import combinations, pairwise

import pytest
from pyspark.sql import functions as F

from edgeproof.functions import distance as D
from edgeproof.functions import fnv
from edgeproof.functions import scalars as S
from edgeproof.operators import catalogs, commit, epochs, jv, kopt, lp, tour
from edgeproof.operators.graph import POINTS, Graph, complete_graph, nearest, nearest_graph, violations
from edgeproof.operators.paths import feasible_appends, grow, normalize
from edgeproof.plans import synth
from edgeproof.plans.cut import cut


def complete(spark, sets):
    """One frame of several complete graphs."""
    return complete_graph(spark.createDataFrame([(g, i, float(x), float(y), x, y) for g, pts in sets.items() for i, (x, y) in enumerate(pts)], POINTS))


def test_distances_are_exact(spark):
    values = [r * r + k for r in (0, 1, 2, 5, 1000, 23_700_000, 94_906_265, (1 << 31) - 5) for k in (-1, 0, 1, r, r + 1) if r * r + k >= 0]
    df = spark.createDataFrame([(v,) for v in values], "s long")
    s = F.col("s")
    for r in df.select("s", D.floor_root(s).alias("f"), *(D.rounded(s, k, fast).alias(f"{k}{fast}") for k in D.KINDS for fast in (False, True))).collect():
        q = math.isqrt(r["s"])
        want = {"EUC_2D": q + (r["s"] - q * q > q), "CEIL_2D": q + (q * q != r["s"])}
        assert r["f"] == q
        for k in D.KINDS:
            assert r[f"{k}False"] == want[k] and (r["s"] >= 1 << 46 or r[f"{k}True"] == want[k])
    assert D.plain(0, 0, 3, 4) == 5 and D.plain(0, 0, 1, 1) == 1 and D.plain(0, 0, 1, 1, "CEIL_2D") == 2


def test_scalars(spark):
    one = spark.range(1).select(
        S.hex16(F.lit(-1)).alias("a"), S.hex_decode(S.hex_encode(F.lit("é1"))).alias("b"), S.hex_decode(F.lit("4")).alias("c"), S.checked_product(F.lit(1 << 62), F.lit(4)).alias("d"),
        S.conservative_integer(F.lit(3.0000000001)).alias("e"), S.conservative_integer(F.lit(3.1)).alias("f"), S.strict_integer(F.lit("-12")).alias("g"), S.strict_integer(F.lit("+1")).alias("h"),
        S.log2_bucket(F.lit(9)).alias("i"), S.outside_count(F.lit(7)).alias("j"), S.inside_count(F.lit(7)).alias("k"), S.single_line(F.lit(" a\nb ")).alias("l"), S.log2_bucket(F.lit(1)).alias("m"),
    ).first()
    assert tuple(one) == ("f" * 16, "é1", None, None, 3, None, -12, None, 3, 46080, 135135, "a b", 0)


def test_catalogs_match_pinned_hashes():
    assert [len(catalogs.outside(m)) for m in range(1, 8)] == [1, 2, 8, 48, 384, 3840, 46080]
    assert [len(catalogs.inside(m)) for m in range(1, 8)] == [1, 3, 15, 105, 945, 10395, 135135]
    # Hashes of the compatibility tables and of the reconnection templates.
    assert [catalogs.table_hash(m) for m in range(1, 6)] == ["4104b5c5658e8f3a", "5fcd7fdac93b4fe9", "9642d8a1cb6bf1ee", "1853eb4cc99dd217", "f6bccacc5c1fa84f"]
    assert [catalogs.templates_hash(k) for k in (3, 4, 5)] == ["e58af5e08d290d04", "03179e3ca191ce82", "6696dde548591bce"]


def test_catalog_predicates(spark):
    rows = catalogs.compatibility(spark, 3).collect()
    assert sum(r["compatible"] for r in rows) == 1 + 4 + 64
    q = spark.createDataFrame([(6, 17, 23), (2, 1, 2), (2, 9, 0)], "m int, outside_id long, inside_id long")
    got = {(r["m"], r["outside_id"]): r["compatible"] for r in catalogs.evaluate(spark, q).collect()}
    assert got[6, 17] == catalogs.one_tour(catalogs.outside(6)[17], catalogs.inside(6)[23]) and got[2, 9] is None
    df = spark.createDataFrame([([1, 0], 1), ([0, 1], 1), ([1, 0, 3, 2], 2), ([1, 0], 2), ([5, 0], 1)], "mates array<int>, m int")
    assert [r[0] for r in df.select(catalogs.is_perfect(F.col("mates"), F.col("m"))).collect()] == [True, False, True, False, False]


def test_path_systems():
    assert normalize([[2, 1, 0], [2, 3], [10, 9]], 11) == (True, "", [[0, 1, 2, 3], [9, 10]], 4)
    for bad in ([], [[1]], [[0, 11]], [[0, 1, 0]], [[0, 1], [1, 0]], [[0, 1, 2], [1, 3]], [[0, 1], [1, 2], [2, 0]]):
        assert not normalize(bad, 11)[0]
    assert grow([[0, 1], [5, 6]], [[1, 3, 5]]) == [[0, 1, 3, 5, 6]] and grow([[0, 1, 2]], [[0, 4, 2]]) is None


def test_appends_in_sql_match_growth(spark):
    rng = random.Random(4)
    parents, tasks = {}, []
    for k in range(60):
        nodes = rng.sample(range(9), 7)
        parents[k] = normalize([nodes[:3], nodes[3:5], nodes[5:7]][: rng.randint(1, 3)], 9)[2]
        inside = [n for p in parents[k] for n in p]
        kind = rng.choice(["point", "end"])
        if kind == "point":
            a, c, b = rng.sample([n for n in range(9)], 3)
            if c in inside:
                continue
        else:
            p = rng.choice(parents[k])
            a, c, b = p[0], -1, rng.choice([n for n in range(9) if n not in (p[0], p[1])])
        tasks.append((k, len(tasks), kind, a, c, b))
    t = spark.createDataFrame(tasks, "key int, task_id int, kind string, first int, center int, second int")
    p = spark.createDataFrame(list(parents.items()), "key int, paths array<array<int>>")
    for r in feasible_appends(p, t).collect():
        more = [[r["first"], r["center"], r["second"]]] if r["kind"] == "point" else [[r["first"], r["second"]]]
        assert r["feasible"] == (grow(parents[r["key"]], more) is not None)


def test_nearest_against_brute_force(spark):
    rng = random.Random(2)
    pts = [(rng.randint(0, 50), rng.randint(0, 50)) for _ in range(120)] + [(10_000, 10_000), (10_000, 10_001), (-900, 3)]
    df = spark.createDataFrame([("a", i, float(x), float(y), x, y) for i, (x, y) in enumerate(pts)] + [("b", i, float(i), 0.0, i, 0) for i in range(4)], POINTS)
    got = {(r["g"], r["a"], r["rank"]): r["b"] for r in nearest(df, 5).collect()}
    for g, ps in (("a", pts), ("b", [(i, 0) for i in range(4)])):
        for a in range(len(ps)):
            want = sorted((D.plain(*ps[a], *ps[b]), b) for b in range(len(ps)) if b != a)[:5]
            assert [got.get((g, a, k + 1)) for k in range(len(want))] == [b for _, b in want]


def test_fixture_quick_elimination(spark):
    g = synth.fixture(spark)
    c = jv.candidates(g).orderBy("u", "v").collect()
    assert [(r["u"], r["v"], r["witness"]) for r in c] == [(0, 4, 5), (0, 6, 2), (2, 5, 0), (3, 5, 4), (3, 7, 6), (4, 6, 3), (4, 7, 1)]
    r = epochs.jv_fixed_point(g)
    assert [m["committed"] for m in r.metrics] == [7, 0] and r.graph.active().count() == 21 and r.status == "fixed-point"
    assert epochs.content_hash(epochs.replay(g, r.records, r.initial_hash, r.final_hash)) == r.final_hash
    for bad in (r.records.withColumn("witness", F.col("u")), r.records.withColumn("snapshot_hash", F.lit("0" * 16)), r.records.where("u > 0"), r.records.withColumn("epoch", F.lit(1))):
        with pytest.raises(epochs.ProofError):
            epochs.replay(g, bad, r.initial_hash, r.final_hash)


def test_hash_of_blocks_is_the_sequential_hash():
    rng = random.Random(9)
    for n in (0, 1, 63, 64, 129, 4097):
        data = rng.randbytes(n)
        cuts = [0, n // 3, n // 3, n // 2, n]
        for h in (fnv.BASIS, 0, 255, (1 << 64) - 1):
            assert fnv.after(h, [fnv.effect(data[a:b]) for a, b in pairwise(cuts)]) == fnv.fnv1a(data, h)


def test_snapshot_is_hashed_in_blocks(spark, monkeypatch):
    """No group holds a graph's whole snapshot; an inactive edge counts; graphs without edges have no hash."""
    rng = random.Random(5)
    g = complete(spark, {name: [(rng.randint(-99, 99), rng.randint(0, 99)) for _ in range(n)] for name, n in (("a", 9), ("b", 7), ("c", 1))})
    g = g.with_edges(g.edges.withColumn("active", F.col("edge_id") % 5 != 0))
    points, edges = g.points.orderBy("id").collect(), g.edges.orderBy("edge_id").collect()
    want = {x: fnv.graph_hash("EUC_2D", True, [(p["ix"], p["iy"]) for p in points if p["g"] == x], [(e["u"], e["v"], e["weight"], e["active"]) for e in edges if e["g"] == x]) for x in "ab"}
    assert epochs.content_hash(g) == want
    monkeypatch.setattr(epochs, "BLOCK_BITS", 2)
    assert epochs.content_hash(g) == want
    sizes = [r["n"] for r in epochs._blocks(g.edges, 1, "edge_id", {"u": "<i4", "v": "<i4", "weight": "<i8", "active": "u1"}).collect()]
    assert max(sizes) == 4 and sum(sizes) == 36 + 21


def test_later_rounds_search_only_near_what_went(spark, monkeypatch):
    """After edges go, candidates are those of a whole search, though only edges near them are searched."""
    rng = random.Random(4)
    rows = [(name, i, *map(float, xy), *xy) for name, n in (("a", 400), ("b", 60)) for i in range(n) for xy in [(rng.randint(0, 5000), rng.randint(0, 5000))]]
    g = nearest_graph(spark.createDataFrame(rows, POINTS), 6)
    g = g.with_edges(cut(g.edges))
    told = lambda df: sorted(map(tuple, df.select("g", "edge_id", "u", "v", "witness").collect()))
    searched, plain = [], jv.ranked_witnesses
    monkeypatch.setattr(jv, "ranked_witnesses", lambda graph, tried=jv.TRIED, edges=None: searched.append((graph.gated() if edges is None else edges).count()) or plain(graph, tried, edges))
    before = cut(jv.candidates(g))
    assert before.count()
    for gone in (commit.commit(g, before), g.edges.where("edge_id % 211 = 7"), g.edges.where("g = 'b' and u = 3")):
        gone = cut(gone)
        left = g.with_edges(cut(commit.without(g, gone).edges))
        assert told(jv.candidates_after(left, before, gone)) == told(jv.candidates(left))
    assert all(few <= every for few, every in zip(searched[1::2], searched[2::2], strict=True)) and searched[-2] * 3 < searched[-1]
    rounds, after = [], jv.candidates_after
    monkeypatch.setattr(jv, "candidates_after", lambda *a: rounds.append(a) or after(*a))
    assert len(rounds) < len(epochs.jv_fixed_point(g).metrics) == len(rounds) + 1 > 1


def optimal_edges(pts):
    """Edges of all optimal tours, by a subset dynamic programme from both sides."""
    n, d = len(pts), lambda a, b: D.plain(*pts[a], *pts[b])
    best = {(1, 0): 0}
    for size in range(2, n + 1):
        for rest in combinations(range(1, n), size - 1):
            mask = 1 | sum(1 << i for i in rest)
            for j in rest:
                best[mask, j] = min(best[mask ^ 1 << j, i] + d(i, j) for i in (0, *rest) if (mask ^ 1 << j, i) in best)
    full = (1 << n) - 1
    total = min(best[full, j] + d(j, 0) for j in range(1, n))
    out = {(0, j) for j in range(1, n) if best[full, j] + d(j, 0) == total}
    for (mask, j), c in best.items():
        for k in range(1, n):
            if not mask >> k & 1:
                back = (full ^ mask ^ 1 << k) | 1
                tail = best.get((back | 1 << k, k))
                if tail is not None and c + d(j, k) + tail == total:
                    out.add((min(j, k), max(j, k)))
    return out


def test_elimination_never_removes_an_optimal_edge(spark):
    """Many graphs in one plan; whatever is removed lies on no optimal tour."""
    sets = {}
    for n in range(6, 10):
        for k in range(3):
            rng = random.Random(f"{n}/{k}")
            sets[f"g{n}_{k}"] = [(rng.randint(0, 2000), rng.randint(0, 2000)) for _ in range(n)]
    g = complete(spark, sets)
    gone = epochs.jv_fixed_point(g, 3).records.collect()
    assert gone
    best = {name: optimal_edges(p) for name, p in sets.items()}
    assert not [r for r in gone if (r["u"], r["v"]) in best[r["g"]]]


def test_commit_is_the_sequential_walk(spark):
    rng, want, edges, rows = random.Random(7), {}, [], []
    for k in range(25):
        name, n = f"g{k}", rng.randint(4, 8)
        all_ = [e for e in combinations(range(n), 2) if rng.random() < 0.9]
        edges += [(name, i, u, v, 1, True) for i, (u, v) in enumerate(all_)]
        deg = {x: sum(x in e for e in all_) for x in range(n)}
        want[name] = []
        for i, (u, v) in enumerate(all_):
            if rng.random() < 0.7:
                rows.append((name, i, u, v, 0))
                if deg[u] > 2 and deg[v] > 2:
                    want[name].append(i)
                    deg[u] -= 1
                    deg[v] -= 1
    pts = spark.createDataFrame([(f"g{k}", i, 0.0, 0.0, 0, 0) for k in range(25) for i in range(8)], POINTS)
    g = Graph(pts, spark.createDataFrame(edges, "g string, edge_id int, u int, v int, weight long, active boolean"))
    got = commit.commit(g, spark.createDataFrame(rows, "g string, edge_id int, u int, v int, witness int").repartition(3)).orderBy("g", "place").collect()
    for name in want:
        assert [r["edge_id"] for r in got if r["g"] == name] == want[name]


def test_tours(spark):
    g = synth.fixture(spark)
    t = spark.createDataFrame([("fix", i, i) for i in range(8)], "g string, pos int, node int")
    r = tour.check_tour(g, t).first()
    assert (r["cost"], r["missing_edges"]) == (395, 0) and tour.faults(g, t).count() == 0
    turned = spark.createDataFrame([("fix", i, (3 - i) % 8) for i in range(8)], "g string, pos int, node int")
    assert tour.tour_hash(g, t).first()["hash"] == tour.tour_hash(g, turned).first()["hash"]
    assert tour.faults(g, t.where("pos < 7")).count() == 1
    with pytest.raises(epochs.ProofError):
        epochs.gated(g, t, lambda x: epochs.Result(x.with_edges(x.edges.withColumn("active", ~((F.col("u") == 0) & (F.col("v") == 1)))), x.edges))


def test_violations(spark):
    g = synth.fixture(spark)
    assert violations(g).count() == 0
    bad = g.with_edges(g.edges.withColumn("weight", F.col("weight") + (F.col("edge_id") == 3).cast("long")).withColumn("v", F.when(F.col("edge_id") == 5, 99).otherwise(F.col("v"))))
    assert {"weight", "endpoint"} <= {r["what"] for r in violations(bad).collect()}


def test_kopt_leaves():
    octagon = {i: (round(1000 * math.cos(i * math.pi / 4)), round(1000 * math.sin(i * math.pi / 4))) for i in range(8)}
    r = kopt.exact_tour([[0, 2, 4, 6, 1, 3, 5, 7]], kopt.Metric(octagon), (1, 0), (0, 2), 10)
    assert r.status == "improved" and r.witness.k == 7
    line = kopt.Metric({i: (i, 0) for i in range(7)})
    r = kopt.find_witness([list(range(7))], line, (1, 0), (0, 1), kopt.Options())
    assert (r.status, r.deletion_sets, r.matchings) == ("no-improvement", 25, 1330)
    assert kopt.find_witness([list(range(7))], line, (1, 0), (0, 1), kopt.Options(max_deletion_sets=3)).status == "unresolved"
    assert kopt.find_witness([list(range(5))], line, (1, 0), (0, 1), kopt.Options(3)).status == "no-improvement"
    rng, proven = random.Random(1), 0
    for _ in range(30):
        d = kopt.Metric({i: (rng.randint(0, 500), rng.randint(0, 500)) for i in range(6)})
        f = kopt.prove_leaf([[0, 1, 2], [3, 4, 5]], d, (0, 1), kopt.Options(5, 0, 10))
        if f.proven:
            proven += 1
            check = lambda leaf: kopt.verify_leaf([[0, 1, 2], [3, 4, 5]], d, (0, 1), leaf)
            assert check(f) == "ok" and kopt.leaf_of(kopt.leaf_row(f)) == f
            f.records[0][1].added_cost += 1
            assert check(f) == "costs"
    assert proven > 10


def test_template_costs_against_brute_force(spark):
    rng = random.Random(3)
    pts = [(rng.randint(0, 99), rng.randint(0, 99)) for _ in range(9)]
    p = spark.createDataFrame([("a", i, float(x), float(y), x, y) for i, (x, y) in enumerate(pts)], POINTS)
    tasks = [(t, k, [rng.randrange(9) for _ in range(2 * k)]) for t, k in enumerate((3, 3, 4, 5, 3, 4))] + [(9, 3, [0, 1, 2, 3, 4, 5])]
    df = spark.createDataFrame([("a", *t) for t in tasks], "g string, task_id int, k int, ports array<int>")
    got = {(r["task_id"], r["template_id"]): r["added_cost"] for r in kopt.template_costs(df, p, catalogs.templates_table(spark)).collect()}
    for t, k, ports in tasks:
        gone = {kopt.edge(ports[2 * i], ports[2 * i + 1]) for i in range(k)}
        for i, form in enumerate(catalogs.templates(k)):
            new = [kopt.edge(ports[a], ports[b]) for a, b in enumerate(form) if a < b]
            bad = any(a == b for a, b in new) or len(set(new)) < k or gone & set(new)
            assert got[t, i] == (None if bad else sum(D.plain(*pts[a], *pts[b]) for a, b in new))
    costs = kopt.template_costs(df, p, catalogs.templates_table(spark))
    assert kopt.first_improving(costs, df.withColumn("deleted_cost", F.lit(0).cast("long"))).where("template_id is not null").count() == 0


def test_lp(spark):
    from edgeproof.sources import lp as files

    e = files.example()
    m = files.frames(spark, files.parse_epoch(files.epoch_text(e)))
    dual = spark.createDataFrame([(0, 1.0)], "row int, y double")
    assert tuple(lp.exact_bound(m, dual).first()) == (True, "16777216", 16777216) and lp.faults(m).count() == 0
    assert not lp.exact_bound(m, dual.withColumn("y", F.lit(float("nan")))).first()["certified"]
    x, y, status = lp.solve_small(m)
    assert status == "OPTIMAL" and abs(x[0] - 1) < 1e-6 and abs(x[1]) < 1e-6
    primal = spark.createDataFrame(list(x.items()), "col int, x double")
    res = lp.accepted(lp.residuals(m, primal, dual, lp.reduced_costs(m, dual).withColumnRenamed("reduced", "rc")), "OPTIMAL").first()
    assert res["accepted"]
    for text in (files.epoch_text(e).replace("rhs 1 1", "rhs 1 2"), files.epoch_text(e).replace("END", "more 1\nEND"), "x"):
        with pytest.raises(ValueError):
            files.parse_epoch(text)


def test_hashes_are_fnv1a():
    assert fnv.fnv1a(b"") == 14695981039346656037 and fnv.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_verifier_plan_stays_small(spark):
    """The verifier's growing of paths is cut from its faults: as one plan its joins passed a hundred, and planning it did not end."""
    from edgeproof.operators import ht_verify, kopt, wavefront

    g = synth.fixture(spark)
    nodes = spark.createDataFrame([], f"g string, target int, node int, paths array<array<int>>, type string, first int, second int, leaf {kopt.LEAF}")
    pair, edge = "struct<center:int,first:int,second:int>", "struct<u:int,v:int>"
    replies = spark.createDataFrame([], f"g string, target int, node int, reply bigint, pair1 {pair}, pair2 {pair}, edge {edge}, infeasible boolean, child int")
    targets = g.active().where("edge_id = 0").select("g", F.col("edge_id").alias("target"), "u", "v")
    got = ht_verify.verify(g, targets, wavefront.Proof(nodes, replies))
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join ") < 40
    assert got.first()["faults"] == ["no root"]


def test_near_nodes_and_replies_are_not_sorted_again(spark):
    """What the rings ranked is not ranked again, and replies are numbered by their place in an array, not by a window over all of them."""
    from edgeproof.operators import ht

    g = synth.fixture(spark)
    t = g.active().select("g", F.col("edge_id").alias("target"), "u", "v")
    near = ht.midpoint_rank(g, t, most=3)
    want = ht.midpoint_rank(g, t).where("rank <= 3")
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, want.collect()))
    replies = ht.hamilton_replies(g, near.select("g", "target", F.col("node").alias("center")), t)
    for df in (near, replies):
        assert "row_number" not in df._jdf.queryExecution().analyzed().toString()


def test_parsing_a_proof_grows_with_its_records():
    """Places of records were counted anew for each, which took over a minute for so many."""
    import time

    from edgeproof.sources import proofs

    n, zero = 30_000, "0" * 16
    text = "\n".join(["CUDAEE_PROOF_V1", "backend spark", f"initial_hash {zero}", *(f"record {k % 2} {zero} {k} {k} {k + 1} JV 3" for k in range(n)), f"final_hash {zero}", "END", ""])
    start = time.perf_counter()
    got = proofs.parse_proof(text)["records"]
    assert [r["place"] for r in got] == [k // 2 for k in range(n)] and time.perf_counter() - start < 20


def _sent_by_broadcast(monkeypatch, make):
    """What ``make`` finds, and how many of the plans that its rings run broadcast exploded cells."""
    from edgeproof.operators import graph

    plans = []

    def watched(df):
        held = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines())
        return held

    monkeypatch.setattr(graph, "cut", watched)
    got, bad = make().collect(), 0
    for lines in plans:
        depth = [len(x) - len(x.lstrip(" :+-*|")) for x in lines]
        for i, x in enumerate(lines):
            below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            bad += "BroadcastExchange" in x and any("explode(" in y for y in lines[i:below])
    assert any("explode(" in y for lines in plans for y in lines)
    return got, bad


def _lone_asks(spark):
    """A dense heap of points, and few asks in the empty rest of the box, whose rings grow to thousands of cells each."""
    at = [(i % 40, i // 40) for i in range(1600)] + [(4000, 4000)]
    points = spark.createDataFrame([("x", i, x, y) for i, (x, y) in enumerate(at)], "g string, b int, bx bigint, by bigint")
    asks = spark.createDataFrame([("x", i, 1000 + 300 * i, 3500 - 200 * i) for i in range(9)], "g string, a int, ax bigint, ay bigint")
    return at, points, asks


def test_ring_cells_are_not_broadcast(spark, monkeypatch):
    """A ring's cells are estimated as one, so those of a few asks passed any broadcast threshold and filled the driver."""
    from edgeproof.operators.graph import nearest_to

    at, points, asks = _lone_asks(spark)
    got, bad = _sent_by_broadcast(monkeypatch, lambda: nearest_to(asks, points, 5))
    for a in asks.collect():
        want = sorted(((x - a.ax) ** 2 + (y - a.ay) ** 2, b) for b, (x, y) in enumerate(at))[:5]
        assert sorted((r.d, r.b) for r in got if r.a == a.a) == want
    assert bad == 0


def test_cells_of_root_candidates_are_not_broadcast(spark, monkeypatch):
    """The same for the near nodes of root candidates whose edges miss: targets across an empty box, most nodes left out by their degree."""
    from edgeproof.operators import ht

    at = [(i % 20, i // 20) for i in range(400)] + [(3000 + 90 * i, 2000 + 130 * (i % 5)) for i in range(6)]
    points = spark.createDataFrame([("x", i, float(x), float(y), x, y) for i, (x, y) in enumerate(at)], POINTS)
    g = nearest_graph(points, 2)
    g = g.with_edges(cut(g.edges))
    t = g.active().where("v >= 400").select("g", F.col("edge_id").alias("target"), "u", "v")
    o = ht.RootOptions(5, 0, 50, mode=ht.MODES[1])
    got, bad = _sent_by_broadcast(monkeypatch, lambda: ht.cd_candidates(g, t, o))
    ranked = [tuple(r) for r in ht.midpoint_rank(g, t, 50).where("rank <= 5").select("target", "node").collect()]
    asked = {(target, c, d) for target, c in ranked for k, d in ranked if k == target and c < d}
    assert got and {(r.target, r.c, r.d) for r in got} <= asked
    assert bad == 0
