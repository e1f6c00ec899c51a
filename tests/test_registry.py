import duckdb
import pytest

from edgeproof.plans import formats, registry  # noqa: F401  formats adds its queries
from edgeproof.streaming.feed import Feed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("embeddings", "supplier", "customer", "nation"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["jv_candidates", "jv_commit_round", "ht_root_replies", "path_compat", "path_normalize", "path_compat_direct", "reconnect_templates", "ht_targets_canonical", "graph_violations", "kopt_costs", "leaf_text", "lp_exact_bound", "lp_solution", "source_lp_solution"])
def test_queries_match_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, got.fetchall()))


def test_more_scalars_beyond_bigint(spark, tmp_path):
    """Keys whose products and sums pass BIGINT, either way, are null as in SQL, not an error."""
    keys = [-20000, -18446, -18445, -9224, -1, 0, 1, 747, 748, 9222, 9223, 9224, 15000, 900000]
    made = spark.createDataFrame([(k, f"Customer#{k}", k / 4) for k in keys], "c_custkey bigint, c_name string, c_acctbal double")
    made.write.parquet(f"{tmp_path}/customer.parquet")
    got = registry.QUERIES["more_scalars"](spark, str(tmp_path)).select("k", "product", "total").collect()
    fits = lambda n: n if -(1 << 63) <= n < 1 << 63 else None
    assert sorted(map(tuple, got)) == [(k, fits(k * 12345678901234567), fits(k * 10**15 + 9223372036000000000)) for k in keys]


def test_entry_module_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "jv_candidates" in e.queries()


def test_feed_gives_new_candidates(spark, tmp_path):
    from edgeproof.operators import jv
    from edgeproof.plans import synth

    g = synth.suppliers_graph(spark, SF)
    before = {r["edge_id"] for r in jv.candidates(g).collect()}
    feed, seen = Feed(g), []
    spark.createDataFrame([("supp", 3), ("supp", 3), ("supp", 999)], "g string, edge_id int").write.parquet(f"{tmp_path}/in")
    q = feed.start(spark.readStream.schema("g string, edge_id int").parquet(f"{tmp_path}/in"), lambda df, n: seen.extend(df.collect()), f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    after = {r["edge_id"] for r in jv.candidates(feed.graph).collect()}
    assert feed.graph.active().count() == g.active().count() - 1
    assert after - before <= {r["edge_id"] for r in seen} <= after


def test_all_root_replies_against_brute_force(spark):
    """Every joint reply of every root candidate of a complete graph, most candidates of which have over 100."""
    import math
    import random
    from itertools import combinations

    from edgeproof.operators.graph import POINTS, complete_graph

    rng = random.Random(3)
    at = [(rng.randrange(1000), rng.randrange(1000)) for _ in range(16)]
    g = complete_graph(spark.createDataFrame([("r", i, float(x), float(y), x, y) for i, (x, y) in enumerate(at)], POINTS))
    d = lambda a, b: math.floor(math.dist(at[a], at[b]) + 0.5)
    survives = lambda u, v, a, b: d(u, b) + d(v, a) >= d(u, v) + d(a, b) or d(u, a) + d(v, b) >= d(u, v) + d(a, b)

    def replies(u, v, c):
        one = [m for m in range(16) if m != c and survives(u, v, c, m)]
        return [(x, y) for x, y in combinations(one, 2) if (x, y) != (u, v) and d(u, v) + d(c, x) + d(c, y) <= d(x, y) + d(u, c) + d(v, c)]

    want, large = [], 0
    for u, v in combinations(range(16), 2):
        of = {c: replies(u, v, c) for c in range(16) if c not in (u, v)}
        cds = sorted((len(of[c]) * len(of[e]), c, e) for c, e in combinations(of, 2) if not survives(u, v, c, e))
        for rank, (n, c, e) in enumerate(cds[:5], 1):
            large += n > 100
            want += [(rank, k, c, *x, e, *y) for k, (x, y) in enumerate((x, y) for x in of[c] for y in of[e])]
    got = registry._root_replies(g).collect()
    assert large and sorted(tuple(r)[1:] for r in got) == sorted(want)
