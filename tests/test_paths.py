import random

from edgeproof.operators import paths


def test_normal_forms_from_rows_agree_with_plain_python(spark):
    rng = random.Random(11)
    systems = [(0, 5, None), (1, 0, [[0, 1]]), (2, 5, []), (3, 400, [list(range(399, -1, -1))]), (4, 11, [[2, 1, 0], [2, 3], [10, 9]]), (5, 9, [[0, 1], [1, 2], [2, 0]]), (6, 9, [[0, 1], [3, 4, 5], [5, 6, 3]])]
    for k in range(7, 400):
        n = rng.choice([6, 9, 14])
        p = [rng.sample(range(n), rng.choice([2, 2, 3, 4])) for _ in range(rng.randrange(1, 5))]
        if k % 17 == 0:
            p.insert(rng.randrange(len(p) + 1), rng.choice([[1], [0, n], [-1, 2], [2, 3, 2]]))
        systems.append((k, n, p))
    got = {r["key"]: (r["valid"], r["reason"], r["paths"], r["edge_count"]) for r in paths.normal_forms(spark.createDataFrame(systems, "key int, nodes int, paths array<array<int>>").repartition(3)).collect()}
    want = {k: paths.normalize(p or [], n) for k, n, p in systems}
    assert {w[1] for w in want.values()} == {"", "no nodes", "no paths", "short path", "node out of range", "repeated node", "repeated edge", "degree above two", "cycle"}
    assert {k: got[k] for k in want if got.get(k) != want[k]} == {k: want[k] for k in want if got.get(k) != want[k]}
