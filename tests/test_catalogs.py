import random

from pyspark.sql import functions as F

from edgeproof.operators import catalogs
from edgeproof.plans.order import numbered


def test_matchings_from_their_numbers_are_those_of_the_lists(spark):
    for which, made in (("outside", catalogs.outside), ("inside", catalogs.inside)):
        got = catalogs.matchings(spark, which, 6).collect()
        assert len(got) == sum(len(made(m)) for m in range(1, 7))
        assert all(tuple(r["mates"]) == made(r["m"])[r["matching_id"]] for r in got)
    rng = random.Random(1)
    asked = [(7, rng.randrange(46080), rng.randrange(135135)) for _ in range(300)] + [(7, 46079, 135134), (7, 0, 0), (1, 0, 0)]
    df = spark.createDataFrame(asked, "m int, o long, i long")
    for r in df.select("*", catalogs.outside_at(F.col("m"), F.col("o")).alias("x"), catalogs.inside_at(F.col("m"), F.col("i")).alias("y")).collect():
        assert tuple(r["x"]) == catalogs.outside(r["m"])[r["o"]] and tuple(r["y"]) == catalogs.inside(r["m"])[r["i"]]


def test_numbers_out_of_range_and_nulls_have_no_matching(spark):
    df = spark.createDataFrame([(2, 2, 0), (2, 0, 3), (2, -1, 0), (0, 0, 0), (8, 0, 0), (None, 0, 0), (3, None, 0), (2, 1, 2)], "m int, outside_id long, inside_id long")
    got = [r["compatible"] for r in catalogs.evaluate(spark, df).collect()]
    assert got[:-1] == [None] * 7 and got[-1] == catalogs.one_tour(catalogs.outside(2)[1], catalogs.inside(2)[2])
    assert catalogs.evaluate(spark, df.limit(0)).count() == 0


def test_templates_are_those_of_the_lists(spark):
    got = {(r["k"], r["template_id"]): tuple(r["mates"]) for r in catalogs.templates_table(spark).collect()}
    assert got == {(k, i): t for k in (3, 4, 5) for i, t in enumerate(catalogs.templates(k))}


def test_numbering_over_partitions(spark):
    rng = random.Random(2)
    rows = [("big", rng.randrange(500), k, None) for k in range(4000)] + [("one", 7, 0, "x"), ("tie", 3, 1, "y"), ("tie", 3, 1, "y"), (None, 5, 5, None), (None, 1, 5, None), ("big", None, 1, "z")]
    df = spark.createDataFrame(rows, "g string, a int, b int, note string").repartition(7)
    for desc in (False, True):
        key = F.col("a").desc() if desc else F.col("a")
        got = numbered(df, [key, "b"], "place")
        assert got.columns == ["g", "a", "b", "note", "place"]
        told = {}
        for r in got.collect():
            told.setdefault(r["g"], []).append((r["place"], r["a"], r["b"]))
        assert {g: len(x) for g, x in told.items()} == {"big": 4001, "one": 1, "tie": 2, None: 2}
        for x in told.values():
            x.sort()
            assert [p for p, _, _ in x] == list(range(len(x)))
            order = [((a is not None, a), b) for _, a, b in x]
            keyed = sorted(order, key=lambda t: ((-t[0][1] if desc else t[0][1]) if t[0][0] else (10**9 if desc else -1), t[1]))
            assert order == keyed
    assert numbered(df.limit(0), ["a"], "place").count() == 0
