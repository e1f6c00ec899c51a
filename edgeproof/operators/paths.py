"""Path systems: normal form, and growth by a point or an end.

``normal_forms`` works on rows: faults are windows over nodes and edges, chains come from list ranking by pointer doubling, so a system may
have any size. Inside the search systems are tiny (a few dozen nodes) and grow in an Arrow function; systems are many, and partitioned.
"""

from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeproof.plans.cut import cut

Paths = list[list[int]]


def normalize(paths: Paths, nodes: int) -> tuple[bool, str, Paths, int]:
    """(valid, reason, paths, edges): the union of the paths as maximal chains, each from its smaller end, in order.

    Invalid without paths, with a path of fewer than two nodes, a node out of range or twice in a path, an edge twice, a node with
    more than two edges, or a cycle.
    """
    bad = lambda why: (False, why, [], 0)
    if nodes <= 0:
        return bad("no nodes")
    if not paths:
        return bad("no paths")
    edges: Counter = Counter()
    near: dict[int, list[int]] = {}
    for p in paths:
        if len(p) < 2:
            return bad("short path")
        if any(n < 0 or n >= nodes for n in p):
            return bad("node out of range")
        if len(set(p)) < len(p):
            return bad("repeated node")
        for a, b in zip(p, p[1:], strict=False):
            edges[min(a, b), max(a, b)] += 1
            if edges[min(a, b), max(a, b)] > 1:
                return bad("repeated edge")
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, []).append(y)
                if len(near[x]) > 2:
                    return bad("degree above two")
    out, seen = [], set()
    for start in sorted(n for n, ns in near.items() if len(ns) == 1):
        if start in seen:
            continue
        chain, before, now = [], None, start
        while now is not None:
            chain.append(now)
            before, now = now, next((n for n in near[now] if n != before), None)
        seen.update(chain)
        out.append(chain)
    if len(seen) < len(near):
        return bad("cycle")
    return True, "", sorted(out), len(edges)


def grow(paths: Paths, more: Paths) -> Paths | None:
    """The normal form of a sound system and further paths; None where there is none. Node ranges are the caller's."""
    ok, _, got, _ = normalize(paths + more, 1 << 31)
    return got if ok else None


def _lists(p) -> Paths:
    return [] if p is None else [[int(x) for x in q] for q in p]


def normal_forms(systems: DataFrame) -> DataFrame:
    """(key, valid, reason, paths, edge_count) of each system (key, nodes, paths), keys different: as ``normalize``, from rows.

    The reason is that of the first fault, path by path. A null list of paths has none; null paths and null nodes are not allowed. Rounds of
    doubling are the logarithm of the longest chain's bound.
    """
    own = systems.select("key", "nodes", "paths")
    path = cut(own.select("key", "nodes", F.posexplode("paths").alias("i", "p")))
    edge = path.select("key", "i", "p", F.explode(F.when(F.size("p") > 1, F.sequence(F.lit(1), F.size("p") - 1))).alias("j"))
    edge = edge.select("key", "i", "j", F.expr("p[j - 1]").alias("a"), F.expr("p[j]").alias("b"))
    zero = F.lit(0)
    at = lambda stage, j=zero, sub=zero: F.array(F.col("i"), F.lit(stage), j, sub).alias("at")
    fault = lambda rows, what, where: rows.select("key", where, F.lit(what).alias("reason"))
    again = F.row_number().over(Window.partitionBy("key", F.least("a", "b"), F.greatest("a", "b")).orderBy("i", "j"))
    ends = edge.select("key", "i", "j", F.explode(F.array("a", "b")).alias("n"))
    met = F.count("*").over(Window.partitionBy("key", "n").orderBy("i", "j").rowsBetween(Window.unboundedPreceding, 0))
    faults = reduce(
        DataFrame.unionByName,
        [
            own.where("nodes <= 0").select("key", F.expr("array(-2, 0, 0, 0)").alias("at"), F.lit("no nodes").alias("reason")),
            own.where("coalesce(size(paths), 0) <= 0").select("key", F.expr("array(-1, 0, 0, 0)").alias("at"), F.lit("no paths").alias("reason")),
            fault(path.where("size(p) < 2"), "short path", at(0)),
            fault(path.where("exists(p, n -> n < 0 or n >= nodes)"), "node out of range", at(1)),
            fault(path.where("size(array_distinct(p)) < size(p)"), "repeated node", at(2)),
            fault(edge.withColumn("nth", again).where("nth > 1"), "repeated edge", at(3, F.col("j"))),
            fault(ends.withColumn("nth", met).where("nth > 2"), "degree above two", at(3, F.col("j"), F.lit(1))),
        ],
    )
    faulty = cut(faults.groupBy("key").agg(F.min_by("reason", "at").alias("reason")))
    good = edge.join(faulty.select("key"), "key", "left_anti")
    arc = cut(good.select("key", "a", "b").unionAll(good.select("key", F.col("b").alias("a"), F.col("a").alias("b"))))
    degree = arc.groupBy("key", F.col("b").alias("n")).agg(F.count("*").alias("degree"))
    after = arc.select(F.col("key").alias("key2"), F.col("a").alias("mid"), F.col("b").alias("c"))
    # each arc points to the one after it; the last ones of chains to themselves
    link = arc.join(after, (arc["key"] == after["key2"]) & (arc["b"] == after["mid"]) & (arc["a"] != after["c"]), "left")
    link = cut(link.select("key", "a", "b", F.coalesce("mid", "a").alias("x"), F.coalesce("c", "b").alias("y"), F.col("c").isNotNull().cast("bigint").alias("far")))
    longest = link.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(0, longest // 2 - 1).bit_length()):
        on = link.select("key", F.col("a").alias("x"), F.col("b").alias("y"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("far").alias("more"))
        link = cut(link.join(on, ["key", "x", "y"]).select("key", "a", "b", F.col("x2").alias("x"), F.col("y2").alias("y"), (F.col("far") + F.col("more")).alias("far")))
    tips = degree.where("degree = 1").select("key", F.col("n").alias("y"))
    told = link.join(tips, ["key", "y"]).select("key", "y", F.col("a").alias("n"), (F.col("far") + 1).alias("place"))
    told = told.unionAll(tips.select("key", "y", F.col("y").alias("n"), F.lit(0).cast("bigint").alias("place")))
    chain = told.groupBy("key", "y").agg(F.sort_array(F.collect_list(F.struct("place", "n")))["n"].alias("chain")).where("chain[0] < element_at(chain, -1)")
    whole = chain.groupBy("key").agg(F.sort_array(F.collect_list("chain")).alias("chains"), F.sum(F.size("chain")).alias("held"))
    size = degree.groupBy("key").agg(F.count("*").alias("all"), F.expr("sum(degree) div 2").alias("edges"))
    out = own.select("key").join(faulty, "key", "left").join(whole, "key", "left").join(size, "key", "left")
    reason = F.coalesce("reason", F.when(F.coalesce("held", F.lit(0)) < F.col("all"), "cycle"), F.lit(""))
    sound = F.col("reason") == ""
    none = F.expr("cast(array() as array<array<int>>)")
    return out.withColumn("reason", reason).select("key", sound.alias("valid"), "reason", F.when(sound, F.col("chains")).otherwise(none).alias("paths"), F.when(sound, F.col("edges")).otherwise(F.lit(0).cast("bigint")).alias("edge_count"))


def _grown(paths: pd.Series, more: pd.Series) -> pd.Series:
    return pd.Series([grow(_lists(p), _lists(m)) for p, m in zip(paths, more, strict=True)], dtype=object)


def grown(paths: Column, more: Column) -> Column:
    """Normal form of a system with further paths; null where it is infeasible."""
    return F.pandas_udf(_grown, "array<array<int>>")(paths, more)


def feasible_appends(parents: DataFrame, tasks: DataFrame) -> DataFrame:
    """``tasks`` (key, task_id, kind, first, center, second) with feasible, decided in SQL without building the child.

    parents: (key, paths). A point task adds first - center - second, an end task first - second. Ends must have fewer than two edges left
    at the parent, and lie in different chains; the centre must be new; an end task must not repeat an edge.
    """
    chain = parents.select("key", F.posexplode("paths").alias("component", "p"))
    node = chain.select("key", "component", "p", F.posexplode("p").alias("i", "n")).select("key", "component", "n", ((F.col("i") > 0) & (F.col("i") < F.size("p") - 1)).alias("inner"))
    at = lambda name: node.select("key", F.col("n").alias(name), F.col("component").alias(f"{name}_c"), F.col("inner").alias(f"{name}_i"))
    t = tasks.join(at("first"), ["key", "first"], "left").join(at("second"), ["key", "second"], "left").join(at("center"), ["key", "center"], "left")
    free = ~F.coalesce("first_i", F.lit(False)) & ~F.coalesce("second_i", F.lit(False))
    apart = ~F.coalesce(F.col("first_c") == F.col("second_c"), F.lit(False))
    point = F.col("center_c").isNull() & (F.col("first") != F.col("second"))
    ok = free & apart & F.when(F.col("kind") == "point", point).otherwise(F.col("first") != F.col("second"))
    return t.select(*tasks.columns, ok.alias("feasible"))
