"""The verifier of Hamilton-Tutte proofs, written apart from the search: it recomputes each node's replies from the graph and compares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeproof.plans.cut import cut

from . import kopt, paths
from .graph import Graph
from .wavefront import Proof

_NODE = ["g", "target", "node"]


def _around(graph: Graph, rows: DataFrame) -> DataFrame:
    """(g, target, center, x, y): for (g, target, u, v, center) each pair x < y of active neighbours of the centre that a tour through the target may use there."""
    p = graph.points.select("g", F.col("id").alias("_i"), F.struct("ix", "iy").alias("_p"))
    with_point = lambda df, node, name: df.join(p, (df["g"] == p["g"]) & (df[node] == p["_i"])).select(df["*"], F.col("_p").alias(name))
    from edgeproof.functions.distance import distance

    d = lambda a, b: distance(F.col(f"{a}.ix"), F.col(f"{a}.iy"), F.col(f"{b}.ix"), F.col(f"{b}.iy"), graph.kind, graph.fast)
    base = rows.select("g", "target", "u", "v", "center").distinct().where("center <> u and center <> v")
    for node, name in (("u", "pu"), ("v", "pv"), ("center", "pc")):
        base = with_point(base, node, name)
    e = graph.edges.where("active")
    touch = e.select("g", F.col("u").alias("center"), F.col("v").alias("x")).unionAll(e.select("g", F.col("v").alias("center"), F.col("u").alias("x")))
    touch = with_point(touch, "x", "px")
    pairs = base.join(touch, ["g", "center"]).join(touch.select("g", "center", F.col("x").alias("y"), F.col("px").alias("py")), ["g", "center"]).where("x < y")

    def stays(n: str) -> F.Column:
        own = d("pu", "pv") + d("pc", n)
        return (d("pu", "pc") + d("pv", n) >= own) | (d("pu", n) + d("pv", "pc") >= own)

    three = d("pu", "pv") + d("pc", "px") + d("pc", "py") <= d("px", "py") + d("pu", "pc") + d("pv", "pc")
    is_target = (F.col("x") == F.least("u", "v")) & (F.col("y") == F.greatest("u", "v"))
    good = pairs.where(~is_target & stays("px") & stays("py") & three)
    return good.select("g", "target", "center", "x", "y")


def _admissible(graph: Graph, cd: DataFrame, mode: str) -> DataFrame:
    """The nodes (g, target, node, u, v, first, second) whose c, d move is allowed."""
    from edgeproof.functions.distance import distance

    p = graph.points.select("g", "id", "ix", "iy")
    rows = cd.where("first <> second and first not in (u, v) and second not in (u, v)")
    for node in ("u", "v", "first", "second"):
        rows = rows.join(p.select("g", F.col("id").alias(node), F.col("ix").alias(f"{node}_x"), F.col("iy").alias(f"{node}_y")), ["g", node])
    d = lambda a, b: distance(F.col(f"{a}_x"), F.col(f"{a}_y"), F.col(f"{b}_x"), F.col(f"{b}_y"), graph.kind, graph.fast)
    own = d("u", "v") + d("first", "second")
    apart = (d("u", "first") + d("v", "second") < own) & (d("u", "second") + d("v", "first") < own)
    e = graph.edges.where("active").select("g", "u", "v")
    here = rows.join(e.select("g", F.col("u").alias("_a"), F.col("v").alias("_b"), F.lit(True).alias("there")), (rows["g"] == e["g"]) & (F.least("first", "second") == F.col("_a")) & (F.greatest("first", "second") == F.col("_b")), "left")
    there = F.coalesce("there", F.lit(False))
    return here.where((there & apart) if mode == "active-incompatible" else (~there | apart)).select(rows["g"], "target", "node")


def verify(graph: Graph, targets: DataFrame, proof: Proof, mode: str = "active-incompatible") -> DataFrame:
    """(g, target, faults): of each target (g, target, u, v) what is wrong with its proof, an empty array if nothing is.

    Wrong is: no node, a root that is not the target's own path with an allowed c, d move, a move of a wrong kind or place, a reply
    missing, too many, out of order or of wrong content, a child whose paths are not those of its reply, a feasible reply called infeasible, a
    node used twice or never, a leaf that does not verify.
    """
    t = targets.select("g", "target", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    nodes = cut(proof.nodes.join(t, ["g", "target"]))
    bad: list[DataFrame] = []

    def fault(rows: DataFrame, what: str) -> None:
        bad.append(rows.select("g", "target", F.lit(what).alias("what")).distinct())

    fault(t.join(proof.nodes.where("node = 0"), ["g", "target"], "left_anti"), "no root")
    fault(proof.nodes.groupBy(*_NODE).count().where("count > 1"), "repeated node")
    root = nodes.where("node = 0")
    fault(root.where((F.col("paths") != F.array(F.array("u", "v"))) | (F.col("type") != "cd")), "root")
    fault(root.where("type = 'cd'").join(_admissible(graph, root.where("type = 'cd'").select("g", "target", "node", "u", "v", "first", "second"), mode), _NODE, "left_anti"), "c, d move")
    fault(nodes.where("(node > 0 and type = 'cd') or type not in ('cd', 'leaf', 'point', 'end')"), "type")
    fault(nodes.where("type <> 'leaf' and leaf is not null and leaf.proven"), "leaf at a move")
    fault(nodes.where((F.col("type") == "point") & ((F.col("second") != -1) | F.array_contains(F.flatten("paths"), F.col("first")))), "point move")
    is_end = F.exists("paths", lambda p: ((p[0] == F.col("first")) & (p[1] == F.col("second"))) | ((F.element_at(p, -1) == F.col("first")) & (F.element_at(p, -2) == F.col("second"))))
    fault(nodes.where((F.col("type") == "end") & ~is_end), "end move")

    centers = nodes.where("type in ('cd', 'point')").select("g", "target", "u", "v", F.col("first").alias("center")).unionAll(nodes.where("type = 'cd'").select("g", "target", "u", "v", F.col("second").alias("center")))
    around = cut(_around(graph, centers))
    at = lambda end: around.select("g", "target", F.col("center").alias(end), F.col("x").alias(f"{end}_x"), F.col("y").alias(f"{end}_y"))
    none_pair, none_edge = F.lit(None).cast("struct<center:int,first:int,second:int>"), F.lit(None).cast("struct<u:int,v:int>")
    pair = lambda end: F.struct(F.col(end).alias("center"), F.col(f"{end}_x").alias("first"), F.col(f"{end}_y").alias("second"))
    path_of = lambda end: F.array(f"{end}_x", end, f"{end}_y")
    own = nodes.select(*_NODE, "paths", "type", "first", "second")
    cd = own.where("type = 'cd'").join(at("first"), ["g", "target", "first"]).join(at("second"), ["g", "target", "second"])
    order = lambda *cs: F.array(*(F.col(c) for c in cs)).alias("order")
    want = [cd.select(*_NODE, "paths", pair("first").alias("pair1"), pair("second").alias("pair2"), none_edge.alias("edge"), F.array(path_of("first"), path_of("second")).alias("more"), order("first_x", "first_y", "second_x", "second_y"))]
    point = own.where("type = 'point'").join(at("first"), ["g", "target", "first"])
    want.append(point.select(*_NODE, "paths", pair("first").alias("pair1"), none_pair.alias("pair2"), none_edge.alias("edge"), F.array(path_of("first")).alias("more"), order("first_x", "first_y")))
    e = graph.edges.where("active")
    touch = e.select("g", F.col("u").alias("first"), F.col("v").alias("x")).unionAll(e.select("g", F.col("v").alias("first"), F.col("u").alias("x")))
    ends = own.where("type = 'end'").join(touch, ["g", "first"]).where("x <> second")
    edge = F.struct(F.least("first", "x").alias("u"), F.greatest("first", "x").alias("v"))
    want.append(ends.select(*_NODE, "paths", none_pair.alias("pair1"), none_pair.alias("pair2"), edge.alias("edge"), F.array(F.array("first", "x")).alias("more"), order("x")))
    wanted = reduce(DataFrame.unionByName, want)
    wanted = wanted.withColumn("reply", F.row_number().over(Window.partitionBy(*_NODE).orderBy("order")).cast("bigint") - 1)
    # paths grow in a large expression: it is cut, so that no fault's filter is pushed into it, nor any rule of the optimizer repeats it
    wanted = cut(wanted.withColumn("child_paths", paths.grown(F.col("paths"), F.col("more"))).drop("more", "order", "paths"))
    told = proof.replies.select(*_NODE, "reply", F.struct("pair1", "pair2", "edge").alias("told"), "infeasible", F.col("child").alias("child"), F.lit(True).alias("is_told"))
    same = wanted.withColumn("wanted", F.struct("pair1", "pair2", "edge")).withColumn("is_wanted", F.lit(True)).join(told, [*_NODE, "reply"], "full_outer")
    child = proof.nodes.select("g", "target", F.col("node").alias("child"), F.col("paths").alias("own_paths"))
    same = cut(same.join(child, ["g", "target", "child"], "left"))
    fault(same.where(F.col("is_told").isNull() | F.col("is_wanted").isNull() | ~F.col("told").eqNullSafe(F.col("wanted"))), "replies")
    fault(same.where("is_told and is_wanted and infeasible and (child_paths is not null or child is not null)"), "infeasible reply")
    fault(same.where(F.expr("is_told and is_wanted and not infeasible") & ~F.coalesce(F.col("own_paths") == F.col("child_paths"), F.lit(False))), "child paths")
    used = proof.replies.where("child is not null").groupBy("g", "target", F.col("child").alias("node")).agg(F.count("*").alias("n"))
    fault(proof.nodes.where("node > 0").join(used.where("n = 1"), _NODE, "left_anti"), "use of a node")
    fault(used.where("node <= 0 or n > 1"), "use of a node")
    fault(proof.replies.where("child <= node"), "order of nodes")

    leaf = nodes.where("type = 'leaf'")
    spot = leaf.select(*_NODE, F.explode(F.flatten("paths")).alias("id")).join(graph.points.select("g", "id", "ix", "iy"), ["g", "id"]).groupBy(*_NODE).agg(F.collect_list(F.struct("id", F.col("ix").alias("x"), F.col("iy").alias("y"))).alias("places"))
    fault(leaf.where("leaf is null or first <> -1 or second <> -1"), "leaf")
    judged = leaf.where("leaf is not null").join(spot, _NODE)
    judged = judged.select("g", "target", kopt.leaf_verdicts(F.col("paths"), F.col("places"), F.col("u"), F.col("v"), F.col("leaf"), graph.kind).alias("why"))
    judged = cut(judged)
    fault(judged.where("why <> 'ok'"), "leaf")
    all_ = reduce(DataFrame.unionAll, bad).groupBy("g", "target").agg(F.array_sort(F.collect_set("what")).alias("faults"))
    return t.select("g", "target").join(all_, ["g", "target"], "left").select("g", "target", F.coalesce("faults", F.expr("cast(array() as array<string>)")).alias("faults"))
