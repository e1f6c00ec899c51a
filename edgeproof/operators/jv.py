"""Quick elimination: candidates, an independent verifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeproof.functions.distance import distance
from edgeproof.plans.cut import cut

from .graph import Graph

#: Most witnesses that are tried for an edge.
TRIED = 10


def _near(graph: Graph) -> DataFrame:
    """(g, n, nx, ny, k, near): each node with its count of active edges and its active neighbours (m, x, y, w) in one array."""
    at = lambda n, *names: graph.points.select("g", F.col("id").alias(n), F.col("ix").alias(names[0]), F.col("iy").alias(names[1]))
    one = F.when(F.col("known"), F.struct("m", "x", "y", F.col("weight").alias("w")))
    rows = graph.adjacency().join(at("m", "x", "y").withColumn("known", F.lit(True)), ["g", "m"], "left")
    return rows.groupBy("g", "n").agg(F.count("*").alias("k"), F.collect_list(one).alias("near")).join(at("n", "nx", "ny"), ["g", "n"])


def ranked_witnesses(graph: Graph, tried: int = TRIED, edges: DataFrame | None = None) -> DataFrame:
    """(g, edge_id, u, v, weight, c, score, rank, and coordinates): the nearest nodes next to either end, for edges that pass the degree gate, or some of them.

    Neighbours travel as one array an end, never by a join on either end, and an edge's are ranked where its second end is, so they are not
    sent. The node that is next to both ends stands twice at one dense rank, and is met once.
    """
    near = _near(graph)
    e = graph.active() if edges is None else edges
    for end, name, k in (("u", "a", "ku"), ("v", "b", "kv")):
        e = e.join(near.select("g", F.col("n").alias(end), F.col("nx").alias(f"{name}x"), F.col("ny").alias(f"{name}y"), F.col("k").alias(k), F.col("near").alias(f"near_{end}")), ["g", end])
    if edges is None:
        e = e.where("ku > 2 and kv > 2")
    names = ["g", "edge_id", "u", "v", "weight", "ax", "ay", "bx", "by"]
    side = F.explode(F.array(F.struct(F.col("near_u").alias("near"), F.col("v").alias("other")), F.struct(F.col("near_v").alias("near"), F.col("u").alias("other"))))
    c = e.select(*names, side.alias("side")).select(*names, F.col("side.other").alias("other"), F.explode("side.near").alias("c")).where("c.m <> other")
    c = c.select(*names, F.col("c.m").alias("c"), F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))
    c = c.withColumn("ac", graph.distance("a", "c")).withColumn("cb", graph.distance("c", "b")).withColumn("score", F.col("ac") + F.col("cb"))
    own = Window.partitionBy("g", "v", "edge_id").orderBy("score", "c")
    c = c.withColumn("rank", F.dense_rank().over(own).cast("bigint")).where(F.col("rank") <= tried)
    return c.withColumn("last", F.lag("c").over(own)).where("last is null or last <> c").drop("last")


def candidates(graph: Graph, tried: int = TRIED, edges: DataFrame | None = None) -> DataFrame:
    """(g, edge_id, u, v, witness): of each edge the first witness c all of whose active neighbours d, but the ends, make both exchanges of edge and cd longer."""
    return first_sound(graph, ranked_witnesses(graph, tried, edges))


def first_sound(graph: Graph, ranked: DataFrame) -> DataFrame:
    """The candidates among ranked witnesses: a witness meets its neighbours in one array, the first bad one of which settles it."""
    near = _near(graph).select("g", F.col("n").alias("c"), "near")

    def bad(d):
        far = lambda x, y: distance(F.col(x), F.col(y), d["x"], d["y"], graph.kind, graph.fast)
        kept = F.col("weight") + d["w"]
        return (d["m"] != F.col("u")) & (d["m"] != F.col("v")) & ((kept <= F.col("ac") + far("bx", "by")) | (kept <= far("ax", "ay") + F.col("cb")))

    c = ranked.select("g", "edge_id", "u", "v", "weight", "ax", "ay", "bx", "by", "c", "ac", "cb", "rank").join(near, ["g", "c"], "left")
    sound = c.where(~F.coalesce(F.exists("near", bad), F.lit(False)))
    return sound.groupBy("g", "edge_id", "u", "v").agg(F.min_by("c", "rank").alias("witness"))


def candidates_after(graph: Graph, before: DataFrame, gone: DataFrame, tried: int = TRIED) -> DataFrame:
    """``candidates`` of a graph from those ``before`` the edges ``gone`` (g, u, v) were taken out of it.

    Only edges with an end at a point of these, or next to one, are searched anew: any other has its witnesses, their neighbours and the
    degrees of its ends as before.
    """
    touched = gone.select("g", F.explode(F.array("u", "v")).alias("n")).distinct()
    near = cut(touched.unionAll(graph.adjacency().join(touched, ["g", "n"]).select("g", F.col("m").alias("n"))).distinct())
    kept, again = before, graph.gated()
    for end in ("u", "v"):
        at = near.select("g", F.col("n").alias(end), F.lit(True).alias(f"by_{end}"))
        kept, again = kept.join(at.drop(f"by_{end}"), ["g", end], "left_anti"), again.join(at, ["g", end], "left")
    again = cut(again.where("by_u or by_v").select("g", "edge_id", "u", "v", "weight"))
    names = ("g", "edge_id", "u", "v", "witness")
    return kept.select(*names).unionByName(candidates(graph, tried, again).select(*names))


def verify(graph: Graph, proposed: DataFrame) -> DataFrame:
    """``proposed`` (g, edge_id, u, v, witness) with ok: whether the edge is active, passes the gate, the witness is a point but no end, and no other active edge at it is compatible.

    Everything is computed anew for the given witness: the compatible edges are counted, from the stored edges and the points.
    """
    e, p = graph.edges.where("active"), graph.points
    at = lambda df, node, name: df.join(p.select("g", F.col("id").alias(node), F.col("ix").alias(f"{name}_x"), F.col("iy").alias(f"{name}_y")), ["g", node])
    far = lambda s, t: distance(F.col(f"{s}_x"), F.col(f"{s}_y"), F.col(f"{t}_x"), F.col(f"{t}_y"), graph.kind, graph.fast)
    ends = e.select("g", F.explode(F.array("u", "v")).alias("n")).groupBy("g", "n").agg(F.count("*").alias("k"))
    row = proposed.select("g", "edge_id", "u", "v", "witness")
    known = row.join(e.select("g", "edge_id", "u", "v"), ["g", "edge_id", "u", "v"], "left_semi")
    for end in ("u", "v"):
        known = known.join(ends.where("k > 2").select("g", F.col("n").alias(end)), ["g", end], "left_semi")
    known = known.where("witness <> u and witness <> v").join(p.select("g", F.col("id").alias("witness")), ["g", "witness"], "left_semi")
    touch = e.select("g", F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("m")), F.struct(F.col("v").alias("n"), F.col("u").alias("m")))).alias("t")).select("g", "t.n", "t.m")
    wide = at(at(at(known, "u", "p"), "v", "q"), "witness", "r")
    other = at(touch.select("g", F.col("n").alias("witness"), F.col("m").alias("o")), "o", "s")
    met = wide.join(other, ["g", "witness"]).where("o <> u and o <> v")
    kept = far("p", "q") + far("r", "s")
    compatible = met.where((kept <= far("p", "r") + far("s", "q")) | (kept <= far("p", "s") + far("q", "r"))).groupBy("g", "edge_id").agg(F.count("*").alias("compatible"))
    good = known.join(compatible, ["g", "edge_id"], "left_anti").select("g", "edge_id", F.lit(True).alias("ok"))
    return row.join(good, ["g", "edge_id"], "left").select("g", "edge_id", "u", "v", "witness", F.coalesce("ok", F.lit(False)).alias("ok"))
