"""Degree-capped commit, exactly as a walk through the ranked candidates, in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeproof.plans.cut import cut
from edgeproof.plans.order import numbered

from .graph import Graph


def commit(graph: Graph, proposed: DataFrame, method: str = "jv") -> DataFrame:
    """(g, edge_id, u, v, witness, method, place): the accepted candidates, in commit order.

    A walk in the order (u, v, method, witness, edge_id), once an edge, accepts a candidate if both ends have more than two edges left. In
    parallel: a candidate falls once as many accepted ones stand before it at an end as that end can spare; it stands once fewer than that, of
    all before it that have not fallen, share either end. The first undecided one is always decided, so rounds end; few are needed. The order is
    carried as a struct, so nothing is numbered but what is accepted.
    """
    first = Window.partitionBy("g", "edge_id").orderBy("u", "v", "witness")
    own = proposed.select("g", "edge_id", "u", "v", "witness", F.lit(method).alias("method")).withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    spare = graph.degree().select("g", F.col("id").alias("n"), (F.col("degree") - 2).alias("spare"))
    rows = own.withColumn("rank", F.struct("u", "v", "method", "witness", "edge_id"))
    ends = rows.select("g", "edge_id", "rank", F.explode(F.array("u", "v")).alias("n")).join(spare, ["g", "n"])
    state = cut(ends.select("g", "n", "edge_id", "rank", "spare", F.lit(None).cast("boolean").alias("taken")))
    before = Window.partitionBy("g", "n").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")).over(before), F.lit(0))
    while not state.where("taken is null").isEmpty():
        seen = state.withColumn("sure", count(F.coalesce("taken", F.lit(False)))).withColumn("maybe", count(F.coalesce("taken", F.lit(True))))
        verdict = seen.groupBy("g", "edge_id").agg(F.bool_or(F.col("sure") >= F.col("spare")).alias("falls"), F.bool_and(F.col("maybe") < F.col("spare")).alias("stands"))
        told = state.join(verdict, ["g", "edge_id"])
        taken = F.coalesce("taken", F.when(F.col("falls"), F.lit(False)).when(F.col("stands"), F.lit(True)))
        state = cut(told.select("g", "n", "edge_id", "rank", "spare", taken.alias("taken")))
    good = state.where("taken").select("g", "edge_id").distinct()
    out = rows.join(good, ["g", "edge_id"], "left_semi")
    return numbered(out, ["rank"], "place").drop("rank")


def without(graph: Graph, committed: DataFrame) -> Graph:
    """The next snapshot: the committed edges inactive; edge ids stay."""
    gone = committed.select("g", "edge_id", F.lit(True).alias("gone"))
    e = graph.edges.join(gone, ["g", "edge_id"], "left")
    return graph.with_edges(e.select("g", "edge_id", "u", "v", "weight", (F.col("active") & F.col("gone").isNull()).alias("active")))
