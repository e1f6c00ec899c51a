"""Tours: cost, edges that the graph lacks, and the gate around a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeproof.functions import fnv

from .graph import Graph


def tour_edges(tour: DataFrame) -> DataFrame:
    """(g, u, v) of each step of tour (g, pos, node), the last back to the first."""
    order = Window.partitionBy("g").orderBy("pos")
    following = F.coalesce(F.lead("node").over(order), F.first("node").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    step = tour.withColumn("to", following)
    return step.select("g", F.least("node", "to").alias("u"), F.greatest("node", "to").alias("v"))


def check_tour(graph: Graph, tour: DataFrame) -> DataFrame:
    """(g, cost, missing_edges): the tour's length and how many of its edges are not active."""
    e = tour_edges(tour)
    cost = graph.at(graph.at(e, "u", "a"), "v", "b").select("g", graph.distance("a", "b").alias("d"))
    lost = e.join(graph.active().select("g", "u", "v"), ["g", "u", "v"], "left_anti").groupBy("g").agg(F.count("*").cast("bigint").alias("k"))
    return cost.groupBy("g").agg(F.sum("d").alias("cost")).join(lost, "g", "left").select("g", "cost", F.coalesce("k", F.lit(0).cast("bigint")).alias("missing_edges"))


def faults(graph: Graph, tour: DataFrame) -> DataFrame:
    """(g, what, n): how a tour is no permutation of its graph's points; empty for a sound one."""
    n = graph.points.groupBy("g").agg(F.count("*").alias("points"))
    t = tour.groupBy("g").agg(F.count("*").alias("steps"), F.count_distinct("node").alias("nodes"), F.min("node").alias("low"), F.max("node").alias("high"))
    bad = n.join(t, "g", "left").where(~F.coalesce((F.col("steps") == F.col("points")) & (F.col("nodes") == F.col("points")) & (F.col("low") == 0) & (F.col("high") == F.col("points") - 1), F.lit(False)))
    return bad.select("g", F.lit("permutation").alias("what"), F.col("points").alias("n"))


def tour_hash(graph: Graph, tour: DataFrame) -> DataFrame:
    """(g, hash) of each tour's edges; a hash is sequential, so each tour is one group."""

    def run(pdf):
        import pandas as pd

        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "hash": [fnv.tour_hash(len(pdf), zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True))]})

    return tour_edges(tour).groupBy("g").applyInPandas(run, "g string, hash string")
