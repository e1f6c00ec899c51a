"""Connected components by alternating large-star and small-star rounds, all in tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import written


def _sum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).first()
    return (r["n"], r["x"], r["s"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v: long, not null) with a link to another one; root is the component's smallest node.

    Loops and repeated edges do no harm; no edges give an empty table. Rounds grow with the logarithm of the longest path; each
    is written, so no lineage and nothing on the driver but three numbers. A node's neighbours are never gathered: their
    minimum is aggregated before the shuffle and joined back, and that join can be split where a node is hot.
    """
    u, v = F.col("u"), F.col("v")
    now = written(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "links")
    before = _sum(now)
    while before[0]:
        both = now.unionAll(now.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), u).alias("m"))
        large = both.where(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        large = written(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(v == F.col("m"), u).otherwise(v).alias("u"), F.col("m").alias("v")).distinct()
        now = written(small.where(u != v), "links")
        after = _sum(now)
        if after == before:
            break
        before = after
    return now.select(u.alias("node"), v.alias("root")).unionAll(now.select(v.alias("node"), v.alias("root")).distinct())
