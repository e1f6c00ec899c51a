"""Graphs derived from the driver's tables, and the small fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeproof.operators.graph import POINTS, Graph, complete_graph, nearest_graph

# The eight points of the fixture.
FIXTURE = [(17, 28), (3, -18), (34, -5), (-13, -26), (-45, -15), (11, 30), (31, -47), (27, -19)]


def points_of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two components of each vector, in millionths."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda k: F.floor(1e6 * F.col("embedding")[k].cast("double")).cast("bigint")
    return _points(e.select(F.lit("emb").alias("g"), F.col("vec_id").cast("int").alias("id"), at(0).alias("ix"), at(1).alias("iy")))


def points_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return _points(s.select(F.lit("supp").alias("g"), F.col("s_suppkey").cast("int").alias("id"), F.round(100 * F.col("s_acctbal")).cast("bigint").alias("ix"), ((7919 * F.col("s_suppkey")) % 100003 * 10).cast("bigint").alias("iy")))


def _points(df: DataFrame) -> DataFrame:
    return df.select("g", "id", F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), "ix", "iy")


def fixture_points(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("fix", i, float(x), float(y), x, y) for i, (x, y) in enumerate(FIXTURE)], POINTS)


def fixture(spark: SparkSession) -> Graph:
    return complete_graph(fixture_points(spark))


def embeddings_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return _held(nearest_graph(points_of_embeddings(spark, sf_dir)))


def suppliers_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return _held(nearest_graph(points_of_suppliers(spark, sf_dir)))


def _held(g: Graph) -> Graph:
    """The graph with its edges cut from the search that found them: they are read several times in each plan."""
    from .cut import cut

    return g.with_edges(cut(g.edges))
