"""Cutting lineage in iterative plans, and the shared folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession, beside: str) -> str:
    """The shared folder; beside the warehouse where it is unset, which only a local master may do: on a cluster that can be one machine's disk."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return own or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + beside


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` in a reliable checkpoint, which survives lost executors; in spark.checkpoint.dir, or beside the warehouse where that is unset."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(_root(spark, "/_checkpoints"))
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one, for files that executors write and read."""
    return f"{_root(spark, '/_shared').rstrip('/')}/edgeproof/{name}-{uuid.uuid4().hex}"
