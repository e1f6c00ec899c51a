"""One-row reports and the guard of output paths."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checked_output(root: str, path: str) -> Path:
    """A path inside ``root``, links followed; anything else is refused."""
    base, out = Path(root).resolve(), (Path(root) / path).resolve()
    if base != out and base not in out.parents:
        raise ValueError(f"{path} is outside {root}")
    return out


def manifest(spark: SparkSession, facts: dict, path: str) -> None:
    """A run's facts as one JSON row."""
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def stage_rollup(spark: SparkSession, stages: list[dict]) -> DataFrame:
    """(kind, stages, committed, attempted, proven) of a local elimination."""
    rows = [(s["kind"], s.get("committed", 0), s.get("attempted", 0), s.get("proven", 0)) for s in stages]
    return spark.createDataFrame(rows, "kind string, committed bigint, attempted bigint, proven bigint").groupBy("kind").agg({"*": "count", "committed": "sum", "attempted": "sum", "proven": "sum"})


def scan_report(outcomes: DataFrame, path: str) -> None:
    """Per-target outcomes of a scan as Parquet; a report, never part of a proof."""
    outcomes.write.parquet(path)
