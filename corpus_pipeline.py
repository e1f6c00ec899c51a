"""The corpus pipeline: stages over documents, each calling one operator of edgeproof.llm.

Null texts are empty texts to every stage, null sources a source of their own, and an empty table stays empty. Further columns of documents
pass all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeproof.llm import fm_decontamination, quality_qda, simhash_neardup, source_mixing, suffix_rindex
from edgeproof.llm._arrow import written


#: Bytes of a passage that is removed where it starts again: fifty short words.
PASSAGE = 240


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant accepts (a posterior of good quality of 0.3 or more)."""
    return quality_qda.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash_neardup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of PASSAGE bytes that start again anywhere; n_chars follows."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    got = suffix_rindex.remove_matches(docs.select(F.struct(*rest).alias("row"), "text"), "row", "text", PASSAGE, kept=True)
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return got.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than one in twenty lies in a benchmark phrase."""
    return fm_decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: each document once for each time it is taken, with its pass and output shard."""
    return source_mixing.mix(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontaminated", decontaminated), ("mixed", mixed)]
#: No SQL can express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
