"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Documents of a source fall into blocks of 128, or the root of their number if that is more, by a hash. A source's target words
are met by whole passes over its permuted blocks, then by the first blocks of one more pass, the last of them in part. The exact number of
blocks to draw is the source's quota. The tree hands the vector of quotas down: each node splits its own between the halves of
its output shards by a multivariate hypergeometric draw with a fixed total, so each shard gets exact counts by source. Shards
take disjoint ranges of a source's permuted draws, and shuffle the documents locally by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._arrow import chunks, text_buffer, word_bounds, written

#: Weights of the sources in code point order, repeating; the mix's words as a share of all; most times a source may be taken.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 7
#: An output shard holds about so many documents.
SHARD_ROWS = 1 << 14
#: A shard is written in so many pieces, by hash, so that tasks are even however shards are dealt out.
PIECES = 64
#: A block holds about so many documents at least.
BLOCK = 128


def _key(source: Column) -> Column:
    """A join key without nulls."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size (words of the whole text; null: 0) and h (a hash of id and text, by which documents are permuted) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole):
                first = word_bounds(*text_buffer(b.column("text")))[2]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("source"), pa.array(np.diff(first)), b.column("h")], names=["id", "source", "size", "h"])

    kind = lambda c: docs.schema[c].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(F.lit(SEED), F.xxhash64(F.col(id_col), F.col(text_col))).alias("h"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {kind(id_col)}, source {kind(source_col)}, size long, h long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """src (key), source_size, docs, blocks and target of each source, one row a source.

    Targets share ``share`` of all words by weight; where one is above ``most`` times its source, it stops there, and the excess is shared
    anew by weight among the others, until none is above. So sources below a common level of words a weight are full, the others at it.
    """
    one = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    one = one.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    one = one.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", "rank")
    full = F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    all_ = Window.partitionBy()
    one = one.withColumn("level", (share * F.sum("source_size").over(all_) - full) / left)
    free = F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))
    level = F.min(free).over(all_)["level"]
    return one.select(
        _key(F.col("source")).alias("src"), "rank", "source_size", "docs",
        F.ceil(F.col("docs") / F.greatest(F.lit(float(BLOCK)), F.sqrt("docs"))).cast("long").alias("blocks"),
        F.round(F.coalesce(F.least(F.col("cap"), F.col("weight") * level), F.col("cap")), 6).alias("target"),
    )


def _split(pdf: pd.DataFrame) -> pd.DataFrame:
    """A node (low, span, and the quota of each source) split between its halves; a leaf as it is."""
    pdf = pdf.sort_values("rank")
    low, span = int(pdf["low"].iloc[0]), int(pdf["span"].iloc[0])
    if span == 1:
        return pdf
    half, quota = span // 2, pdf["quota"].to_numpy()
    rng = np.random.default_rng([SEED, low, span])
    rest, take, own = int(quota.sum()), int(quota.sum()) * half // span, np.zeros(len(quota), np.int64)
    for i, q in enumerate(quota.tolist()):  # the margins of the multivariate draw, one after the other
        rest -= q
        own[i] = rng.hypergeometric(q, rest, take) if q and take and rest else min(q, take)
        take -= int(own[i])
    return pd.concat([pdf.assign(span=half, quota=own), pdf.assign(low=low + half, span=span - half, quota=quota - own)])


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the block at the border, the documents that still fit in the order of h, the shortest quarter last, and one more if that comes nearer."""
    left, some, over = float(pdf["left"].iloc[0]), [], []
    short = pdf["size"].quantile(0.25)
    for h, size in sorted(zip(pdf["h"].tolist(), pdf["size"].tolist(), strict=True), key=lambda x: (x[1] <= short, -x[1] if x[1] <= short else 0, x[0])):
        if 0 < size <= left:
            left -= size
            some.append(h)
        elif size > 0:
            over.append((size, h))
    if over and min(over)[0] - left < left:
        some.append(min(over)[1])
    return pd.DataFrame({"src": [pdf["src"].iloc[0]], "block": [pdf["block"].iloc[0]], "some": [some]})


def tree(quotas: DataFrame, shards: int) -> DataFrame:
    """src, shard, quota: the quotas (src, rank, quota) split among the output shards, level by level; each shard's total is a floor or ceiling of its part."""
    nodes, span = quotas.select("src", "rank", "quota", F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("span")), shards
    while span > 1:
        nodes = nodes.groupBy("low").applyInPandas(_split, nodes.schema)
        span -= span // 2
    return nodes.select("src", F.col("low").alias("shard"), "quota")


def draws(sized: DataFrame, plan: DataFrame, shards: int) -> DataFrame:
    """src, block, full (whole draws of the block), some (h of the documents of a draw in part; null if none), takes (array of pass, shard, some)."""
    docs = sized.select(_key(F.col("source")).alias("src"), "size", "h").join(plan.select("src", "blocks"), "src")
    docs = docs.select("src", F.pmod("h", "blocks").alias("block"), "size", "h")
    sums = docs.groupBy("src", "block").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("src").orderBy(F.xxhash64("src", "block", F.lit(SEED)), "block")
    sums = sums.withColumn("seq", F.row_number().over(order).cast("long") - 1).withColumn("after", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    own = plan.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    sums = sums.join(own.select("src", "rank", "passes", "rest"), "src")
    before = F.col("after") - F.col("words")
    sums = sums.withColumn("last", F.when(F.col("after") <= F.col("rest"), "whole").when(before < F.col("rest"), "part"))
    part = sums.where("last = 'part'").select("src", "block", (F.col("rest") - before).alias("left"))
    inner = docs.join(part, ["src", "block"]).groupBy("src", "block", "h", "left").agg(F.sum("size").alias("size"))
    some = inner.groupBy("src", "block").applyInPandas(_fill, "src string, block long, some array<long>")
    sums = sums.join(some, ["src", "block"], "left")
    drawn = F.col("last").eqNullSafe("whole") | F.col("some").isNotNull()
    count = sums.groupBy("src", "rank", "passes").agg(F.count("*").alias("n"), F.sum(drawn.cast("long")).alias("more"))
    quotas = count.select("src", "rank", (F.col("passes") * F.col("n") + F.col("more")).alias("quota"))
    ranges = tree(quotas, shards).where("quota > 0").withColumn("end", F.sum("quota").over(Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)))
    places = ranges.select("src", "shard", F.explode(F.sequence(F.col("end") - F.col("quota"), F.col("end") - 1)).alias("place"))
    each = sums.join(count.select("src", "n"), "src").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    each = each.where((F.col("pass") < F.col("passes")) | drawn)
    each = each.select("src", "block", "pass", F.when(F.col("pass") == F.col("passes"), F.col("some")).alias("some"), (F.col("pass") * F.col("n") + F.col("seq")).alias("place"))
    each = each.join(places, ["src", "place"])
    return each.groupBy("src", "block").agg(
        F.sum(F.col("some").isNull().cast("long")).alias("full"), F.max("some").alias("some"),
        F.sort_array(F.collect_list(F.struct("pass", "shard", "some"))).alias("takes"),
    )


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, most: float, shards: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    sized = written(sizes(docs, id_col, text_col, source_col), "sizes")
    plan = written(targets(sized, weights, share, most), "targets")
    shards = shards or max(8, -(-(plan.agg(F.sum("docs")).first()[0] or 0) // SHARD_ROWS))
    return sized, plan, written(draws(sized, plan, shards), "draws")


def quotas_taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, shards: int | None = None) -> DataFrame:
    """id_col, size, source_size, target (of the row's source) and taken (words the mix takes of it, repeats counted) of each row.

    A null source is a source of its own, last in order; null and empty texts have size 0; rows equal in id and text are taken
    alike; a table without words has targets 0. Text never moves: only ids, hashes and sizes are joined, by source and block.
    """
    sized, plan, drawn = _planned(docs, id_col, text_col, source_col, weights, share, most, shards)
    rows = sized.withColumn("src", _key(F.col("source"))).join(plan.select("src", "source_size", "target", "blocks"), "src").withColumn("block", F.pmod("h", "blocks"))
    rows = rows.join(drawn.select("src", "block", "full", "some"), ["src", "block"], "left")
    times = F.coalesce("full", F.lit(0)) + F.coalesce(F.array_contains("some", F.col("h")).cast("long"), F.lit(0))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, shards: int | None = None) -> DataFrame:
    """The mix itself: the columns of ``docs``, once for each time a row is taken, with mix_pass and mix_shard; shards are shuffled locally by a hash, each in PIECES pieces.

    The rules are those of ``quotas_taken``. Columns of ``docs`` with the added names are replaced. Text is shuffled once, to its shard.
    """
    names = [c for c in docs.columns if c not in ("mix_pass", "mix_shard")]
    _, plan, drawn = _planned(docs, id_col, text_col, source_col, weights, share, most, shards)
    own = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names))).alias("row")
    rows = docs.select(own, F.xxhash64(F.lit(SEED), F.xxhash64(F.col(id_col), F.col(text_col))).alias("h"), _key(F.col(source_col)).alias("src"))
    rows = rows.join(plan.select("src", "blocks"), "src").withColumn("block", F.pmod("h", "blocks"))
    rows = rows.join(drawn.select("src", "block", "takes"), ["src", "block"]).select("row", "h", F.explode("takes").alias("take"))
    rows = rows.where(F.col("take.some").isNull() | F.array_contains("take.some", F.col("h")))
    rows = rows.withColumn("draw", F.xxhash64("h", "take.pass")).withColumn("piece", F.pmod("draw", F.lit(PIECES)))
    rows = rows.repartition("take.shard", "piece").sortWithinPartitions("take.shard", "piece", "draw")
    return rows.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)), F.col("take.pass").alias("mix_pass"), F.col("take.shard").alias("mix_shard"))


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return quotas_taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))
