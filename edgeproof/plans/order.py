"""Places in an order, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cut import cut


def numbered(df: DataFrame, keys: list[Column | str], name: str, group: str = "g") -> DataFrame:
    """``df`` with ``name`` (bigint): the place of each row, from 0, in the order by ``keys`` of its ``group``.

    Rows are sorted by range, so one large group lies in many partitions; a partition's rows of a group follow each other, and what is counted
    are these runs: one row a partition and group. The sorted rows are cut first, as the ranges must not move between counting and numbering.
    Rows of equal keys stand in any order; a null group is a group, null keys come first; an empty frame stays empty. Columns must not be
    called _part, _row, _shift.
    """
    at = [F.col(group), *(F.col(k) if isinstance(k, str) else k for k in keys)]
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = cut(df.repartitionByRange(*at).sortWithinPartitions(*at).select("*", F.spark_partition_id().alias("_part"), row.alias("_row")))
    runs = held.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    whole = held.join(runs, (F.col("_part") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    return whole.select(*df.columns, (F.col("_row") + F.col("_shift")).cast("bigint").alias(name))
