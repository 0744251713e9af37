"""Exact ranks over a whole table, or over groups of any size, without one task per group.

The rows are range-partitioned and sorted, numbered where they lie, and every
partition's rows of a group are counted; the counts before a partition are the
offset its row numbers start from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def with_rank(df: DataFrame, order: Sequence[Column], group: Sequence[str] = (), name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``df`` with the position (1, 2, ...) of each row in its group under ``order``.

    ``order`` should be total, else equal rows take positions in any order. The
    rows are read twice (range bounds are sampled first), so pass a stored or
    cheap frame. Null group keys form a group of their own.
    """
    keys = [*(F.col(g).asc_nulls_first() for g in group), *order]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    placed = materialize(ranged, "ranked").withColumn("_part", F.shiftright("_place", 33))
    # at most one row a partition and group start: partitions + groups
    parts = placed.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    parts = parts.withColumnRenamed("_part", "_part_of")
    same = F.col("_part") == F.col("_part_of")
    for i, g in enumerate(group):
        same &= placed[g].eqNullSafe(F.col(f"_g{i}"))
    rank = F.col("_before") + F.col("_place") - F.col("_first") + 1
    return placed.join(parts, same).select(*df.columns, rank.cast("long").alias(name))
