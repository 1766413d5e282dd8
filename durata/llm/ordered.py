"""Exact places of rows in a sorted order, without a window over a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from durata.llm.shared import written

_PART = 33  # monotonically_increasing_id holds the partition above this bit


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``at``, a row's place (from 0) among the rows of its
    ``group`` in ascending ``order``, and ``n``, the rows of that group.

    The rows are range-partitioned by group and order, so a hot group spreads
    over tasks; rows equal in all of these columns are told apart by where
    they were read and spread too.  A row's place in its sorted partition,
    fixed by writing it, and the counts per group and partition give ``at``.
    Null counts as a value of its own and comes first.
    """
    keys = [*group, *order]
    sorted_rows = (df.withColumn("__read", F.monotonically_increasing_id())
                   .repartitionByRange(*keys, "__read").sortWithinPartitions(*keys, "__read").drop("__read"))
    rows = written(sorted_rows.withColumn("__place", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("__part", F.shiftright("__place", _PART))
    # one row for each group and partition that meet: partitions plus groups at most
    met = rows.groupBy(*group, "__part").agg(F.min("__place").alias("first"), F.count(F.lit(1)).alias("rows"))
    upto = Window.partitionBy(*group).orderBy("__part")
    met = met.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__part").alias("__p"),
                     (F.sum("rows").over(upto) - F.col("rows") - F.col("first")).alias("__shift"),
                     F.sum("rows").over(Window.partitionBy(*group)).alias("n"))
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return rows.join(met, same).select(*df.columns, (F.col("__place") + F.col("__shift")).alias("at"), "n")
