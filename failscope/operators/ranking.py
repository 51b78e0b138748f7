"""Row numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from failscope.session import materialize


def with_rank(df: DataFrame, group: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """Add the 0-based position of each row inside its group, in ``order``.

    The table is range-sorted by (group, order), so a large group spans many
    partitions. A row's position is its offset in the partition plus the rows of the
    same group in earlier partitions; those totals are one small row per (group,
    partition). The sorted table is written first, which fixes the partitions.
    """
    ordered = materialize(
        df.orderBy(*group, *order).withColumn("_pos", F.monotonically_increasing_id()), "ranked")
    ordered = ordered.withColumn("_part", F.shiftright("_pos", 33))
    parts = ordered.groupBy(*group, "_part").agg(
        F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    w = Window.partitionBy(*group).orderBy("_part")
    parts = materialize(
        parts.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).drop("_n"), "rank-parts")
    return ordered.join(parts, [*group, "_part"]).withColumn(
        out, F.col("_before") + F.col("_pos") - F.col("_first")
    ).drop("_pos", "_part", "_before", "_first")
