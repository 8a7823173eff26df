"""Ranks within groups of any size, by one range sort over all groups together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markloom.llm._io import materialise


def ranked(df: DataFrame, group: str, order: list[str], tag: str, few_groups: bool = False) -> DataFrame:
    """``df`` with ``rank``: the 0-based place of a row in its group by the ``order`` columns.

    A large group is spread over many range partitions. Each partition's rows are numbered
    as they lie and shifted by the counts of the same group in the partitions before it.
    ``few_groups``: there are so few groups that the counts, a row for each partition and
    group that starts in it, may be broadcast.
    """
    ordered = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    at = F.monotonically_increasing_id()
    placed = materialise(ordered.select("*", F.shiftright(at, 33).cast("int").alias("_part"), at.alias("_at")), tag)
    runs = placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifted = runs.select(
        F.col(group).alias("_group"), F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    if few_groups:
        shifted = F.broadcast(shifted)
    met = placed.join(shifted, placed[group].eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p")))
    return met.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_group", "_p", "_first", "_before")
