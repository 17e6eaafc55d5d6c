"""Ranks and running sums over large groups, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import materialise


def _placed(items: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    keys = [*group, *order]
    rows = items.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialise(rows.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}), "ranked")


def rank_within(items: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Add the zero-based rank of each row within `group` by `order`.

    Rows are range-partitioned by (group, order) and written once with their number in the partition; what each
    partition holds of each group is counted and summed up into offsets. Ties get distinct ranks; null keys form a group
    of their own. An empty group list ranks the whole table.
    """
    group = group or ["_all"]
    rows = items.withColumn("_all", F.lit(0)) if group == ["_all"] else items
    placed = _placed(rows, group, order)
    counts = placed.groupBy(*group, "_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    w = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.withColumn("_before", F.sum("_n").over(w) - F.col("_n"))
    offsets = offsets.select(F.col("_p").alias("_op"), "_first", "_before", *[F.col(g).alias(f"_o{i}") for i, g in enumerate(group)])
    on = F.col("_p") == F.col("_op")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_o{i}"))
    joined = placed.join(offsets, on).drop("_op", *[f"_o{i}" for i in range(len(group))])
    return joined.withColumn(name, F.col("_i") - F.col("_first") + F.col("_before")).drop("_p", "_i", "_first", "_before", "_all")


def running_sum(items: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of `value` over all rows before each row in `order` (ties in any order), over the whole table."""
    placed = _placed(items, [], order)
    parts = placed.groupBy("_p").agg(F.sum(value).alias("_s"))  # one row a partition
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = parts.select("_p", (F.sum("_s").over(w) - F.col("_s")).alias("_before"))
    inner = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = placed.withColumn("_own", F.sum(value).over(inner) - F.col(value))
    return own.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_own") + F.col("_before")).drop("_p", "_i", "_own", "_before")
