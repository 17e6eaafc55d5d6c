"""Rows that were delivered more than once, reduced to their first delivery without moving the rows themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import broadcast_if_small, materialise, stored


def with_row_identity(scan: DataFrame) -> DataFrame:
    """Add the identity of each row of a parquet scan (file and row number), to be kept through later steps."""
    return scan.withColumns({"_file": F.col("_metadata.file_path"), "_number": F.col("_metadata.row_index")})


def first_deliveries(rows: DataFrame, key: Column, order: str, source: str | None = None) -> DataFrame:
    """The rows of a parquet scan, once per non-null `key`: the smallest `order`, ties by file and row number.

    Only keys, `order` and row identities are shuffled; the keys delivered more than once are then joined back (as a
    broadcast where they are few), so wide columns never move. Rows without a key are dropped. Adds the column `key`.
    With `source`, the path of the scanned table, the repeated keys are stored until that table changes.
    """
    if "_file" not in rows.columns:
        rows = with_row_identity(rows)
    keyed = rows.withColumn("key", key).withColumn("_row", F.struct(F.col(order).alias("o"), F.col("_file").alias("f"), F.col("_number").alias("n"))).filter("key is not null")
    repeats = keyed.groupBy("key").agg(F.count("*").alias("_n"), F.min("_row").alias("_first")).filter("_n > 1").select("key", "_first")
    spark = rows.sparkSession
    repeated = stored(spark, "repeated", source, lambda: repeats) if source else materialise(repeats, "repeated")
    repeated = broadcast_if_small(repeated, 8 << 20)
    return keyed.join(repeated, "key", "left").filter(F.col("_first").isNull() | (F.col("_first") == F.col("_row"))).drop("_first", "_row", "_file", "_number")
