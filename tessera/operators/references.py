"""References to records that do not exist.

Method: child references and parent rows are brought into one long form (parent table, key, tag), grouped by parent
table and key with partial aggregation, and the groups kept that lack a parent row (or got their first one too late).
Only these keys go back to the references, so a hot key never gathers its rows in one task: the grouping carries
three numbers per key, and the join back is one that adaptive execution can split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dangling_references(references: list[DataFrame], parents: list[DataFrame], removed: DataFrame) -> DataFrame:
    """Orphan and early references.

    references: frames of `table_name, column_name, row_key, parent_table, ref_key, ref_time`; parents: frames of
    `parent_table, ref_key, row_time`; removed: `parent_table, ref_key`. Null or blank keys must be null; they are no
    references. Result: the references with `status`: deleted (no row, in `removed`), missing (no row), late (the
    earliest row is younger than the reference), and `period`, the month of the reference (null without a time).
    Repeated rows of one reference count once (the earliest). References without a time are never late. Empty inputs
    give an empty result.
    """
    refs = reduce(DataFrame.unionByName, references).filter("ref_key is not null")
    refs = refs.groupBy("table_name", "column_name", "row_key", "parent_table", "ref_key").agg(F.min("ref_time").alias("ref_time"))
    rows = reduce(DataFrame.unionByName, parents).filter("ref_key is not null")
    none = F.lit(None).cast("timestamp")
    long = (
        refs.select("parent_table", "ref_key", F.lit("child").alias("tag"), F.col("ref_time").alias("ref_time"), none.alias("row_time"))
        .unionByName(rows.select("parent_table", "ref_key", F.lit("parent").alias("tag"), none.alias("ref_time"), "row_time"))
        .unionByName(removed.filter("ref_key is not null").select("parent_table", "ref_key", F.lit("removed").alias("tag"), none.alias("ref_time"), none.alias("row_time")))
    )
    keys = (
        long.groupBy("parent_table", "ref_key")
        .agg(
            F.max(F.col("tag") == "child").alias("asked"),
            F.max(F.col("tag") == "parent").alias("there"),
            F.max(F.col("tag") == "removed").alias("was_removed"),
            F.min("row_time").alias("first_row"),
            F.min("ref_time").alias("first_ref"),
        )
        .filter("asked")
    )
    suspects = keys.filter("not there or first_row > first_ref").select("parent_table", "ref_key", "there", "was_removed", "first_row")
    out = refs.join(suspects, ["parent_table", "ref_key"])
    status = F.when(~F.col("there") & F.col("was_removed"), "deleted").when(~F.col("there"), "missing").when(F.col("first_row") > F.col("ref_time"), "late")
    return out.withColumn("status", status).filter("status is not null").select("table_name", "column_name", "row_key", "ref_key", "status", F.date_format("ref_time", "yyyy-MM").alias("period"))
