"""Queries of problem 9: evaluation texts leaking into training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.leakage import SAME, leaked_passages
from tessera.runtime import read_table


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the items that leaked into it, in order or not, and how much of each."""
    return leaked_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks of which a window of successive words is nearly equal in place."""
    return p9_leaks(spark, sf_dir).filter(F.col("best_window") >= SAME).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item the number of documents that hold it and the largest share covered."""
    return p9_leaks(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.round(F.max("covered"), 6).alias("most_covered"))


QUERIES = {"p9_found": p9_found, "p9_leaks": p9_leaks, "p9_items": p9_items}
