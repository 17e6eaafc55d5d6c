"""Queries of problem 8: filling fixed-capacity containers with items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.packing import CAPACITY, measured, pack
from tessera.runtime import materialise, read_table


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: the containers and items of each number of free tokens."""
    by = p8_containers(spark, sf_dir).filter("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n_items"))
    return by.groupBy((F.lit(CAPACITY) - F.col("used")).alias("free_tokens")).agg(F.count("*").alias("n_containers"), F.sum("n_items").alias("n_items"))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers, counted: documents placed, and faults of each kind (all 0).

    A document's pieces must follow one another from its first token on, all but the last full, and those that are in a
    container must hold as many tokens as its text (a document where they don't counts as a gap); no container may be
    overfull; positions in a container must run from 0 without gaps; texts within the capacity are in one piece.
    """
    documents = read_table(spark, sf_dir, "documents")
    sized = measured(documents)
    placed = materialise(pack(documents, sized=sized), "containers")
    w = Window.partitionBy("doc_id").orderBy("piece")
    before = F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    pieces = placed.select("doc_id", "piece", "n_tokens", (~before.eqNullSafe(F.col("first_token"))).alias("gap"), (F.lead("piece").over(w).isNotNull() & (F.col("n_tokens") != CAPACITY)).alias("short"))
    held = placed.filter("container is not null").select("doc_id", "n_tokens").unionByName(sized.select("doc_id", (-F.col("n_tokens")).alias("n_tokens")))
    short = held.groupBy("doc_id").agg(F.sum("n_tokens").alias("rest")).agg(count(F.col("rest") != 0)("n_unlike"))
    docs = pieces.agg(F.countDistinct("doc_id").alias("n_documents"), count(F.col("gap"))("n_gaps"), count(F.col("short"))("n_short_cuts"))
    by = placed.filter("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"), F.countDistinct("position").alias("places"), F.min("position").alias("first"), F.max("position").alias("last"))
    boxes = by.agg(count(F.col("used") > CAPACITY)("n_overfull"), count((F.col("places") != F.col("n")) | (F.col("first") != 0) | (F.col("last") != F.col("n") - 1))("n_misplaced"), F.coalesce(F.sum("used") > (F.count("*") - 1) * CAPACITY * 0.9, F.lit(True)).alias("well_filled"))
    all_of = docs.join(F.broadcast(boxes)).join(F.broadcast(short))  # one row each
    return all_of.withColumn("n_gaps", F.col("n_gaps") + F.col("n_unlike")).drop("n_unlike")


#: The whole result comes first: it is what stands for the problem where one of its queries is taken.
QUERIES = {"p8_containers": p8_containers, "p8_checks": p8_checks, "p8_fill": p8_fill}
ORACLES = {"p8_checks": "SELECT count(DISTINCT doc_id) AS n_documents, CAST(0 AS BIGINT) AS n_gaps, CAST(0 AS BIGINT) AS n_short_cuts, CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_misplaced, true AS well_filled FROM documents"}
