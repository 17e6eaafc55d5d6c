"""Queries of problem 10: subject area of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.subjects import document_subjects
from tessera.runtime import materialise, read_table


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of each document, of those that subject_areas lists (a small fixed table), with scores."""
    areas = read_table(spark, sf_dir, "subject_areas").select("subject").distinct()
    return document_subjects(read_table(spark, sf_dir, "documents")).join(areas, "subject", "left_semi").select("doc_id", "subject", "score")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).select("doc_id", "subject")


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per subject its documents, their share of all documents, and its share of the assignments by equal parts."""
    found = materialise(p10_found(spark, sf_dir), "subjects")
    total = read_table(spark, sf_dir, "documents").agg(F.count("*").alias("n_all"))
    parts = found.groupBy("doc_id").agg(F.count("*").alias("n"))
    areas = read_table(spark, sf_dir, "subject_areas").select("subject").distinct()
    by = found.join(parts, "doc_id").groupBy("subject").agg(F.count("*").alias("n_documents"), F.sum(1 / F.col("n")).alias("parts"))
    return areas.join(by, "subject", "left").join(F.broadcast(total)).select(
        "subject",
        F.coalesce("n_documents", F.lit(0)).cast("long").alias("n_documents"),
        F.round(F.coalesce("n_documents", F.lit(0)) / F.greatest("n_all", F.lit(1)), 6).alias("share_of_documents"),
        F.round(F.coalesce("parts", F.lit(0.0)) / F.greatest("n_all", F.lit(1)), 6).alias("share_by_parts"),
    )


def p10_label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per subject the hand labels, how many of them the operator gives too, and its own count on labelled documents."""
    labels = read_table(spark, sf_dir, "doc_labels").select("doc_id", "subject").distinct()
    found = p10_found(spark, sf_dir).join(labels.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("found", F.lit(1))
    both = labels.withColumn("labelled", F.lit(1)).join(found, ["doc_id", "subject"], "full")
    return both.groupBy("subject").agg(F.count("labelled").alias("n_labels"), F.count("found").alias("n_found"), F.count(F.col("labelled") + F.col("found")).alias("n_both"))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_shares": p10_shares, "p10_label_agreement": p10_label_agreement}
