"""Queries of problem 2: splitting oversized items at natural boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.splitting import LIMIT_TOKENS, OVERLAP_TOKENS, max_chars, split_oversized
from tessera.operators.deliveries import first_deliveries
from tessera.runtime import key_of, materialise, read_table


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_deliveries(read_table(spark, sf_dir, "chunks"), key_of("id"), "created_at")
    return split_oversized(rows.select(F.col("key").alias("chunk_id"), "content", "turn_indices"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that had to be split: those with a second piece."""
    return p2_pieces(spark, sf_dir).filter("piece = 1").select("chunk_id")


def p2_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the cuts were made: pieces and their size by kind of boundary."""
    p = p2_pieces(spark, sf_dir)
    return p.groupBy("boundary").agg(F.count("*").alias("n_pieces"), F.max("n_tokens").alias("most_tokens"), F.round(F.avg("n_tokens"), 2).alias("mean_tokens"))


def p2_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk put together again from its pieces without their overlaps, as a digest, and whether any piece is too
    long or repeats other than the last 64 tokens of the piece before."""
    p = materialise(p2_pieces(spark, sf_dir).filter("content is not null"), "pieces")
    w = Window.partitionBy("chunk_id").orderBy("piece")
    again = max_chars(OVERLAP_TOKENS)
    tail = F.lag(F.right("content", F.lit(again))).over(w)
    p = p.withColumn("wrong", (F.col("piece") > 0) & ((F.col("overlap_chars") != again) | (F.left("content", F.lit(again)) != tail)) | (F.col("n_tokens") > LIMIT_TOKENS))
    parts = F.sort_array(F.collect_list(F.struct("piece", F.expr("substring(content, overlap_chars + 1)").alias("text"))))
    return p.groupBy("chunk_id").agg(F.md5(F.array_join(F.transform(parts, lambda x: x["text"]), "")).alias("content_md5"), F.max("wrong").alias("wrong"))


QUERIES = {"p2_found": p2_found, "p2_rebuilt": p2_rebuilt, "p2_pieces": p2_pieces, "p2_boundaries": p2_boundaries}
ORACLES = {"p2_rebuilt": r"SELECT lower(trim(id, E' \t\n\r')) AS chunk_id, md5(min(content)) AS content_md5, false AS wrong FROM chunks WHERE content IS NOT NULL GROUP BY 1", "p2_found": r"SELECT DISTINCT lower(trim(id, E' \t\n\r')) AS chunk_id FROM chunks WHERE ceil(length(content) / 3.5) > 1024"}
