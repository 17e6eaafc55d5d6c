"""Queries of problem 7: deeply nested records to related flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.deliveries import first_deliveries
from tessera.operators.shred import shred_blocks, shred_leaves, split_plain
from tessera.runtime import key_of, read_table


def distinct_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that have content, once per uuid (a second delivery differs in `ingested_at` only)."""
    rows = first_deliveries(read_table(spark, sf_dir, "sample_session"), key_of("uuid"), "ingested_at")
    return rows.select(F.col("key").alias("uuid"), key_of("sessionId").alias("session_id"), "type", F.col("message.role").alias("role"), F.col("message.model").alias("model"), F.col("message.content").alias("content")).filter("content is not null")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred_blocks(distinct_messages(spark, sf_dir), "uuid", "content").withColumnRenamed("message_id", "uuid")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir).filter(F.col("type") == "tool_result")
    return b.select("uuid", "block_path", F.coalesce(key_of("tool_use_id"), F.lit("")).alias("tool_use_id"))


def p7_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root table: one row per message; plain text stays here."""
    m = distinct_messages(spark, sf_dir)
    m = m.select("uuid", "session_id", "type", "role", "model", F.length("content").alias("content_chars"), "content")
    return split_plain(m)


def p7_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks; the parent is the block at parent_path of the same message, or the message itself."""
    return blocks(spark, sf_dir).select("uuid", "block_path", "parent_path", "nesting", "type", "text", "thinking", F.col("extra")["signature"].alias("signature"), F.size("extra").alias("n_extra"))


def p7_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf of every block in long form, with the levels that the tables are rebuilt from."""
    return shred_leaves(distinct_messages(spark, sf_dir), "uuid", "content").withColumnRenamed("message_id", "uuid")


def p7_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaf paths that the data hold, with the number of their values and of nulls among them."""
    return p7_leaves(spark, sf_dir).groupBy("leaf_path").agg(F.count("*").alias("n_values"), F.sum(F.col("value").isNull().cast("long")).alias("n_nulls"))


def p7_tool_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).filter(F.col("type") == "tool_use").select("uuid", "block_path", "parent_path", key_of("id").alias("tool_use_id"), "name", F.col("input").alias("input_json"))


def p7_tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).filter(F.col("type") == "tool_result").select("uuid", "block_path", "parent_path", key_of("tool_use_id").alias("tool_use_id"), F.col("content").alias("payload"), (F.col("is_error") == "true").alias("is_error"))


QUERIES = {"p7_found": p7_found, "p7_messages": p7_messages, "p7_blocks": p7_blocks, "p7_leaves": p7_leaves, "p7_fields": p7_fields, "p7_tool_uses": p7_tool_uses, "p7_tool_results": p7_tool_results}

BLOCKS_SQL = r"""m AS (
  SELECT lower(trim(uuid, E' \t\n\r')) AS uuid, min(message.content) AS content FROM sample_session
  WHERE uuid IS NOT NULL AND message.content IS NOT NULL GROUP BY 1),
j0 AS (SELECT uuid, CASE WHEN json_valid(content) AND regexp_matches(content, '^\s*[\[{"]') THEN content::JSON END AS j FROM m),
j1 AS (SELECT uuid, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN (j->>'$')::JSON END ELSE j END AS j FROM j0),
j2 AS (SELECT uuid, CASE json_type(j) WHEN 'ARRAY' THEN j WHEN 'OBJECT' THEN json_array(j) END AS j FROM j1),
b(uuid, block_path, parent_path, block) AS (
  SELECT uuid, CAST(i AS VARCHAR), CAST(NULL AS VARCHAR), j->i FROM j2, unnest(range(CAST(json_array_length(j) AS BIGINT))) t(i) WHERE j IS NOT NULL
  UNION ALL
  SELECT uuid, block_path || '.' || i, block_path, block->'content'->i FROM b, unnest(range(CASE WHEN json_type(block, '$.content') = 'ARRAY' THEN CAST(json_array_length(block, '$.content') AS BIGINT) ELSE 0 END)) t(i)),
blocks AS (SELECT * FROM b WHERE json_type(block) = 'OBJECT')
"""
_KEY = r"nullif(lower(trim({}, E' \t\n\r')), '')"
_TEXT = "CASE WHEN json_type(block, '$.{0}') IN ('NULL') THEN NULL ELSE block->>'$.{0}' END"
ORACLES = {
    "p7_found": f"WITH RECURSIVE {BLOCKS_SQL} SELECT uuid, block_path, lower(trim(coalesce(block->>'$.tool_use_id', ''), E' \\t\\n\\r')) AS tool_use_id FROM blocks WHERE block->>'$.type' = 'tool_result'",
    "p7_messages": f"""WITH RECURSIVE {BLOCKS_SQL},
one AS (SELECT lower(trim(uuid, E' \\t\\n\\r')) AS uuid, min(lower(trim(sessionId, E' \\t\\n\\r'))) AS session_id, min(type) AS type, min(message.role) AS role, min(message.model) AS model FROM sample_session WHERE uuid IS NOT NULL AND message.content IS NOT NULL GROUP BY 1),
n AS (SELECT uuid, CAST(count(*) AS INTEGER) AS n_blocks FROM blocks WHERE parent_path IS NULL GROUP BY uuid)
SELECT one.*, CAST(length(m.content) AS INTEGER) AS content_chars, CASE WHEN n.uuid IS NULL AND json_array_length(j2.j) IS DISTINCT FROM 0 THEN m.content END AS plain_text, coalesce(n.n_blocks, 0) AS n_blocks
FROM one JOIN m ON m.uuid = one.uuid LEFT JOIN n ON n.uuid = one.uuid LEFT JOIN j2 ON j2.uuid = one.uuid""",
    "p7_tool_uses": f"WITH RECURSIVE {BLOCKS_SQL} SELECT uuid, block_path, parent_path, {_KEY.format(_TEXT.format('id'))} AS tool_use_id, block->>'$.name' AS name, CASE json_type(block, '$.input') WHEN 'VARCHAR' THEN block->>'$.input' WHEN 'NULL' THEN NULL ELSE CAST(block->'input' AS VARCHAR) END AS input_json FROM blocks WHERE block->>'$.type' = 'tool_use'",
    "p7_tool_results": f"WITH RECURSIVE {BLOCKS_SQL} SELECT uuid, block_path, parent_path, {_KEY.format(_TEXT.format('tool_use_id'))} AS tool_use_id, CASE json_type(block, '$.content') WHEN 'VARCHAR' THEN block->>'$.content' WHEN 'NULL' THEN NULL WHEN 'ARRAY' THEN NULL ELSE CAST(block->'content' AS VARCHAR) END AS payload, block->>'$.is_error' = 'true' AS is_error FROM blocks WHERE block->>'$.type' = 'tool_result'",
    "p7_fields": f"""WITH RECURSIVE {BLOCKS_SQL},
names AS (SELECT repeat('content.', len(block_path) - len(replace(block_path, '.', ''))) || k AS leaf_path, json_type(block, '$.' || k) AS kind FROM blocks, unnest(json_keys(block)) t(k))
SELECT leaf_path, count(*) AS n_values, CAST(sum(CASE WHEN kind = 'NULL' THEN 1 ELSE 0 END) AS BIGINT) AS n_nulls FROM names WHERE NOT (kind = 'ARRAY' AND leaf_path LIKE '%content') GROUP BY leaf_path""",
    "p7_blocks": f"""WITH RECURSIVE {BLOCKS_SQL} SELECT uuid, block_path, parent_path, CAST(len(block_path) - len(replace(block_path, '.', '')) AS INTEGER) AS nesting, block->>'$.type' AS type, block->>'$.text' AS text, block->>'$.thinking' AS thinking,
  block->>'$.signature' AS signature, CAST(len(list_filter(json_keys(block), lambda k: k NOT IN ('type', 'text', 'thinking', 'id', 'name', 'input', 'tool_use_id', 'content', 'is_error'))) AS INTEGER) AS n_extra FROM blocks""",
}
