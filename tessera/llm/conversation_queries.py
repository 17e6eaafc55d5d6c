"""Queries of problem 3: rebuilding conversations from message rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.conversations import conversation_lines, judge_sessions, message_texts, ordered_conversations, placed_lines
from tessera.operators.deliveries import first_deliveries
from tessera.plans.nested import BLOCKS_SQL
from tessera.runtime import key_of, materialise, read_table


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_deliveries(read_table(spark, sf_dir, "sample_session"), key_of("uuid"), "ingested_at")
    return rows.select("key", key_of("parentUuid").alias("parent"), key_of("sessionId").alias("session"), "type", "isSidechain", "timestamp", F.col("message.role").alias("role"), F.col("message.content").alias("content"))


def p3_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session with its counts and, if it is to be dropped, the reason."""
    return judge_sessions(conversation_lines(_rows(spark, sf_dir)), repeated=False)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_sessions(spark, sf_dir).filter("reason is not null").select(F.col("session").alias("session_id"), "reason")


def p3_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound conversations in order, with a clean role and the text of each line."""
    rows = _rows(spark, sf_dir)
    lines = materialise(conversation_lines(rows), "lines")
    placed = placed_lines(lines)
    sound = materialise(judge_sessions(lines, placed=placed, repeated=False).filter("reason is null").select("session"), "sound")
    order = ordered_conversations(lines, sound, placed=placed)
    texts = message_texts(rows.filter("content is not null").select(F.col("key").alias("uuid"), "content"))
    return order.join(texts, order.key == texts.uuid, "left").select(
        F.col("session").alias("session_id"), "position", F.col("key").alias("uuid"), F.col("speaker").alias("role"), F.timestamp_micros("micros").alias("at"), "same_speaker", "text"
    )


def p3_alternation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session its main lines, those whose speaker is that of the line before, and the share of lines that alternate."""
    j = judge_sessions(conversation_lines(_rows(spark, sf_dir))).filter("n_lines > 0")
    return j.select(F.col("session").alias("session_id"), "n_lines", "n_repeated", F.round(1 - F.col("n_repeated") / F.col("n_lines"), 6).alias("share_alternating"), "reason")


QUERIES = {"p3_alternation": p3_alternation, "p3_found": p3_found, "p3_sessions": p3_sessions, "p3_conversations": p3_conversations}

_TRIM = "nullif(lower(trim({}, E' \\t\\n\\r')), '')"
_SQL = f"""{BLOCKS_SQL},
lines AS (
  SELECT {_TRIM.format('uuid')} AS uuid, min({_TRIM.format('parentUuid')}) AS parent, min({_TRIM.format('sessionId')}) AS session, min(type) AS type, bool_or(coalesce(isSidechain, false)) AS side
  FROM sample_session WHERE uuid IS NOT NULL GROUP BY 1),
top AS (
  SELECT uuid, bool_or(block->>'$.type' = 'text' AND json_type(block, '$.text') = 'VARCHAR' AND trim(block->>'$.text', E' \\t\\n\\r') <> '') AS has_text,
    bool_or(block->>'$.type' = 'tool_result') AS has_result, bool_or(block->>'$.type' = 'tool_use') AS has_use
  FROM blocks WHERE parent_path IS NULL GROUP BY uuid),
f AS (
  SELECT l.*, l.type IN ('user', 'assistant') AND NOT l.side AS main,
    CASE WHEN t.uuid IS NULL AND json_array_length(j2.j) IS DISTINCT FROM 0 THEN coalesce(trim(m.content, E' \\t\\n\\r') <> '', false) ELSE coalesce(t.has_text, false) END AS has_text,
    coalesce(t.has_result, false) AS has_result, coalesce(t.has_use, false) AS has_use
  FROM lines l LEFT JOIN top t ON l.uuid = t.uuid LEFT JOIN m ON l.uuid = m.uuid LEFT JOIN j2 ON l.uuid = j2.uuid),
g AS (SELECT *, main AND type = 'user' AND has_text AND NOT has_result AS prompt, main AND type = 'assistant' AND (has_text OR has_use) AS reply FROM f),
fine(uuid) AS (
  SELECT uuid FROM g WHERE parent IS NULL
  UNION ALL SELECT g.uuid FROM g JOIN fine ON g.parent = fine.uuid),
down(prompt, uuid, session) AS (
  SELECT uuid, uuid, session FROM g WHERE prompt
  UNION ALL SELECT d.prompt, g.uuid, g.session FROM down d JOIN g ON g.parent = d.uuid AND g.session = d.session AND NOT g.side AND NOT g.prompt),
answered AS (SELECT DISTINCT d.prompt FROM down d JOIN g ON d.uuid = g.uuid WHERE g.reply),
s AS (
  SELECT session, sum(CASE WHEN main THEN 1 ELSE 0 END) AS n_lines, sum(CASE WHEN prompt THEN 1 ELSE 0 END) AS n_prompts, sum(CASE WHEN reply THEN 1 ELSE 0 END) AS n_replies,
    bool_or(main AND uuid NOT IN (SELECT uuid FROM fine)) AS broken, bool_or(prompt AND uuid NOT IN (SELECT prompt FROM answered)) AS silent
  FROM g WHERE session IS NOT NULL GROUP BY session),
j AS (SELECT session, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_prompts AS BIGINT) AS n_prompts, CAST(n_replies AS BIGINT) AS n_replies,
  CASE WHEN n_prompts = 0 AND n_replies = 0 THEN 'empty' WHEN broken THEN 'broken' WHEN silent THEN 'no_reply' END AS reason FROM s)"""
ORACLES = {
    "p3_found": f"WITH RECURSIVE {_SQL} SELECT session AS session_id, reason FROM j WHERE reason IS NOT NULL",
    "p3_sessions": f"WITH RECURSIVE {_SQL} SELECT * FROM j",
}
