"""From log lines to turns, tool exchanges, chunks and session states."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import transcripts as T
from tessera.operators.deliveries import first_deliveries
from tessera.plans.nested import BLOCKS_SQL
from tessera.plans.registry import Registry
from tessera.runtime import key_of, materialise, read_table
from tessera.sources import jsonl
from tessera.sources.store import K

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

_LINES = f"ln AS (SELECT {K.format('uuid')} AS uuid, arg_min(type, ingested_at) AS type, arg_min({K.format('sessionId')}, ingested_at) AS session, bool_or(coalesce(isSidechain, false)) AS side, min(ingested_at) AS ing, any_value(cwd) AS cwd, any_value(slug) AS slug FROM sample_session WHERE {K.format('uuid')} IS NOT NULL GROUP BY 1)"


def _lines(spark, d):
    return first_deliveries(read_table(spark, d, "sample_session"), key_of("uuid"), "ingested_at").withColumn("uuid", F.col("key"))


def _messages(spark, d):
    """The messages of the main threads in order of arrival."""
    m = jsonl.keep_messages(_lines(spark, d))
    return materialise(m.select("uuid", key_of("sessionId").alias("session"), "type", F.col("message.content").alias("content"), F.unix_micros("ingested_at").alias("at")).filter("session is not null"), "messages")


@register(f"WITH {_LINES} SELECT uuid, type, session FROM ln WHERE type NOT IN ('progress', 'file-history-snapshot') AND NOT side")
def session_messages(spark, d):
    """The scan without noise and sidechains."""
    return jsonl.keep_messages(_lines(spark, d)).select("uuid", "type", key_of("sessionId").alias("session"))


@register(f"WITH {_LINES} SELECT session, count(*) AS n_messages, count(*) FILTER (type = 'user') AS n_user, count(*) FILTER (side) AS n_sidechain, min(ing) AS first_at, max(ing) AS last_at FROM ln WHERE session IS NOT NULL GROUP BY 1")
def session_metadata(spark, d):
    l = _lines(spark, d).withColumn("session", key_of("sessionId")).filter("session is not null")
    return l.groupBy("session").agg(F.count("*").alias("n_messages"), F.count(F.when(F.col("type") == "user", 1)).alias("n_user"), F.count(F.when(F.coalesce("isSidechain", F.lit(False)), 1)).alias("n_sidechain"), F.min("ingested_at").alias("first_at"), F.max("ingested_at").alias("last_at"))


@register("""WITH n AS (SELECT DISTINCT cwd, list_filter(string_split(cwd, '/'), lambda p: p <> '') AS p FROM sample_session WHERE cwd IS NOT NULL), s AS (SELECT p[-1] AS one, count(*) AS n FROM n WHERE len(p) > 0 GROUP BY 1)
SELECT cwd, CASE WHEN s.n = 1 THEN one ELSE array_to_string(p[greatest(1, len(p) - 1):len(p)], '-') END AS slug FROM n JOIN s ON p[-1] = one""")
def project_slugs(spark, d):
    return jsonl.project_slugs(read_table(spark, d, "sample_session"))


@register(f"WITH {_LINES}, s AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ing, uuid) AS r FROM ln WHERE session IS NOT NULL) SELECT session, count(*) <= 2 AND NOT bool_or(r <= 10 AND type = 'assistant') AS dead_end FROM s GROUP BY 1")
def dead_end_sessions(spark, d):
    l = _lines(spark, d).withColumn("session", key_of("sessionId")).filter("session is not null").withColumn("at", F.struct("ingested_at", "uuid"))
    return jsonl.dead_ends(l, "session", "at")


_MSG = f"{_LINES}, ms AS (SELECT ln.uuid, ln.session, ln.type, ln.ing, m.content FROM ln LEFT JOIN m ON ln.uuid = m.uuid WHERE ln.type NOT IN ('progress', 'file-history-snapshot') AND NOT side AND session IS NOT NULL)"
_TURN = f"""{_MSG}, tx AS (SELECT uuid, arg_min(block->>'$.text', CAST(block_path AS INTEGER)) AS text FROM blocks WHERE parent_path IS NULL AND block->>'$.type' = 'text' GROUP BY 1), hb AS (SELECT DISTINCT uuid FROM blocks WHERE parent_path IS NULL),
op AS (SELECT ms.*, coalesce(ms.type = 'user' AND ((hb.uuid IS NULL AND content IS NOT NULL) OR (trim(tx.text) <> '' AND NOT starts_with(tx.text, '[Request interrupted'))), false) AS opens FROM ms LEFT JOIN tx ON ms.uuid = tx.uuid LEFT JOIN hb ON ms.uuid = hb.uuid),
nu AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ing, uuid ROWS UNBOUNDED PRECEDING) AS n FROM op),
tn AS (SELECT *, CAST(n - least(min(n) OVER (PARTITION BY session), 1) AS INTEGER) AS turn FROM nu)"""


@register(f"WITH RECURSIVE {BLOCKS_SQL}, {_TURN} SELECT session, turn, count(*) AS n_messages, min(ing) AS started, bool_or(opens) AS opened FROM tn GROUP BY 1, 2")
def session_turns(spark, d):
    """Turn assembly: messages between turn openings."""
    t = T.turns(_messages(spark, d))
    first = F.min(F.struct("at", "uuid", "type"))
    return t.groupBy("session", "turn").agg(F.count("*").alias("n_messages"), F.timestamp_micros(F.min("at")).alias("started"), first.alias("f")).join(_opened(t), ["session", "turn"], "left").select("session", "turn", "n_messages", "started", F.coalesce("opened", F.lit(False)).alias("opened"))


def _opened(t):
    """Turns that an opening message started: all but a session's leading one without any."""
    b = t.filter("turn > 0").select("session", "turn").distinct().withColumn("opened", F.lit(True))
    zero = t.filter("turn = 0")
    top = T.shred_blocks(zero, "uuid", "content").filter("parent_path is null")
    first = top.filter("type = 'text'").groupBy(F.col("message_id").alias("uuid")).agg(F.min_by("text", F.col("block_path").cast("int")).alias("_t"))
    has = top.select(F.col("message_id").alias("uuid")).distinct().withColumn("_b", F.lit(True))
    plain = F.when(F.col("_b").isNull() & F.col("content").isNotNull(), F.col("content"))
    z = zero.join(first, "uuid", "left").join(has, "uuid", "left").filter(T.opens_turn(F.col("type"), plain, F.col("_t")))
    return b.unionByName(z.select("session", "turn").distinct().withColumn("opened", F.lit(True)))


_EX = f"""{_MSG}, ub AS (SELECT b.uuid, block_path, block, session, ing FROM blocks b JOIN ms ON b.uuid = ms.uuid),
us AS (SELECT session, block->>'$.id' AS tool_use_id, arg_min(uuid, (ing, uuid, block_path)) AS use_uuid, arg_min(block->>'$.name', (ing, uuid, block_path)) AS name FROM ub WHERE block->>'$.type' = 'tool_use' AND block->>'$.id' IS NOT NULL GROUP BY 1, 2),
rs AS (SELECT session, block->>'$.tool_use_id' AS tool_use_id, arg_min(uuid, (ing, uuid, block_path)) AS result_uuid FROM ub WHERE block->>'$.type' = 'tool_result' AND block->>'$.tool_use_id' IS NOT NULL GROUP BY 1, 2)"""


@register(f"WITH RECURSIVE {BLOCKS_SQL}, {_EX} SELECT us.session, us.tool_use_id, name, use_uuid, result_uuid FROM us LEFT JOIN rs ON us.session = rs.session AND us.tool_use_id = rs.tool_use_id")
def tool_exchanges(spark, d):
    return T.tool_exchanges(_messages(spark, d)).select("session", "tool_use_id", "name", "use_uuid", "result_uuid")


@register()
def rendered_turns(spark, d):
    return T.rendered_turns(T.turns(_messages(spark, d)))


@register()
def chunk_packing(spark, d):
    """Turns packed into chunks of at most 1,024 tokens."""
    return T.chunk_turns(T.rendered_turns(T.turns(_messages(spark, d))), 1024)


@register()
def session_states(spark, d):
    return T.session_state(T.tool_exchanges(_messages(spark, d)))
