"""Edges between the members of agent teams, and between a main session and its sub-agents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import WEIGHTS

#: Seconds within which a message counts as received where no chunk says so.
PROXIMITY_SECONDS = 10
LEADS = ("team-lead", "lead")


def _chunk_of_turn(chunks: DataFrame) -> DataFrame:
    """session, agent, turn and the first chunk (by time, then id) that holds the turn."""
    t = chunks.select("session", "agent", "id", "start", F.explode(F.array_distinct("turn_indices")).alias("turn"))
    return t.groupBy("session", "agent", "turn").agg(F.min(F.struct("start", "id")).alias("c")).select("session", "agent", "turn", F.col("c.id").alias("chunk"))


def team_edges(uses: DataFrame, chunks: DataFrame, seconds: float = PROXIMITY_SECONDS) -> DataFrame:
    """src, dst, reference_type, weight, at.

    uses: tool calls `session, agent, turn, name, input` (JSON) and `at` (timestamp), with `agent` null for the lead;
    chunks: `session, agent, id, turn_indices, start, end`. A call of Task with a team and a name links the lead's chunk
    of that turn to the member's first chunk (team-spawn). A SendMessage links the sender's chunk to the recipient's
    chunk nearest in time (its start or end within `seconds`), as team-report where the recipient is the lead, else as
    peer-message. Calls whose ends have no chunk give no edge; repeated calls of one pair give one.
    """
    at_turn = _chunk_of_turn(chunks)
    u = uses.withColumn("me", F.coalesce("agent", F.lit("")))
    sent = u.join(at_turn.select("session", F.coalesce("agent", F.lit("")).alias("me"), "turn", F.col("chunk").alias("src")), ["session", "me", "turn"])
    get = lambda n: F.get_json_object("input", f"$.{n}")
    spawn = sent.filter((F.col("name") == "Task") & (F.col("me") == "") & get("team_name").isNotNull()).select("session", "src", "at", get("name").alias("member"))
    first = chunks.filter("agent is not null").groupBy("session", F.col("agent").alias("member")).agg(F.min(F.struct("start", "id")).alias("c")).select("session", "member", F.col("c.id").alias("dst"))
    spawned = spawn.join(first, ["session", "member"]).select("src", "dst", F.lit("team-spawn").alias("reference_type"), "at")
    to = F.when(get("recipient").isin(*LEADS), F.lit("")).otherwise(get("recipient"))
    said = sent.filter(F.col("name") == "SendMessage").select("session", "src", "at", to.alias("other")).filter("other is not null")
    # chunks within reach of the time: both sides fall into slots of that width, so the join stays an equi-join
    slot = lambda c: F.floor(F.unix_micros(c) / int(seconds * 1e6))
    ends = chunks.select("session", F.coalesce("agent", F.lit("")).alias("other"), F.col("id").alias("dst"), F.explode(F.array("start", "end")).alias("t")).filter("t is not null")
    near = said.withColumn("s", F.explode(F.array(slot("at") - 1, slot("at"), slot("at") + 1))).join(ends.withColumn("s", slot("t")), ["session", "other", "s"])
    gap = F.abs(F.unix_micros("t") - F.unix_micros("at"))
    best = near.filter(gap <= int(seconds * 1e6)).groupBy("session", "src", "at", "other").agg(F.min(F.struct(gap.alias("gap"), "dst")).alias("m"))
    told = best.select("src", F.col("m.dst").alias("dst"), F.when(F.col("other") == "", "team-report").otherwise("peer-message").alias("reference_type"), "at")
    weights = F.create_map(*[F.lit(x) for n in ("team-spawn", "team-report", "peer-message") for x in (n, WEIGHTS[n])])
    every = spawned.unionByName(told).filter("src <> dst").groupBy("src", "dst", "reference_type").agg(F.min("at").alias("at"))
    return every.withColumn("weight", weights[F.col("reference_type")])


def first_contacts(chunks: DataFrame) -> DataFrame:
    """session, agent, src, dst: the lead's last chunk that began before an agent's first chunk, to that first chunk.

    What is left of a spawn where the calls themselves are not stored. chunks: `session, agent, id, start`; `agent` is null
    for the lead. Agents that began before any chunk of the lead have no row.
    """
    lead = chunks.filter("agent is null").select("session", F.col("start").alias("t"), F.col("id").alias("src"))
    first = chunks.filter("agent is not null").groupBy("session", "agent").agg(F.min(F.struct("start", "id")).alias("f"))
    joined = first.join(lead, "session").filter(F.col("t") <= F.col("f.start"))
    got = joined.groupBy("session", "agent", "f").agg(F.max(F.struct("t", "src")).alias("m"))
    return got.select("session", "agent", F.col("m.src").alias("src"), F.col("f.id").alias("dst"))


def agent_edges(lines: DataFrame, chunk_of_line: DataFrame) -> DataFrame:
    """src, dst, reference_type: brief edges from the chunk of the main line that a sub-agent's first line hangs under to
    the chunk of that first line, and debrief edges from the chunk of its last line to the chunk of the first main line
    after it.

    lines: `uuid, parent, session, agent, at`; chunk_of_line: `uuid, chunk`. Lines without a chunk give no edge.
    """
    at = F.struct("at", "uuid")
    ends = lines.filter("agent is not null").groupBy("session", "agent").agg(F.min(F.struct("at", "uuid", "parent")).alias("f"), F.max(at).alias("l"))
    c = chunk_of_line.select("uuid", "chunk")
    brief = ends.select(F.col("f.parent").alias("uuid"), F.col("f.uuid").alias("to")).join(c.withColumnRenamed("chunk", "src"), "uuid").join(c.select(F.col("uuid").alias("to"), F.col("chunk").alias("dst")), "to")
    main = lines.filter("agent is null").select("session", F.struct("at", "uuid").alias("m"))
    after = ends.join(main, "session").filter(F.col("m") > F.col("l")).groupBy("session", "agent", "l").agg(F.min("m").alias("m"))
    back = after.select(F.col("l.uuid").alias("uuid"), F.col("m.uuid").alias("to")).join(c.withColumnRenamed("chunk", "src"), "uuid").join(c.select(F.col("uuid").alias("to"), F.col("chunk").alias("dst")), "to")
    kind = lambda df, n: df.select("src", "dst", F.lit(n).alias("reference_type"))
    return kind(brief, "brief").unionByName(kind(back, "debrief")).filter("src <> dst").distinct()
