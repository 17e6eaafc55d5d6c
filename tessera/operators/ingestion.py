"""Ingesting again and again: checkpoints per session, batches with errors kept apart, re-embedding that can go on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import pipelines
from tessera.operators import transcripts as T
from tessera.runtime import broadcast_if_small, materialise

CHECKPOINT = "session string, last_turn int, last_at long"


def pending_messages(messages: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """The messages of sessions that have something new since the checkpoint (`session, last_turn, last_at`).

    Sessions are compared by their latest message; the others are left out before anything is parsed. All messages of
    a changed session come along, as turns are numbered from its start.
    """
    newest = messages.groupBy("session").agg(F.max("at").alias("newest"))
    j = newest.join(checkpoint, "session", "left").filter("last_at is null or newest > last_at").select("session")
    return messages.join(broadcast_if_small(j), "session", "left_semi")


@dataclass
class Ingested:
    """New rows by table, the checkpoint after them, and the messages that could not be read."""

    tables: dict[str, DataFrame]
    checkpoint: DataFrame
    rejected: DataFrame


def ingest_increment(messages: DataFrame, checkpoint: DataFrame, most_tokens: int = T.MAX_TOKENS, link_sessions: bool = True) -> Ingested:
    """Ingest what is new: late turns of known sessions are appended, chunked apart from the turns stored before.

    messages: as for `pipelines.ingest`. A message without a session, a uuid or a time is rejected with the reason and
    stops nothing else. The last stored turn of a session counts as complete. Replaying the same messages with the
    checkpoint that came out gives no rows. Without messages all tables are empty and the checkpoint stays.
    """
    reason = F.when(F.col("session").isNull(), "no session").when(F.col("uuid").isNull(), "no uuid").when(F.col("at").isNull(), "no time")
    judged = materialise(messages.withColumn("reason", reason), "judged")
    good = judged.filter("reason is null").drop("reason")
    todo = materialise(pending_messages(good, checkpoint), "pending")
    numbered = materialise(T.turns(todo), "turns")
    fresh = numbered.join(broadcast_if_small(checkpoint.select("session", "last_turn")), "session", "left").filter("last_turn is null or turn > last_turn").drop("last_turn")
    tables = pipelines.ingest_turns(materialise(fresh, "fresh"), most_tokens, link_sessions)
    done = numbered.groupBy("session").agg(F.max("turn").alias("last_turn"), F.max("at").alias("last_at"))
    kept = checkpoint.join(broadcast_if_small(done.select("session")), "session", "left_anti")
    return Ingested(tables, materialise(kept.unionByName(done), "checkpoint"), judged.filter("reason is not null"))


def ingest_batches(batches: list[tuple[str, Callable[[], DataFrame]]], checkpoint: DataFrame, sink: Callable[[str, dict[str, DataFrame]], None], done: set[str] | None = None, most_tokens: int = T.MAX_TOKENS) -> tuple[DataFrame, dict[str, str]]:
    """Ingest named batches in order; what fails is noted with its error and does not stop the others.

    `sink(name, tables)` stores a batch's rows and should be idempotent by name; names in `done` are passed over, so a
    run that was broken off goes on where it stopped. Sessions are linked across at the end by the caller, over the whole
    store. Returns the checkpoint and, per name, `ok`, `skipped` or the error.
    """
    said: dict[str, str] = {}
    for name, read in batches:
        if done and name in done:
            said[name] = "skipped"
            continue
        try:
            got = ingest_increment(read(), checkpoint, most_tokens, link_sessions=False)
            sink(name, got.tables)
            checkpoint, said[name] = got.checkpoint, "ok"
        except Exception as e:  # noqa: BLE001
            said[name] = f"{type(e).__name__}: {e}"
    return checkpoint, said


def reembed(spark: SparkSession, docs: DataFrame, path: str, model: str, embed: Callable[[DataFrame], DataFrame], parts: int = 16) -> list[int]:
    """Embed `id, text` anew in `parts` by the hash of the id, each its own folder below `path`; parts that are complete
    (Spark's own mark of success) are left alone, so a broken run goes on. Returns the parts that were made."""
    made = []
    for n in range(parts):
        folder = f"{path}/model={model}/part={n}"
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            continue
        mine = docs.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == n)
        embed(mine).write.mode("overwrite").parquet(folder)
        made.append(n)
    return made
