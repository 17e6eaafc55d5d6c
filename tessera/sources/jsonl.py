"""Session logs as JSON lines: scans, discovery, and the same as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One log line; content that is JSON keeps its text, so both forms of a message fit.
LINE = (
    "type string, uuid string, timestamp string, sessionId string, parentUuid string, isSidechain boolean, slug string, cwd string, "
    "message struct<role: string, content: string, model: string, stop_reason: string>, data string, parentToolUseID string, toolUseID string, messageId string, snapshot string, agentId string"
)
NOISE = ("progress", "file-history-snapshot")


def _parsed(text: DataFrame) -> DataFrame:
    j = F.from_json("value", LINE, {"mode": "PERMISSIVE"})
    return text.withColumn("j", j)


def read_sessions(spark: SparkSession, path: str, sidechains: bool = False, noise: bool = False, recursive: bool = True) -> DataFrame:
    """One row per message of all .jsonl files under `path`, with `file` and `offset` as the order of lines.

    Blank and malformed lines are skipped; sidechain and noise lines are dropped unless asked for.
    """
    raw = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.jsonl").text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("offset"))
    rows = _parsed(raw.filter(F.trim("value") != "")).filter("j.type is not null").select("file", "offset", "j.*")
    return keep_messages(rows, sidechains, noise)


def keep_messages(rows: DataFrame, sidechains: bool = False, noise: bool = False) -> DataFrame:
    if not noise:
        rows = rows.filter(~F.col("type").isin(*NOISE))
    return rows if sidechains else rows.filter(~F.coalesce("isSidechain", F.lit(False)))


def stream_sessions(spark: SparkSession, path: str, sidechains: bool = False, noise: bool = False) -> DataFrame:
    """The same as a stream over new files."""
    raw = spark.readStream.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").text(path)
    return keep_messages(_parsed(raw.filter(F.trim("value") != "")).filter("j.type is not null").select("j.*"), sidechains, noise)


def session_info(rows: DataFrame, group: str = "file", order: str = "offset") -> DataFrame:
    """Per file the first non-empty session, slug, directory and time, the last time, and the number of messages."""
    first = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col(order))).alias(c)
    return rows.groupBy(group).agg(first("sessionId"), first("slug"), first("cwd"), first("timestamp").alias("first_at"), F.max_by("timestamp", F.when(F.col("timestamp") != "", F.col(order))).alias("last_at"), F.count("*").alias("n_messages"))


def dead_ends(rows: DataFrame, group: str = "file", order: str = "offset") -> DataFrame:
    """Per sub-agent file whether it is a dead end: at most two lines and no assistant among the first ten."""
    w = Window.partitionBy(group).orderBy(order)
    r = rows.withColumn("_r", F.row_number().over(w))
    return r.groupBy(group).agg(((F.count("*") <= 2) & ~F.max((F.col("_r") <= 10) & (F.col("type") == "assistant"))).alias("dead_end"))


def discover(spark: SparkSession, path: str, least_bytes: int = 0) -> DataFrame:
    """The session files under `path` by their metadata, oldest first: names that are UUIDs, no hidden folders."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(path).select("path", "modificationTime", "length")
    name = F.element_at(F.split("path", "/"), -1)
    ok = name.rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\.jsonl$") & ~F.col("path").rlike(r"/(\.[^/]+|node_modules)/")
    return f.filter(ok & (F.col("length") > least_bytes)).orderBy("modificationTime", "path")


def project_slugs(dirs: DataFrame) -> DataFrame:
    """cwd -> slug: the last component, or the last two where several directories share it."""
    parts = F.filter(F.split("cwd", "/"), lambda p: p != "")
    n = dirs.select("cwd").filter("cwd is not null").distinct().withColumn("_p", parts).filter(F.size("_p") > 0)
    n = n.withColumn("_one", F.element_at("_p", -1))
    shared = n.groupBy("_one").agg(F.count("*").alias("_n"))
    return n.join(shared, "_one").select("cwd", F.when(F.col("_n") == 1, F.col("_one")).otherwise(F.array_join(F.slice("_p", F.greatest(F.lit(1), F.size("_p") - 1), F.lit(2)), "-")).alias("slug"))
