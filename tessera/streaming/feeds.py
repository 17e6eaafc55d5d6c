"""Streams: the retrieval log and session logs, incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.lookups import upsert
from tessera.runtime import materialise

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, watermark: str = "10 minutes", schema: str = EVENTS, files_per_trigger: int | None = None) -> DataFrame:
    """New parquet files of events as a stream with event time `at`."""
    r = spark.readStream.schema(schema).format("parquet")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", watermark)


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, by: str = "event_type") -> DataFrame:
    """Tumbling or sliding counts and sums; late rows within the watermark are taken."""
    w = F.window("at", length, slide) if slide else F.window("at", length)
    return events.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def session_counts(events: DataFrame, gap: str, by: str = "user_id") -> DataFrame:
    """Sessions by gap; the state of a session is merged as rows come, so a hot key needs no sort."""
    return events.groupBy(F.session_window("at", gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def deduplicated(events: DataFrame, key: list[str]) -> DataFrame:
    """Each key once within the watermark."""
    return events.dropDuplicatesWithinWatermark(key)


def run_once(stream: DataFrame, checkpoint: str, each_batch, mode: str = "update") -> StreamingQuery:
    """Process everything that is there, then stop; a restart goes on from the checkpoint."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each_batch).start()
    q.awaitTermination()
    return q


#: Folders that an upserted table is kept in, by the hash of the key; a batch rewrites those it touches.
FOLDERS = 16


def upsert_into(path: str, key: list[str], version: str):
    """A batch writer that inserts or replaces rows by key in a table of FOLDERS folders (`folder=N`).

    Only the folders that a batch touches are read, merged and replaced. A merged folder is first written whole beside the
    table; replacing is what may be repeated: a batch that was broken off comes again with the same number, and merging
    it twice changes nothing.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        b = batch.withColumn(version, F.lit(n).cast("long")).withColumn("folder", F.pmod(F.xxhash64(*key), F.lit(FOLDERS)).cast("int"))
        b = materialise(b, "batch")
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
            touched = [r.folder for r in b.select("folder").distinct().collect()]  # FOLDERS at most
            b = materialise(upsert(spark.read.parquet(path).filter(F.col("folder").isin(*touched)), b, key, version), "merged")
        b.repartition("folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(path)

    return write


def append_into(path: str):
    """A batch writer for logs (retrieval feedback, say): a folder per batch, overwritten if the batch comes again."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return write
