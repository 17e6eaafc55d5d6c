from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.streaming import feeds

START = datetime(2024, 1, 1)


def write(spark, path, rows, mode="append"):
    df = spark.createDataFrame([(i, START + timedelta(minutes=m), u, "click", 1.0, None) for i, m, u in rows], feeds.EVENTS)
    df.coalesce(1).write.mode(mode).parquet(path)


def test_windows_are_upserted_over_restarts(spark, tmp_path):
    src, table, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))
    write(spark, src, [(1, 0, 7), (2, 30, 7), (3, 61, 8)])
    run = lambda: feeds.run_once(feeds.windowed_counts(feeds.event_stream(spark, src, "2 hours"), "1 hour"), mark, feeds.upsert_into(table, ["start", "event_type"], "batch"))
    run()
    assert {r.start.hour: r.n for r in spark.read.parquet(table).collect()} == {0: 2, 1: 1}
    write(spark, src, [(4, 59, 7), (5, 500, 7)])  # one late row within the watermark, and one that moves it on
    run()
    assert {r.start.hour: r.n for r in spark.read.parquet(table).collect()} == {0: 3, 1: 1, 8: 1}
    write(spark, src, [(6, 1, 7)])  # too late by now
    run()
    assert {r.start.hour: r.n for r in spark.read.parquet(table).collect()} == {0: 3, 1: 1, 8: 1}


def test_sessions_and_duplicates(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, src, [(1, 0, 7), (2, 10, 7), (3, 90, 7), (3, 90, 7), (4, 5, 8)])
    got = []
    stream = feeds.deduplicated(feeds.event_stream(spark, src, "1 day"), ["event_id"])
    feeds.run_once(stream.select("event_id"), str(tmp_path / "m1"), lambda b, n: got.extend(r[0] for r in b.collect()), mode="append")
    assert sorted(got) == [1, 2, 3, 4]
    sessions = []
    feeds.run_once(feeds.session_counts(feeds.event_stream(spark, src, "1 hour"), "30 minutes"), str(tmp_path / "m2"), lambda b, n: sessions.extend((r.user_id, r.n) for r in b.collect()), mode="complete")
    assert sorted(set(sessions)) == [(7, 2), (8, 1)]
    batch = feeds.session_counts(spark.read.parquet(src).withColumn("at", F.col("ts").cast("timestamp")), "30 minutes")
    assert sorted((r.user_id, r.n) for r in batch.collect()) == [(7, 2), (7, 2), (8, 1)]
