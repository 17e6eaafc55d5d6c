"""Selections, joins and roll-ups over the store: parametrised, one plan each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import broadcast_if_small

#: Words that summaries are not searched for (fixed values).
SUMMARY_STOP_WORDS = (
    "the and for that this with from are was were been have has had not but what how why when where who which "
    "did does will can could would should about into over after before"
).split()


def by_keys(table: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose `key` is in the key table (its one column); null keys match nothing."""
    k = keys.toDF("_k").distinct()
    return table.join(broadcast_if_small(k), table[key] == k["_k"], "left_semi")


def time_range(chunks: DataFrame, project: str | None = None, start=None, end=None, session: str | None = None, agent: str | None = None, limit: int | None = None) -> DataFrame:
    """Chunks that start within [start, end), oldest first; ties by id."""
    conds: list[Column] = []
    if project is not None:
        conds.append(F.col("session_slug") == project)
    if start is not None:
        conds.append(F.col("start_time") >= F.lit(start).cast("timestamp"))
    if end is not None:
        conds.append(F.col("start_time") < F.lit(end).cast("timestamp"))
    if session is not None:
        conds.append(F.col("session_id") == session)
    if agent is not None:
        conds.append(F.col("agent_id") == agent)
    out = chunks.filter(reduce(lambda a, b: a & b, conds, F.lit(True))).orderBy("start_time", "id")
    return out if limit is None else out.limit(limit)


def newest(rows: DataFrame, time: str, n: int, key: str = "id") -> DataFrame:
    """The n newest rows, given oldest first."""
    return rows.orderBy(F.desc(time), F.desc(key)).limit(n).orderBy(time, key)


def page(rows: DataFrame, order: list, size: int, number: int) -> DataFrame:
    """Page `number` (from 0) of `size` rows."""
    return rows.orderBy(*order).offset(size * number).limit(size)


def project_summary(chunks: DataFrame) -> DataFrame:
    """Per project with a name: chunks, first and last start."""
    return chunks.filter("session_slug <> ''").groupBy("session_slug").agg(F.count("*").alias("n_chunks"), F.min("start_time").alias("first_seen"), F.max("start_time").alias("last_seen"))


def session_summary(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("session_slug", "session_id").agg(F.min("start_time").alias("first_start"), F.max("end_time").alias("last_end"), F.count("*").alias("n_chunks"), F.coalesce(F.sum("approx_tokens"), F.lit(0)).cast("long").alias("total_tokens"))


def previous_session(sessions: DataFrame) -> DataFrame:
    """For each session the one of the same project that started last before it (ties by id)."""
    w = Window.partitionBy("session_slug").orderBy("first_start", "session_id")
    return sessions.withColumn("previous_id", F.lag("session_id").over(w)).withColumn("previous_end", F.lag("last_end").over(w))


def search_summaries(summaries: DataFrame, query: str, text: str, time: str, limit: int = 5) -> DataFrame:
    """Rows whose text holds any query word of 3 letters or more that is no stop word, newest first; none without words."""
    words = [w for w in query.lower().split() if len(w) >= 3 and w not in SUMMARY_STOP_WORDS]
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in words], F.lit(False))
    return summaries.filter(hit).orderBy(F.desc(time)).limit(limit)


def both_ends_within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges whose two ends are both in the id table."""
    k = broadcast_if_small(ids.toDF("_k").distinct())
    return edges.join(k, edges.src == k["_k"], "left_semi").join(k, edges.dst == k["_k"], "left_semi")


def nearest_in_time(events: DataFrame, targets: DataFrame, key: list[str], seconds: int) -> DataFrame:
    """As-of nearest join: per event the target of the same key whose `at` is nearest, at most `seconds` away.

    Both sides are bucketed by time, the targets three times, so the join is an equi-join whatever the key's skew. Ties
    go to the earlier, then the smaller target id.
    """
    bucket = lambda c: F.floor(F.unix_seconds(c) / seconds)
    e = events.withColumn("_b", bucket(F.col("at")))
    t = targets.withColumnRenamed("at", "_at").withColumn("_b", F.explode(F.array([bucket(F.col("_at")) + i for i in (-1, 0, 1)])))
    away = F.abs(F.unix_micros("at") - F.unix_micros("_at"))
    j = e.join(t, [*key, "_b"]).withColumn("_away", away).filter(F.col("_away") <= seconds * 1_000_000)
    best = j.groupBy("event_id").agg(F.min(F.struct("_away", "_at", "target_id")).alias("_m"))
    return best.select("event_id", F.col("_m.target_id").alias("target_id"), (F.col("_m._away") / 1000).cast("long").alias("away_ms"))


def gap_sessions(events: DataFrame, key: list[str], time: str, seconds: float, order: str) -> DataFrame:
    """Number the runs of events of one key with gaps of at most `seconds` (from 1)."""
    w = Window.partitionBy(*key).orderBy(time, order)
    gap = F.unix_micros(time) - F.lag(F.unix_micros(time)).over(w)
    start = F.when(gap.isNull() | (gap > int(seconds * 1_000_000)), 1).otherwise(0)
    return events.withColumn("_start", start).withColumn("run", F.sum("_start").over(w).cast("long")).drop("_start")


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Insert or replace: per key the row with the highest version; of equal versions the new one."""
    w = Window.partitionBy(*key).orderBy(F.desc(version), F.desc("_new"))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_new")


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Insert or ignore: the new rows whose key the table does not have, once per key."""
    return new.dropDuplicates(key).join(old.select(*key), key, "left_anti")


def update_present(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Update only the columns of `changes` that are not null, and add its new keys."""
    cols = [c for c in old.columns if c != key]
    c = changes.select(key, *[F.col(x).alias(f"_{x}") if x in changes.columns else F.lit(None).alias(f"_{x}") for x in cols])
    return old.join(c, key, "full").select(key, *[F.coalesce(F.col(f"_{x}"), F.col(x)).alias(x) for x in cols])


def jaccard_matches(old: DataFrame, new: DataFrame, least: float) -> DataFrame:
    """Pairs of (old_group, new_group) of `grp, member` with a Jaccard overlap of at least `least`."""
    o, n = old.select(F.col("grp").alias("old_group"), "member").distinct(), new.select(F.col("grp").alias("new_group"), "member").distinct()
    shared = o.join(n, "member").groupBy("old_group", "new_group").agg(F.count("*").alias("n"))
    so, sn = o.groupBy("old_group").agg(F.count("*").alias("a")), n.groupBy("new_group").agg(F.count("*").alias("b"))
    return shared.join(so, "old_group").join(sn, "new_group").withColumn("overlap", F.col("n") / (F.col("a") + F.col("b") - F.col("n"))).filter(F.col("overlap") >= least).select("old_group", "new_group", "overlap")


def one_to_one(pairs: DataFrame, left: str, right: str, score: str, most: int = 100_000) -> DataFrame:
    """Greedy one-to-one matching by falling score, ties by left, then right.

    A pair is taken when it is the best left for both of its ends; such pairs are taken together, round by round, which
    gives the greedy result.
    """
    from tessera.runtime import materialise

    rest, taken = materialise(pairs.select(left, right, score), "pairs"), None
    while True:
        order = [F.desc(score), F.asc(left), F.asc(right)]
        best = rest.withColumn("_l", F.row_number().over(Window.partitionBy(left).orderBy(*order))).withColumn("_r", F.row_number().over(Window.partitionBy(right).orderBy(*order)))
        now = materialise(best.filter("_l = 1 and _r = 1").select(left, right, score), "taken")
        if now.isEmpty():
            return taken if taken is not None else now
        taken = now if taken is None else taken.unionByName(now)
        rest = materialise(rest.join(now.select(left), left, "left_anti").join(now.select(right), right, "left_anti"), "pairs")


def nth_smallest_index(values: Column, share: float) -> Column:
    """The percentile by index floor(n * share) of a sorted array, without interpolation (the last one at most)."""
    n = F.size(values)
    return F.element_at(values, F.least(F.floor(n * F.lit(share)).cast("int") + 1, n))


def histogram_percentile(rows: DataFrame, value: str, share: float) -> DataFrame:
    """The same over a whole table: values are counted first, so nothing but distinct values is sorted in one place."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(value).count()
    w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = counts.agg(F.sum("count").alias("n"))
    run = counts.withColumn("upto", F.sum("count").over(w)).join(F.broadcast(total))
    return run.filter(F.col("upto") > F.least(F.floor(F.col("n") * share), F.col("n") - 1)).agg(F.min(value).alias("value"))


def set_hash(ids: Column) -> Column:
    """Order-insensitive hash of a set of ids: the first 16 hex digits of the SHA-256 of the sorted ids joined by commas."""
    return F.substring(F.sha2(F.array_join(F.array_sort(ids), ","), 256), 1, 16)
