"""Repository maps, retention, archives and streams."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import lookups as L
from tessera.operators import maintenance as M
from tessera.operators import repomap as R
from tessera.operators import retrieval
from tessera.plans.registry import Registry
from tessera.plans.search import _ANG
from tessera.plans.texts import q
from tessera.runtime import read_table, work_dir
from tessera.sources import archive as A
from tessera.sources import store as S
from tessera.sources.store import prelude as P
from tessera.streaming import feeds

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

_FENCE = r"(?s)```ts\r?\n(.*?)```"


def _snippets(spark, d):
    """Code fences of the chunks as files."""
    code = F.array_join(F.regexp_extract_all("content", F.lit(_FENCE), 1), "\n")
    return S.chunks(spark, d).select(F.col("id").alias("file"), F.lit("snippet").alias("language"), code.alias("source")).filter("source <> ''")


_TAGS = f"""fs AS (SELECT id AS file, array_to_string(regexp_extract_all(content, {q(_FENCE)}, 1), E'\\n') AS source FROM c), ls AS (SELECT file, unnest(string_split(source, E'\\n')) AS text, generate_subscripts(string_split(source, E'\\n'), 1) AS line FROM fs WHERE source <> ''),
rl AS (SELECT file, line, {' '.join(f"CASE WHEN regexp_matches(text, {q(p)}) THEN {{'name': regexp_extract(text, {q(p)}, 1), 'kind': '{k}', 'type': '{t}'}} ELSE" for p, k, t in R.RULES['snippet'])} NULL {'END ' * len(R.RULES['snippet'])} AS t FROM ls),
tg AS (SELECT file, t.name AS name, t.kind AS kind, t.type AS type, min(line) AS line FROM rl WHERE t IS NOT NULL GROUP BY ALL
  UNION ALL SELECT file, name, 'ref', 'identifier', min(line) FROM (SELECT file, line, unnest(regexp_extract_all(text, {q(R._CALL)}, 1)) AS name FROM ls) GROUP BY ALL),
fe2 AS (SELECT r.file AS src, x.file AS dst, sum(greatest(1.0, log2(length(r.name)))) AS weight FROM (SELECT DISTINCT file, name FROM tg WHERE kind = 'ref') r JOIN (SELECT DISTINCT file, name FROM tg WHERE kind = 'def') x ON r.name = x.name AND r.file <> x.file GROUP BY 1, 2),
fr AS (SELECT t.file, count(*) FILTER (kind = 'def') AS n_defs, coalesce(any_value(w), 0) + 0.1 * count(*) FILTER (kind = 'def') AS score FROM tg t LEFT JOIN (SELECT dst, sum(weight) AS w FROM fe2 GROUP BY 1) i ON i.dst = t.file GROUP BY 1)"""


@register(f"WITH {P('c')}, {_TAGS} SELECT file, name, kind, type, CAST(line AS INTEGER) AS line FROM tg")
def regex_tags(spark, d):
    return R.tags(_snippets(spark, d), calls=True)


@register(f"WITH {P('c')}, {_TAGS} SELECT src, dst, round(weight, 6) AS weight FROM fe2")
def file_graph(spark, d):
    return R.file_edges(R.tags(_snippets(spark, d), calls=True)).withColumn("weight", F.round("weight", 6))


@register(f"WITH {P('c')}, {_TAGS} SELECT file, n_defs, round(score, 6) AS score FROM fr")
def file_rank(spark, d):
    return R.file_ranks(R.tags(_snippets(spark, d), calls=True)).withColumn("score", F.round("score", 6))


@register()
def repo_map(spark, d):
    """The definitions of the best files within a budget of 1,024 tokens (each has one at least, so 1,024 are enough)."""
    t = R.ranked_definitions(R.tags(_snippets(spark, d), calls=True))
    top = t.orderBy(F.desc("score"), "file", "place").limit(1024)
    return retrieval.pack_prefix(top, None, [F.desc("score"), "file", "place"], "tokens", 1024, 0, 1).select("file", "name", "type", "line", "tokens")


@register(f"WITH {P('c')}, {_TAGS} SELECT file, name, line::INTEGER AS line FROM tg WHERE kind = 'def' AND name = (SELECT min(name) FROM tg WHERE kind = 'def')")
def find_symbol(spark, d):
    t = R.tags(_snippets(spark, d)).filter("kind = 'def'")
    return t.join(F.broadcast(t.agg(F.min("name").alias("name"))), "name").select("file", "name", "line")


NOW = "2026-02-01"


@register(f"WITH {P('v')} SELECT id, last_accessed FROM v WHERE last_accessed < TIMESTAMPTZ '{NOW} 00:00:00+00' - INTERVAL 90 DAY")
def ttl_expired(spark, d):
    return M.expired(S.search_vectors(spark, d).select("id", "last_accessed"), "last_accessed", NOW, 90)


@register(f"WITH {P('v')} SELECT id FROM v ORDER BY last_accessed NULLS FIRST, id LIMIT (SELECT greatest(0, count(*) - 200) FROM v)")
def fifo_evict(spark, d):
    return M.beyond_cap(S.search_vectors(spark, d), "last_accessed", 200).select("id")


_GONE = "gn AS (SELECT id FROM c WHERE start_time < TIMESTAMPTZ '2024-06-01 00:00:00+00')"


@register(f"""WITH {P('c', 'e', 'a', 'v', 'k')}, {_GONE}, ka AS (SELECT * FROM a WHERE chunk_id NOT IN (SELECT id FROM gn)) SELECT 'chunks' AS name, count(*) AS n FROM c WHERE id NOT IN (SELECT id FROM gn)
UNION ALL SELECT 'edges', count(*) FROM e WHERE src NOT IN (SELECT id FROM gn) AND dst NOT IN (SELECT id FROM gn) UNION ALL SELECT 'assignments', count(*) FROM ka
UNION ALL SELECT 'vectors', count(*) FROM v WHERE id NOT IN (SELECT id FROM gn) UNION ALL SELECT 'clusters', count(*) FROM k WHERE id IN (SELECT cluster_id FROM ka)""")
def cascade_delete(spark, d):
    """What is left of each table after the chunks before June 2024 are forgotten."""
    c = S.chunks(spark, d)
    gone = M.forget(c, F.col("start_time") < F.lit("2024-06-01").cast("timestamp"))
    left = M.cascade_delete(gone, c.select("id"), S.edges(spark, d).select("id", "src", "dst"), S.chunk_clusters(spark, d), S.search_vectors(spark, d).select("id"), S.clusters(spark, d).select("id"))
    parts = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


@register(f"""WITH {P('c', 'v')}, qv AS (SELECT embedding AS q FROM v ORDER BY id LIMIT 1), s AS (SELECT v.id, round(1 - {_ANG.format('embedding', 'q')}, 6) AS score FROM v, qv) SELECT c.id FROM c JOIN s ON c.id = s.id WHERE start_time >= TIMESTAMPTZ '2024-06-01 00:00:00+00' AND score >= 0.5""")
def forget_similar(spark, d):
    """Which chunks a request to forget by time and meaning would remove."""
    v = S.search_vectors(spark, d)
    r = v.orderBy("id").select("embedding").first()
    query = F.array(*[F.lit(float(x)) for x in (r.embedding if r else [0.0])])
    near = v.filter(F.round(1 - V.angular(F.col("embedding"), query), 6) >= 0.5)
    return M.forget(S.chunks(spark, d), F.col("start_time") >= F.lit("2024-06-01").cast("timestamp"), near)


@register(f"WITH {P('v', 'f')}, t AS (SELECT chunk_id, max(returned_at) AS m FROM f GROUP BY 1) SELECT v.id, greatest(last_accessed, t.m) AS last_accessed FROM v LEFT JOIN t ON t.chunk_id = v.id")
def touch_on_read(spark, d):
    log = S.feedback(spark, d).select(F.col("chunk_id").alias("id"), F.col("returned_at").alias("at"))
    return M.last_access(S.search_vectors(spark, d).select("id", "last_accessed"), log)


@register(f"WITH {P('c')} SELECT id, created_at FROM c")
def upsert_chunks(spark, d):
    """Replaying half of the chunks as new versions changes nothing but the version that is kept."""
    c = S.chunks(spark, d).select("id", "created_at")
    return L.upsert(c, c.filter("id > 'chunk-8'"), ["id"], "created_at")


@register(f"WITH {P('c')} SELECT id FROM c WHERE id <= 'chunk-8'")
def insert_or_ignore(spark, d):
    c = S.chunks(spark, d).select("id")
    return L.insert_missing(c.filter("id > 'chunk-8'"), c, ["id"])


@register(f"WITH {P('k')} SELECT id, CASE WHEN name IS NULL THEN 'unnamed' ELSE name END AS name, description FROM k")
def partial_update(spark, d):
    """Only the columns that a change gives are updated."""
    k = S.clusters(spark, d).select("id", "name", "description")
    return L.update_present(k, k.filter("name is null").select("id", F.lit("unnamed").alias("name")), "id").select("id", "name", "description")


@register(f"""WITH {P('c', 'e', 'a', 'v', 'k')}, p AS (SELECT id FROM c WHERE session_slug IN ('onyx-parser', 'kestrel-ranker')), pa AS (SELECT * FROM a WHERE chunk_id IN (SELECT id FROM p)) SELECT 'chunks' AS name, count(*) AS n FROM p UNION ALL SELECT 'edges', count(*) FROM e WHERE src IN (SELECT id FROM p) AND dst IN (SELECT id FROM p)
UNION ALL SELECT 'assignments', count(*) FROM pa UNION ALL SELECT 'clusters', count(*) FROM k WHERE id IN (SELECT cluster_id FROM pa) UNION ALL SELECT 'vectors', count(*) FROM v WHERE id IN (SELECT id FROM p)""")
def archive_round_trip(spark, d):
    """Two projects exported, encrypted, and read again."""
    tables = {"chunks": S.chunks(spark, d), "edges": S.edges(spark, d), "assignments": S.chunk_clusters(spark, d), "clusters": S.clusters(spark, d), "vectors": S.search_vectors(spark, d)}
    path = os.path.join(work_dir(spark), "tessera", f"archive-{uuid.uuid4().hex}")
    A.write_archive(A.select_archive(tables, ["onyx-parser", "kestrel-ranker"], paths=True, code=True), path, secret="0123456789abcdef")
    back = A.read_archive(spark, path, secret="0123456789abcdef")
    parts = [back[n].agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in A.TABLES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


def _streamed(spark, d, shape, key):
    """Run a stream over the events to its end and return the table that it keeps."""
    base = os.path.join(work_dir(spark), "tessera", f"stream-{uuid.uuid4().hex}")
    src = os.path.join(base, "in")
    read_table(spark, d, "events").repartition(4).write.parquet(src)
    stream = shape(feeds.event_stream(spark, src, watermark="3650 days", files_per_trigger=2))
    feeds.run_once(stream, os.path.join(base, "checkpoint"), feeds.upsert_into(os.path.join(base, "table"), key, "batch"))
    return spark.read.parquet(os.path.join(base, "table")).drop("batch", "folder")


@register("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    """Hourly counts by a stream of several batches, upserted; equal to the batch result."""
    t = _streamed(spark, d, lambda s: feeds.windowed_counts(s, "1 hour"), ["start", "event_type"])
    return t.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@register("WITH r AS (SELECT *, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), s AS (SELECT *, sum(CASE WHEN before IS NULL OR epoch_us(ts) - before >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM r) SELECT user_id, time_bucket(INTERVAL 1 MICROSECOND, min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, run")
def stream_sessions(spark, d):
    """30-minute sessions by a stream in event-time order of its files: a session is given once, when the watermark (an
    hour) has passed its end; what is still open at the end of the input is closed by a row far ahead."""
    base = os.path.join(work_dir(spark), "tessera", f"stream-{uuid.uuid4().hex}")
    src = os.path.join(base, "in")
    e = read_table(spark, d, "events")
    last = e.agg(F.max("ts").alias("t")).select(F.lit(-1).cast("long").alias("event_id"), (F.col("t") + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"))
    e.select("event_id", "ts", "user_id").repartitionByRange(4, "ts").write.parquet(src)
    last.coalesce(1).write.mode("append").parquet(src)
    stream = feeds.session_counts(feeds.event_stream(spark, src, "1 hour", "event_id long, ts timestamp_ntz, user_id long"), "30 minutes")
    feeds.run_once(stream, os.path.join(base, "checkpoint"), feeds.append_into(os.path.join(base, "table")), mode="append")
    return spark.read.parquet(os.path.join(base, "table")).filter("user_id >= 0").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@register("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type, CAST(ts AS DATE))")
def events_rollup(spark, d):
    """Counts and sums by type and day, by type, and of all."""
    e = read_table(spark, d, "events").select("event_type", F.col("ts").cast("date").alias("day"), "value")
    return e.rollup("event_type", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) t(k) GROUP BY 1, 2")
def stream_sliding(spark, d):
    return _streamed(spark, d, lambda s: feeds.windowed_counts(s, "1 hour", "30 minutes"), ["start", "event_type"]).select("start", "event_type", "n")
