"""Selections, joins, aggregations, rankings and set operations over the store."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import lookups as L
from tessera.plans.registry import Registry
from tessera.runtime import key_of, read_table
from tessera.sources import store as S
from tessera.sources.store import prelude as P

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

#: The project that examples ask for: the one with the most chunks (ties by name).
_TOP = "(SELECT session_slug FROM c WHERE session_slug <> '' GROUP BY 1 ORDER BY count(*) DESC, session_slug LIMIT 1)"


def _top_project(chunks):
    n = chunks.filter("session_slug <> ''").groupBy("session_slug").count()
    return F.broadcast(n.orderBy(F.desc("count"), "session_slug").limit(1).select("session_slug"))


def _of_top(chunks):
    return chunks.join(_top_project(chunks), "session_slug", "left_semi")


@register(f"WITH {P('c')} SELECT id, session_id, session_slug, approx_tokens, start_time FROM c")
def chunk_scan(spark, d):
    return S.chunks(spark, d).select("id", "session_id", "session_slug", "approx_tokens", "start_time")


@register(f"WITH {P('e')} SELECT id, src, dst, edge_type, weight FROM e")
def edge_scan(spark, d):
    return S.edges(spark, d).select("id", "src", "dst", "edge_type", "weight")


@register(f"WITH {P('v')} SELECT id, round(list_sum(list_transform(embedding, lambda x: x * x)), 4) AS squared FROM v")
def vector_scan_by_model(spark, d):
    v = S.search_vectors(spark, d)
    return v.select("id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 4).alias("squared"))


@register(f"WITH {P('c', 'a')} SELECT id, session_slug, approx_tokens FROM c WHERE id IN (SELECT chunk_id FROM a WHERE distance < 0.05)")
def chunks_by_keys(spark, d):
    return L.by_keys(S.chunks(spark, d), "id", S.chunk_clusters(spark, d).filter("distance < 0.05").select("chunk_id")).select("id", "session_slug", "approx_tokens")


@register(f"WITH {P('c')} SELECT id, session_id, start_time FROM c WHERE session_slug = {_TOP}")
def chunks_by_project(spark, d):
    return _of_top(S.chunks(spark, d)).select("id", "session_id", "start_time")


@register(f"WITH {P('c')} SELECT id, session_slug, start_time, approx_tokens FROM c WHERE start_time >= '2024-06-01' AND start_time < '2024-09-01'")
def time_range_chunks(spark, d):
    return L.time_range(S.chunks(spark, d), start="2024-06-01", end="2024-09-01").select("id", "session_slug", "start_time", "approx_tokens")


@register(f"WITH {P('c')} SELECT id FROM c WHERE session_slug = {_TOP} AND created_at < '2025-01-01' AND agent_id IS NULL AND approx_tokens > 100")
def conjunctive_filter(spark, d):
    return _of_top(S.chunks(spark, d)).filter("created_at < '2025-01-01' and agent_id is null and approx_tokens > 100").select("id")


@register(f"WITH {P('c')} SELECT session_id, max(end_time) AS ended_at FROM c GROUP BY 1 HAVING max(end_time) BETWEEN '2024-06-01' AND '2024-12-31'")
def sessions_ended_between(spark, d):
    return S.chunks(spark, d).groupBy("session_id").agg(F.max("end_time").alias("ended_at")).filter(F.col("ended_at").between("2024-06-01", "2024-12-31"))


@register(f"WITH {P('k')} SELECT id, description IS NOT NULL AS has_description, refreshed_at IS NULL OR refreshed_at < TIMESTAMP '2024-09-01' AS stale FROM k")
def cluster_staleness(spark, d):
    return S.clusters(spark, d).select("id", F.col("description").isNotNull().alias("has_description"), (F.col("refreshed_at").isNull() | (F.col("refreshed_at") < F.lit("2024-09-01").cast("timestamp"))).alias("stale"))


@register(f"WITH {P('k')} SELECT id, created_at FROM k WHERE lower(description) LIKE '%patient%' OR lower(description) LIKE '%trouble%' ORDER BY created_at DESC LIMIT 5")
def summary_search(spark, d):
    """OR-of-contains keyword search; the stop words and the short word of the query do not count."""
    return L.search_summaries(S.clusters(spark, d), "What about the trouble of a patient", "description", "created_at").select("id", "created_at")


@register(f"WITH {P('c')} SELECT session_id, count(*) > 0 AS ingested FROM c GROUP BY 1")
def session_ingested(spark, d):
    return S.chunks(spark, d).groupBy("session_id").agg((F.count("*") > 0).alias("ingested"))


@register(f"WITH {P('c', 'e')} SELECT c.id, (SELECT count(*) FROM e WHERE src = c.id) AS n_out, (SELECT count(*) FROM e WHERE dst = c.id) AS n_in, (SELECT count(*) FROM e WHERE src = c.id AND edge_type = 'forward') AS n_forward FROM c")
def edges_of_chunk(spark, d):
    e = S.edges(spark, d)
    out = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"), F.count(F.when(F.col("edge_type") == "forward", 1)).alias("n_forward"))
    into = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))
    return S.chunks(spark, d).select("id").join(out, "id", "left").join(into, "id", "left").na.fill(0).select("id", "n_out", "n_in", "n_forward")


@register(f"WITH {P('c')}, t AS (SELECT id, agent_id FROM c ORDER BY start_time DESC, id LIMIT 50) SELECT id FROM t WHERE agent_id IS NULL")
def agent_filter_after_limit(spark, d):
    """The filter comes after the limit, as in searches over all projects."""
    return S.chunks(spark, d).orderBy(F.desc("start_time"), "id").limit(50).filter("agent_id is null").select("id")


@register(f"WITH {P('c', 'a')} SELECT a.cluster_id, c.id, round(a.distance, 6) AS distance FROM c JOIN a ON a.chunk_id = c.id")
def cluster_members(spark, d):
    c = S.chunks(spark, d).select("id")
    return S.chunk_clusters(spark, d).join(c, F.col("chunk_id") == c.id).select("cluster_id", "id", F.round("distance", 6).alias("distance"))


@register(f"""WITH {P('c', 'a')} SELECT a.cluster_id, count(*) AS n_all, CAST(sum(CASE WHEN c.session_slug = {_TOP} THEN 1 ELSE 0 END) AS BIGINT) AS n_project,
  round(sum(CASE WHEN c.session_slug = {_TOP} THEN 1 ELSE 0 END) / count(*), 6) AS relevance FROM c JOIN a ON a.chunk_id = c.id GROUP BY 1 HAVING sum(CASE WHEN c.session_slug = {_TOP} THEN 1 ELSE 0 END) > 0""")
def cluster_project_relevance(spark, d):
    c = S.chunks(spark, d)
    c = c.join(_top_project(c).withColumn("own", F.lit(1)), "session_slug", "left").select("id", F.coalesce("own", F.lit(0)).alias("own"))
    j = S.chunk_clusters(spark, d).join(c, F.col("chunk_id") == c.id)
    return j.groupBy("cluster_id").agg(F.count("*").alias("n_all"), F.sum("own").cast("long").alias("n_project"), F.round(F.sum("own") / F.count("*"), 6).alias("relevance")).filter("n_project > 0")


@register(f"WITH {P('c', 'a')} SELECT id, created_at FROM c WHERE id NOT IN (SELECT chunk_id FROM a) ORDER BY created_at DESC, id LIMIT 100")
def unindexed_chunks(spark, d):
    c = S.chunks(spark, d).select("id", "created_at")
    return c.join(S.chunk_clusters(spark, d).select(F.col("chunk_id").alias("id")), "id", "left_anti").orderBy(F.desc("created_at"), "id").limit(100)


@register(f"WITH {P('c', 'f')} SELECT chunk_id, count(*) AS n, count(DISTINCT tool_name) AS n_tools FROM f JOIN c ON c.id = f.chunk_id GROUP BY 1 ORDER BY n DESC, chunk_id LIMIT 20")
def top_chunks(spark, d):
    c = S.chunks(spark, d).select(F.col("id").alias("chunk_id"))
    return S.feedback(spark, d).join(c, "chunk_id").groupBy("chunk_id").agg(F.count("*").alias("n"), F.countDistinct("tool_name").alias("n_tools")).orderBy(F.desc("n"), "chunk_id").limit(20)


@register(f"WITH {P('c', 'f')} SELECT session_slug, count(*) AS n, count(DISTINCT chunk_id) AS n_chunks FROM f JOIN c ON c.id = f.chunk_id GROUP BY 1")
def project_retrievals(spark, d):
    c = S.chunks(spark, d).select(F.col("id").alias("chunk_id"), "session_slug")
    return S.feedback(spark, d).join(c, "chunk_id").groupBy("session_slug").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("n_chunks"))


@register(f"WITH {P('c', 'e')} SELECT id, src, dst FROM e WHERE src IN (SELECT id FROM c WHERE session_slug = {_TOP}) AND dst IN (SELECT id FROM c WHERE session_slug = {_TOP})")
def both_endpoint_edges(spark, d):
    return L.both_ends_within(S.edges(spark, d), _of_top(S.chunks(spark, d)).select("id")).select("id", "src", "dst")


@register(f"WITH {P('c', 'a', 'k')} SELECT id FROM k WHERE id NOT IN (SELECT cluster_id FROM a WHERE chunk_id IN (SELECT id FROM c))")
def empty_clusters(spark, d):
    kept = S.chunk_clusters(spark, d).join(S.chunks(spark, d).select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").select(F.col("cluster_id").alias("id"))
    return S.clusters(spark, d).join(kept, "id", "left_anti").select("id")


@register("""WITH p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), q AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'),
j AS (SELECT p.event_id, q.event_id AS target_id, q.ts AS qt, abs(epoch_us(p.ts) - epoch_us(q.ts)) AS away FROM p JOIN q ON p.user_id = q.user_id AND abs(epoch_us(p.ts) - epoch_us(q.ts)) <= 600000000),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY away, qt, target_id) AS r FROM j) SELECT event_id, target_id, away // 1000 AS away_ms FROM r WHERE r = 1""")
def nearest_event_asof(spark, d):
    e = read_table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at"), "event_type")
    left = e.filter("event_type = 'purchase'").select("user_id", "event_id", "at")
    right = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("target_id"), "at")
    return L.nearest_in_time(left, right, ["user_id"], 600)


@register(f"WITH {P('c')} SELECT t AS turn, session_id, id FROM (SELECT DISTINCT unnest(turn_indices) AS t, session_id, id FROM c) WHERE t IS NOT NULL")
def chunks_of_turn(spark, d):
    return S.chunks(spark, d).select(F.explode("turn_indices").alias("turn"), "session_id", "id").filter("turn is not null").distinct()


_SESSIONS = "s AS (SELECT session_slug, session_id, min(start_time) AS first_start, max(end_time) AS last_end, count(*) AS n_chunks, CAST(coalesce(sum(approx_tokens), 0) AS BIGINT) AS total_tokens FROM c GROUP BY 1, 2)"


@register(f"WITH {P('c')}, {_SESSIONS} SELECT session_slug, session_id, lag(session_id) OVER w AS previous_id, lag(last_end) OVER w AS previous_end FROM s WINDOW w AS (PARTITION BY session_slug ORDER BY first_start, session_id)")
def previous_session(spark, d):
    return L.previous_session(L.session_summary(S.chunks(spark, d))).select("session_slug", "session_id", "previous_id", "previous_end")


@register(f"WITH {P('c')}, {_SESSIONS} SELECT * FROM s")
def sessions_for_project(spark, d):
    return L.session_summary(S.chunks(spark, d))


@register(f"WITH {P('c')} SELECT session_slug, count(*) AS n_chunks, min(start_time) AS first_seen, max(start_time) AS last_seen FROM c WHERE session_slug <> '' GROUP BY 1")
def projects_summary(spark, d):
    return L.project_summary(S.chunks(spark, d))


@register(f"WITH {P('c', 'e', 'k', 'a')} SELECT (SELECT count(*) FROM c) AS n_chunks, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM k) AS n_clusters, (SELECT count(*) FROM a) AS n_assignments, (SELECT count(DISTINCT agent_id) FROM c) AS n_agents")
def store_counts(spark, d):
    one = lambda df, n: df.agg(F.count("*").alias(n))
    c = S.chunks(spark, d).agg(F.count("*").alias("n_chunks"), F.countDistinct("agent_id").alias("n_agents"))
    return c.join(one(S.edges(spark, d), "n_edges")).join(one(S.clusters(spark, d), "n_clusters")).join(one(S.chunk_clusters(spark, d), "n_assignments"))


_BUCKETS = ((200, "0-200"), (500, "200-500"), (1000, "500-1K"), (2000, "1K-2K"), (5000, "2K-5K"))


@register(f"WITH {P('c')} SELECT CASE " + " ".join(f"WHEN approx_tokens < {n} THEN '{s}'" for n, s in _BUCKETS) + " ELSE '5K+' END AS bucket, count(*) AS n, min(approx_tokens) AS least FROM c GROUP BY 1")
def size_buckets(spark, d):
    b = F
    for n, s in _BUCKETS:
        b = b.when(F.col("approx_tokens") < n, s)
    return S.chunks(spark, d).groupBy(b.otherwise("5K+").alias("bucket")).agg(F.count("*").alias("n"), F.min("approx_tokens").alias("least"))


@register(f"WITH {P('c')} SELECT CAST(date_trunc('week', start_time) AS DATE) AS week, count(*) AS n FROM c GROUP BY 1")
def weekly_monday(spark, d):
    return S.chunks(spark, d).groupBy(F.date_trunc("week", "start_time").cast("date").alias("week")).agg(F.count("*").alias("n"))


@register(f"WITH {P('f')} SELECT CAST(date_trunc('week', CAST(returned_at AS DATE) - 1) AS DATE) + 1 AS week, count(*) AS n FROM f GROUP BY 1")
def weekly_tuesday(spark, d):
    """Weeks from Tuesday to Monday, named by the Tuesday."""
    day = F.col("returned_at").cast("date")
    return S.feedback(spark, d).groupBy(F.date_add(F.date_trunc("week", F.date_sub(day, 1)).cast("date"), 1).alias("week")).agg(F.count("*").alias("n"))


@register(f"WITH {P('f')} SELECT tool_name, count(*) AS n FROM f GROUP BY 1")
def tool_usage(spark, d):
    return S.feedback(spark, d).groupBy("tool_name").agg(F.count("*").alias("n"))


@register(f"WITH {P('f')} SELECT chunk_id, count(*) AS n, round(log2(1 + count(*)), 6) AS score FROM f GROUP BY 1")
def feedback_scores(spark, d):
    return S.feedback(spark, d).groupBy("chunk_id").agg(F.count("*").alias("n"), F.round(F.log2(1 + F.count("*")), 6).alias("score"))


@register("SELECT event_type, count(*) AS n, coalesce(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END), 0)::BIGINT AS hits, round(coalesce(avg(value), 0), 6) AS mean FROM events GROUP BY 1")
def cache_stats(spark, d):
    e = read_table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("value") > 50).cast("long")), F.lit(0)).cast("long").alias("hits"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("mean"))


@register(f"WITH {P('e')} SELECT edge_type, reference_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM e), 6) AS share FROM e GROUP BY 1, 2")
def edge_type_distribution(spark, d):
    e = S.edges(spark, d)
    return e.groupBy("edge_type", "reference_type").agg(F.count("*").alias("n")).join(F.broadcast(e.agg(F.count("*").alias("total")))).select("edge_type", "reference_type", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("share"))


@register(f"WITH {P('c')}, n AS (SELECT session_id, count(*) AS n FROM c GROUP BY 1) SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, median(n) AS median FROM n")
def session_size_stats(spark, d):
    n = S.chunks(spark, d).groupBy("session_id").agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median"))


_PCT = " UNION ALL ".join(f"SELECT '{n}' AS name, (SELECT list_sort(list(approx_tokens))[least(CAST(floor(count(*) * {p}) AS BIGINT) + 1, count(*))] FROM c) AS value" for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))


@register(f"WITH {P('c')} {_PCT}")
def percentiles_floor(spark, d):
    """Percentiles by index floor(n p), from counts of distinct values."""
    c = S.chunks(spark, d)
    parts = [L.histogram_percentile(c, "approx_tokens", p).select(F.lit(n).alias("name"), "value") for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(f"WITH {P('a')} SELECT cluster_id, substr(sha256(string_agg(chunk_id, ',' ORDER BY chunk_id)), 1, 16) AS membership_hash FROM a GROUP BY 1")
def membership_hash(spark, d):
    return S.chunk_clusters(spark, d).groupBy("cluster_id").agg(L.set_hash(F.collect_list("chunk_id")).alias("membership_hash"))


@register(f"WITH {P('a', 'k')}, n AS (SELECT cluster_id, count(*) AS n FROM a GROUP BY 1) SELECT (SELECT count(*) FROM k) AS n_clusters, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_assigned, round(coalesce(avg(n), 0), 6) AS mean, coalesce(max(n), 0) AS most, coalesce(min(n), 0) AS least FROM n")
def cluster_stats(spark, d):
    n = S.chunk_clusters(spark, d).groupBy("cluster_id").agg(F.count("*").alias("n"))
    z = F.lit(0)
    return S.clusters(spark, d).agg(F.count("*").alias("n_clusters")).join(n.agg(F.coalesce(F.sum("n"), z).alias("n_assigned"), F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("mean"), F.coalesce(F.max("n"), z).alias("most"), F.coalesce(F.min("n"), z).alias("least")))


@register(f"WITH {P('c')} SELECT regexp_extract(project_path, '[^/]+$') AS name, count(*) AS n_chunks, count(DISTINCT session_id) AS n_sessions FROM c WHERE project_path IS NOT NULL GROUP BY 1 HAVING count(*) >= 20 ORDER BY n_chunks DESC, name LIMIT 25")
def projects_rolled_up(spark, d):
    name = F.regexp_extract("project_path", "[^/]+$", 0)
    return S.chunks(spark, d).filter("project_path is not null").groupBy(name.alias("name")).agg(F.count("*").alias("n_chunks"), F.countDistinct("session_id").alias("n_sessions")).filter("n_chunks >= 20").orderBy(F.desc("n_chunks"), "name").limit(25)


@register(f"WITH {P('c')} SELECT session_slug, round(avg(approx_tokens), 4) AS mean, round(stddev_pop(approx_tokens), 4) AS deviation, min(approx_tokens) AS least, max(approx_tokens) AS most, list_sort(list(approx_tokens))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper_median FROM c GROUP BY 1")
def token_statistics(spark, d):
    values = F.array_sort(F.collect_list("approx_tokens"))
    return S.chunks(spark, d).groupBy("session_slug").agg(F.round(F.avg("approx_tokens"), 4).alias("mean"), F.round(F.stddev_pop("approx_tokens"), 4).alias("deviation"), F.min("approx_tokens").alias("least"), F.max("approx_tokens").alias("most"), L.nth_smallest_index(values, 0.5).alias("upper_median"))


@register(f"WITH {P('c')}, r AS (SELECT session_slug, approx_tokens, row_number() OVER (PARTITION BY session_slug ORDER BY approx_tokens, id) AS r FROM c) SELECT session_slug, approx_tokens AS fifth FROM r WHERE r = 5")
def kth_smallest(spark, d):
    w = Window.partitionBy("session_slug").orderBy("approx_tokens", "id")
    return S.chunks(spark, d).withColumn("r", F.row_number().over(w)).filter("r = 5").select("session_slug", F.col("approx_tokens").alias("fifth"))


@register("SELECT subject, count(*) FILTER (labeller = 'rater-a') AS rater_a, count(*) FILTER (labeller = 'rater-b') AS rater_b, count(*) FILTER (labeller = 'rater-c') AS rater_c FROM doc_labels GROUP BY 1")
def labels_by_rater(spark, d):
    t = read_table(spark, d, "doc_labels").groupBy("subject").pivot("labeller", ["rater-a", "rater-b", "rater-c"]).count().na.fill(0)
    return t.toDF("subject", "rater_a", "rater_b", "rater_c")


@register(f"WITH {P('c')} SELECT session_id, id, lead(id) OVER w AS next_id, lag(id) OVER w AS previous_id FROM c WINDOW w AS (PARTITION BY session_id ORDER BY start_time, id)")
def neighbours_in_session(spark, d):
    w = Window.partitionBy("session_id").orderBy("start_time", "id")
    return S.chunks(spark, d).select("session_id", "id", F.lead("id").over(w).alias("next_id"), F.lag("id").over(w).alias("previous_id"))


@register(f"WITH {P('f')}, r AS (SELECT *, lag(epoch_us(returned_at)) OVER w AS before FROM f WINDOW w AS (PARTITION BY chunk_id, tool_name ORDER BY returned_at, event_id)), s AS (SELECT *, CAST(sum(CASE WHEN before IS NULL OR epoch_us(returned_at) - before > 5000000 THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id, tool_name ORDER BY returned_at, event_id) AS BIGINT) AS run FROM r) SELECT chunk_id, tool_name, run, count(*) AS n, min(returned_at) AS first FROM s GROUP BY 1, 2, 3")
def retrieval_bursts(spark, d):
    """Runs of the same chunk and tool with gaps of at most 5 seconds."""
    r = L.gap_sessions(S.feedback(spark, d), ["chunk_id", "tool_name"], "returned_at", 5, "event_id")
    return r.groupBy("chunk_id", "tool_name", "run").agg(F.count("*").alias("n"), F.min("returned_at").alias("first"))


@register("WITH r AS (SELECT *, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), s AS (SELECT *, CAST(sum(CASE WHEN before IS NULL OR epoch_us(ts) - before >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM r) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, run")
def sessionize_gap(spark, d):
    """30-minute sessions per user by the built-in session window, whose state is merged without sorting a user's rows."""
    e = read_table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "30 minutes")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("session_window")


@register(f"WITH {P('f')} SELECT event_id, list(chunk_id) OVER (PARTITION BY tool_name ORDER BY returned_at, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS context FROM f")
def sliding_context(spark, d):
    w = Window.partitionBy("tool_name").orderBy("returned_at", "event_id").rowsBetween(-3, -1)
    got = F.collect_list("chunk_id").over(w)
    return S.feedback(spark, d).select("event_id", F.when(F.size(got) > 0, got).alias("context"))


@register(f"WITH {P('c')} SELECT id, start_time FROM c WHERE session_slug = {_TOP} ORDER BY start_time DESC, id DESC LIMIT 15")
def recent_chunks(spark, d):
    return L.newest(_of_top(S.chunks(spark, d)).select("id", "start_time"), "start_time", 15)


@register(f"WITH {P('c')} SELECT id, start_time FROM c WHERE start_time < TIMESTAMPTZ '2025-01-01 00:00:00+00' ORDER BY start_time DESC, id DESC LIMIT 15")
def chunks_before(spark, d):
    return L.newest(S.chunks(spark, d).filter(F.col("start_time") < F.lit("2025-01-01").cast("timestamp")).select("id", "start_time"), "start_time", 15)


@register(f"WITH {P('c')} SELECT id, session_slug, (SELECT count(*) FROM c) AS total FROM c ORDER BY start_time DESC, id LIMIT 50 OFFSET 100")
def paginate_chunks(spark, d):
    c = S.chunks(spark, d).select("id", "session_slug", "start_time")
    return L.page(c, [F.desc("start_time"), "id"], 50, 2).join(F.broadcast(c.agg(F.count("*").alias("total")))).select("id", "session_slug", "total")


@register(f"WITH {P('e')} SELECT id, weight FROM e ORDER BY weight DESC, id LIMIT 100")
def paginate_edges(spark, d):
    return L.page(S.edges(spark, d).select("id", "weight"), [F.desc("weight"), "id"], 100, 0)


@register(f"WITH {P('v')} SELECT id, last_accessed FROM v ORDER BY last_accessed NULLS FIRST, id LIMIT 20")
def oldest_vectors(spark, d):
    return S.search_vectors(spark, d).select("id", "last_accessed").orderBy(F.asc_nulls_first("last_accessed"), "id").limit(20)


@register(f"WITH {P('c')}, s AS (SELECT session_slug, session_id, max(end_time) AS ended_at FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY session_slug ORDER BY ended_at DESC, session_id) AS r FROM s) SELECT session_slug, session_id, ended_at FROM r WHERE r <= 3")
def recent_sessions_per_project(spark, d):
    w = Window.partitionBy("session_slug").orderBy(F.desc("ended_at"), "session_id")
    s = S.chunks(spark, d).groupBy("session_slug", "session_id").agg(F.max("end_time").alias("ended_at"))
    return s.withColumn("r", F.row_number().over(w)).filter("r <= 3").drop("r")


@register(f"WITH {P('c')} SELECT DISTINCT session_slug, session_id FROM c")
def distinct_sessions(spark, d):
    return S.chunks(spark, d).select("session_slug", "session_id").distinct()


@register(f"WITH {P('c', 'e', 'a')} SELECT id FROM c WHERE id NOT IN (SELECT src FROM e) AND id NOT IN (SELECT dst FROM e) AND id NOT IN (SELECT chunk_id FROM a)")
def orphan_chunks(spark, d):
    e = S.edges(spark, d)
    used = e.select(F.col("src").alias("id")).union(e.select("dst")).union(S.chunk_clusters(spark, d).select("chunk_id"))
    return S.chunks(spark, d).select("id").join(used, "id", "left_anti")


@register(f"WITH {P('c', 'k')}, x AS (SELECT lower(trim(x, E' \\t\\n\\r')) AS id FROM (SELECT unnest(exemplar_ids) AS x FROM k)) SELECT id FROM c WHERE id IN (SELECT id FROM x)")
def exemplar_intersection(spark, d):
    x = S.clusters(spark, d).select(F.explode("exemplar_ids").alias("x")).select(key_of("x").alias("id"))
    return S.chunks(spark, d).select("id").intersect(x)


@register(f"""WITH {P('a')}, x AS (SELECT chunk_id, cluster_id, coalesce(distance, 1) AS d FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY d, cluster_id) AS r FROM x) SELECT chunk_id, cluster_id, round(1 - d, 6) AS score FROM r WHERE r = 1""")
def first_assignment(spark, d):
    """Order-preserving de-duplication: the nearest cluster of each chunk."""
    best = F.min(F.struct(F.coalesce("distance", F.lit(1.0)).alias("d"), "cluster_id"))
    return S.chunk_clusters(spark, d).groupBy("chunk_id").agg(best.alias("b")).select("chunk_id", F.col("b.cluster_id").alias("cluster_id"), F.round(1 - F.col("b.d"), 6).alias("score"))


@register(f"""WITH {P('k')}, x AS (SELECT id AS entry, lower(trim(unnest(exemplar_ids), E' \\t\\n\\r')) AS chunk_id, len(exemplar_ids) AS n FROM k) SELECT chunk_id, max(n) AS best, count(DISTINCT entry) AS n_entries FROM x WHERE chunk_id <> '' GROUP BY 1""")
def dereference_entries(spark, d):
    """Index entries (clusters with their exemplars) back to chunks: distinct, with the largest score."""
    x = S.clusters(spark, d).select(F.col("id").alias("entry"), F.size("exemplar_ids").alias("n"), F.explode("exemplar_ids").alias("x"))
    return x.select("entry", "n", key_of("x").alias("chunk_id")).filter("chunk_id is not null").groupBy("chunk_id").agg(F.max("n").alias("best"), F.countDistinct("entry").alias("n_entries"))


@register(f"""WITH {P('a', 'k')}, o AS (SELECT id AS grp, lower(trim(unnest(exemplar_ids), E' \\t\\n\\r')) AS member FROM k), n AS (SELECT cluster_id AS grp, chunk_id AS member FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(distance, 1), chunk_id) AS r FROM a) WHERE r <= 3),
oo AS (SELECT DISTINCT * FROM o WHERE member <> ''), m AS (SELECT oo.grp AS old_group, n.grp AS new_group, count(*) AS n FROM oo JOIN n ON oo.member = n.member GROUP BY 1, 2)
SELECT old_group, new_group, round(n / ((SELECT count(*) FROM oo WHERE grp = old_group) + (SELECT count(*) FROM n WHERE grp = new_group) - n), 6) AS overlap FROM m
WHERE n / ((SELECT count(*) FROM oo WHERE grp = old_group) + (SELECT count(*) FROM n WHERE grp = new_group) - n) >= 0.2""")
def cluster_overlap(spark, d):
    w = Window.partitionBy("cluster_id").orderBy(F.coalesce("distance", F.lit(1.0)), "chunk_id")
    old = S.clusters(spark, d).select(F.col("id").alias("grp"), F.explode("exemplar_ids").alias("x")).select("grp", key_of("x").alias("member")).filter("member is not null")
    new = S.chunk_clusters(spark, d).withColumn("r", F.row_number().over(w)).filter("r <= 3").select(F.col("cluster_id").alias("grp"), F.col("chunk_id").alias("member"))
    return L.jaccard_matches(old, new, 0.2).withColumn("overlap", F.round("overlap", 6))


@register()
def cluster_label_carry_over(spark, d):
    """Greedy one-to-one matching of old and new clusters by overlap: which new cluster keeps which old name."""
    return L.one_to_one(cluster_overlap(spark, d), "old_group", "new_group", "overlap")


@register(f"""WITH {P('e')}, p AS (SELECT src, dst, count(*) AS n, min(created_at) AS first FROM e GROUP BY 1, 2) SELECT src, dst, n, first FROM p""")
def distinct_pairs(spark, d):
    return S.edges(spark, d).groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("created_at").alias("first"))


@register("""WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders), c AS (SELECT c_custkey, c_nationkey FROM customer), n AS (SELECT n_nationkey, n_name FROM nation)
SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM o JOIN c ON o_custkey = c_custkey JOIN n ON c_nationkey = n_nationkey GROUP BY 1""")
def orders_by_nation(spark, d):
    c, n = read_table(spark, d, "customer"), read_table(spark, d, "nation")
    j = read_table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, d):
    l = read_table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"))


@register("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) + grouping(l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def lineitem_cube(spark, d):
    return read_table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), (F.grouping("l_returnflag").cast("long") + F.grouping("l_linestatus").cast("long")).alias("level"))


@register("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark, d):
    return read_table(spark, d, "customer").join(read_table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
