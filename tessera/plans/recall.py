"""Recall and prediction, briefings, index entries, reclustering, ingestion end to end."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import fulltext, pipelines, retrieval
from tessera.operators import graph as G
from tessera.operators import transcripts as T
from tessera.operators.deliveries import first_deliveries
from tessera.operators.ranking import rank_within
from tessera.plans.registry import Registry
from tessera.plans.search import _PIPE, TERMS, _bm25_sql, _fused, _query_vector, _texts
from tessera.runtime import key_of, materialise, read_table
from tessera.sources import store as S
from tessera.sources.store import prelude as P

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


def _recall(spark, d, backward):
    hits = _fused(spark, d).orderBy(F.desc("score"), "id").limit(5).select("id", "score")
    v = S.search_vectors(spark, d)
    q = F.array(*[F.lit(x) for x in _query_vector(v)])
    scores = v.select("id", F.round(1 - V.angular(F.col("embedding"), q), 9).alias("score"))
    nodes = S.chunks(spark, d).select("id", F.col("approx_tokens").alias("tokens"))
    return pipelines.recall(materialise(hits, "hits"), S.forward_edges(spark, d), scores, nodes, 12, 20_000, backward)


@register()
def recall(spark, d):
    """What led to the best hits: the best chain backward in time."""
    return _recall(spark, d, True)


@register()
def predict(spark, d):
    """What came after the best hits."""
    return _recall(spark, d, False)


@register(f"WITH {P('c')}, {_bm25_sql('c', 'content', TERMS, 'kr')}, kw AS (SELECT id, round(score, 6) AS score FROM kr ORDER BY 2 DESC, id LIMIT 20) SELECT kw.id, kw.score, c.session_slug FROM kw JOIN c ON c.id = kw.id")
def keyword_primary_search(spark, d):
    t = _texts(spark, d)
    hits = fulltext.bm25(t, TERMS).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)
    return t.select("id", "session_slug").join(F.broadcast(hits), "id").select("id", "score", "session_slug")


@register(f"""WITH {P('k')}, {_bm25_sql('k', 'description', ['trouble'], 'kr')}, e AS (SELECT id, round(score, 6) AS score FROM kr ORDER BY 2 DESC, id LIMIT 20), x AS (SELECT lower(trim(unnest(k.exemplar_ids), E' \\t\\n\\r')) AS chunk_id, e.score FROM e JOIN k ON k.id = e.id)
SELECT chunk_id AS id, max(score) AS score FROM x WHERE chunk_id <> '' GROUP BY 1""")
def index_search(spark, d):
    """Search over descriptions, then back to the chunks that they describe, each with its best score."""
    k = S.clusters(spark, d)
    hits = fulltext.bm25(k.withColumn("text", F.col("description")), ["trouble"]).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)
    x = k.select("id", F.explode("exemplar_ids").alias("x")).join(F.broadcast(hits), "id").select(key_of("x").alias("id"), "score")
    return x.filter("id is not null").groupBy("id").agg(F.max("score").alias("score"))


@register(f"{_PIPE}, r AS (SELECT rrf.id, approx_tokens, sum(approx_tokens + 55) OVER (ORDER BY score DESC, rrf.id ROWS UNBOUNDED PRECEDING) AS run FROM rrf JOIN c ON c.id = rrf.id) SELECT b AS budget, count(*) FILTER (run + 200 <= b) AS survivors FROM r, (VALUES (1000), (3000), (8000), (20000)) t(b) GROUP BY 1")
def budget_survival(spark, d):
    """How many of the ranked results a response budget holds."""
    r = S.chunks(spark, d).select("id", "approx_tokens").join(F.broadcast(_fused(spark, d)), "id")
    w = Window.orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumn("run", F.sum(F.col("approx_tokens") + 55).over(w) + 200)
    budgets = F.explode(F.array(*[F.lit(b) for b in (1000, 3000, 8000, 20000)]))
    return r.select(budgets.alias("budget"), "run").groupBy("budget").agg(F.count(F.when(F.col("run") <= F.col("budget"), 1)).alias("survivors"))


@register(f"""WITH {P('c')}, s AS (SELECT session_id, arg_max(session_slug, (start_time, id)) AS session_slug, max(end_time) AS ended_at, count(*) AS n_chunks, list_sort(list_distinct(flatten(list(list_distinct(regexp_extract_all(content, 'src/[a-z]+/[a-z-]+\\.[a-z]+')))))) AS files FROM c GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY session_slug ORDER BY ended_at DESC, session_id) AS r FROM s) SELECT session_slug, session_id, ended_at, n_chunks, files FROM r WHERE r <= 3""")
def briefing(spark, d):
    """The last three sessions of each project with the files that they name."""
    at = F.struct("start_time", "id")
    files = F.array_distinct(F.regexp_extract_all("content", F.lit(r"src/[a-z]+/[a-z-]+\.[a-z]+"), 0))
    s = S.chunks(spark, d).withColumn("f", files).groupBy("session_id").agg(F.max_by("session_slug", at).alias("session_slug"), F.max("end_time").alias("ended_at"), F.count("*").alias("n_chunks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("f")))).alias("files"))
    return G.top_per(s, "session_slug", 3, F.desc("ended_at"), F.col("session_id")).drop("rank")


@register(f"""WITH {P('c', 'a')}, n AS (SELECT session_slug, cluster_id, count(*) AS n FROM c JOIN a ON a.chunk_id = c.id GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY session_slug ORDER BY n DESC, cluster_id) AS r FROM n) SELECT session_slug, cluster_id, n FROM r WHERE r <= 5""")
def session_start(spark, d):
    """The five clusters that matter most to each project."""
    n = S.chunk_clusters(spark, d).join(S.chunks(spark, d).select(F.col("id").alias("chunk_id"), "session_slug"), "chunk_id").groupBy("session_slug", "cluster_id").agg(F.count("*").alias("n"))
    return G.top_per(n, "session_slug", 5, F.desc("n"), F.col("cluster_id")).drop("rank")


@register(f"""WITH {P('c')}, t AS (SELECT id, (length(content) - length(replace(content, '```', ''))) / 3.0 / greatest(1, length(content)) AS ratio FROM c), r AS (SELECT id, row_number() OVER (ORDER BY round(ratio, 9), id) - 1 AS rank, count(*) OVER () AS n FROM t), k AS (SELECT DISTINCT CAST(floor(i * (n - 1) / 19.0 + 0.5) AS BIGINT) AS rank FROM range(20) x(i), (SELECT max(n) AS n FROM r)) SELECT id, r.rank FROM r JOIN k ON r.rank = k.rank""")
def code_ratio_sample(spark, d):
    """Twenty chunks spread evenly over the share of code fences (a sampling operator)."""
    ratio = F.round((F.length("content") - F.length(F.replace("content", F.lit("```"), F.lit("")))) / 3.0 / F.greatest(F.lit(1), F.length("content")), 9)
    r = rank_within(S.chunks(spark, d).select("id", ratio.alias("ratio")), [], ["ratio", "id"])
    n = r.agg(F.count("*").alias("n"))
    places = n.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.floor(i * (F.col("n") - 1) / 19.0 + 0.5)))).alias("rank"))
    return r.join(F.broadcast(places), "rank").select("id", "rank")


@register()
def cluster_labels(spark, d):
    """Names for clusters from the terms that set their chunks apart."""
    t = S.chunk_clusters(spark, d).join(S.chunks(spark, d).select(F.col("id").alias("chunk_id"), F.col("content").alias("text")), "chunk_id").select("cluster_id", F.col("chunk_id").alias("id"), "text")
    return pipelines.top_terms(t, "cluster_id")


@register()
def backfill_entries(spark, d):
    """Index entries for chunks without a cluster, newest first, 500 at most (a batch of the upkeep)."""
    c, newest = S.chunks(spark, d), (F.desc("created_at"), "id")
    rest = c.select("id", "created_at").join(S.chunk_clusters(spark, d).select(F.col("chunk_id").alias("id")), "id", "left_anti").orderBy(*newest).limit(500)
    batch = F.broadcast(materialise(rest.select("id"), "batch"))  # texts are not ranked, but described where they are scanned
    described = c.join(batch, "id").select("id", "created_at", X.heuristic_description(F.col("content")).alias("description"))
    return described.orderBy(*newest).limit(500).select("id", "description")


@register(f"""WITH {P('c')}, o AS (SELECT id, session_id, session_slug, lead(id) OVER w AS next_id, lead(session_id) OVER w = session_id AS same FROM c WINDOW w AS (PARTITION BY session_slug ORDER BY start_time, id)) SELECT CASE WHEN same THEN 'adjacent' ELSE 'cross_session' END AS kind, count(*) AS n, min(id) AS first_id FROM o WHERE next_id IS NOT NULL GROUP BY 1""")
def pair_samples(spark, d):
    """The labelled pairs that evaluations draw from: adjacent chunks, and neighbours across sessions."""
    w = Window.partitionBy("session_slug").orderBy("start_time", "id")
    o = S.chunks(spark, d).select("id", F.lead("id").over(w).alias("next_id"), (F.lead("session_id").over(w) == F.col("session_id")).alias("same"))
    return o.filter("next_id is not null").groupBy(F.when(F.col("same"), "adjacent").otherwise("cross_session").alias("kind")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@register()
def recluster(spark, d):
    """Clusters fitted anew, with stored names carried over."""
    v = S.search_vectors(spark, d).select("id", "embedding")
    unit = v.select("id", F.transform("embedding", lambda x: x / V.norm(F.col("embedding"))).alias("embedding"))
    old = S.clusters(spark, d).filter("name is not null").select("id", "name").join(S.chunk_clusters(spark, d).withColumnRenamed("cluster_id", "id"), "id").select(F.col("id").alias("grp"), F.col("chunk_id").alias("member"))
    r = pipelines.recluster(unit, old)
    sizes = r["assignments"].groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 6).alias("mean_distance"))
    return sizes.join(r["names"].select(F.col("new_group").alias("label"), F.col("old_group").alias("carried_from")), "label", "left")


@register()
def ingested_store(spark, d):
    """The log lines ingested end to end: rows per table of the new store."""
    m = first_deliveries(read_table(spark, d, "sample_session"), key_of("uuid"), "ingested_at").filter("type in ('user', 'assistant') and not coalesce(isSidechain, false)")
    m = m.select(F.col("key").alias("uuid"), key_of("sessionId").alias("session"), "type", F.col("message.content").alias("content"), F.unix_micros("ingested_at").alias("at"), "slug").filter("session is not null")
    out = pipelines.ingest(materialise(m, "messages"), 1024)
    parts = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
