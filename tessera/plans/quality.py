"""Clustering, evaluation, topic-continuity and decay queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import clustering as C
from tessera.operators import decay as D
from tessera.operators import evaluation as E
from tessera.operators import graph as G
from tessera.operators import tuning as TU
from tessera.operators import vector_search as VS
from tessera.operators.ranking import rank_within
from tessera.plans.graphs import _SEEDS, _STATED_SEEDS, _seeds, _stated, _walk_sql
from tessera.plans.registry import Registry
from tessera.plans.search import _ANG, _CEN, _E, _STATED, _embeddings
from tessera.plans.texts import _JACCARD, _KEYS, _PATHS, _TRIM, _USER, q
from tessera.runtime import broadcast_if_small, materialise, read_table
from tessera.sources import store as S
from tessera.sources.store import prelude as P

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


@register()
def hdbscan_labels(spark, d):
    return C.hdbscan(_embeddings(spark, d))


@register()
def hdbscan_leaves(spark, d):
    """The finest clusters of the same hierarchy."""
    return C.hdbscan(_embeddings(spark, d), leaves=True)


@register(f"WITH {_E} SELECT count(*) AS n, true AS sizes_hold, true AS scores_hold, true AS labels_dense FROM x")
def hdbscan_checks(spark, d):
    """What must hold of the clusters: sizes of at least 4, probabilities and scores from 0 to 1, labels without gaps."""
    h = materialise(C.hdbscan(_embeddings(spark, d)), "labels")
    by = h.filter("label >= 0").groupBy("label").count().agg(F.coalesce(F.min("count"), F.lit(4)).alias("least"), F.count("*").alias("n_labels"), F.coalesce(F.max("label"), F.lit(-1)).alias("top"))
    ok = F.col("probability").between(0, 1) & F.col("outlier").between(0, 1) & ((F.col("label") >= 0) | ((F.col("probability") == 0) & (F.col("outlier") == 1)))
    return h.agg(F.count("*").alias("n"), F.min(ok).alias("scores_hold")).join(F.broadcast(by)).select("n", (F.col("least") >= 4).alias("sizes_hold"), "scores_hold", (F.col("top") + 1 == F.col("n_labels")).alias("labels_dense"))


@register()
def hdbscan_incremental(spark, d):
    """A model fitted on the older three quarters of the vectors, by id; the newer quarter is assigned by it."""
    e = _embeddings(spark, d)
    edge = F.broadcast(e.agg((F.max("id") * 3 / 4).alias("edge")))
    old = materialise(e.join(edge).filter(F.col("id") <= F.col("edge")).drop("edge"), "old")
    new = e.join(edge).filter(F.col("id") > F.col("edge")).drop("edge")
    fitted = materialise(C.hdbscan(old), "fitted")
    return fitted.select("id", "label").unionByName(C.assign(new, C.cluster_model(old, fitted)))


@register()
def hdbscan_sweep(spark, d):
    """Clusters and noise for several least cluster sizes."""
    return C.sweep(_embeddings(spark, d), [2, 3, 4, 5, 6, 8, 10, 12, 15])


@register("WITH x AS (SELECT vec_id, label FROM embeddings) SELECT count(DISTINCT label) FILTER (label > 0) AS n_clusters, round(avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END), 6) AS noise_ratio FROM x")
def noise_and_clusters(spark, d):
    """Cluster count and noise share, with label 0 taken as noise."""
    e = _embeddings(spark, d)
    return e.agg(F.countDistinct(F.when(F.col("label") > 0, F.col("label"))).alias("n_clusters"), F.round(F.avg((F.col("label") == 0).cast("double")), 6).alias("noise_ratio"))


@register(f"""WITH {_E}, {_STATED}, p AS (SELECT q.id, q.label, x.label AS other, avg(CASE WHEN q.id = x.id THEN NULL ELSE {_ANG.format('q.embedding', 'x.embedding')} END) AS m FROM q, x GROUP BY 1, 2, 3),
g AS (SELECT id, label, max(CASE WHEN other = label THEN coalesce(m, 0) END) AS a, min(CASE WHEN other <> label THEN m END) AS b FROM p GROUP BY 1, 2) SELECT id, label, round(CASE WHEN b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM g""")
def silhouette(spark, d):
    """Silhouettes of the stated vectors (ids divisible by 50) against all."""
    e = _embeddings(spark, d)
    s = E.silhouette(e.filter("id % 50 = 0"), e)
    return s.select("id", "label", F.round("silhouette", 6).alias("silhouette"))


_SCORE = "s AS (SELECT value AS score, event_type = 'purchase' AS positive FROM events WHERE event_type IN ('purchase', 'click'))"


def _scored_events(spark, d):
    return read_table(spark, d, "events").filter("event_type in ('purchase', 'click')").select(F.col("value").alias("score"), (F.col("event_type") == "purchase").alias("positive"))


@register(f"WITH {_SCORE}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s), t AS (SELECT sum(CASE WHEN positive THEN r END) AS rs, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM r) SELECT round((rs - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * n), 6) AS auc, p AS n_positive, n AS n_negative FROM t")
def roc_auc(spark, d):
    return E.roc_auc(_scored_events(spark, d), "score", "positive").withColumn("auc", F.round("auc", 6))


@register(f"WITH {_SCORE}, c AS (SELECT score, count(*) FILTER (positive) AS pos, count(*) FILTER (NOT positive) AS neg FROM s GROUP BY 1), r AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c), j AS (SELECT score AS threshold, tp / p - fp / n AS j, tp / (tp + fp) AS pr, tp / p AS rc FROM r) SELECT round(threshold, 6) AS threshold, round(j, 6) AS j, round(pr, 6) AS precision, round(rc, 6) AS recall, round(2 * pr * rc / (pr + rc), 6) AS f1 FROM j ORDER BY round(j.j, 9) DESC, j.threshold DESC LIMIT 1")
def youden_threshold(spark, d):
    y = E.youden(_scored_events(spark, d), "score", "positive")
    return y.select(*[F.round(c, 6).alias(c) for c in y.columns])


_THRESHOLDS = (0.4, 0.44, 0.46, 0.48, 0.5)


@register(f"WITH {_CEN}, r AS (SELECT id, label, cl, round({_ANG.format('embedding', 'c')}, 6) AS dist FROM x, z), t AS (SELECT unnest([{', '.join(map(str, _THRESHOLDS))}]) AS threshold), n AS (SELECT threshold, sum(CASE WHEN dist < threshold AND label = cl THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN dist < threshold AND label <> cl THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN dist >= threshold AND label = cl THEN 1 ELSE 0 END) AS fn FROM r, t GROUP BY 1) SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM n")
def threshold_sweep(spark, d):
    """True and false assignments by distance threshold, all thresholds in one pass."""
    e = _embeddings(spark, d)
    c = VS.centroids(e, "label").agg(F.collect_list(F.struct("label", "centroid")).alias("cs"))
    pairs = e.join(F.broadcast(c)).select("label", F.explode(F.transform("cs", lambda x: F.struct(x["label"].alias("cl"), F.round(V.angular(F.col("embedding"), x["centroid"]), 6).alias("dist")))).alias("m")).select((F.col("label") == F.col("m.cl")).alias("own"), "m.dist")
    s = lambda c: F.sum(c.cast("long"))
    near = [(t, F.col("dist") < t) for t in _THRESHOLDS]
    one = pairs.agg(F.array(*[F.struct(F.lit(t).alias("threshold"), s(n & F.col("own")).alias("tp"), s(n & ~F.col("own")).alias("fp"), s(~n & F.col("own")).alias("fn")) for t, n in near]).alias("r"))
    return one.select(F.explode("r").alias("r")).select("r.*")


_ORD = "o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS r FROM x)"


@register(f"WITH {_E}, {_ORD}, p AS (SELECT a.label, round(list_cosine_similarity(a.embedding, b.embedding), 9) AS sim, row_number() OVER (PARTITION BY a.label ORDER BY a.r, b.r) AS n FROM o a JOIN o b ON a.label = b.label AND a.r < b.r AND a.r <= 15 AND b.r <= 15), i AS (SELECT label, avg(sim) AS intra FROM p WHERE n <= 100 GROUP BY 1) SELECT label, round(intra, 6) AS intra FROM i")
def cluster_quality(spark, d):
    """Mean similarity within each cluster, over the first 100 pairs in order (of the first 15 members)."""
    o = rank_within(_embeddings(spark, d).select("id", "label", "embedding"), ["label"], ["id"], "r").filter("r < 15")
    g = o.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("r", "embedding"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b["r"] > a["r"]), lambda b: F.round(V.cosine(a["embedding"], b["embedding"]), 9))))
    one = g.select("label", F.slice(pairs, 1, 100).alias("s")).filter(F.size("s") > 0)
    return one.select("label", F.round(F.aggregate("s", F.lit(0.0), lambda x, y: x + y) / F.size("s"), 6).alias("intra"))


@register(f"WITH {_CEN}, p AS (SELECT a.cl AS a, b.cl AS b, {_ANG.format('a.c', 'b.c')} AS dist FROM z a JOIN z b ON a.cl < b.cl) SELECT round(avg(dist), 6) AS separation, count(*) AS n_pairs FROM p")
def centroid_separation(spark, d):
    """Mean angular distance between centroids: pairs of a table of one row a cluster."""
    c = VS.centroids(_embeddings(spark, d), "label").agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("c"))
    dist = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: b["label"] > a["label"]), lambda b: V.angular(a["centroid"], b["centroid"]))))
    return c.select(F.explode(dist).alias("x")).agg(F.round(F.avg("x"), 6).alias("separation"), F.count("*").alias("n_pairs"))


_RANKED = f"{_E}, {_STATED}, p AS (SELECT q.id AS qid, q.label AS ql, x.label AS xl, row_number() OVER (PARTITION BY q.id ORDER BY round({_ANG.format('q.embedding', 'x.embedding')}, 6), x.id) AS rank FROM q JOIN x ON q.id <> x.id)"


def _label_ranks(spark, d, k=20):
    e = _embeddings(spark, d)
    n = VS.knn_join(e.filter("id % 50 = 0"), e, k)
    lab = e.select("id", "label")
    return n.join(lab, "id").join(lab.select(F.col("id").alias("qid"), F.col("label").alias("ql")), "qid").select("qid", "rank", (F.col("label") == F.col("ql")).alias("hit"))


@register(f"WITH {_RANKED}, f AS (SELECT qid, min(CASE WHEN ql = xl THEN rank END) AS first, avg(CASE WHEN rank <= 10 THEN CASE WHEN ql = xl THEN 1.0 ELSE 0.0 END END) AS p10 FROM p WHERE rank <= 20 GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(p10), 6) AS precision_10 FROM f")
def retrieval_mrr(spark, d):
    """Recall, mean reciprocal rank and precision of finding a vector of the same label."""
    r = _label_ranks(spark, d)
    f = r.groupBy("qid").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.avg(F.when(F.col("rank") <= 10, F.col("hit").cast("double"))).alias("p10"))
    within = lambda k: F.round(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 6)
    return f.agg(F.count("*").alias("n"), within(5).alias("recall_5"), within(10).alias("recall_10"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg("p10"), 6).alias("precision_10"))


@register(f"WITH {_RANKED} SELECT rank, count(*) AS n, round(avg(CASE WHEN ql = xl THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM p WHERE rank <= 20 GROUP BY 1")
def recall_by_rank(spark, d):
    """The hit rate at each rank: where a pipeline loses its results."""
    r = _label_ranks(spark, d)
    return r.groupBy(F.col("rank").cast("long").alias("rank")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"))


@register(f"WITH {_CEN}, m AS (SELECT id, label, cl, round({_ANG.format('embedding', 'c')}, 6) AS dist FROM x, z), r AS (SELECT id, label, cl, row_number() OVER (PARTITION BY id ORDER BY dist, cl) AS rank FROM m) SELECT label, round(avg(1.0 / rank), 6) AS mrr, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM r WHERE cl = label GROUP BY 1")
def discrimination_mrr(spark, d):
    """How well each vector finds its own cluster among the centroids."""
    e = _embeddings(spark, d)
    c = VS.centroids(e, "label").agg(F.collect_list(F.struct("label", "centroid")).alias("cs"))
    dist = F.array_sort(F.transform("cs", lambda x: F.struct(F.round(V.angular(F.col("embedding"), x["centroid"]), 6).alias("dist"), x["label"].alias("cl"))))
    r = e.join(F.broadcast(c)).select("label", F.array_position(F.transform(dist, lambda x: x["cl"]), F.col("label")).alias("rank"))
    return r.groupBy("label").agg(F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"), F.round(F.avg((F.col("rank") == 1).cast("double")), 6).alias("hit_rate"))


@register(f"WITH {_CEN}, r AS (SELECT label, cl, {_ANG.format('embedding', 'c')} AS dist FROM x, z) SELECT label, round(avg(CASE WHEN cl <> label THEN dist END) - avg(CASE WHEN cl = label THEN dist END), 6) AS gap FROM r GROUP BY 1")
def alignment_gap(spark, d):
    """How much nearer the members are to their own centroid than to the others."""
    e = _embeddings(spark, d)
    c = VS.centroids(e, "label").agg(F.collect_list(F.struct("label", "centroid")).alias("cs"))
    m = e.join(F.broadcast(c)).select("label", F.explode(F.transform("cs", lambda x: F.struct(x["label"].alias("cl"), V.angular(F.col("embedding"), x["centroid"]).alias("dist")))).alias("m"))
    own = F.col("m.cl") == F.col("label")
    return m.groupBy("label").agg(F.round(F.avg(F.when(~own, F.col("m.dist"))) - F.avg(F.when(own, F.col("m.dist"))), 6).alias("gap"))


_HEALTH = """h AS (SELECT (SELECT count(*) FROM c) AS n_chunks, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM c WHERE id IN (SELECT chunk_id FROM a)) AS n_clustered,
(SELECT count(*) FROM c WHERE id NOT IN (SELECT src FROM e) AND id NOT IN (SELECT dst FROM e) AND id NOT IN (SELECT chunk_id FROM a)) AS n_orphans, (SELECT count(DISTINCT session_slug) FROM c) AS n_projects, (SELECT count(DISTINCT session_id) FROM c) AS n_sessions,
(SELECT date_diff('day', min(start_time), max(start_time)) FROM c) AS span_days)"""


def _health(spark, d):
    c, e, a = S.chunks(spark, d), S.edges(spark, d), S.chunk_clusters(spark, d)
    ids = c.select("id")
    flag = lambda df, col, n: df.select(F.col(col).alias("id")).distinct().withColumn(n, F.lit(1))
    linked = e.select("src").union(e.select("dst")).toDF("id").distinct().withColumn("linked", F.lit(1))
    j = ids.join(linked, "id", "left").join(flag(a, "chunk_id", "clustered"), "id", "left")
    one = j.agg(F.count("*").alias("n_chunks"), F.count("clustered").alias("n_clustered"), F.count(F.when(F.col("linked").isNull() & F.col("clustered").isNull(), 1)).alias("n_orphans"))
    two = c.agg(F.countDistinct("session_slug").alias("n_projects"), F.countDistinct("session_id").alias("n_sessions"), F.datediff(F.max("start_time"), F.min("start_time")).cast("long").alias("span_days"))
    return one.join(two).join(e.agg(F.count("*").alias("n_edges")))


@register(f"WITH {P('c', 'e', 'a')}, {_HEALTH} SELECT n_chunks, n_edges, n_projects, n_sessions, span_days, round(n_clustered / n_chunks, 6) AS coverage, round(n_orphans / n_chunks, 6) AS orphan_share, round(n_edges / n_chunks, 6) AS edges_per_chunk FROM h")
def health(spark, d):
    r = lambda n: F.round(F.col(n) / F.col("n_chunks"), 6)
    return _health(spark, d).select("n_chunks", "n_edges", "n_projects", "n_sessions", "span_days", r("n_clustered").alias("coverage"), r("n_orphans").alias("orphan_share"), r("n_edges").alias("edges_per_chunk"))


@register(f"WITH {P('c', 'e', 'a')}, s AS (SELECT c.session_slug, count(*) AS n_edges FROM e JOIN c ON e.src = c.id GROUP BY 1) SELECT c.session_slug, count(*) AS n_chunks, coalesce(any_value(s.n_edges), 0) AS n_edges, round(avg(CASE WHEN c.id IN (SELECT chunk_id FROM a) THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM c LEFT JOIN s ON c.session_slug = s.session_slug GROUP BY 1")
def health_by_project(spark, d):
    """Edges count for the project of their source."""
    c = S.chunks(spark, d).select("id", "session_slug")
    a = S.chunk_clusters(spark, d).select(F.col("chunk_id").alias("id")).distinct().withColumn("k", F.lit(1.0))
    s = S.edges(spark, d).join(c.withColumnRenamed("id", "src"), "src").groupBy("session_slug").agg(F.count("*").alias("n_edges"))
    g = c.join(a, "id", "left").groupBy("session_slug").agg(F.count("*").alias("n_chunks"), F.round(F.avg(F.coalesce("k", F.lit(0.0))), 6).alias("coverage"))
    return g.join(s, "session_slug", "left").select("session_slug", "n_chunks", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "coverage")


@register(f"WITH {P('c', 'e', 'a')}, {_HEALTH}, p AS (SELECT least(100.0, 30 * least(1.0, n_edges / n_chunks / 3) + 40 * n_clustered / n_chunks + 30 * (1 - n_orphans / n_chunks)) AS health FROM h) SELECT round(health, 4) AS health, 60.0::DOUBLE AS latency, round((health * 25 + 60.0 * 15) / 40, 4) AS overall FROM p")
def overall_score(spark, d):
    """Health with a latency of 150 ms at p95; parts that are missing do not count."""
    h = _health(spark, d)
    n = F.col("n_chunks")
    health = E.health_score(F.col("n_edges") / n, F.col("n_clustered") / n, F.col("n_orphans") / n)
    parts = {"health": health, "latency": E.latency_score(F.lit(150.0)), "retrieval": F.lit(None).cast("double"), "chain": F.lit(None).cast("double")}
    return h.select(F.round(health, 4).alias("health"), parts["latency"].alias("latency"), F.round(E.overall_score(parts), 4).alias("overall"))


_FIG = """fg AS (SELECT n_chunks, n_edges, (SELECT count(*) FROM k) AS n_clusters, (SELECT count(*) FROM e WHERE reference_type = 'within-chain') AS n_within_chain, n_clustered / n_chunks AS cluster_coverage, n_orphans / n_chunks AS orphan_share, n_edges / n_chunks AS edges_per_chunk,
(SELECT median(n) FROM (SELECT count(*) AS n FROM c GROUP BY session_id)) AS median_session_size, """ + ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in TU.FIGURES if n not in "n_chunks n_edges n_clusters n_within_chain cluster_coverage orphan_share edges_per_chunk median_session_size".split()) + " FROM h)"


@register(f"WITH {P('c', 'e', 'a', 'k')}, {_HEALTH}, {_FIG} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, '{t}' AS setting, '{p}' AS priority FROM fg WHERE {c}" for m, t, p, c in TU.RULES))
def tuning_recommendations(spark, d):
    """The rules over the collection's figures, one row for each that fires; parts that need a benchmark run are null."""
    e = S.edges(spark, d)
    within = e.agg(F.count(F.when(F.col("reference_type") == "within-chain", 1)).alias("n_within_chain"))
    sizes = S.chunks(spark, d).groupBy("session_id").count().agg(F.median("count").alias("median_session_size"))
    n = F.col("n_chunks")
    f = _health(spark, d).join(within).join(sizes).join(S.clusters(spark, d).agg(F.count("*").alias("n_clusters")))  # one row each
    return TU.recommendations(f.withColumns({"cluster_coverage": F.col("n_clustered") / n, "orphan_share": F.col("n_orphans") / n, "edges_per_chunk": F.col("n_edges") / n}))


@register(f"""WITH {P('c', 'a')}, m AS (SELECT strftime(start_time, '%Y-%m') AS run, avg(CASE WHEN id IN (SELECT chunk_id FROM a) THEN 1.0 ELSE 0.0 END) AS v FROM c WHERE start_time IS NOT NULL GROUP BY 1), l AS (SELECT run, v, lag(v) OVER (ORDER BY run) AS p FROM m)
SELECT run, 'cluster_coverage' AS metric, round(v, 6) AS value, round(p, 6) AS previous, round(v - p, 6) AS delta, CASE WHEN v - p = 0 THEN false ELSE v - p > 0 END AS improved FROM l""")
def run_deltas(spark, d):
    """Runs against the run before them: here the coverage of each month's chunks as a run."""
    c = S.chunks(spark, d).filter("start_time is not null").select("id", F.date_format("start_time", "yyyy-MM").alias("run"))
    a = S.chunk_clusters(spark, d).select(F.col("chunk_id").alias("id")).distinct().withColumn("k", F.lit(1.0))
    h = c.join(a, "id", "left").groupBy("run").agg(F.avg(F.coalesce("k", F.lit(0.0))).alias("value")).select("run", F.col("run").alias("at"), F.lit("cluster_coverage").alias("metric"), "value")
    r = lambda n: F.round(n, 6).alias(n)
    return TU.deltas(materialise(h, "runs")).select("run", "metric", r("value"), r("previous"), r("delta"), "improved")


@register(f"WITH {_E} SELECT count(*) AS n_entries, true AS one_representative_each, true AS nearest_is_representative FROM x")
def entry_cluster_checks(spark, d):
    """What must hold of clustered index entries: one representative a cluster, and none nearer to the centroid."""
    r = materialise(entry_clusters(spark, d), "entries")
    by = r.filter("label >= 0").groupBy("label").agg(F.sum(F.col("is_representative").cast("int")).alias("n"), F.min("distance").alias("least"), F.min(F.when(F.col("is_representative"), F.col("distance"))).alias("own"))
    ok = by.agg(F.coalesce(F.min(F.col("n") == 1), F.lit(True)).alias("one_representative_each"), F.coalesce(F.min(F.col("least") == F.col("own")), F.lit(True)).alias("nearest_is_representative"))
    return r.agg(F.count("*").alias("n_entries")).join(ok)


@register()
def entry_clusters(spark, d):
    """Index entries clustered by their vectors: label, angular distance to the centroid, and whether an entry stands for
    its cluster (the nearest, ties to the smaller id); noise has no distance."""
    e = _embeddings(spark, d).select("id", "embedding")
    own = materialise(C.hdbscan(e).select("id", "label").join(e, "id"), "entries")
    cents = VS.centroids(own.filter("label >= 0"), "label")
    j = own.join(broadcast_if_small(cents), "label", "left").select("id", "label", F.round(V.angular(F.col("embedding"), F.col("centroid")), 9).alias("distance"))
    best = j.filter("label >= 0").groupBy("label").agg(F.min(F.struct("distance", "id")).alias("b")).select("label", F.col("b.id").alias("best"))
    return j.join(broadcast_if_small(best), "label", "left").select("id", "label", "distance", F.coalesce(F.col("id") == F.col("best"), F.lit(False)).alias("is_representative"))


@register(f"WITH {P('c')}, m AS (SELECT strftime(start_time, '%Y-%m') AS month, count(*) AS n_chunks, avg(approx_tokens) AS mean_tokens FROM c GROUP BY 1) SELECT month, n_chunks, n_chunks - lag(n_chunks) OVER (ORDER BY month) AS chunks_delta, round(mean_tokens - lag(mean_tokens) OVER (ORDER BY month), 4) AS tokens_delta FROM m")
def trend(spark, d):
    """Changes from month to month (a table of one row a month)."""
    w = Window.orderBy("month")
    m = S.chunks(spark, d).groupBy(F.date_format("start_time", "yyyy-MM").alias("month")).agg(F.count("*").alias("n_chunks"), F.avg("approx_tokens").alias("t"))
    return m.select("month", "n_chunks", (F.col("n_chunks") - F.lag("n_chunks").over(w)).alias("chunks_delta"), F.round(F.col("t") - F.lag("t").over(w), 4).alias("tokens_delta"))


@register(_walk_sql("src", "dst", _STATED_SEEDS) + ", b AS (SELECT seed, max(len(path)) AS n FROM p GROUP BY 1) SELECT (SELECT count(*) FROM sd) AS n_seeds, round((SELECT avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END) FROM b), 6) AS coverage, round((SELECT avg(n) FROM b), 6) AS mean_longest")
def chain_quality(spark, d):
    """How many of the stated queries have a chain, and how long the longest are."""
    seeds = materialise(_stated(spark, d), "stated")
    b = G.walk_paths(S.forward_edges(spark, d), seeds, 5).groupBy("seed").agg(F.max(F.size("path")).alias("n"))
    return seeds.agg(F.count("*").alias("n_seeds")).join(b.agg(F.round(F.avg((F.col("n") >= 2).cast("double")), 6).alias("coverage"), F.round(F.avg("n"), 6).alias("mean_longest")))


_PAIRS = f"""tx AS (SELECT id, session_id, session_slug, start_time, end_time, regexp_matches({_TRIM.format(_USER)}, {q(X.TOPIC_SHIFT)}) AS shift, regexp_matches({_TRIM.format(_USER)}, {q(X.CONTINUATION)}) AS cont, {_KEYS.format('content')} AS k, {_PATHS.format('content')} AS p FROM c),
pr AS (SELECT lag(id) OVER w AS src, id AS dst, session_id, shift, cont, (epoch_us(start_time) - epoch_us(lag(end_time) OVER w)) / 6e7 AS gap, {_JACCARD.format('p', 'lag(p) OVER w')} AS po, {_JACCARD.format('k', 'lag(k) OVER w')} AS ko, lag(session_id) OVER w = session_id AS same FROM tx WINDOW w AS (PARTITION BY session_slug ORDER BY start_time, id)),
ft AS (SELECT * FROM pr WHERE src IS NOT NULL)"""


def _features(spark, d):
    t = F.col("content")
    u = X.user_text(t)
    c = S.chunks(spark, d).select("id", "session_id", "session_slug", "start_time", "end_time", X.has_topic_shift(u).alias("shift"), X.has_continuation(u).alias("cont"), X.keywords(t).alias("k"), X.paths(t).alias("p"))
    w = Window.partitionBy("session_slug").orderBy("start_time", "id")
    f = c.select(F.lag("id").over(w).alias("src"), F.col("id").alias("dst"), "session_id", "shift", "cont", ((F.unix_micros("start_time") - F.unix_micros(F.lag("end_time").over(w))) / 6e7).alias("gap"), "p", F.lag("p").over(w).alias("pp"), "k", F.lag("k").over(w).alias("pk"), (F.lag("session_id").over(w) == F.col("session_id")).alias("same"))
    return f.filter("src is not null").select("src", "dst", "shift", "cont", "gap", X.jaccard(F.col("p"), F.col("pp")).alias("po"), X.jaccard(F.col("k"), F.col("pk")).alias("ko"), "same")


@register(f"WITH {P('c')}, {_PAIRS} SELECT src, dst, round(greatest(0, least(1, 0.5 - CASE WHEN shift THEN 0.4 ELSE 0 END + CASE WHEN cont THEN 0.3 ELSE 0 END + 0.2 * po + 0.15 * ko + CASE WHEN gap > 30 THEN -0.25 WHEN gap > 10 THEN -0.1 ELSE 0 END)), 6) AS score FROM ft")
def lexical_score(spark, d):
    """Topic continuity between successive chunks of a project."""
    f = _features(spark, d)
    return f.select("src", "dst", F.round(E.lexical_score(F.col("shift"), F.col("cont"), F.col("po"), F.col("ko"), F.col("gap")), 6).alias("score"))


_SIM = "hy AS (SELECT ft.*, CASE WHEN v1.id IS NULL OR v2.id IS NULL THEN 0.0 ELSE 1 - acos(greatest(-1, least(1, list_cosine_similarity(v1.embedding, v2.embedding)))) / pi() END AS sim, 1 / (1 + exp(0.1 * (coalesce(gap, 30) - 30))) AS tg FROM ft LEFT JOIN v v1 ON v1.id = src LEFT JOIN v v2 ON v2.id = dst)"


def _hybrid_features(spark, d):
    v = S.search_vectors(spark, d).select("id", "embedding")
    f = _features(spark, d).join(v.select(F.col("id").alias("src"), F.col("embedding").alias("e1")), "src", "left").join(v.select(F.col("id").alias("dst"), F.col("embedding").alias("e2")), "dst", "left")
    both = F.col("e1").isNotNull() & F.col("e2").isNotNull()
    return f.withColumn("sim", F.when(both, 1 - V.angular(F.col("e1"), F.col("e2"))).otherwise(0.0))


_H = {"similarity": "sim", "shift": "CASE WHEN shift THEN 0.0 ELSE 1.0 END", "time": "tg", "continuation": "CASE WHEN cont THEN 1.0 ELSE 0.5 END", "paths": "po", "keywords": "ko"}


def _hybrid_sql(leave_out=()):
    kept = {n: w for n, w in E.HYBRID.items() if n not in leave_out}
    return " + ".join(f"({_H[n]}) * {w / sum(kept.values())!r}" for n, w in kept.items())


def _hybrid_columns():
    return {"similarity": F.col("sim"), "shift": F.when(F.col("shift"), 0.0).otherwise(1.0), "time": E.time_feature(F.coalesce("gap", F.lit(30.0))), "continuation": F.when(F.col("cont"), 1.0).otherwise(0.5), "paths": F.col("po"), "keywords": F.col("ko")}


@register(f"WITH {P('c', 'v')}, {_PAIRS}, {_SIM} SELECT src, dst, round({_hybrid_sql()}, 6) AS score FROM hy")
def hybrid_score(spark, d):
    return _hybrid_features(spark, d).select("src", "dst", F.round(E.hybrid_score(_hybrid_columns()), 6).alias("score"))


_ABLATIONS = {"full": (), **{f"no-{n}": (n,) for n in E.HYBRID}, **{f"only-{n}": tuple(m for m in E.HYBRID if m != n) for n in ("similarity", "time", "shift")}}


@register(f"WITH {P('c', 'v')}, {_PAIRS}, {_SIM}, r AS (" + " UNION ALL ".join(f"SELECT '{n}' AS config, same, {_hybrid_sql(x)} AS score FROM hy" for n, x in _ABLATIONS.items()) + ") SELECT config, count(*) AS n, round(avg(CASE WHEN same THEN score END), 6) AS same_session, round(avg(CASE WHEN NOT same THEN score END), 6) AS other_session FROM r GROUP BY 1")
def ablation(spark, d):
    """Mean continuity within and across sessions for each set of features, in one pass."""
    f = _hybrid_columns()
    h = _hybrid_features(spark, d).select("same", F.explode(F.array(*[F.struct(F.lit(n).alias("config"), E.hybrid_score(f, x).alias("score")) for n, x in _ABLATIONS.items()])).alias("c"))
    return h.groupBy("c.config").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("same"), F.col("c.score"))), 6).alias("same_session"), F.round(F.avg(F.when(~F.col("same"), F.col("c.score"))), 6).alias("other_session"))


@register(f"WITH {P('c')}, {_PAIRS} SELECT src, dst, CASE WHEN NOT same THEN 'new_session' WHEN shift THEN 'topic_shift' WHEN cont THEN 'continuation' WHEN gap > 30 THEN 'gap' WHEN po > 0 THEN 'shared_file' ELSE 'continuation_default' END AS label FROM ft")
def transition_labels(spark, d):
    """Ordered labelling rules: the first that holds."""
    label = F.when(~F.col("same"), "new_session").when(F.col("shift"), "topic_shift").when(F.col("cont"), "continuation").when(F.col("gap") > 30, "gap").when(F.col("po") > 0, "shared_file").otherwise("continuation_default")
    return _features(spark, d).select("src", "dst", label.alias("label"))


@register(f"WITH {P('c')}, {_PAIRS}, l AS (SELECT dst, same, row_number() OVER (PARTITION BY same ORDER BY md5(dst), dst) AS r FROM ft), m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM ft GROUP BY same)) SELECT dst, same FROM l, m WHERE r <= n")
def balanced_dataset(spark, d):
    """As many pairs of each kind as of the rarer one, in a reproducible order."""
    f = _features(spark, d).select("dst", "same", F.md5("dst").alias("h"))
    least = f.groupBy("same").count().agg(F.min("count").alias("n"))
    return rank_within(f, ["same"], ["h", "dst"], "r").join(F.broadcast(least)).filter(F.col("r") < F.col("n")).select("dst", "same")


@register(f"WITH {P('c', 'v')}, {_PAIRS}, {_SIM} SELECT round(avg(CASE WHEN c1.code_block_count > 0 AND c2.code_block_count = 0 THEN sim END), 6) AS code_to_text, round(avg(CASE WHEN c1.code_block_count = 0 AND c2.code_block_count = 0 THEN sim END), 6) AS text_to_text FROM hy JOIN c c1 ON c1.id = src JOIN c c2 ON c2.id = dst")
def code_text_alignment(spark, d):
    n = S.chunks(spark, d).select("id", F.col("code_block_count").alias("n"))
    h = _hybrid_features(spark, d).join(n.select(F.col("id").alias("src"), F.col("n").alias("n1")), "src").join(n.select(F.col("id").alias("dst"), F.col("n").alias("n2")), "dst")
    return h.agg(F.round(F.avg(F.when((F.col("n1") > 0) & (F.col("n2") == 0), F.col("sim"))), 6).alias("code_to_text"), F.round(F.avg(F.when((F.col("n1") == 0) & (F.col("n2") == 0), F.col("sim"))), 6).alias("text_to_text"))


@register(f"WITH {P('c', 'v')}, {_PAIRS}, {_SIM} SELECT c2.approx_tokens > 512 AS long, count(*) AS n, round(avg(sim), 6) AS mean_similarity FROM hy JOIN c c2 ON c2.id = dst GROUP BY 1")
def context_window_drift(spark, d):
    n = S.chunks(spark, d).select(F.col("id").alias("dst"), (F.col("approx_tokens") > 512).alias("long"))
    return _hybrid_features(spark, d).join(n, "dst").groupBy("long").agg(F.count("*").alias("n"), F.round(F.avg("sim"), 6).alias("mean_similarity"))


def _weight_sql(m: str, x: str = "hops") -> str:
    kind, w0, rate, hold, exponent, tiers = D.MODELS[m]
    fall = lambda w, h, r: f"greatest(0, {w!r} - {r!r} * greatest(0, {x} - {h}))"
    if kind == "multi-linear":
        return " + ".join(fall(w, h, w / n) for w, h, n in tiers)
    if kind == "exponential":
        return f"{w0!r} * exp(-{rate!r} * {x})"
    return f"{w0!r} / pow(1 + {rate!r} * {x}, {exponent!r})" if kind == "power-law" else fall(w0, hold, rate)


_CURVES = "cv AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, CAST(hops AS INTEGER) AS hops, CAST({_weight_sql(m)} AS DOUBLE) AS weight FROM range(61) t(hops)" for m in D.MODELS) + ")"


@register(f"WITH {_CURVES} SELECT model, hops, round(weight, 6) AS weight FROM cv")
def decay_curves(spark, d):
    return D.curves(spark).withColumn("weight", F.round("weight", 6))


@register(f"WITH {_CURVES}, t AS (SELECT *, lag(weight) OVER w AS b, first(weight) OVER w AS s FROM cv WINDOW w AS (PARTITION BY model ORDER BY hops)) SELECT model, round(sum((weight + b) / 2), 6) AS area, min(CASE WHEN round(weight, 9) <= round(s / 2, 9) THEN hops END) AS half_life FROM t GROUP BY 1")
def decay_areas(spark, d):
    return D.curve_area(D.curves(spark).withColumn("weight", F.round("weight", 9))).withColumn("area", F.round("area", 6))


_IDENTIFIER = r"\b[a-z]+(?:[A-Z][a-z]+)+\b|\b[a-z]+_[a-z_]+\b"
_HOPS = "sq AS (SELECT id, session_id, content, row_number() OVER (PARTITION BY session_id ORDER BY start_time, id) AS pos FROM c), tn AS (SELECT id, session_id, pos, unnest(list_distinct(list_concat({}, regexp_extract_all(content, '{}')))) AS name FROM sq), rf AS (SELECT a.id, a.session_id, CAST(a.pos - b.pos AS INTEGER) AS hops FROM (SELECT *, lag(pos) OVER (PARTITION BY session_id, name ORDER BY pos) AS pp FROM tn) a JOIN sq b ON a.session_id = b.session_id AND b.pos = a.pp)".format(_PATHS.format("content"), _IDENTIFIER)


def _references(spark, d):
    """Mentions of a path or code identifier with the number of chunks since its last mention in the session."""
    w = Window.partitionBy("session_id").orderBy("start_time", "id")
    s = S.chunks(spark, d).select("id", "session_id", F.row_number().over(w).alias("pos"), F.array_distinct(F.concat(X.paths(F.col("content")), F.regexp_extract_all("content", F.lit(_IDENTIFIER), 0))).alias("p"))
    n = s.select("id", "session_id", "pos", F.explode("p").alias("name"))
    back = F.lag("pos").over(Window.partitionBy("session_id", "name").orderBy("pos"))
    return n.withColumn("hops", F.col("pos") - back).filter("hops is not null").select("id", "hops")


@register(f"WITH {P('c')}, {_HOPS} SELECT CASE WHEN hops < 2 THEN 1 WHEN hops < 4 THEN 2 WHEN hops < 7 THEN 4 WHEN hops < 11 THEN 7 WHEN hops < 21 THEN 11 ELSE 21 END AS bin, count(*) AS n FROM rf GROUP BY 1")
def hop_bins(spark, d):
    return _references(spark, d).groupBy(D.hop_bin(F.col("hops")).alias("bin")).agg(F.count("*").alias("n"))


@register(f"WITH {P('c')}, {_HOPS}, b AS (SELECT CASE WHEN hops < 2 THEN 1 WHEN hops < 4 THEN 2 WHEN hops < 7 THEN 4 WHEN hops < 11 THEN 7 WHEN hops < 21 THEN 11 ELSE 21 END AS bin, count(*) AS n FROM rf GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY bin) AS x, row_number() OVER (ORDER BY n DESC, bin) AS y FROM b) SELECT round(CASE WHEN count(*) > 1 THEN 1 - 6 * sum(pow(x - y, 2)) / (count(*) * (count(*) * count(*) - 1)) END, 6) AS spearman FROM r")
def spearman(spark, d):
    """Rank correlation of hop bins and the number of references in them."""
    b = _references(spark, d).groupBy(D.hop_bin(F.col("hops")).alias("bin")).agg(F.count("*").alias("n"))
    return E.spearman_ordinal(b, "bin", "n").withColumn("spearman", F.round("spearman", 6))


@register(f"WITH {P('c')}, {_HOPS}, {_CURVES} SELECT model, count(*) AS n, round(avg(weight), 6) AS mean_weight FROM rf JOIN cv ON cv.hops = least(rf.hops, 60) WHERE rf.hops >= 1 GROUP BY 1")
def decay_fit(spark, d):
    """The mean weight that each model leaves at the distances of real references of at least one hop."""
    r = _references(spark, d).filter("hops >= 1").select(F.least("hops", F.lit(60)).alias("hops"))
    w = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), D.weight(m, F.col("hops").cast("double")).alias("weight")) for m in D.MODELS]))
    return r.select(w.alias("x")).groupBy("x.model").agg(F.count("*").alias("n"), F.round(F.avg("x.weight"), 6).alias("mean_weight"))


@register(f"WITH {P('c')}, {_HOPS} SELECT count(*) AS n, round(avg(1.0 / hops), 6) AS mrr FROM rf WHERE hops >= 1")
def decay_mrr(spark, d):
    """Mean reciprocal rank of the referred chunk when earlier chunks are ranked by any falling weight."""
    return _references(spark, d).filter("hops >= 1").agg(F.count("*").alias("n"), F.round(F.avg(1 / F.col("hops")), 6).alias("mrr"))


@register("WITH t AS (SELECT floor(count(*) * 0.5) AS a, count(*) AS n FROM events) SELECT CAST(row_number() OVER (ORDER BY value, event_id) - 1 AS BIGINT) AS rank, event_id FROM events QUALIFY rank % 1000 = 0")
def event_rank_marks(spark, d):
    """Every thousandth event by value: ranks over the whole table without a single sorting task."""
    r = rank_within(read_table(spark, d, "events").select("value", "event_id"), [], ["value", "event_id"])
    return r.filter("rank % 1000 = 0").select("rank", "event_id")
