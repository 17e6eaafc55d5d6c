"""Keyword and vector search, and the retrieval pipeline from fusion to packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.functions.porter import stems
from tessera.operators import block_search as B
from tessera.operators import fulltext, retrieval
from tessera.operators import vector_search as VS
from tessera.plans.registry import Registry
from tessera.runtime import broadcast_if_small, materialise, read_table
from tessera.sources import store as S
from tessera.sources.store import prelude as P

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

TERMS = X.sanitize_query('"plan" AND compare*')
NOW = "2026-02-01"


def _bm25_sql(source: str, text: str, terms: list[str], name: str = "kw", where: str = "TRUE") -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(len(terms)))
    need = " AND ".join(f"tf{i} > 0" for i in range(len(terms)))
    return rf"""{name}w AS (SELECT *, list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM {source}),
{name}t AS (SELECT * EXCLUDE (w), coalesce(len(w), 0) AS dl, {tf} FROM {name}w), {name}s AS (SELECT count(*) AS n, avg(dl) AS av, {df} FROM {name}t),
{name} AS (SELECT id, {score} AS score FROM {name}t, {name}s WHERE {need} AND {where})"""


def _texts(spark, d):
    return S.chunks(spark, d).withColumn("text", F.col("content"))


@register(f"WITH {P('c')}, {_bm25_sql('c', 'content', TERMS)} SELECT id, round(score, 6) AS score FROM kw ORDER BY score DESC, id LIMIT 20")
def bm25(spark, d):
    s = S.keyword_index(spark, d).search({"q": TERMS}).select("id", F.round("score", 6).alias("score"))
    return s.orderBy(F.desc("score"), "id").limit(20)


@register(f"WITH {P('c')}, {_bm25_sql('c', 'content', TERMS, where='agent_id IS NULL')} SELECT id, round(score, 6) AS score FROM kw ORDER BY score DESC, id LIMIT 20")
def bm25_filtered(spark, d):
    """The filter narrows the hits; the statistics stay global."""
    s = fulltext.bm25(_texts(spark, d), TERMS, within=F.col("agent_id").isNull())
    return s.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@register(f"WITH {P('k')}, {_bm25_sql('k', 'description', ['trouble'])} SELECT id, round(score, 6) AS score FROM kw ORDER BY score DESC, id LIMIT 20")
def bm25_entries(spark, d):
    s = S.entry_index(spark, d).search({"q": ["trouble"]})
    return s.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@register()
def bm25_stemmed(spark, d):
    """As the store's tokeniser has it: diacritics folded, words stemmed (Porter)."""
    fold = lambda t: stems(X.words(F.translate(F.lower(t), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")))
    s = fulltext.bm25(_texts(spark, d), ["plan", "compar"], tokens=fold)
    return s.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


_MANY = {"q1": ["plan", "compare"], "q2": ["router"], "q3": ["trouble", "refuses"]}


@register(f"WITH {P('c')}, " + ", ".join(_bm25_sql("c", "content", t, n) for n, t in _MANY.items()) + " " + " UNION ALL ".join(f"SELECT '{n}' AS qid, id, round(score, 6) AS score FROM {n}" for n in _MANY))
def bm25_many(spark, d):
    """Many queries in one pass."""
    return S.keyword_index(spark, d).search(_MANY).select("qid", "id", F.round("score", 6).alias("score"))


def _query_vector(vectors, id_column: str = "id") -> list[float]:
    r = vectors.orderBy(id_column).select("embedding").first()
    return [float(x) for x in r.embedding] if r else [0.0]


_E = "x AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings), qv AS (SELECT embedding AS q FROM x ORDER BY id LIMIT 1)"
_ANG = "acos(greatest(-1, least(1, list_cosine_similarity({}, {})))) / pi()"


def _embeddings(spark, d):
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


@register(f"WITH {_E} SELECT id, round({_ANG.format('embedding', 'q')}, 6) AS distance FROM x, qv WHERE id > 0 ORDER BY 2, id LIMIT 20")
def knn(spark, d):
    e = _embeddings(spark, d)
    return VS.distances(e.filter("id > 0"), _query_vector(e)).select("id", F.round("distance", 6).alias("distance")).orderBy("distance", "id").limit(20)


@register(f"WITH {_E} SELECT id, round({_ANG.format('embedding', 'q')}, 6) AS distance FROM x, qv WHERE label IN (1, 2, 3) ORDER BY 2, id LIMIT 20")
def knn_filtered(spark, d):
    e = _embeddings(spark, d)
    return VS.distances(e.filter("label in (1, 2, 3)"), _query_vector(e)).select("id", F.round("distance", 6).alias("distance")).orderBy("distance", "id").limit(20)


@register(f"WITH {P('v', 'c', 'a')}, qv AS (SELECT embedding AS q FROM v ORDER BY id LIMIT 1) SELECT id, round({_ANG.format('embedding', 'q')}, 6) AS distance FROM v, qv WHERE id IN (SELECT chunk_id FROM a) ORDER BY 2, id LIMIT 20")
def knn_within_ids(spark, d):
    v = S.search_vectors(spark, d)
    some = v.join(S.chunk_clusters(spark, d).select(F.col("chunk_id").alias("id")), "id", "left_semi")
    return VS.distances(some, _query_vector(v)).select("id", F.round("distance", 6).alias("distance")).orderBy("distance", "id").limit(20)


@register(f"WITH {_E}, s AS (SELECT id, round(greatest(0, 1 - {_ANG.format('embedding', 'q')}), 6) AS score FROM x, qv) SELECT id, score FROM s WHERE score >= 0.55")
def similarity_threshold(spark, d):
    """A threshold above 1 is read as a percentage."""
    at = 55 / 100
    e = _embeddings(spark, d)
    return VS.distances(e, _query_vector(e)).select("id", F.round(F.greatest(F.lit(0.0), 1 - F.col("distance")), 6).alias("score")).filter(F.col("score") >= at)


_STATED = "q AS (SELECT * FROM x WHERE id % 50 = 0)"


@register(f"WITH {_E}, {_STATED}, p AS (SELECT q.id AS qid, x.id, round({_ANG.format('q.embedding', 'x.embedding')}, 6) AS distance FROM q JOIN x ON q.id <> x.id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS INTEGER) AS rank FROM p) SELECT * FROM r WHERE rank <= 5")
def pairwise_topk(spark, d):
    """The nearest of all vectors for the stated queries (ids divisible by 50)."""
    e = _embeddings(spark, d)
    return VS.knn_join(e.filter("id % 50 = 0"), e, 5)


@register(f"WITH {_E}, {_STATED}, p AS (SELECT q.id AS qid, x.id, round(list_distance(q.embedding, x.embedding), 6) AS distance FROM q JOIN x ON q.id <> x.id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM p) SELECT qid AS id, distance AS core_distance FROM r WHERE rank = 4")
def core_distance(spark, d):
    """The distance to the 4th neighbour, for the stated queries against all vectors."""
    e = _embeddings(spark, d)
    return VS.knn_join(e.filter("id % 50 = 0"), e, 4, "euclidean").filter("rank = 4").select(F.col("qid").alias("id"), F.col("distance").alias("core_distance"))


@register(f"""WITH {_E}, {_STATED}, p AS (SELECT q.id AS qid, x.id, round(list_distance(q.embedding, x.embedding), 6) AS distance FROM q JOIN x ON q.id <> x.id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM p),
k AS (SELECT qid, distance AS core FROM r WHERE rank = 4), m AS (SELECT p.qid, p.id, round(greatest(a.core, b.core, p.distance), 6) AS mutual FROM p JOIN k a ON a.qid = p.qid JOIN k b ON b.qid = p.id),
s AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY mutual, id) AS INTEGER) AS rank FROM m) SELECT * FROM s WHERE rank <= 5""")
def mutual_reachability(spark, d):
    """Of the stated queries the 5 nearest to each other by mutual reachability (core distances are against all vectors):
    every pair of them is compared, in blocks."""
    e = _embeddings(spark, d)
    mine = e.filter("id % 50 = 0")
    core = VS.knn_join(mine, e, 4, "euclidean").filter("rank = 4").select(F.col("qid").alias("id"), F.col("distance").alias("core"))
    points = B.numbered(mine)
    rows = materialise(points.join(core, "id"), "cores")
    near = B.nearest_by_reach(rows, rows, 5)
    names = points.select("num", "id")
    got = near.join(names.withColumnRenamed("id", "qid"), "num").join(names.select(F.col("num").alias("other"), "id"), "other")
    return got.select("qid", "id", F.col("distance").alias("mutual"), "rank")


@register(f"WITH {_E}, y AS (SELECT label, i, avg(embedding[i]) AS m FROM x, range(1, 65) t(i) GROUP BY 1, 2), z AS (SELECT label, list(m ORDER BY i) AS c FROM y GROUP BY 1) SELECT label, list_transform(c, lambda v: round(v / sqrt(list_sum(list_transform(c, lambda u: u * u))), 6)) AS centroid FROM z")
def centroids(spark, d):
    c = VS.centroids(_embeddings(spark, d), "label")
    return c.select("label", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


_CEN = f"{_E}, y AS (SELECT label, i, avg(embedding[i]) AS m FROM x, range(1, 65) t(i) GROUP BY 1, 2), z AS (SELECT label AS cl, list(m ORDER BY i) AS c FROM y GROUP BY 1)"


@register(f"WITH {_CEN}, r AS (SELECT label, id, round({_ANG.format('embedding', 'c')}, 6) AS distance FROM x JOIN z ON cl = label), s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, id) AS r FROM r) SELECT label, id, distance FROM s WHERE r <= 3")
def exemplars(spark, d):
    """The 3 members nearest to each centroid, as a bounded minimum per group."""
    e = _embeddings(spark, d)
    j = e.join(broadcast_if_small(VS.centroids(e, "label")), "label").select("label", F.struct(F.round(V.angular(F.col("embedding"), F.col("centroid")), 6).alias("distance"), "id").alias("s"), F.pmod(F.xxhash64("id"), F.lit(32)).alias("salt"))
    best = lambda c: F.slice(F.sort_array(c), 1, 3)
    part = j.groupBy("label", "salt").agg(best(F.collect_list("s")).alias("s"))
    return part.groupBy("label").agg(best(F.flatten(F.collect_list("s"))).alias("s")).select("label", F.explode("s").alias("x")).select("label", "x.id", "x.distance")


@register(f"WITH {_CEN}, r AS (SELECT id, label, cl, round({_ANG.format('embedding', 'c')}, 6) AS distance FROM x, z), s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, cl) AS r FROM r) SELECT id, label, cl AS nearest, distance FROM s WHERE r = 1")
def nearest_cluster(spark, d):
    """Each vector against the centroids, which are sent in blocks of bounded size."""
    e = _embeddings(spark, d)
    c = VS.centroids(e, "label").select(F.col("label").alias("id"), F.col("centroid").alias("embedding"))
    near = VS.within_angle(e, c, 1.1, only_nearest=True).select(F.col("qid").alias("id"), F.struct(F.round("distance", 6).alias("distance"), F.col("id").alias("nearest")).alias("m"))
    best = near.groupBy("id").agg(F.min("m").alias("m"))
    return e.select("id", "label").join(best, "id").select("id", "label", "m.nearest", "m.distance")


@register(f"WITH {_CEN}, r AS (SELECT id, label, cl, round({_ANG.format('embedding', 'c')}, 6) AS distance FROM x, z) SELECT id, cl AS cluster, distance FROM r WHERE distance < 0.48 AND label <> cl")
def noise_rescue(spark, d):
    """Further clusters of a vector within the threshold of their centroid (several are possible)."""
    e = _embeddings(spark, d)
    c = VS.centroids(e, "label").select(F.col("label").alias("id"), F.col("centroid").alias("embedding"))
    near = VS.within_angle(e, c, 0.49).select(F.col("qid").alias("id"), F.col("id").alias("cluster"), F.round("distance", 6).alias("distance")).filter("distance < 0.48")
    return near.join(e.select("id", "label"), "id").filter("cluster <> label").select("id", "cluster", "distance")


@register(f"WITH {_E}, {_STATED}, g AS (SELECT id // 100 AS grp, embedding AS v FROM q), p AS (SELECT x.id, max(round(list_cosine_similarity(x.embedding, g.v), 6)) AS best FROM x, g WHERE g.grp = 0 GROUP BY 1) SELECT id, best FROM p ORDER BY best DESC, id LIMIT 20")
def max_similarity_over_variants(spark, d):
    """The best similarity over several variants of a query (a bounded set)."""
    e = _embeddings(spark, d)
    variants = [[float(x) for x in r.embedding] for r in e.filter("id % 50 = 0 and id < 100").orderBy("id").select("embedding").collect()]
    best = F.greatest(*[F.round(V.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in q])), 6) for q in variants]) if len(variants) > 1 else F.lit(None).cast("double")
    return e.select("id", best.alias("best")).orderBy(F.desc("best"), "id").limit(20)


@register(f"WITH {_E} SELECT id, round(1 - list_dot_product(embedding, q), 6) AS one_minus_dot, round(list_distance(embedding, q), 6) AS euclidean FROM x, qv")
def other_distances(spark, d):
    e = _embeddings(spark, d)
    q = F.array(*[F.lit(x) for x in _query_vector(e)])
    return e.select("id", F.round(V.one_minus_dot(F.col("embedding"), q), 6).alias("one_minus_dot"), F.round(V.euclidean(F.col("embedding"), q), 6).alias("euclidean"))


@register()
def hashed_embeddings(spark, d):
    """Stand-in embeddings through a content-hash cache: equal texts are embedded once."""
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    cache = spark.createDataFrame([], "content_hash string, model_id string, embedding array<double>, hit_count long")
    done, _ = VS.embed_with_cache(docs, cache, "hashing-64", VS.embed_by_hashing)
    return done


_VEC = f"qv AS (SELECT embedding AS q FROM v ORDER BY id LIMIT 1), vs AS (SELECT v.id, round(1 - {_ANG.format('embedding', 'q')}, 6) AS score FROM v, qv WHERE v.id IN (SELECT id FROM c))"
_KW = f"{_bm25_sql('c', 'content', TERMS, 'kr')}, kw AS (SELECT id, round(score, 6) AS score FROM kr)"
_TOP = "SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {} ORDER BY score DESC, id LIMIT 20"
_RRF = f"""lists AS (SELECT *, 'vector' AS source, 4 AS pr FROM ({_TOP.format('vs')}) UNION ALL SELECT *, 'keyword', 3 FROM ({_TOP.format('kw')})),
rrf AS (SELECT id, sum(1.0 / (60 + rank)) AS raw, round(sum(1.0 / (60 + rank)), 9) AS score, arg_min(source, pr) AS source FROM lists GROUP BY 1)"""
_PIPE = f"WITH {P('c', 'v', 'a')}, {_VEC}, {_KW}, {_RRF}"


def _lists(spark, d):
    v = S.search_vectors(spark, d)
    ids = S.chunks(spark, d).select("id")
    vec = VS.distances(v.join(ids, "id", "left_semi"), _query_vector(v)).select("id", F.round(1 - F.col("distance"), 6).alias("score"))
    kw = S.keyword_index(spark, d).search({"q": TERMS}).select("id", F.round("score", 6).alias("score"))
    return retrieval.ranked(vec, "vector", 20).unionByName(retrieval.ranked(kw, "keyword", 20))


def _fused(spark, d):
    """The fused list, at most 40 rows: written once, as everything that follows reads it several times."""
    return materialise(retrieval.fuse(_lists(spark, d)).withColumn("score", F.round("score", 9)), "fused")


@register(f"{_PIPE} SELECT id, score, source FROM rrf")
def rrf(spark, d):
    return _fused(spark, d)


_EXPAND = """h AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS pos FROM rrf), ad AS (SELECT chunk_id AS id, cluster_id, coalesce(distance, 1) AS dist FROM a),
f1 AS (SELECT cluster_id, score, pos, dist, row_number() OVER (PARTITION BY cluster_id ORDER BY pos, dist) AS r FROM h JOIN ad USING (id)),
wk AS (SELECT cluster_id, score AS hit, row_number() OVER (ORDER BY pos, dist, cluster_id) AS o FROM f1 WHERE r = 1),
sb AS (SELECT ad.id, o, hit * (1 - dist) AS score, row_number() OVER (PARTITION BY wk.cluster_id ORDER BY dist, ad.id) AS n FROM ad JOIN wk ON ad.cluster_id = wk.cluster_id AND o <= 3 WHERE ad.id NOT IN (SELECT id FROM rrf) AND ad.id IN (SELECT id FROM c) AND hit * (1 - dist) > 0),
ex AS (SELECT id, round(arg_min(score, o), 9) AS score, 'cluster' AS source FROM sb WHERE n <= 5 GROUP BY 1)"""


def _expanded(spark, d, hits=None):
    hits = _fused(spark, d) if hits is None else hits
    near = retrieval.expand_clusters(hits, S.chunk_clusters(spark, d), S.chunks(spark, d)).withColumn("score", F.round("score", 9))
    return materialise(near, "near")


@register(f"{_PIPE}, {_EXPAND} SELECT * FROM ex")
def cluster_expand(spark, d):
    return _expanded(spark, d)


_SCORED = f"""pool AS (SELECT id, score, source FROM rrf UNION ALL SELECT * FROM ex),
sc AS (SELECT p.id, p.source, c.approx_tokens, c.content, round(p.score * (1 + 0.3 * exp(-((epoch_us(TIMESTAMPTZ '{NOW} 00:00:00+00') - epoch_us(c.start_time)) / 3.6e9) * ln(2) / 48)) / (1 + log2(greatest(1.0, c.approx_tokens / 500.0))), 9) AS score FROM pool p JOIN c ON p.id = c.id)"""


def _scored(spark, d):
    hits = _fused(spark, d)
    pool = hits.select("id", "score", "source").unionByName(_expanded(spark, d, hits).select("id", "score", "source"))
    c = S.chunks(spark, d).select("id", "approx_tokens", "content", "start_time")
    s = F.col("score") * retrieval.recency(F.col("start_time"), F.lit(NOW).cast("timestamp")) * retrieval.length_penalty(F.col("approx_tokens"))
    return c.join(F.broadcast(pool), "id").select("id", "source", "approx_tokens", "content", F.round(s, 9).alias("score"))


@register(f"{_PIPE}, {_EXPAND}, {_SCORED} SELECT id, source, score FROM sc")
def recency_length_score(spark, d):
    return _scored(spark, d).select("id", "source", "score")


@register(f"{_PIPE}, {_EXPAND}, {_SCORED} SELECT id, source, score, translate(substr(content, 1, 100), E'\\n', ' ') AS preview, round(score / (SELECT max(score) FROM sc WHERE approx_tokens <= 20000), 6) AS relative FROM sc WHERE approx_tokens <= 20000 ORDER BY score DESC, id LIMIT 20")
def hybrid_search(spark, d):
    """Vector and keyword search fused, expanded, rescored and normalised by the best: the flagship query."""
    s = _scored(spark, d).filter("approx_tokens <= 20000")
    best = s.agg(F.max("score").alias("best"))
    return s.join(F.broadcast(best)).select("id", "source", "score", F.translate(F.substring("content", 1, 100), "\n", " ").alias("preview"), F.round(F.col("score") / F.col("best"), 6).alias("relative")).orderBy(F.desc("score"), "id").limit(20)


@register(f"{_PIPE}, {_EXPAND}, {_SCORED}, r AS (SELECT *, sum(approx_tokens + 5) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS run FROM sc) SELECT id, score FROM r WHERE run + 50 <= 3000")
def pack_prefix(spark, d):
    return retrieval.pack_prefix(_scored(spark, d), None, [F.desc("score"), "id"], "approx_tokens", 3000).select("id", "score")


@register(f"""{_PIPE}, {_EXPAND}, {_SCORED}, r AS (SELECT *, 200 + sum(approx_tokens + 55) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS run FROM sc), o AS (SELECT *, sum(CASE WHEN run > 3000 THEN 1 ELSE 0 END) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS over_, 3000 - (run - approx_tokens - 55) - 55 AS left_ FROM r)
SELECT id, over_ = 1 AS cut FROM o WHERE over_ = 0 OR (over_ = 1 AND left_ > 100)""")
def pack_with_truncation(spark, d):
    return retrieval.pack_truncating(_scored(spark, d), [F.desc("score"), "id"], "approx_tokens", "content", 3000).select("id", "cut")


@register()
def pack_skipping(spark, d):
    """Packing that passes over what does not fit, for each project's newest chunks (100 at most a project)."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_slug").orderBy(F.desc("start_time"), "id")
    c = S.chunks(spark, d).select("session_slug", "id", "approx_tokens", "start_time").withColumn("r", F.row_number().over(w)).filter("r <= 100")
    lists = c.groupBy("session_slug").agg(F.sort_array(F.collect_list(F.struct("r", "id", "approx_tokens"))).alias("l"))
    taken = lists.withColumn("t", retrieval.fits(F.transform("l", lambda x: x["approx_tokens"]), 2000))
    return taken.select("session_slug", F.explode(F.filter("l", lambda x, i: F.get("t", i))).alias("x")).select("session_slug", "x.id", "x.approx_tokens")


@register()
def mmr(spark, d):
    """The pipeline's result reordered for diversity within a budget."""
    s = _scored(spark, d).select(F.lit(1).alias("qid"), "id", "score", F.col("approx_tokens").alias("tokens"))
    return retrieval.rerank_mmr(s.join(S.search_vectors(spark, d).select("id", "embedding"), "id", "left"), budget=6000)


@register(f"{_PIPE}, {_EXPAND} SELECT 'vector' AS method, id FROM ({_TOP.format('vs')}) UNION ALL SELECT 'keyword', id FROM ({_TOP.format('kw')}) UNION ALL SELECT 'fused', id FROM rrf UNION ALL SELECT 'full', id FROM rrf UNION ALL SELECT 'full', id FROM ex")
def compare_methods(spark, d):
    lists, full = _lists(spark, d), _expanded(spark, d).select("id")
    fused = lists.select("id").distinct()
    m = lambda df, n: df.select(F.lit(n).alias("method"), "id")
    return lists.select(F.col("source").alias("method"), "id").unionByName(m(fused, "fused")).unionByName(m(fused, "full")).unionByName(m(full, "full"))


@register(f"""{_PIPE.replace("AS (SELECT *, 'vector'", "AS (SELECT *, 1.0 AS weight, 'vector'").replace("SELECT *, 'keyword', 3", "SELECT *, 1.0, 'keyword', 3 ")}, el AS (SELECT id, row_number() OVER (ORDER BY start_time DESC, id) AS rank FROM c WHERE contains(content, 'TODO') OR session_slug = 'onyx-parser' ORDER BY start_time DESC, id LIMIT 100),
b AS (SELECT id, rank, 1.0 AS weight, 1 AS pr, 'entity' AS source FROM el UNION ALL SELECT id, rank, weight, pr, source FROM lists) SELECT id, round(sum(weight * CASE WHEN source = 'entity' THEN 1.5 ELSE 1 END / (60 + rank)), 9) AS score, arg_min(source, pr) AS source FROM b GROUP BY 1""")
def entity_boost(spark, d):
    """Entity hits (newest first, 100 at most) enter the fusion with weight 1.5."""
    e = S.chunks(spark, d).filter(F.contains("content", F.lit("TODO")) | (F.col("session_slug") == "onyx-parser")).select("id", F.unix_micros("start_time").cast("double").alias("score"))
    return retrieval.fuse(_lists(spark, d).unionByName(retrieval.ranked(e, "entity", 100, 1.5))).withColumn("score", F.round("score", 9))


@register(f"""WITH {P('c')}, p AS (SELECT session_slug FROM c WHERE session_slug <> '' GROUP BY 1 ORDER BY count(*) DESC, session_slug LIMIT 1),
n AS (SELECT id, session_id, start_time, end_time, approx_tokens FROM c WHERE session_slug IN (SELECT session_slug FROM p) ORDER BY start_time DESC, id DESC LIMIT 50), r AS (SELECT *, sum(approx_tokens + 5) OVER (ORDER BY start_time DESC, id DESC ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT session_id, count(*) AS n_chunks, CAST(sum(approx_tokens) AS BIGINT) AS tokens, min(start_time) AS first_start, max(end_time) AS last_end FROM r WHERE run + 50 <= 10000 GROUP BY 1""")
def reconstruct_timeline(spark, d):
    """The newest chunks of a project within a budget (its share at 200 tokens a chunk bounds the scan), by session."""
    c = S.chunks(spark, d)
    top = c.filter("session_slug <> ''").groupBy("session_slug").count().orderBy(F.desc("count"), "session_slug").limit(1)
    mine = c.join(F.broadcast(top.select("session_slug")), "session_slug", "left_semi").orderBy(F.desc("start_time"), F.desc("id")).limit(10_000 // 200)
    kept = retrieval.pack_prefix(mine, None, [F.desc("start_time"), F.desc("id")], "approx_tokens", 10_000)
    return kept.groupBy("session_id").agg(F.count("*").alias("n_chunks"), F.sum("approx_tokens").alias("tokens"), F.min("start_time").alias("first_start"), F.max("end_time").alias("last_end"))
