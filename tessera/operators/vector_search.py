"""Exact vector search: one query by expressions, query sets by blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V

#: Query vectors that are sent to the executors at a time.
QUERY_BLOCK = 2_000


def distances(vectors: DataFrame, query: list[float], distance=V.angular) -> DataFrame:
    """The table with the `distance` of each embedding to one query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("distance", distance(F.col("embedding").cast("array<double>"), q))


def knn(vectors: DataFrame, query: list[float], k: int, distance=V.angular) -> DataFrame:
    """The k nearest rows, ties by id."""
    return distances(vectors, query, distance).orderBy("distance", "id").limit(k)


def _matrix(rows, dim: int | None = None) -> np.ndarray:
    x = np.array([np.asarray(r, np.float64) for r in rows]) if len(rows) else np.zeros((0, dim or 1))
    return x


def _metric(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "euclidean":
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    n = na[:, None] * nb
    cos = np.divide(a @ b.T, n, out=np.zeros((len(a), len(b))), where=n > 0)
    return np.arccos(np.clip(cos, -1, 1)) / np.pi if metric == "angular" else cos


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The stated query set (`id, embedding`) in blocks of bounded size."""
    ids, rows = [], []
    for r in queries.select("id", "embedding").toLocalIterator():
        ids.append(r.id)
        rows.append(r.embedding)
        if len(ids) == QUERY_BLOCK:
            yield np.array(ids, object), _matrix(rows)
            ids, rows = [], []
    if ids:
        yield np.array(ids, object), _matrix(rows)


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "angular") -> DataFrame:
    """qid, id, distance (6 decimals), rank: the k nearest vectors of each of a stated set of queries, itself excluded.

    Every partition of the vectors gives its best k per query; these are merged. Ties go to the smaller id. Ids keep
    their type; null embeddings must be filtered before.
    """
    kind = dict(vectors.dtypes)["id"]
    spark = vectors.sparkSession
    parts = None
    for ids, x in query_blocks(queries):
        shared = spark.sparkContext.broadcast((ids, x))

        def run(frames, shared=shared):
            ids, x = shared.value
            for f in frames:
                if not len(f):
                    continue
                d = np.round(_metric(x, _matrix(f["embedding"].tolist()), metric), 6)
                names = f["id"].to_numpy()
                d[ids[:, None] == names[None, :].astype(object)] = np.inf
                n = min(k, d.shape[1])
                bound = np.partition(d, n - 1, axis=1)[:, n - 1]
                a, b = np.nonzero((d <= bound[:, None]) & np.isfinite(d))
                got = pd.DataFrame({"qid": ids[a], "id": names[b], "distance": d[a, b]}).sort_values(["qid", "distance", "id"])
                yield got[got.groupby("qid").cumcount() < k]

        part = vectors.select("id", "embedding").mapInPandas(run, f"qid {kind}, id {kind}, distance double")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return spark.createDataFrame([], f"qid {kind}, id {kind}, distance double, rank int")
    w = Window.partitionBy("qid").orderBy("distance", "id")
    return parts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def within_angle(vectors: DataFrame, centres: DataFrame, most: float, only_nearest: bool = False) -> DataFrame:
    """qid, id, distance: every centre (`id, embedding`) within an angle (share of pi, below `most`) of each vector, or
    only the nearest of each block of centres (angles at 6 decimals, ties to the smaller id).

    Centres are sent to the executors in blocks of bounded size and compared by matrix products.
    """
    kind, of = dict(vectors.dtypes)["id"], dict(centres.dtypes)["id"]
    spark = vectors.sparkSession
    parts = None
    for ids, x in query_blocks(centres):
        order = np.argsort(ids)
        shared = spark.sparkContext.broadcast((ids[order], x[order]))

        def run(frames, shared=shared):
            ids, x = shared.value
            for f in frames:
                if len(f) and only_nearest:
                    d = np.round(_metric(_matrix(f["embedding"].tolist()), x, "angular"), 6)
                    b = d.argmin(1)
                    low = d[np.arange(len(d)), b]
                    ok = low < most
                    yield pd.DataFrame({"qid": f["id"].to_numpy()[ok], "id": ids[b[ok]], "distance": low[ok]})
                elif len(f):
                    d = _metric(_matrix(f["embedding"].tolist()), x, "angular")
                    a, b = np.nonzero(d < most)
                    yield pd.DataFrame({"qid": f["id"].to_numpy()[a], "id": ids[b], "distance": d[a, b]})

        part = vectors.select("id", "embedding").mapInPandas(run, f"qid {kind}, id {of}, distance double")
        parts = part if parts is None else parts.unionByName(part)
    return parts if parts is not None else spark.createDataFrame([], f"qid {kind}, id {of}, distance double")


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Per group the unit-length mean of its embeddings (null where the mean is zero).

    Positions are summed element-wise with partial aggregation.
    """
    e = vectors.select(group, F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    means = e.groupBy(group, "pos").agg(F.avg("x").alias("m"))
    c = means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    n = V.norm(F.col("mean"))
    return c.select(group, F.when(n > 0, F.transform("mean", lambda x: x / n)).alias("centroid"))


def embed_by_hashing(docs: DataFrame, dim: int = 64) -> DataFrame:
    """A stand-in embedder where no model is at hand: signed hashed word counts, unit length (zero for wordless texts)."""
    from tessera.functions.text import words

    w = docs.select("id", F.explode(words(F.col("text"))).alias("w")).select("id", F.pmod(F.xxhash64("w"), F.lit(dim)).alias("pos"), F.when(F.pmod(F.xxhash64("w", F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s"))
    cells = w.groupBy("id", "pos").agg(F.sum("s").alias("x"))
    maps = cells.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return maps.select("id", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.greatest("n", F.lit(1e-12))).alias("embedding"))


def embed_with_cache(docs: DataFrame, cache: DataFrame, model: str, embed) -> tuple[DataFrame, DataFrame]:
    """Embeddings of `id, text` through a cache (`content_hash, model_id, embedding, hit_count`): only texts that it does
    not hold go to `embed`, once per distinct text. Returns (id, embedding) and the cache's new state."""
    h = docs.withColumn("content_hash", F.sha2("text", 256)).filter("text is not null")
    mine = cache.filter(F.col("model_id") == model)
    known = h.join(mine.select("content_hash", "embedding"), "content_hash")
    fresh_text = h.join(mine.select("content_hash"), "content_hash", "left_anti").groupBy("content_hash").agg(F.first("text").alias("text"))
    fresh = embed(fresh_text.withColumnRenamed("content_hash", "id")).withColumnRenamed("id", "content_hash")
    done = known.select("id", "embedding").unionByName(h.join(fresh, "content_hash").select("id", "embedding"))
    hits = known.groupBy("content_hash").agg(F.count("*").alias("_h"))
    state = cache.join(hits.withColumn("model_id", F.lit(model)), ["content_hash", "model_id"], "left").withColumn("hit_count", F.col("hit_count") + F.coalesce("_h", F.lit(0))).drop("_h")
    return done, state.unionByName(fresh.select("content_hash", F.lit(model).alias("model_id"), "embedding", F.lit(0).cast("long").alias("hit_count")))
