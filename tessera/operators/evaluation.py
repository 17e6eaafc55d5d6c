"""Quality measures: ranking, separation, classification, health."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import running_sum
from tessera.operators.vector_search import _matrix, _metric, query_blocks
from tessera.runtime import materialise

# Weights of the overall score and latency steps.
PART_WEIGHTS = {"health": 25, "retrieval": 35, "chain": 25, "latency": 15}
LATENCY_STEPS = ((50, 100), (100, 80), (200, 60), (500, 40))


def _counts(scored: DataFrame, score: str, positive: str) -> DataFrame:
    p = F.col(positive).cast("long")
    return scored.filter(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(score).agg(F.sum(p).alias("pos"), F.sum(1 - p).alias("neg"))


def roc_auc(scored: DataFrame, score: str, positive: str) -> DataFrame:
    """The probability that a positive row scores higher than a negative one, ties half (null without both kinds).

    Rows are counted by score first; the running count of negatives below comes from range partitions.
    """
    n = running_sum(_counts(scored, score, positive), [score], "neg", "below")
    a = n.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return a.select(F.try_divide("u", F.col("p") * F.col("n")).alias("auc"), F.col("p").alias("n_positive"), F.col("n").alias("n_negative"))


def youden(scored: DataFrame, score: str, positive: str) -> DataFrame:
    """The threshold (score >= threshold is positive) with the largest sensitivity + specificity - 1, ties to the
    larger; with precision, recall and F1 there."""
    c = materialise(_counts(scored, score, positive), "counts")
    total = c.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    r = running_sum(running_sum(c, [score], "neg", "neg_below"), [score], "pos", "pos_below").join(F.broadcast(total))
    tp, fp = F.col("p") - F.col("pos_below"), F.col("n") - F.col("neg_below")
    m = r.select(F.col(score).alias("threshold"), (tp / F.col("p") - fp / F.col("n")).alias("j"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, F.col("p")).alias("recall"))
    best = m.agg(F.max_by(F.struct("threshold", "j", "precision", "recall"), F.struct(F.round("j", 9), "threshold")).alias("b")).select("b.*")
    return best.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def silhouette(queries: DataFrame, points: DataFrame, metric: str = "angular") -> DataFrame:
    """id, label, silhouette of a stated set of points against all (`id, embedding, label`; label < 0 is noise).

    Each partition sums the distances of every query to every label; only these sums are shuffled. A point alone in its
    cluster has an inner distance of 0; without a second cluster the silhouette is 0.
    """
    kind = dict(points.dtypes)["id"]
    spark = points.sparkSession
    parts = None
    for ids, x in query_blocks(queries):
        shared = spark.sparkContext.broadcast((ids, x))

        def run(frames, shared=shared):
            ids, x = shared.value
            for f in frames:
                if not len(f):
                    continue
                d = _metric(x, _matrix(f["embedding"].tolist()), metric)
                same = ids[:, None] == f["id"].to_numpy().astype(object)[None, :]
                labels = f["label"].to_numpy()
                for c in np.unique(labels):
                    m = labels == c
                    part = np.where(same[:, m], 0.0, d[:, m])
                    yield pd.DataFrame({"id": ids, "other": np.full(len(ids), c), "total": part.sum(1), "n": (~same[:, m]).sum(1)})

        p = points.filter("label >= 0").select("id", "embedding", "label").mapInPandas(run, f"id {kind}, other int, total double, n long")
        parts = p if parts is None else parts.unionByName(p)
    if parts is None:
        return spark.createDataFrame([], f"id {kind}, label int, silhouette double")
    means = parts.groupBy("id", "other").agg((F.sum("total") / F.greatest(F.sum("n"), F.lit(1))).alias("mean"))
    j = means.join(queries.filter("label >= 0").select("id", F.col("label").cast("int").alias("label")), "id")
    g = j.groupBy("id", "label").agg(F.max(F.when(F.col("other") == F.col("label"), F.col("mean"))).alias("a"), F.min(F.when(F.col("other") != F.col("label"), F.col("mean"))).alias("b"))
    top = F.greatest("a", "b")
    return g.select("id", "label", F.when(F.col("b").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top).alias("silhouette"))


def spearman_ordinal(bins: DataFrame, x: str, y: str) -> DataFrame:
    """1 - 6 sum(d^2) / (n (n^2 - 1)) with ordinal ranks (ties by x); for small tables such as bins."""
    from pyspark.sql import Window

    w = lambda *c: F.row_number().over(Window.orderBy(*c))
    r = bins.withColumn("_x", w(x)).withColumn("_y", w(F.desc(y), x))
    a = r.agg(F.sum(F.pow(F.col("_x") - F.col("_y"), 2)).alias("d"), F.count("*").alias("n"))
    return a.select(F.when(F.col("n") > 1, 1 - 6 * F.col("d") / (F.col("n") * (F.col("n") * F.col("n") - 1))).alias("spearman"))


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def health_score(edges_per_chunk: Column, coverage: Column, orphans: Column) -> Column:
    return F.least(F.lit(100.0), 30 * F.least(F.lit(1.0), edges_per_chunk / 3) + 40 * coverage + 30 * (1 - orphans))


def latency_score(p95: Column) -> Column:
    c = F
    for most, points in LATENCY_STEPS:
        c = c.when(p95 <= most, float(points))
    return c.otherwise(20.0)


def overall_score(parts: dict[str, Column]) -> Column:
    """The weighted mean of the parts that are there (null parts do not count)."""
    total = sum((F.when(c.isNotNull(), c * PART_WEIGHTS[n]).otherwise(0.0) for n, c in parts.items()), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), PART_WEIGHTS[n]).otherwise(0) for n, c in parts.items()), F.lit(0))
    return F.try_divide(total, weight)


def lexical_score(shift: Column, continuation: Column, path_overlap: Column, keyword_overlap: Column, gap_minutes: Column) -> Column:
    """Topic continuity from text alone, 0 to 1 (fixed weights)."""
    gap = F.when(gap_minutes > 30, -0.25).when(gap_minutes > 10, -0.1).otherwise(0.0)
    return clip01(0.5 - F.when(shift, 0.4).otherwise(0.0) + F.when(continuation, 0.3).otherwise(0.0) + 0.2 * path_overlap + 0.15 * keyword_overlap + gap)


# Weights of the hybrid continuity score.
HYBRID = {"similarity": 0.5, "shift": 0.2, "time": 0.15, "continuation": 0.05, "paths": 0.05, "keywords": 0.05}


def hybrid_score(features: dict[str, Column], leave_out: tuple[str, ...] = ()) -> Column:
    """Weighted mean of the features that are not left out, weights renormalised."""
    kept = {n: w for n, w in HYBRID.items() if n not in leave_out}
    return sum((features[n] * (w / sum(kept.values())) for n, w in kept.items()), F.lit(0.0))


def time_feature(gap_minutes: Column) -> Column:
    return 1 / (1 + F.exp(0.1 * (gap_minutes - 30)))
