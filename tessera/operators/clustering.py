"""Density clustering with a hierarchy (HDBSCAN) over all vectors, assignment of new ones, and outlier scores.

Core distances and links come from exact nearest neighbours, block by block (`block_search`); the links' spanning forest
is reduced partition by partition, since the lightest tree of a union is that of the parts' lightest trees; parts that
neighbours leave unconnected are joined by their lightest link of all, round by round (Boruvka). Only the tree, three
numbers a vector, is then gathered in one task, which is where the hierarchy is read off.

The tree is that of the links to at least NEIGHBOURS neighbours and between parts. A lighter link between two rows that
are not among each other's NEIGHBOURS nearest, within one part, is not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.block_search import BLOCK, crossings, nearest_rows, numbered
from tessera.runtime import broadcast_if_small, materialise

MIN_CLUSTER_SIZE = 4
EXEMPLARS = 3
NEIGHBOURS = 16
#: Links that one task reduces to a forest at a time.
LINKS_PER_TASK = 2_000_000


def _settle(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number of each one's set after these links; `parent` holds it before."""
    parent = parent.copy()
    while len(a):
        x, y = parent[a], parent[b]
        low = np.minimum(x, y)
        np.minimum.at(parent, x, low)
        np.minimum.at(parent, y, low)
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
        apart = parent[a] != parent[b]
        a, b = a[apart], b[apart]
    return parent


def spanning_forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The links (by index) of the lightest spanning forest over numbers 0 to n - 1, and each one's part (Boruvka).

    Ties go to the smaller a, then b.
    """
    order = np.lexsort((b, a, weight))
    a, b = a[order], b[order]
    part, chosen = np.arange(n), []
    live = np.arange(len(a))
    while len(live):
        live = live[part[a[live]] != part[b[live]]]
        if not len(live):
            break
        first = np.full(n, len(a))
        np.minimum.at(first, part[a[live]], live)
        np.minimum.at(first, part[b[live]], live)
        take = np.unique(first[first < len(a)])
        chosen.append(take)
        part = _settle(part, part[a[take]], part[b[take]])[part]
    return order[np.concatenate(chosen)] if chosen else np.zeros(0, np.int64), part


@dataclass
class Hierarchy:
    """Flat clusters of a spanning tree: label (-1 is noise), membership probability and outlier score per point."""

    labels: np.ndarray
    probability: np.ndarray
    outlier: np.ndarray


def hierarchy(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int, least: int = MIN_CLUSTER_SIZE, leaves: bool = False) -> Hierarchy:
    """Clusters of a spanning tree by excess of mass, or its leaf clusters.

    Going up the tree, a component becomes a cluster when it reaches `least` points; two clusters that meet end and are
    the children of a new one; points that meet a cluster join it. A cluster's stability is its members times the span
    of 1 / distance it lives for; a cluster is taken if it is at least as stable as the best choice below it, and then
    nothing below it is (the whole set is never taken where it has children). Ends at distance 0 count as no span.
    The probability is a point's 1 / distance within its cluster's span, 1 where that has no finite end; the outlier score
    is 1 less the share of its 1 / distance in the cluster's largest, 1 for noise.
    """
    group = np.arange(n)
    members: dict[int, list[int]] = {i: [i] for i in range(n)}
    alive: dict[int, int] = {}
    born: list[float] = []
    died: list[float] = []
    kids: list[list[int]] = []
    own: list[list[int]] = []
    joined = np.zeros(n)

    def begin(points: list[int], lam: float, children: list[int]) -> int:
        born.append(lam)
        died.append(0.0)
        kids.append(children)
        own.append(list(points))
        return len(born) - 1

    order = np.lexsort((b, a, weight))
    for x, y, w in zip(a[order].tolist(), b[order].tolist(), weight[order].tolist()):
        lam = np.inf if w == 0 else 1 / w
        ga, gb = group[x], group[y]
        if len(members[ga]) < len(members[gb]):
            ga, gb = gb, ga
        ca, cb = alive.pop(ga, None), alive.pop(gb, None)
        moved = members.pop(gb)
        kept = members[ga]
        if ca is not None and cb is not None:
            died[ca] = died[cb] = lam
            new = begin(kept + moved, lam, [ca, cb])
        elif ca is not None or cb is not None:
            new = ca if ca is not None else cb
            more = moved if ca is not None else kept
            own[new] += more
            joined[more] = lam
        else:
            new = begin(kept + moved, lam, []) if len(kept) + len(moved) >= least else None
            if new is not None:
                joined[own[new]] = lam
        kept += moved
        group[moved] = ga
        if new is not None:
            alive[ga] = new
    finite = lambda v: 0.0 if np.isinf(v) else v
    stable = [len(own[c]) * max(0.0, finite(born[c]) - died[c]) for c in range(len(born))]
    top = set(alive.values())
    best, taken = list(stable), [True] * len(born)
    for c in range(len(born)):  # children always come before their parent
        if kids[c]:
            below = sum(best[k] for k in kids[c])
            taken[c] = not leaves and stable[c] >= below and c not in top
            best[c] = stable[c] if taken[c] else below
    labels = np.full(n, -1)
    stack, found = list(top), []
    while stack:
        c = stack.pop()
        if taken[c]:
            found.append(c)
        else:
            stack += kids[c]
    probability, outlier = np.zeros(n), np.ones(n)
    for i, c in enumerate(sorted(found, key=lambda c: min(own[c]))):
        mine = np.array(own[c])
        labels[mine] = i
        lam = joined[mine]
        ends = lam[np.isfinite(lam)]
        most = ends.max() if len(ends) else 0.0
        if most > died[c]:
            probability[mine] = np.clip((np.minimum(lam, most) - died[c]) / (most - died[c]), 0, 1)
        else:
            probability[mine] = 1.0
        outlier[mine] = np.where(np.isfinite(lam), np.clip(1 - lam / most, 0, 1), 0.0) if most else 0.0
    return Hierarchy(labels, probability, outlier)


def _reduce(links: DataFrame, parts: int) -> DataFrame:
    """The spanning forests of the links, by partitions."""

    def run(frames):
        f = pd.concat([x for x in frames if len(x)] or [pd.DataFrame({"a": [], "b": [], "weight": []})], ignore_index=True)
        if not len(f):
            return
        names, at = np.unique(np.concatenate([f["a"], f["b"]]).astype(np.int64), return_inverse=True)
        keep, _ = spanning_forest(at[: len(f)], at[len(f) :], f["weight"].to_numpy(float), len(names))
        yield f.iloc[np.sort(keep)]

    placed = links.coalesce(1) if parts == 1 else links.repartition(parts, F.floor(F.least("a", "b") / 4096))
    return placed.mapInPandas(run, "a long, b long, weight double")


def spanning_links(points: DataFrame, n: int, least: int, block: int = BLOCK, near: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The spanning tree (a, b, weight) of `num, embedding` by mutual reachability, and the core distance of each num.

    `near`: the nearest rows, if they are known (at least `least` a row).
    """
    if near is None:
        near = materialise(nearest_rows(points, points, min(n - 1, max(least, NEIGHBOURS)), True, block), "near")
    core = materialise(near.groupBy("num").agg(F.max(F.when(F.col("rank") <= least, F.col("distance"))).alias("core")), "core")
    ends = near.join(broadcast_if_small(core), "num").join(broadcast_if_small(core.select(F.col("num").alias("other"), F.col("core").alias("core2"))), "other")
    links = ends.select(F.least("num", "other").alias("a"), F.greatest("num", "other").alias("b"), F.greatest("distance", "core", "core2").alias("weight")).distinct()
    while True:
        size = (links := materialise(links, "links")).count()
        while size > LINKS_PER_TASK:
            parts = -(-size // LINKS_PER_TASK)
            links = materialise(_reduce(links, max(1, parts // 2)), "links")
            if size == (size := links.count()) or parts == 1:
                break
        tree = materialise(_reduce(links, 1), "tree")
        if tree.count() >= n - 1:
            return tree, core
        parts = materialise(tree.coalesce(1).mapInPandas(_parts_of(n), "num long, part long"), "parts")
        rows = materialise(points.select("num", "embedding").join(core, "num").join(parts, "num"), "parted")
        links = tree.unionByName(crossings(rows, n, block)).distinct()


def _parts_of(n: int):
    def run(frames):
        f = pd.concat(list(frames) or [pd.DataFrame({"a": [], "b": []})], ignore_index=True)
        part = _settle(np.arange(n), f["a"].to_numpy(np.int64), f["b"].to_numpy(np.int64))
        for lo in range(0, n, 50_000):
            yield pd.DataFrame({"num": np.arange(lo, min(n, lo + 50_000)), "part": part[lo : lo + 50_000]})

    return run


def hdbscan(vectors: DataFrame, least: int = MIN_CLUSTER_SIZE, leaves: bool = False, block: int = BLOCK) -> DataFrame:
    """id, label, distance to the centroid, probability and outlier score of every vector (`id, embedding`); -1 is noise.

    Labels count from 0 in the order of the clusters' smallest ids. All vectors take part, whatever their number; equal
    vectors are at distance 0. Null embeddings must be filtered before; ids must be distinct; an empty table gives an
    empty result and a single vector is noise.
    """
    kind = dict(vectors.dtypes)["id"]
    schema = f"id {kind}, label int, distance double, probability double, outlier double"
    points = numbered(vectors)
    n = points.count()
    if n < 2:
        return points.select("id", F.lit(-1).alias("label"), F.lit(None).cast("double").alias("distance"), F.lit(0.0).alias("probability"), F.lit(1.0).alias("outlier")).to(vectors.sparkSession.createDataFrame([], schema).schema)
    labels = _labelled(spanning_links(points, n, least, block)[0], n, least, leaves)
    rows = materialise(points.join(broadcast_if_small(labels), "num"), "labelled")
    means = _means(rows.filter("label >= 0"))
    far = F.sqrt(F.aggregate(F.zip_with("embedding", "mean", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return rows.join(broadcast_if_small(means), "label", "left").select("id", "label", F.when(F.col("label") >= 0, far).alias("distance"), "probability", "outlier")


def _labelled(tree: DataFrame, n: int, least: int, leaves: bool = False) -> DataFrame:
    def read(frames):
        f = pd.concat(list(frames), ignore_index=True)
        h = hierarchy(f["a"].to_numpy(np.int64), f["b"].to_numpy(np.int64), f["weight"].to_numpy(float), n, least, leaves)
        for lo in range(0, n, 50_000):
            hi = min(n, lo + 50_000)
            yield pd.DataFrame({"num": np.arange(lo, hi), "label": h.labels[lo:hi].astype(np.int32), "probability": h.probability[lo:hi], "outlier": h.outlier[lo:hi]})

    return materialise(tree.coalesce(1).mapInPandas(read, "num long, label int, probability double, outlier double"), "labels")


def sweep(vectors: DataFrame, sizes: list[int], block: int = BLOCK) -> DataFrame:
    """least, n_clusters and noise (share) for several least cluster sizes; neighbours are searched once."""
    points = numbered(vectors)
    n = points.count()
    near = materialise(nearest_rows(points, points, min(max(1, n - 1), max(*sizes, NEIGHBOURS)), True, block), "near")
    out = None
    for least in sizes if n > 1 else []:
        labels = _labelled(spanning_links(points, n, least, block, near)[0], n, least)
        row = labels.agg(F.lit(least).alias("least"), (F.max("label") + 1).alias("n_clusters"), F.avg((F.col("label") < 0).cast("double")).alias("noise"))
        out = row if out is None else out.unionByName(row)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "least int, n_clusters int, noise double")


def _means(rows: DataFrame) -> DataFrame:
    """label and the mean of its embeddings, position by position with partial sums."""
    e = rows.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("m"))
    return materialise(e.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean")), "means")


def cluster_model(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """What assignment needs, as a table: per cluster its centroid, EXEMPLARS nearest members (`kind` 0 and 1) and `spread`,
    the mean distance to the centroid: label, kind, spread, embedding."""
    own = labels.filter("label >= 0").select("id", "label", "distance").join(vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")), "id")
    means = _means(own)
    spread = own.groupBy("label").agg(F.avg("distance").alias("spread"))
    salt = F.pmod(F.xxhash64("id"), F.lit(32))
    best = lambda c: F.slice(F.sort_array(c), 1, EXEMPLARS)
    part = own.groupBy("label", salt.alias("salt")).agg(best(F.collect_list(F.struct("distance", "id", "embedding"))).alias("s"))
    typical = part.groupBy("label").agg(best(F.flatten(F.collect_list("s"))).alias("s")).select("label", F.explode("s").alias("x")).select("label", F.lit(1).alias("kind"), "x.embedding")
    rows = means.select("label", F.lit(0).alias("kind"), F.col("mean").alias("embedding")).unionByName(typical)
    return rows.join(spread, "label").select("label", "kind", "spread", "embedding")


def assign(vectors: DataFrame, model: DataFrame, reach: float = 2.0, block: int = BLOCK) -> DataFrame:
    """id, label of new vectors: the cluster of the nearest centroid or exemplar, -1 where its centroid is farther than
    `reach` times the cluster's spread. Without clusters all are noise."""
    m = materialise(rank_within_model(model), "model")
    points = numbered(vectors)
    if m.isEmpty():
        return points.select("id", F.lit(-1).alias("label"))
    near = nearest_rows(points, m, 1, False, block).join(m.select(F.col("num").alias("other"), "label", "spread"), "other").select("num", "label", "spread")
    cents = m.filter("kind = 0").select("label", F.col("embedding").alias("mean"))
    far = F.sqrt(F.aggregate(F.zip_with("embedding", "mean", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    got = points.join(near, "num").join(broadcast_if_small(cents), "label")
    return got.select("id", F.when(far <= reach * F.greatest("spread", F.lit(1e-12)), F.col("label")).otherwise(-1).alias("label"))


def rank_within_model(model: DataFrame) -> DataFrame:
    from tessera.operators.ranking import rank_within

    return rank_within(model, [], ["label", "kind", "embedding"], "num")


def save_model(model: DataFrame, path: str, n_fitted: int) -> None:
    """Keep a fitted model (of a project and an embedding model, by path) with the number of vectors it was fitted on."""
    model.withColumn("n_fitted", F.lit(n_fitted).cast("long")).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    m = spark.read.parquet(path)
    r = m.select("n_fitted").first()
    return m.drop("n_fitted"), r.n_fitted if r else 0


def needs_refit(n_fitted: int, n_new: int, most_growth: float = 0.3) -> bool:
    """Whether new vectors are too many for incremental assignment."""
    return n_fitted == 0 or n_new / n_fitted > most_growth


def update(vectors: DataFrame, model: DataFrame, n_fitted: int, least: int = MIN_CLUSTER_SIZE) -> tuple[DataFrame, bool]:
    """Labels (id, label) of new vectors by the model, or of a fit of them where they are too many for it; and which."""
    if needs_refit(n_fitted, vectors.count()):
        return hdbscan(vectors, least).select("id", "label"), True
    return assign(vectors, model), False
