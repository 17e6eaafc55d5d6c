"""Nearest rows between two tables of vectors, by blocks of bounded size on both sides.

Rows are numbered densely from 0 (`num`) and cut into blocks by their number, so blocks are of one size whatever the
data. Every block of queries meets every block of entries in a task of its own; a task keeps the best per query only, so
no pair of rows is ever emitted beyond those. All pairs are computed: the work is the product of both sides, and a row
travels once for each block of the other side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import rank_within
from tessera.runtime import materialise

#: Rows of a block; a task holds two blocks.
BLOCK = 16_000
_CHUNK = 1024


def numbered(vectors: DataFrame) -> DataFrame:
    """`id, embedding` with the dense number `num` in the order of ids, written once."""
    return materialise(rank_within(vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")), [], ["id"], "num"), "numbered")


def _euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T), 0))


def _meet(queries: DataFrame, entries: DataFrame, n_queries: int, n_entries: int, kernel, schema: str, block: int) -> DataFrame:
    cut = lambda df, own, other, n: df.withColumn(own, F.floor(F.col("num") / block).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-n // block) - 1)))))
    q = cut(queries, "qb", "eb", n_entries)
    e = cut(entries, "eb", "qb", n_queries)
    q, e = q.toDF(*q.columns), e.toDF(*e.columns)

    def run(queries, entries):
        if not len(queries) or not len(entries):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        return kernel(queries, entries)

    return q.groupBy("qb", "eb").cogroup(e.groupBy("qb", "eb")).applyInPandas(run, schema)


def _stack(f: pd.DataFrame) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in f["embedding"]])


def nearest_rows(queries: DataFrame, entries: DataFrame, k: int, same: bool = False, block: int = BLOCK) -> DataFrame:
    """num, other, distance (Euclidean), rank: the k nearest entries of each query (`num, embedding` each).

    `same` says that both are one table, where a row is not its own neighbour. Ties go to the smaller number.
    """

    def kernel(q, e):
        x, y, qn, en = _stack(q), _stack(e), q["num"].to_numpy(np.int64), e["num"].to_numpy(np.int64)
        order = np.argsort(en)
        y, en = y[order], en[order]
        out = []
        for lo in range(0, len(x), _CHUNK):
            d = _euclidean(x[lo : lo + _CHUNK], y)
            if same:
                d[qn[lo : lo + _CHUNK, None] == en[None, :]] = np.inf
            n = min(k, d.shape[1])
            bound = np.partition(d, n - 1, axis=1)[:, n - 1]
            a, b = np.nonzero((d <= bound[:, None]) & np.isfinite(d))
            at = np.lexsort((en[b], d[a, b], a))
            a, b = a[at], b[at]
            start = np.searchsorted(a, np.arange(len(d)))
            first = np.arange(len(a)) - start[a] < n
            a, b = a[first], b[first]
            out.append(pd.DataFrame({"num": qn[lo + a], "other": en[b], "distance": d[a, b]}))
        return pd.concat(out, ignore_index=True)

    found = _meet(queries.select("num", "embedding"), entries.select("num", "embedding"), queries.count(), entries.count(), kernel, "num long, other long, distance double", block)
    w = Window.partitionBy("num").orderBy("distance", "other")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_by_reach(queries: DataFrame, entries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """As `nearest_rows` within one table, by mutual reachability: the largest of the distance and both rows' `core`."""

    def kernel(q, e):
        x, y, qn, en = _stack(q), _stack(e), q["num"].to_numpy(np.int64), e["num"].to_numpy(np.int64)
        qc, ec = q["core"].to_numpy(float), e["core"].to_numpy(float)
        out = []
        for lo in range(0, len(x), _CHUNK):
            d = np.round(np.maximum(np.maximum(_euclidean(x[lo : lo + _CHUNK], y), qc[lo : lo + _CHUNK, None]), ec[None, :]), 6)
            d[qn[lo : lo + _CHUNK, None] == en[None, :]] = np.inf
            a, b = np.nonzero(np.isfinite(d))
            n = min(k, d.shape[1])
            keep = d[a, b] <= np.partition(d, n - 1, axis=1)[a, n - 1]
            got = pd.DataFrame({"num": qn[lo + a[keep]], "other": en[b[keep]], "distance": d[a[keep], b[keep]]}).sort_values(["num", "distance", "other"])
            out.append(got[got.groupby("num").cumcount() < k])
        return pd.concat(out, ignore_index=True)

    found = _meet(queries.select("num", "embedding", "core"), entries.select("num", "embedding", "core"), queries.count(), entries.count(), kernel, "num long, other long, distance double", block)
    w = Window.partitionBy("num").orderBy("distance", "other")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def crossings(rows: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """For each `part` of the rows (`num, embedding, core, part`) its lightest link to another part by mutual
    reachability: a, b, weight."""

    def kernel(q, e):
        x, y = _stack(q), _stack(e)
        qn, en, qp, ep = (f[c].to_numpy(np.int64) for c in ("num", "part") for f in (q, e))
        qc, ec = q["core"].to_numpy(float), e["core"].to_numpy(float)
        best = []
        for lo in range(0, len(x), _CHUNK):
            d = np.maximum(np.maximum(_euclidean(x[lo : lo + _CHUNK], y), qc[lo : lo + _CHUNK, None]), ec[None, :])
            d[qp[lo : lo + _CHUNK, None] == ep[None, :]] = np.inf
            at = d.argmin(1)
            w = d[np.arange(len(d)), at]
            ok = np.isfinite(w)
            best.append(pd.DataFrame({"part": qp[lo : lo + _CHUNK][ok], "weight": w[ok], "a": np.minimum(qn[lo : lo + _CHUNK], en[at])[ok], "b": np.maximum(qn[lo : lo + _CHUNK], en[at])[ok]}))
        got = pd.concat(best, ignore_index=True).sort_values(["part", "weight", "a", "b"])
        return got.drop_duplicates("part")

    found = _meet(rows, rows, n, n, kernel, "part long, weight double, a long, b long", block)
    return found.groupBy("part").agg(F.min(F.struct("weight", "a", "b")).alias("m")).select("m.a", "m.b", "m.weight").distinct()
