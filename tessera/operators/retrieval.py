"""The retrieval pipeline over ranked lists: fusion, boosts, expansion, rescoring, diversity, packing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order in which sources are credited (fixed values).
PRIORITY = {"graph": 0, "entity": 1, "cluster": 2, "keyword": 3, "vector": 4}
RRF_K = 60
HALF_LIFE_HOURS, RECENCY_WEIGHT, SESSION_FACTOR = 48.0, 0.3, 1.2
LENGTH_REFERENCE = 500
MMR_LEAST, MMR_LAMBDA, MMR_SLOTS = 10, 0.7, 15


def ranked(hits: DataFrame, source: str, limit: int, weight: float = 1.0) -> DataFrame:
    """A list for fusion from `id, score`: the best `limit`, ranked from 1, ties by id."""
    top = hits.select("id", "score").orderBy(F.desc("score"), "id").limit(limit)
    return top.select("id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"), F.lit(source).alias("source"), F.lit(float(weight)).alias("weight"))


def fuse(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of `id, rank, source, weight`: the sum of weight / (k + rank), credited to the best source."""
    priority = F.create_map(*[x for s, p in PRIORITY.items() for x in (F.lit(s), F.lit(p))])
    g = lists.groupBy("id").agg(F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))).alias("score"), F.min_by("source", priority[F.col("source")]).alias("source"))
    return g


def recency(start: Column, now: Column, session: Column | None = None) -> Column:
    """1 + 0.3 exp(-age in hours ln 2 / 48), times 1.2 within the session."""
    age = (F.unix_micros(now) - F.unix_micros(start)) / 3.6e9
    boost = 1 + RECENCY_WEIGHT * F.exp(-age * math.log(2) / HALF_LIFE_HOURS)
    return boost * F.when(session, SESSION_FACTOR).otherwise(1.0) if session is not None else boost


def length_penalty(tokens: Column) -> Column:
    return 1 / (1 + F.log2(F.greatest(F.lit(1.0), tokens / float(LENGTH_REFERENCE))))


def expand_clusters(hits: DataFrame, assignments: DataFrame, chunks: DataFrame, clusters: int = 3, siblings: int = 5, feedback: DataFrame | None = None, feedback_weight: float = 0.1) -> DataFrame:
    """Siblings of the hits (`id, score`): the first `clusters` distinct clusters in hit order, each with its `siblings`
    nearest members that are no hits and are in `chunks` (`id`). Score: hit score (1 - distance), if above 0, plus the
    weighted log2(1 + retrievals) of the sibling. A sibling of two clusters counts for the first. Null distances are 1.
    """
    h = hits.withColumn("_pos", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    a = assignments.select(F.col("chunk_id").alias("id"), "cluster_id", F.coalesce("distance", F.lit(1.0)).alias("_d"))
    first = F.broadcast(h).join(a, "id").groupBy("cluster_id").agg(F.min(F.struct("_pos", "_d", "cluster_id", "score")).alias("_f"))
    walked = first.select("cluster_id", F.col("_f.score").alias("_hit"), F.row_number().over(Window.orderBy("_f")).alias("_order")).filter(F.col("_order") <= clusters)
    sib = a.join(F.broadcast(walked), "cluster_id").join(F.broadcast(hits.select("id")), "id", "left_anti").join(chunks.select("id"), "id", "left_semi")
    score = F.col("_hit") * (1 - F.col("_d"))
    near = Window.partitionBy("cluster_id").orderBy("_d", "id")
    picked = sib.filter(score > 0).withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= siblings).withColumn("score", score)
    out = picked.groupBy("id").agg(F.min_by("score", "_order").alias("score"))
    if feedback is not None:
        n = feedback.groupBy(F.col("chunk_id").alias("id")).agg(F.count("*").alias("_r"))
        out = out.join(n, "id", "left").select("id", (F.col("score") + feedback_weight * F.log2(1 + F.coalesce("_r", F.lit(0)))).alias("score"))
    return out.withColumn("source", F.lit("cluster"))


def pack_prefix(rows: DataFrame, group: str | None, order: list, tokens: str, budget: int, fixed: int = 50, each: int = 5) -> DataFrame:
    """The longest prefix in `order` whose tokens, with `each` per row and `fixed` once, stay within the budget."""
    w = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_run", F.sum(F.col(tokens) + each).over(w)).filter(F.col("_run") + fixed <= budget).drop("_run")


def pack_truncating(rows: DataFrame, order: list, tokens: str, text: str, budget: int, fixed: int = 200, each: int = 55, least: int = 100) -> DataFrame:
    """As a prefix, but the first row that does not fit is cut to what is left if that is more than `least` tokens.

    Cut texts end at the last blank line past their half, else at 4 characters a token. Adds `packed` and `cut`.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumn("_run", F.sum(F.col(tokens) + each).over(w) + fixed)
    left = F.lit(budget) - (F.col("_run") - F.col(tokens) - each) - each
    first = Window.partitionBy(F.lit(0)).orderBy(*order)
    over = run.withColumn("_over", F.sum((F.col("_run") > budget).cast("int")).over(first.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_left", left)
    kept = over.filter((F.col("_over") == 0) | ((F.col("_over") == 1) & (F.col("_left") > least)))
    head = F.substring(F.col(text), F.lit(1), (F.col("_left") * 4).cast("int"))
    at = F.length(head) - F.instr(F.reverse(head), "\n\n") - 1
    fine = (F.instr(F.reverse(head), "\n\n") > 0) & (at > F.length(head) / 2)
    return kept.withColumn("cut", F.col("_over") == 1).withColumn("packed", F.when(F.col("_over") == 0, F.col(text)).when(fine, F.substring(head, F.lit(1), at)).otherwise(head)).drop("_run", "_over", "_left")


def fits(tokens: Column, budget: int) -> Column:
    """Which of an ordered array of sizes a skip-and-continue packing takes: those that still fit, in order."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("taken"))

    def step(acc, t):
        ok = acc["used"] + t <= budget
        return F.struct((acc["used"] + F.when(ok, t).otherwise(0)).cast("long").alias("used"), F.concat(acc["taken"], F.array(ok)).alias("taken"))

    return F.aggregate(tokens, start, step)["taken"]


def mmr_order(scores: np.ndarray, vectors: list[np.ndarray | None], tokens: np.ndarray, budget: int | None = None, lam: float = MMR_LAMBDA, least: int = MMR_LEAST, slots_below: int = MMR_SLOTS) -> list[int]:
    """Maximal marginal relevance: the indices in the order chosen.

    Each step takes the candidate with the largest lambda relevance - (1 - lambda) largest cosine to those chosen;
    relevance is the score over the best score, a missing vector is always new, ties go to the better score, then the
    earlier one. With a budget, candidates that no longer fit are passed over, and lambda rises towards 1 where the
    budget holds few candidates of median size. Fewer than `least` candidates keep their order (and the budget).
    """
    n = len(scores)
    if budget is not None and n:
        slots = budget / max(1.0, float(np.sort(tokens)[n // 2]))
        lam = lam + (1 - lam) * max(0.0, 1 - slots / slots_below)
    order, used, left = [], 0, list(range(n))
    if n < least:
        for i in left:
            if budget is None or used + tokens[i] <= budget:
                order.append(i)
                used += tokens[i]
        return order
    top = max(scores.max(), 1e-12)
    near = np.zeros(n)
    unit = [None if v is None else v / (np.linalg.norm(v) or 1.0) for v in vectors]
    while left:
        left = [i for i in left if budget is None or used + tokens[i] <= budget]
        if not left:
            break
        i = max(left, key=lambda j: (lam * scores[j] / top - (1 - lam) * near[j], scores[j], -j))
        order.append(i)
        used += tokens[i]
        left.remove(i)
        if unit[i] is not None:
            for j in left:
                if unit[j] is not None:
                    near[j] = max(near[j], float(unit[i] @ unit[j]))
    return order


def rerank_mmr(candidates: DataFrame, budget: int | None = None, lam: float = MMR_LAMBDA) -> DataFrame:
    """MMR per query over `qid, id, score, tokens, embedding`: adds `place` from 0; rows passed over are dropped.

    A query's candidates are a ranked list of bounded length, so each is one small group.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        v = [None if e is None else np.asarray(e, float) for e in g["embedding"]]
        order = mmr_order(g["score"].to_numpy(), v, g["tokens"].to_numpy(), budget, lam)
        out = g.iloc[order][["qid", "id", "score", "tokens"]].copy()
        out["place"] = range(len(out))
        return out

    kind = dict(candidates.dtypes)
    return candidates.groupBy("qid").applyInPandas(run, f"qid {kind['qid']}, id {kind['id']}, score double, tokens int, place int")


def rerank_with(hits: DataFrame, scorer) -> DataFrame:
    """The hits (`id, score`) with the scores that `scorer` (hits -> `id, score`) gives instead; null where it gives none."""
    return hits.drop("score").join(scorer(hits).select("id", "score"), "id", "left")
