"""Compositions: ingestion, recall, reclustering, briefing, and reports."""

from __future__ import annotations

import json
import os
import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import clustering as C
from tessera.operators import graph as G
from tessera.operators import transcripts as T
from tessera.operators import vector_search as VS
from tessera.operators.lookups import jaccard_matches, one_to_one
from tessera.runtime import broadcast_if_small, materialise


def ingest(messages: DataFrame, most_tokens: int = T.MAX_TOKENS) -> dict[str, DataFrame]:
    """From messages (`session, uuid, type, content, at`, `slug`) to the store's tables: chunks, edges, entities, states.

    Ids are hashes of what they name, so ingesting the same messages again gives the same rows.
    """
    return ingest_turns(materialise(T.turns(messages), "turns"), most_tokens)


def ingest_turns(numbered: DataFrame, most_tokens: int = T.MAX_TOKENS, link_sessions: bool = True) -> dict[str, DataFrame]:
    """As `ingest`, from messages that have their `turn` already; `link_sessions` links resumed sessions to the one before."""
    messages = numbered
    rendered = materialise(T.rendered_turns(numbered), "rendered")
    packed = T.chunk_turns(rendered, most_tokens)
    span = rendered.select("session", "turn", "started", "ended")
    slug = messages.groupBy("session").agg(F.min("slug").alias("session_slug"))
    c = packed.withColumn("first", F.array_min("turn_indices")).withColumn("last", F.array_max("turn_indices"))
    c = c.join(span.select("session", F.col("turn").alias("first"), F.timestamp_micros("started").alias("start_time")), ["session", "first"], "left").join(span.select("session", F.col("turn").alias("last"), F.timestamp_micros("ended").alias("end_time")), ["session", "last"], "left")
    chunks = c.join(slug, "session").select(
        F.concat(X.chunk_id(F.col("session"), F.col("turn_indices"), F.col("text")), F.lit("-"), F.col("piece")).alias("id"),
        F.col("session").alias("session_id"), "session_slug", "turn_indices", "start_time", "end_time", F.col("text").alias("content"), "approx_tokens", X.code_blocks(F.col("text")).alias("code_block_count"),
    )
    chunks = materialise(chunks, "chunks")
    edges = G.materialise_edges(G.causal_edges(chunks), "within-chain")
    if link_sessions:
        edges = edges.unionByName(G.materialise_edges(G.session_links(chunks, only_resumed=True), "cross-session"))
    return {
        "chunks": chunks,
        "edges": edges,
        "entities": chunks.select("id", F.explode(X.entities(X.relevant_text(F.col("content")))).alias("e")).select("id", "e.*"),
        "states": T.session_state(T.tool_exchanges(messages)),
    }


def recall(hits: DataFrame, edges: DataFrame, scores: DataFrame, nodes: DataFrame, depth: int, budget: int, backward: bool = True) -> DataFrame:
    """The best chain from the hits (`id, score`), backward or forward in time: place, id, source.

    Chains need two chunks at least; without one the hits themselves are the answer (source `search`).
    """
    e = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if backward else edges
    paths = G.walk_paths(e, hits.select("id"), depth, nodes, budget, per_seed=10)
    best = G.best_paths(paths, scores).orderBy(F.desc("median"), F.desc(F.size("path")), "path").limit(1)
    best = materialise(best, "best")
    if best.isEmpty():
        w = Window.orderBy(F.desc("score"), "id")
        return hits.select((F.row_number().over(w) - 1).alias("place"), "id", F.lit("search").alias("source"))
    return best.select(F.posexplode(F.reverse("path") if backward else F.col("path")).alias("place", "id")).withColumn("source", F.lit("chain"))


def recluster(vectors: DataFrame, old: DataFrame | None = None, threshold: float = 0.10) -> dict[str, DataFrame]:
    """Fit, assign, rescue and carry labels over.

    vectors: `id, embedding`; old: `grp, member` of named clusters. Result: assignments (id, label, distance: of noise
    every cluster within the threshold of its centroid), centroids, and names (label -> old group, overlap >= 0.5).
    """
    fitted = materialise(C.hdbscan(vectors), "fitted")
    own = fitted.filter("label >= 0").join(vectors, "id").select("id", "label", "embedding")
    cents = materialise(VS.centroids(own, "label"), "centroids")
    a = own.join(broadcast_if_small(cents), "label").select("id", "label", V.angular(F.col("embedding"), F.col("centroid")).alias("distance"))
    # noise within the threshold of a centroid: an angle is a distance between unit vectors, so candidates come block-wise
    noise = fitted.filter("label < 0").select("id").join(vectors, "id")
    near = VS.within_angle(noise, cents.select(F.col("label").alias("id"), F.col("centroid").alias("embedding")), threshold)
    a = materialise(a.unionByName(near.select(F.col("qid").alias("id"), F.col("id").alias("label"), "distance")), "assigned")
    out = {"assignments": a, "centroids": cents}
    if old is not None:
        out["names"] = one_to_one(jaccard_matches(old, a.select(F.col("label").alias("grp"), F.col("id").alias("member")), 0.5), "old_group", "new_group", "overlap")
    return out


def top_terms(docs: DataFrame, group: str, k: int = 5, least_df: int = 2) -> DataFrame:
    """Labels without a language model: per group the terms with the highest tf-idf (`group, term, score, rank`)."""
    w = docs.select(group, "id", F.explode(F.array_distinct(X.keywords(F.col("text")))).alias("term"))
    df = w.groupBy("term").agg(F.countDistinct("id").alias("df")).filter(F.col("df") >= least_df)
    n = docs.agg(F.countDistinct("id").alias("n"))
    tf = w.groupBy(group, "term").agg(F.countDistinct("id").alias("tf"))
    s = tf.join(df, "term").join(F.broadcast(n)).select(group, "term", F.round(F.col("tf") * F.ln(F.col("n") / F.col("df")), 6).alias("score"))
    return G.top_per(s, group, k, F.desc("score"), F.col("term"))


def time_window(now: datetime, days_back: float | None = None, start: datetime | None = None, end: datetime | None = None, session: str | None = None, previous: bool = False) -> dict:
    """What a reconstruction request asks for: a previous session, a session, days back, or a half-open range."""
    if previous:
        return {"kind": "previous", "before": now}
    if session is not None:
        return {"kind": "session", "session": session}
    if days_back is not None:
        return {"kind": "range", "start": now - timedelta(days=days_back), "end": now}
    if start is not None or end is not None:
        return {"kind": "range", "start": start, "end": end if end is not None else now}
    raise ValueError("a session, a previous session, days or a range is needed")


_BLOCK_HEAD = re.compile(r"^\s*(?:#+\s*|---\s*)?chunk\s+(\d+)\b.*$", re.I)


def parse_entries(answer: str) -> dict[int, dict]:
    """Read a language model's index entries: per chunk number its queries (bullets) and summary; SKIP leaves it out."""
    out: dict[int, dict] = {}
    at = None
    for line in answer.splitlines():
        head = _BLOCK_HEAD.match(line)
        if head:
            at = int(head[1])
            out[at] = {"queries": [], "summary": None}
        elif at is not None and line.strip().upper() == "SKIP":
            out.pop(at, None)
            at = None
        elif at is not None and (m := re.match(r"^\s*(?:[-*•]|\d+[.)])\s+(.+)$", line)):
            out[at]["queries"].append(m[1].strip())
        elif at is not None and (m := re.match(r"^\s*summary\s*:\s*(.+)$", line, re.I)):
            out[at]["summary"] = m[1].strip()
    return {n: e for n, e in out.items() if e["queries"] or e["summary"]}


def report(title: str, figures: dict[str, float | int | str]) -> str:
    """A benchmark run as Markdown with its JSON below."""
    rows = "\n".join(f"| {k} | {v:.4f} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in figures.items())
    return f"# {title}\n\n| figure | value |\n|-|-|\n{rows}\n\n```json\n{json.dumps(figures, sort_keys=True)}\n```\n"


def store_run(spark: SparkSession, path: str, run: str, figures: dict[str, float]) -> None:
    """Append a run to the history, in long form."""
    spark.createDataFrame([(run, k, float(v)) for k, v in figures.items()], "run string, metric string, value double").coalesce(1).write.mode("append").parquet(path)


def export_curves(curves: DataFrame, path: str) -> None:
    """Decay curves as CSV, one column a model."""
    models = [r.model for r in curves.select("model").distinct().orderBy("model").collect()]
    curves.groupBy("hops").pivot("model", models).agg(F.first("weight")).orderBy("hops").coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
