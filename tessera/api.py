"""The tools over one store: search, recall, predict, projects, sessions, reconstruct, stats, forget, repository map."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import fulltext, lookups, maintenance, pipelines, repomap, retrieval
from tessera.operators import vector_search as VS
from tessera.runtime import Opened, materialise
from tessera.sources import store as S


class Memory:
    """The store of a data directory. Every tool returns a DataFrame; nothing is changed in place.

    `now` is the clock of recency and windows, a parameter so that answers can be repeated.
    """

    def __init__(self, spark: SparkSession, data_dir: str, config: Config | None = None, now: datetime | None = None) -> None:
        self.spark, self.dir = Opened(spark), data_dir
        self.config, self.now = config or Config(), now or datetime.now()

    def _chunks(self, project: str | None = None, agent: str | None = None) -> DataFrame:
        c = S.chunks(self.spark, self.dir)
        if project is not None:
            c = c.filter(F.col("session_slug") == project)
        return c if agent is None else c.filter(F.col("agent_id") == agent)

    def _fused(self, query: str, vector: list[float] | None, project: str | None, agent: str | None) -> DataFrame:
        """Keyword statistics stay global; project and agent narrow the hits before the limit."""
        cfg = self.config
        inside = F.lit(True)
        if project is not None:
            inside = inside & (F.col("session_slug") == project)
        if agent is not None:
            inside = inside & F.coalesce(F.col("agent_id") == agent, F.lit(False))
        docs = S.chunks(self.spark, self.dir).withColumn("text", F.col("content"))
        lists = retrieval.ranked(fulltext.bm25(docs, X.sanitize_query(query), within=inside), "keyword", cfg.keyword_limit, cfg.keyword_weight)
        if vector is not None:
            v = S.search_vectors(self.spark, self.dir).join(self._chunks(project, agent).select("id"), "id", "left_semi")
            hits = VS.distances(v, vector).select("id", (1 - F.col("distance")).alias("score"))
            lists = lists.unionByName(retrieval.ranked(hits, "vector", cfg.vector_limit, cfg.vector_weight))
        return retrieval.fuse(lists, cfg.rrf_k)

    def search(self, query: str, vector: list[float] | None = None, project: str | None = None, agent: str | None = None, max_tokens: int | None = None, session: str | None = None) -> DataFrame:
        """place, id, source, score, approx_tokens, packed, cut: fused hits and their cluster siblings, weighted by recency
        and length, reordered for diversity and packed into the budget. Without a vector it is keyword search."""
        cfg, budget = self.config, max_tokens or self.config.response_budget
        hits = materialise(self._fused(query, vector, project, agent), "hits")
        near = retrieval.expand_clusters(hits, S.chunk_clusters(self.spark, self.dir), self._chunks(project, agent), cfg.max_clusters, cfg.max_siblings)
        pool = hits.select("id", "score", "source").unionByName(near.select("id", "score", "source"))
        c = S.chunks(self.spark, self.dir).select("id", "session_id", "start_time", "approx_tokens", "content")
        weight = retrieval.recency(F.col("start_time"), F.lit(self.now), F.col("session_id") == session if session else None) * retrieval.length_penalty(F.col("approx_tokens"))
        scored = c.join(F.broadcast(pool), "id").withColumn("score", F.col("score") * weight).filter(F.col("approx_tokens") <= budget)
        scored = materialise(scored, "scored")
        vectors = S.search_vectors(self.spark, self.dir).select("id", "embedding").join(F.broadcast(scored.select("id")), "id", "left_semi")
        listed = scored.select(F.lit(0).alias("qid"), "id", "score", F.col("approx_tokens").alias("tokens")).join(vectors, "id", "left")
        order = retrieval.rerank_mmr(listed, budget, cfg.mmr_lambda).select("id", "place")
        packed = retrieval.pack_truncating(scored.join(order, "id"), ["place"], "approx_tokens", "content", budget)
        return packed.select("place", "id", "source", "score", "approx_tokens", "packed", "cut")

    def _chain(self, query, vector, project, max_tokens, backward) -> DataFrame:
        hits = materialise(self._fused(query, vector, project, None).orderBy(F.desc("score"), "id").limit(5).select("id", "score"), "seeds")
        v = S.search_vectors(self.spark, self.dir)
        q = F.array(*[F.lit(float(x)) for x in vector]) if vector is not None else None
        scores = v.select("id", (1 - V.angular(F.col("embedding"), q)).alias("score")) if q is not None else hits
        nodes = self._chunks(project).select("id", F.col("approx_tokens").alias("tokens"))
        return pipelines.recall(hits, S.forward_edges(self.spark, self.dir), scores, nodes, self.config.max_chain_depth, max_tokens or self.config.response_budget, backward)

    def recall(self, query: str, vector: list[float] | None = None, project: str | None = None, max_tokens: int | None = None) -> DataFrame:
        """place, id, source: the chain that led to the best hits, or the hits where there is none."""
        return self._chain(query, vector, project, max_tokens, True)

    def predict(self, query: str, vector: list[float] | None = None, project: str | None = None, max_tokens: int | None = None) -> DataFrame:
        """place, id, source: the chain that follows the best hits."""
        return self._chain(query, vector, project, max_tokens, False)

    def list_projects(self) -> DataFrame:
        return lookups.project_summary(self._chunks()).orderBy(F.desc("last_seen"), "session_slug")

    def list_sessions(self, project: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        return lookups.session_summary(lookups.time_range(self._chunks(), project, start, end)).orderBy("first_start", "session_id")

    def reconstruct(self, project: str, max_tokens: int | None = None, newest: bool = True, **window) -> DataFrame:
        """The chunks of a window (see pipelines.time_window; none: the project's latest) within the budget, in order."""
        budget = max_tokens or self.config.response_budget
        c = self._chunks(project)
        order = [F.desc("start_time"), F.desc("id")] if newest else ["start_time", "id"]
        if not window:
            c = c.orderBy(*order).limit(-(-budget // 200))
        else:
            w = pipelines.time_window(self.now, **window)
            if w["kind"] == "range":
                c = lookups.time_range(c, start=w["start"], end=w["end"])
            elif w["kind"] == "session":
                c = c.filter(F.col("session_id") == w["session"])
            else:
                last = lookups.session_summary(c.filter(F.col("end_time") <= F.lit(w["before"]))).orderBy(F.desc("last_end"), "session_id").limit(1)
                c = c.join(F.broadcast(last.select("session_id")), "session_id", "left_semi")
        return retrieval.pack_prefix(c, None, order, "approx_tokens", budget).select("id", "session_id", "start_time", "approx_tokens", "content").orderBy("start_time", "id")

    def stats(self) -> DataFrame:
        """name and number of rows of each table."""
        tables = {"chunks": self._chunks(), "edges": S.edges(self.spark, self.dir), "clusters": S.clusters(self.spark, self.dir), "assignments": S.chunk_clusters(self.spark, self.dir), "vectors": S.search_vectors(self.spark, self.dir)}
        parts = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in tables.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def forget(self, project: str, before: datetime | None = None, after: datetime | None = None, session: str | None = None, vector: list[float] | None = None, threshold: float = 0.6) -> dict[str, DataFrame]:
        """The store without what the filters select (`gone` holds the ids, for a dry run). A threshold above 1 is a percentage."""
        cond = F.col("session_slug") == project
        if before is not None:
            cond = cond & (F.col("start_time") < F.lit(before))
        if after is not None:
            cond = cond & (F.col("start_time") >= F.lit(after))
        if session is not None:
            cond = cond & (F.col("session_id") == session)
        similar = None
        if vector is not None:
            least = threshold / 100 if threshold > 1 else threshold
            similar = VS.distances(S.search_vectors(self.spark, self.dir), vector).filter(1 - F.col("distance") >= least).select("id")
        gone = materialise(maintenance.forget(self._chunks(), cond, similar), "gone")
        left = maintenance.cascade_delete(gone, self._chunks(), S.edges(self.spark, self.dir), S.chunk_clusters(self.spark, self.dir), S.search_vectors(self.spark, self.dir), S.clusters(self.spark, self.dir))
        return left | {"gone": gone}

    def repo_map(self, root: str, max_tokens: int | None = None) -> DataFrame:
        """The definitions of the most referred-to files under `root`, within the budget."""
        t = repomap.ranked_definitions(repomap.tags(repomap.scan_tree(self.spark, root), calls=True))
        order = [F.desc("score"), "file", "place"]
        return retrieval.pack_prefix(t, None, order, "tokens", max_tokens or self.config.repo_map_tokens, 0, 1).select("file", "name", "type", "line", "score")
