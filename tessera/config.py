"""Settings with their defaults and checks."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Defaults of retrieval, clustering, upkeep; wrong values raise on construction."""

    cluster_threshold: float = 0.10
    min_cluster_size: int = 4
    incremental_ratio: float = 0.3
    max_chain_depth: int = 50
    summary_budget: int = 500
    response_budget: int = 20_000
    rrf_k: int = 60
    vector_weight: float = 1.0
    keyword_weight: float = 1.0
    vector_limit: int = 20
    keyword_limit: int = 20
    entity_weight: float = 1.5
    max_clusters: int = 3
    max_siblings: int = 5
    mmr_lambda: float = 0.7
    feedback_weight: float = 0.1
    recency_weight: float = 0.3
    half_life_hours: float = 48.0
    length_reference: int = 500
    description_tokens: int = 130
    backfill_batch: int = 500
    repo_map_tokens: int = 1024
    ttl_days: int = 90
    max_vectors: int = 0
    embedding_cache: int = 100_000

    def __post_init__(self) -> None:
        wrong = [
            name
            for name, ok in (
                ("cluster_threshold", 0 < self.cluster_threshold < 1),
                ("min_cluster_size", self.min_cluster_size >= 2),
                ("max_chain_depth", self.max_chain_depth >= 1),
                ("summary_budget", self.summary_budget >= 100),
                ("response_budget", self.response_budget >= 500),
                ("mmr_lambda", 0 <= self.mmr_lambda <= 1),
                ("incremental_ratio", self.incremental_ratio >= 0),
                ("ttl_days", self.ttl_days >= 0),
                ("max_vectors", self.max_vectors >= 0),
            )
            if not ok
        ]
        if wrong:
            raise ValueError("out of range: " + ", ".join(wrong))
