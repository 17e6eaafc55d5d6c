"""What the figures of a benchmark run suggest to change, and how runs compare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (metric, setting, priority, condition over the figures); priorities in order high, medium, low.
RULES = [
    ("Cluster coverage", "clustering.threshold", "high", "cluster_coverage < 0.7"),
    ("Cluster coverage (small sessions)", "clustering.minClusterSize", "medium", "cluster_coverage < 0.7 and median_session_size < 5"),
    ("Orphan chunk rate", "(action)", "high", "orphan_share > 0.3"),
    ("Inter-cluster separation", "clustering.threshold", "medium", "separation < 0.3"),
    ("Intra-cluster similarity", "clustering.threshold", "medium", "intra_similarity < 0.5"),
    ("Chain coverage (sparse edges)", "(action)", "high", "chain_coverage < 0.5 and edges_per_chunk < 1"),
    ("Chain coverage", "(action)", "medium", "chain_coverage < 0.5 and edges_per_chunk >= 1"),
    ("Mean chain length", "traversal.maxDepth", "low", "mean_chain_length > 0 and mean_chain_length < 3"),
    ("Recall latency", "traversal.maxDepth", "medium", "recall_p95_ms > 200"),
    ("Recall latency (large collection)", "vectors.ttlDays", "low", "recall_p95_ms > 200 and n_chunks > 5000"),
    ("Bridging recall", "(action)", "medium", "bridging_recall_10 < 0.3"),
    ("Precision", "(info)", "medium", "precision_10 > 0 and precision_10 < 0.7"),
    ("Token efficiency", "tokens.mcpMaxResponse", "low", "token_efficiency > 0 and token_efficiency < 0.6"),
    ("Search fallback rate", "(action)", "medium", "fallback_rate > 0.8 and n_edges > 0"),
    ("Within-chain edges", "(action)", "low", "n_within_chain = 0 and n_edges > 0"),
    ("Source diversity", "retrieval.mmrLambda", "medium", "cluster_share < 0.05 and cluster_coverage >= 0.5 and n_clusters > 0"),
    ("Stale clusters", "(action)", "low", "n_clusters > 0 and cluster_coverage < 0.5"),
]
#: The figures that the rules read; those of a part that was not run are null and fire nothing.
FIGURES = (
    "n_chunks n_edges n_clusters n_within_chain cluster_coverage orphan_share edges_per_chunk median_session_size separation intra_similarity chain_coverage "
    "mean_chain_length fallback_rate recall_p95_ms bridging_recall_10 precision_10 token_efficiency cluster_share"
).split()
# Whether a figure is better when it is higher.
HIGHER_IS_BETTER = {"edges_per_chunk": True, "cluster_coverage": True, "orphan_share": False, "adjacent_recall_10": True, "bridging_recall_10": True, "precision_10": True, "token_efficiency": True, "cluster_share": True, "chain_coverage": True, "mean_chain_length": True, "recall_p95_ms": False}


def recommendations(figures: DataFrame) -> DataFrame:
    """metric, setting, priority (high first) of every rule that fires on one row of figures; missing figures are null."""
    f = figures
    for n in FIGURES:
        if n not in f.columns:
            f = f.withColumn(n, F.lit(None).cast("double"))
    hits = F.array_compact(F.array(*[F.when(F.expr(c), F.struct(F.lit(("high", "medium", "low").index(p)).alias("rank"), F.lit(i).alias("rule"), F.lit(m).alias("metric"), F.lit(s).alias("setting"), F.lit(p).alias("priority"))) for i, (m, s, p, c) in enumerate(RULES)]))
    return f.select(F.explode(F.array_sort(hits)).alias("r")).select("r.metric", "r.setting", "r.priority")


def deltas(history: DataFrame) -> DataFrame:
    """run, metric, value, previous, delta, improved: each run of `run, at, metric, value` against the run before it.

    Metrics without a direction are not compared (`improved` is null); a metric that one of both runs lacks has no delta.
    """
    from pyspark.sql import Window

    order = history.select("run", "at").distinct().withColumn("before", F.lag("run").over(Window.orderBy("at", "run")))  # a row a run
    h = history.join(F.broadcast(order.select("run", "before")), "run")
    old = history.select(F.col("run").alias("before"), "metric", F.col("value").alias("previous"))
    better = F.create_map(*[F.lit(x) for pair in HIGHER_IS_BETTER.items() for x in pair])[F.col("metric")]
    d = h.join(old, ["before", "metric"], "left").withColumn("delta", F.col("value") - F.col("previous"))
    return d.select("run", "metric", "value", "previous", "delta", F.when(F.col("delta") == 0, F.lit(False)).otherwise((F.col("delta") > 0) == better).alias("improved"))
