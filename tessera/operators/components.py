"""Connected components of an undirected graph by propagation of minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import materialise

#: Rounds after which something must be wrong: a few times the logarithm of any number of nodes.
MAX_ROUNDS = 200


def connected_components(edges: DataFrame) -> DataFrame:
    """`node` and `component` (the smallest node of its component) for all nodes of `src, dst`.

    Alternates two contractions until nothing changes: every node's larger neighbours are linked to its smallest
    neighbour, then its smaller ones are. Both are a grouped minimum (partially aggregated, so hot nodes are no burden)
    and a join back; the number of rounds grows with the logarithm of the size. Nulls are left out, loops make their
    node a component of its own if it has no other edge; node types need an order.
    """
    e = materialise(edges.select("src", "dst").filter("src is not null and dst is not null"), "edges")
    alone = e.filter("src = dst").select(F.col("src").alias("node")).distinct()
    links = e.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    links = materialise(links, "links")
    before = None
    for _ in range(MAX_ROUNDS):
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = both.filter("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).filter("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        joined = large.join(low, "src")
        small = joined.select(F.col("dst").alias("src"), F.col("low").alias("dst")).filter("src <> dst").unionByName(low.select("src", F.col("low").alias("dst"))).distinct()
        links = materialise(small, "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"labels still change after {MAX_ROUNDS} rounds")
    found = links.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = found.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    out = found.unionByName(roots)
    rest = alone.join(out.select("node"), "node", "left_anti")
    return out.unionByName(rest.withColumn("component", F.col("node")))
