"""Queries of problems 4 and 5: similarity clusters, and the most similar vectors of every vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.grouping import describe_groups, grid_clusters, similarity_groups
from tessera.llm.vectors import nearest
from tessera.runtime import key_of, materialise, read_table

K, LEAST = 5, 0.70


def p4_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_groups(read_table(spark, sf_dir, "vectors"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_members(spark, sf_dir).select("group_id", F.col("id").alias("vector_id"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group with its size and most typical members."""
    return describe_groups(p4_members(spark, sf_dir))


def p4_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of the plain grid method, by adjacency of dense cells alone."""
    return grid_clusters(read_table(spark, sf_dir, "vectors"))


def p4_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored clusters held against the groups: per cluster its assigned chunks, those in the group that holds most of
    them, the mean stored distance of both, and how many stored exemplars lie in that group. Distances that are null or
    outside 0 to 1 are left out of the means."""
    members = materialise(p4_found(spark, sf_dir), "groups")
    links = read_table(spark, sf_dir, "chunk_clusters").select(key_of("chunk_id").alias("vector_id"), key_of("cluster_id").alias("cluster_id"), F.when(F.col("distance").between(0, 1), F.col("distance")).alias("distance")).filter("cluster_id is not null")
    links = links.groupBy("cluster_id", "vector_id").agg(F.min("distance").alias("distance"))
    by = links.join(members, "vector_id", "left").groupBy("cluster_id", "group_id").agg(F.count("vector_id").alias("n"), F.sum("distance").alias("total"), F.count("distance").alias("known"))
    main = F.max_by(F.struct("group_id", "n", "total", "known"), F.when(F.col("group_id").isNotNull(), F.struct("n", "group_id")))
    whole = by.groupBy("cluster_id").agg(F.sum("n").alias("n_assigned"), F.sum("total").alias("total"), F.sum("known").alias("known"), main.alias("m"))
    typical = read_table(spark, sf_dir, "clusters").select(key_of("id").alias("cluster_id"), F.explode("exemplar_ids").alias("x")).select("cluster_id", key_of("x").alias("vector_id")).distinct()
    hits = typical.join(members, "vector_id", "left").join(whole.select("cluster_id", F.col("m.group_id").alias("main")), "cluster_id").groupBy("cluster_id").agg(F.count("*").alias("n_exemplars"), F.sum((F.coalesce(F.col("group_id") == F.col("main"), F.lit(False))).cast("long")).alias("n_exemplars_inside"))
    return whole.join(hits, "cluster_id", "left").select(
        "cluster_id", "n_assigned", F.col("m.group_id").alias("group_id"), F.coalesce("m.n", F.lit(0)).alias("n_inside"),
        F.round(F.try_divide("total", "known"), 6).alias("mean_distance"), F.round(F.try_divide("m.total", "m.known"), 6).alias("mean_distance_inside"),
        F.coalesce("n_exemplars", F.lit(0)).alias("n_exemplars"), F.coalesce("n_exemplars_inside", F.lit(0)).alias("n_exemplars_inside"),
    )


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar vectors of every usable vector."""
    return nearest(read_table(spark, sf_dir, "vectors"), K)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = nearest(read_table(spark, sf_dir, "vectors"), K, LEAST)
    return got.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


QUERIES = {"p4_found": p4_found, "p4_grid": p4_grid, "p4_groups": p4_groups, "p4_stored": p4_stored, "p5_found": p5_found, "p5_neighbours": p5_neighbours}

_USABLE = r"""k AS (SELECT nullif(lower(trim(id, E' \t\n\r')), '') AS id, nullif(lower(trim(model_id, E' \t\n\r')), '') AS model, embedding FROM vectors),
n AS (SELECT model, len(embedding) AS n, count(*) AS c FROM k WHERE model IS NOT NULL AND id IS NOT NULL AND embedding IS NOT NULL GROUP BY ALL),
l AS (SELECT model, arg_max(n, c * 100000 + n) AS n FROM n GROUP BY model),
u AS (
  SELECT k.model, k.id, CAST(min(k.embedding) AS DOUBLE[]) AS v FROM k JOIN l ON k.model = l.model AND len(k.embedding) = l.n
  WHERE k.id IS NOT NULL AND len(list_filter(k.embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(k.embedding, lambda x: x <> 0)) > 0 GROUP BY k.model, k.id),
pairs AS (SELECT a.model, a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS c FROM u a JOIN u b ON a.model = b.model AND a.id <> b.id)"""
ORACLES = {
    "p5_found": f"WITH {_USABLE}, r AS (SELECT *, row_number() OVER (PARTITION BY model, a ORDER BY c DESC, b) AS r FROM pairs) SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE r <= 5 AND c >= 0.7",
    "p4_found": f"""WITH RECURSIVE {_USABLE}, e AS (SELECT model, a, b FROM pairs WHERE c >= 0.7),
reach(model, id, other) AS (SELECT DISTINCT model, a, a FROM e UNION SELECT r.model, r.id, e.b FROM reach r JOIN e ON r.model = e.model AND r.other = e.a),
g AS (SELECT model, id, min(other) AS group_id, count(*) AS n FROM reach GROUP BY model, id)
SELECT group_id, id AS vector_id FROM g WHERE n >= 3""",
}
