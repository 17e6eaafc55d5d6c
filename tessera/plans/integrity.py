"""Queries of problem 6: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.references import dangling_references
from tessera.runtime import key_of, read_table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read_table(spark, sf_dir, "edges")
    links = read_table(spark, sf_dir, "chunk_clusters")
    removed = read_table(spark, sf_dir, "removed_keys")

    def ref(df, table, column, row_key, parent, time):
        return df.select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), row_key.alias("row_key"), F.lit(parent).alias("parent_table"), key_of(column).alias("ref_key"), F.col(time).alias("ref_time"))

    pair = F.concat(F.coalesce(key_of("chunk_id"), F.lit("")), F.lit("|"), F.coalesce(key_of("cluster_id"), F.lit("")))
    references = [
        ref(edges, "edges", "source_chunk_id", key_of("id"), "chunks", "created_at"),
        ref(edges, "edges", "target_chunk_id", key_of("id"), "chunks", "created_at"),
        ref(links, "chunk_clusters", "chunk_id", pair, "chunks", "assigned_at"),
        ref(links, "chunk_clusters", "cluster_id", pair, "clusters", "assigned_at"),
    ]
    parents = [read_table(spark, sf_dir, t).select(F.lit(t).alias("parent_table"), key_of("id").alias("ref_key"), F.col("created_at").alias("row_time")) for t in ("chunks", "clusters")]
    gone = removed.select(key_of("key_table").alias("parent_table"), key_of("key_id").alias("ref_key"))
    return dangling_references(references, parents, gone)


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of such references per table, field, month and status."""
    return p6_found(spark, sf_dir).groupBy("table_name", "column_name", "period", "status").agg(F.count("*").alias("n_references"), F.countDistinct("ref_key").alias("n_keys"))


QUERIES = {"p6_found": p6_found, "p6_report": p6_report}

_K = "nullif(lower(trim({}, E' \\t\\n\\r')), '')"
_PAIR = f"coalesce({_K.format('chunk_id')}, '') || '|' || coalesce({_K.format('cluster_id')}, '')"
_SQL = f"""refs AS (
  SELECT 'edges' AS table_name, 'source_chunk_id' AS column_name, {_K.format('id')} AS row_key, 'chunks' AS parent, {_K.format('source_chunk_id')} AS ref_key, created_at AS t FROM edges
  UNION ALL SELECT 'edges', 'target_chunk_id', {_K.format('id')}, 'chunks', {_K.format('target_chunk_id')}, created_at FROM edges
  UNION ALL SELECT 'chunk_clusters', 'chunk_id', {_PAIR}, 'chunks', {_K.format('chunk_id')}, assigned_at FROM chunk_clusters
  UNION ALL SELECT 'chunk_clusters', 'cluster_id', {_PAIR}, 'clusters', {_K.format('cluster_id')}, assigned_at FROM chunk_clusters),
once AS (SELECT table_name, column_name, row_key, parent, ref_key, min(t) AS t FROM refs WHERE ref_key IS NOT NULL GROUP BY ALL),
parents AS (SELECT 'chunks' AS parent, {_K.format('id')} AS k, min(created_at) AS first FROM chunks GROUP BY ALL UNION ALL SELECT 'clusters', {_K.format('id')}, min(created_at) FROM clusters GROUP BY ALL),
gone AS (SELECT DISTINCT {_K.format('key_table')} AS parent, {_K.format('key_id')} AS k FROM removed_keys),
found AS (SELECT table_name, column_name, row_key, ref_key,
  CASE WHEN p.k IS NULL AND g.k IS NOT NULL THEN 'deleted' WHEN p.k IS NULL THEN 'missing' WHEN p.first > o.t THEN 'late' END AS status, strftime(t, '%Y-%m') AS period
  FROM once o LEFT JOIN parents p ON o.parent = p.parent AND o.ref_key = p.k LEFT JOIN gone g ON o.parent = g.parent AND o.ref_key = g.k)"""
ORACLES = {
    "p6_found": f"WITH {_SQL} SELECT * FROM found WHERE status IS NOT NULL",
    "p6_report": f"WITH {_SQL} SELECT table_name, column_name, period, status, count(*) AS n_references, count(DISTINCT ref_key) AS n_keys FROM found WHERE status IS NOT NULL GROUP BY ALL",
}
