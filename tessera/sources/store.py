"""The engine's logical tables over a data directory: cleaned of repeated rows, keys normalised.

Each view has its SQL twin in PRELUDE, used by the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import is_usable
from tessera.operators import fulltext
from tessera.operators.deliveries import first_deliveries
from tessera.operators.ranking import rank_within
from tessera.runtime import broadcast_if_small, key_of, materialise, read_table, view

#: The embedding model that searches use, and its length.
SEARCH_MODEL, SEARCH_DIM = "memo-embed-128", 128


@view
def chunks(spark: SparkSession, d: str) -> DataFrame:
    """One row per chunk id (the first stored); approx_tokens is recomputed as ceil(characters / 3.5)."""
    rows = first_deliveries(read_table(spark, d, "chunks"), key_of("id"), "created_at", f"{d}/chunks.parquet")
    return rows.select(
        F.col("key").alias("id"), key_of("session_id").alias("session_id"), "session_slug", "turn_indices", "start_time", "end_time", "content",
        "code_block_count", "tool_use_count", F.ceil(F.length(F.coalesce("content", F.lit(""))) / 3.5).cast("int").alias("approx_tokens"), "created_at", "agent_id", "spawn_depth", "project_path", "team_name",
    )


@view
def edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with both keys, once per id; a null weight is 1."""
    e = read_table(spark, d, "edges").select(key_of("id").alias("id"), key_of("source_chunk_id").alias("src"), key_of("target_chunk_id").alias("dst"), "edge_type", "reference_type", F.coalesce("initial_weight", F.lit(1.0)).alias("weight"), "created_at", "link_count")
    return e.filter("id is not null and src is not null and dst is not null").dropDuplicates(["id"])


@view
def forward_edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct forward links between chunks that exist."""
    ids = chunks(spark, d).select("id")
    e = edges(spark, d).filter("edge_type = 'forward' and src <> dst").select("src", "dst").distinct()
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


@view
def chunk_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Assignments with both keys, once per pair; distances outside 0 to 1 are null."""
    a = read_table(spark, d, "chunk_clusters").select(key_of("chunk_id").alias("chunk_id"), key_of("cluster_id").alias("cluster_id"), F.when(F.col("distance").between(0, 1), F.col("distance")).alias("distance"), "assigned_at")
    return a.filter("chunk_id is not null and cluster_id is not null").groupBy("chunk_id", "cluster_id").agg(F.min("distance").alias("distance"), F.min("assigned_at").alias("assigned_at"))


@view
def clusters(spark: SparkSession, d: str) -> DataFrame:
    """One row per cluster id (the latest created)."""
    w = Window.partitionBy("id").orderBy(F.desc("created_at"), F.desc_nulls_last("refreshed_at"))
    c = read_table(spark, d, "clusters").withColumn("id", key_of("id")).filter("id is not null")
    return c.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


@view
def search_vectors(spark: SparkSession, d: str) -> DataFrame:
    """id and embedding (doubles) of the usable vectors of the search model, once per id."""
    v = read_table(spark, d, "vectors").filter(key_of("model_id") == SEARCH_MODEL).select(key_of("id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "last_accessed", "orphaned_at")
    return v.filter("id is not null").filter(is_usable("embedding", SEARCH_DIM)).groupBy("id").agg(F.min("embedding").alias("embedding"), F.min("last_accessed").alias("last_accessed"), F.min("orphaned_at").alias("orphaned_at"))


@view
def keyword_index(spark: SparkSession, d: str) -> fulltext.Index:
    """The keyword index of the chunks' contents, stored until the table changes."""
    return fulltext.Index.stored(spark, "chunks", f"{d}/chunks.parquet", lambda: chunks(spark, d).select("id", F.col("content").alias("text")))


@view
def entry_index(spark: SparkSession, d: str) -> fulltext.Index:
    """The keyword index of the clusters' descriptions."""
    return fulltext.Index.stored(spark, "clusters", f"{d}/clusters.parquet", lambda: clusters(spark, d).select("id", F.col("description").alias("text")))


@view
def feedback(spark: SparkSession, d: str) -> DataFrame:
    """The retrieval log, from the events: the number-th chunk in id order was returned by a tool at a time.

    Events carry numbers only; event and user number together point into all chunks numbered by id.
    """
    numbered = materialise(rank_within(chunks(spark, d).select("id").filter("id is not null"), [], ["id"], "n"), "numbered")
    total = F.greatest(F.lit(1), F.lit(numbered.count()))
    e = read_table(spark, d, "events").select(F.pmod(F.col("event_id") * 31 + F.col("user_id"), total).alias("n"), F.col("event_type").alias("tool_name"), F.col("ts").cast("timestamp").alias("returned_at"), "event_id")
    return e.join(broadcast_if_small(numbered), "n").select(F.col("id").alias("chunk_id"), "tool_name", "returned_at", "event_id")


K = "nullif(lower(trim({}, E' \\t\\n\\r')), '')"
_VIEWS = {
    "c": f"""SELECT * EXCLUDE (r) FROM (SELECT {K.format('id')} AS id, {K.format('session_id')} AS session_id, session_slug, turn_indices, start_time, end_time, content, code_block_count, tool_use_count,
        CAST(ceil(length(coalesce(content, '')) / 3.5) AS INTEGER) AS approx_tokens, created_at, agent_id, spawn_depth, project_path, team_name, row_number() OVER (PARTITION BY {K.format('id')} ORDER BY created_at) AS r FROM chunks) WHERE r = 1 AND id IS NOT NULL""",
    "e": f"""SELECT DISTINCT {K.format('id')} AS id, {K.format('source_chunk_id')} AS src, {K.format('target_chunk_id')} AS dst, edge_type, reference_type, coalesce(initial_weight, 1.0) AS weight, created_at, link_count FROM edges
        WHERE {K.format('id')} IS NOT NULL AND {K.format('source_chunk_id')} IS NOT NULL AND {K.format('target_chunk_id')} IS NOT NULL""",
    "fe": "SELECT DISTINCT src, dst FROM e WHERE edge_type = 'forward' AND src <> dst AND src IN (SELECT id FROM c) AND dst IN (SELECT id FROM c)",
    "a": f"""SELECT {K.format('chunk_id')} AS chunk_id, {K.format('cluster_id')} AS cluster_id, min(CASE WHEN distance BETWEEN 0 AND 1 THEN distance END) AS distance, min(assigned_at) AS assigned_at FROM chunk_clusters
        WHERE {K.format('chunk_id')} IS NOT NULL AND {K.format('cluster_id')} IS NOT NULL GROUP BY 1, 2""",
    "k": f"SELECT * EXCLUDE (r, id), kid AS id FROM (SELECT *, {K.format('id')} AS kid, row_number() OVER (PARTITION BY {K.format('id')} ORDER BY created_at DESC, refreshed_at DESC NULLS LAST) AS r FROM clusters) WHERE r = 1 AND kid IS NOT NULL",
    "v": f"""SELECT {K.format('id')} AS id, min(CAST(embedding AS DOUBLE[])) AS embedding, min(last_accessed) AS last_accessed, min(orphaned_at) AS orphaned_at FROM vectors
        WHERE {K.format('model_id')} = '{SEARCH_MODEL}' AND {K.format('id')} IS NOT NULL AND len(embedding) = {SEARCH_DIM}
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1""",
    "f": "SELECT n.id AS chunk_id, event_type AS tool_name, ts AS returned_at, event_id FROM events JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM c) n ON n.n = (event_id * 31 + user_id) % (SELECT count(*) FROM c)",
}
_NEEDS = {"fe": ("c", "e"), "f": ("c",)}


def prelude(*views: str) -> str:
    """The WITH list that defines these views, each after those it needs."""
    done: list[str] = []

    def add(v: str) -> None:
        for n in _NEEDS.get(v, ()):
            add(n)
        if v not in done:
            done.append(v)

    for v in views:
        add(v)
    return ", ".join(f"{v} AS ({_VIEWS[v]})" for v in done)
