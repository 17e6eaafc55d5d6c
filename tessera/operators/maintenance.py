"""Retention and upkeep: forgetting, cascades, expiry, caps, compaction, tasks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import broadcast_if_small


def without(table: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose key is not in `gone` (one column `id`); null keys stay."""
    g = broadcast_if_small(gone.select("id").distinct())
    return table.join(g, table[key] == g["id"], "left_anti")


def cascade_delete(gone: DataFrame, chunks: DataFrame, edges: DataFrame, assignments: DataFrame, vectors: DataFrame, clusters: DataFrame) -> dict[str, DataFrame]:
    """The store without the chunks of `gone` (`id`): their edges, assignments and vectors go too, and then the clusters
    that have no member left."""
    a = without(assignments, "chunk_id", gone)
    emptied = clusters.join(a.select(F.col("cluster_id").alias("id")).distinct(), "id", "left_semi")
    return {"chunks": without(chunks, "id", gone), "edges": without(without(edges, "src", gone), "dst", gone), "assignments": a, "vectors": without(vectors, "id", gone), "clusters": emptied}


def expired(rows: DataFrame, time: str, now, days: int) -> DataFrame:
    """Rows last used more than `days` before `now`; rows never used are not expired."""
    return rows.filter(F.col(time) < F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)))


def beyond_cap(rows: DataFrame, time: str, most: int, key: str = "id") -> DataFrame:
    """The oldest rows beyond a cap on their number (0: no cap)."""
    if most <= 0:
        return rows.limit(0)
    n = rows.count()
    return rows.orderBy(F.asc_nulls_first(time), key).limit(max(0, n - most))


def last_access(vectors: DataFrame, log: DataFrame) -> DataFrame:
    """Touch on read as an append-only log: the latest of the stored and the logged access."""
    t = log.groupBy("id").agg(F.max("at").alias("_at"))
    return vectors.join(t, "id", "left").withColumn("last_accessed", F.greatest("last_accessed", "_at")).drop("_at")


def forget(chunks: DataFrame, condition: Column, similar: DataFrame | None = None) -> DataFrame:
    """The ids to forget: those that meet the condition and, if given, are in `similar` (`id`)."""
    out = chunks.filter(condition).select("id")
    return out if similar is None else out.join(similar.select("id"), "id", "left_semi")


def compact(df: DataFrame, path: str, bytes_per_file: int = 256 << 20, order: list[str] | None = None) -> None:
    """Rewrite a table into files of about one size, sorted within files for pruning by column statistics."""
    from tessera.runtime import size_in_bytes

    n = max(1, -(-size_in_bytes(df) // bytes_per_file))
    out = df.repartition(n) if not order else df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    out.write.mode("overwrite").parquet(path)


@dataclass(frozen=True)
class Task:
    """A scheduled maintenance task: due when its hour and minute have passed since the last run."""

    name: str
    every_hours: float
    run: Callable[[], object]
    at_hour: int | None = None


def due(task: Task, last_run_hours_ago: float | None) -> bool:
    return last_run_hours_ago is None or last_run_hours_ago >= task.every_hours


def run_due(tasks: list[Task], last: dict[str, float | None]) -> dict[str, object]:
    """Run what is due, in order; an error of one task is its result and does not stop the others."""
    out: dict[str, object] = {}
    for t in tasks:
        if due(t, last.get(t.name)):
            try:
                out[t.name] = t.run()
            except Exception as e:  # noqa: BLE001
                out[t.name] = e
    return out
