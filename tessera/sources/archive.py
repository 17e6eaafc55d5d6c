"""Export and import of a store as gzip-compressed JSON lines with a manifest."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import redact_code, redact_paths
from tessera.operators.lookups import both_ends_within, upsert

VERSION = "1.1"
TABLES = ("chunks", "edges", "assignments", "clusters", "vectors")


def select_archive(tables: dict[str, DataFrame], projects: list[str] | None = None, paths: bool = False, code: bool = False) -> dict[str, DataFrame]:
    """What an archive of some projects holds: their chunks (redacted if asked for), edges between them, their
    assignments, the clusters that these name, and their vectors."""
    c = tables["chunks"]
    if projects is not None:
        c = c.filter(F.col("session_slug").isin(projects))
    if paths:
        c = c.withColumn("content", redact_paths(F.col("content")))
    if code:
        c = c.withColumn("content", redact_code(F.col("content")))
    ids = c.select("id")
    a = tables["assignments"].join(ids.withColumnRenamed("id", "chunk_id"), "chunk_id", "left_semi")
    return {
        "chunks": c,
        "edges": both_ends_within(tables["edges"], ids),
        "assignments": a,
        "clusters": tables["clusters"].join(a.select(F.col("cluster_id").alias("id")).distinct(), "id", "left_semi"),
        "vectors": tables["vectors"].join(ids, "id", "left_semi"),
    }


def write_archive(tables: dict[str, DataFrame], path: str, secret: str | None = None) -> None:
    """One folder of gzip JSON lines per table; with a secret (16, 24 or 32 bytes) each row is encrypted (AES-GCM)."""
    spark = next(iter(tables.values())).sparkSession
    for name in TABLES:
        rows = tables[name].select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
        if secret is not None:
            rows = rows.select(F.hex(F.aes_encrypt(F.encode("value", "utf-8"), F.lit(secret.encode()))).alias("value"))
        rows.write.mode("overwrite").option("compression", "gzip").text(os.path.join(path, name))
    manifest = [(VERSION, n, tables[n].schema.json(), secret is not None) for n in TABLES]
    spark.createDataFrame(manifest, "version string, name string, schema string, encrypted boolean").coalesce(1).write.mode("overwrite").json(os.path.join(path, "manifest"))


def read_archive(spark: SparkSession, path: str, secret: str | None = None) -> dict[str, DataFrame]:
    """The tables of an archive; unknown versions and a missing secret raise."""
    from pyspark.sql.types import StructType
    import json

    out = {}
    for r in spark.read.schema("version string, name string, schema string, encrypted boolean").json(os.path.join(path, "manifest")).collect():
        if r.version.split(".")[0] != VERSION.split(".")[0]:
            raise ValueError(f"archive version {r.version}")
        if r.encrypted and secret is None:
            raise ValueError("the archive is encrypted")
        rows = spark.read.text(os.path.join(path, r.name))
        if r.encrypted:
            rows = rows.select(F.decode(F.aes_decrypt(F.unhex("value"), F.lit(secret.encode())), "utf-8").alias("value"))
        schema = StructType.fromJson(json.loads(r.schema))
        out[r.name] = rows.select(F.from_json("value", schema).alias("j")).select("j.*")
    return out


def dangling(tables: dict[str, DataFrame]) -> DataFrame:
    """Validation: the number of edges and assignments that point to no chunk of the archive."""
    ids = tables["chunks"].select("id")
    e = tables["edges"]
    bad_edges = e.join(both_ends_within(e, ids).select("id"), "id", "left_anti").agg(F.count("*").alias("dangling_edges"))
    bad = tables["assignments"].join(ids.withColumnRenamed("id", "chunk_id"), "chunk_id", "left_anti").agg(F.count("*").alias("dangling_assignments"))
    return bad_edges.join(bad)


def merge_chunks(old: DataFrame, archive: DataFrame) -> DataFrame:
    """Import by merging: the archive's row replaces an older one of the same id."""
    return upsert(old, archive.select(*old.columns), ["id"], "created_at")
