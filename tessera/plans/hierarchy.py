"""Queries of problem 1: parent-child links to full hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.forest import link_rows, locality_buckets, resolve_forest
from tessera.runtime import key_of, materialise, read_table


def session_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct log lines with their parent and a locality bucket (their session)."""
    raw = read_table(spark, sf_dir, "sample_session").select(key_of("uuid").alias("uuid"), key_of("parentUuid").alias("parent"), key_of("sessionId").alias("grp"), "ingested_at")
    return locality_buckets(materialise(link_rows(raw, "uuid", "parent", "grp", "ingested_at"), "links"), "key", "grp")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_forest(session_links(spark, sf_dir))
    return out.select(F.col("key").alias("uuid"), F.col("root").alias("root_uuid"), F.col("depth").cast("int").alias("depth"))


def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's full path from its root, for lines on or below cycles only the line itself."""
    out = resolve_forest(session_links(spark, sf_dir), with_path=True)
    return out.select(F.col("key").alias("uuid"), F.col("root").alias("root_uuid"), F.col("depth").cast("int").alias("depth"), "dangling", "path")


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of each line, one row a pair, with the number of links between; no shuffle after the paths."""
    paths = materialise(p1_paths(spark, sf_dir).select("uuid", "depth", "path"), "paths")
    pairs = paths.select("uuid", "depth", F.posexplode("path").alias("at", "ancestor"))
    return pairs.filter("depth > at").select(F.col("ancestor").alias("uuid"), F.col("uuid").alias("descendant_uuid"), (F.col("depth") - F.col("at")).cast("int").alias("distance"))


def p1_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines on or below cycles, named by the smallest key on the cycle."""
    return p1_found(spark, sf_dir).filter("depth < 0").select("uuid", F.col("root_uuid").alias("cycle_uuid"), (F.col("depth") == -1).alias("on_cycle"))


QUERIES = {"p1_found": p1_found, "p1_paths": p1_paths, "p1_descendants": p1_descendants, "p1_cycles": p1_cycles}

_LINKS = r"""links AS (
  SELECT uuid, min(parent) AS parent FROM (
    SELECT lower(trim(uuid, E' \t\n\r')) AS uuid, nullif(lower(trim(parentUuid, E' \t\n\r')), '') AS parent FROM sample_session) t
  WHERE uuid <> '' GROUP BY uuid),
up AS (SELECT l.uuid, p.uuid AS parent FROM links l LEFT JOIN links p ON l.parent = p.uuid),
tree(uuid, root, depth) AS (
  SELECT uuid, uuid, 0 FROM up WHERE parent IS NULL
  UNION ALL SELECT u.uuid, t.root, t.depth + 1 FROM up u JOIN tree t ON u.parent = t.uuid),
loose AS (SELECT * FROM up WHERE uuid NOT IN (SELECT uuid FROM tree)),
walk(uuid, spot, low) AS (
  SELECT uuid, parent, least(uuid, parent) FROM loose
  UNION SELECT w.uuid, l.parent, least(w.low, l.parent) FROM walk w JOIN loose l ON w.spot = l.uuid WHERE w.spot <> w.uuid),
ring AS (SELECT uuid, min(low) AS root FROM walk WHERE spot = uuid GROUP BY uuid),
below(uuid, root) AS (
  SELECT uuid, root FROM ring
  UNION SELECT l.uuid, b.root FROM loose l JOIN below b ON l.parent = b.uuid),
answer AS (
  SELECT uuid, root, depth FROM tree
  UNION ALL SELECT b.uuid, b.root, CASE WHEN r.uuid IS NULL THEN -2 ELSE -1 END FROM (SELECT DISTINCT * FROM below) b LEFT JOIN ring r ON b.uuid = r.uuid)
"""
ORACLES = {
    "p1_found": f"WITH RECURSIVE {_LINKS} SELECT uuid, root AS root_uuid, CAST(depth AS INTEGER) AS depth FROM answer",
    "p1_cycles": f"WITH RECURSIVE {_LINKS} SELECT uuid, root AS cycle_uuid, depth = -1 AS on_cycle FROM answer WHERE depth < 0",
    "p1_descendants": f"""WITH RECURSIVE {_LINKS}, pairs(uuid, descendant_uuid, distance) AS (
  SELECT u.parent, u.uuid, 1 FROM up u JOIN tree t ON u.uuid = t.uuid WHERE u.parent IS NOT NULL
  UNION ALL SELECT u.parent, p.descendant_uuid, p.distance + 1 FROM pairs p JOIN up u ON p.uuid = u.uuid WHERE u.parent IS NOT NULL)
  SELECT uuid, descendant_uuid, CAST(distance AS INTEGER) AS distance FROM pairs""",
}
