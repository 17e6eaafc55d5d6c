"""Decay curves of edge weights over hops."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tiers as (initial weight, hold, hops to die after the hold).
DEFAULT, FAST, SLOW = [(1.0, 1, 4), (0.5, 5, 15), (0.3, 10, 40)], [(1.0, 0, 3), (0.4, 2, 8)], [(0.8, 3, 10), (0.5, 10, 30), (0.2, 20, 80)]
# The models that are compared, as (type, initial weight, rate, hold, exponent, tiers).
MODELS = {
    "linear-simple": ("linear", 1.0, 1 / 20, 0, 1.0, []),
    "delayed-linear": ("delayed-linear", 1.0, 1 / 20, 3, 1.0, []),
    "multi-linear-default": ("multi-linear", 1.0, 0.0, 0, 1.0, DEFAULT),
    "multi-linear-fast": ("multi-linear", 1.0, 0.0, 0, 1.0, FAST),
    "multi-linear-slow": ("multi-linear", 1.0, 0.0, 0, 1.0, SLOW),
    "exponential": ("exponential", 1.8, math.log(2) / 5, 0, 1.0, []),
    "exponential-slow": ("exponential", 1.8, math.log(2) / 15, 0, 1.0, []),
    "power-law": ("power-law", 1.8, 0.2, 0, 1.0, []),
    "power-law-steep": ("power-law", 1.8, 0.2, 0, 2.0, []),
}
# Lower bounds of the hop bins.
HOP_BINS = (1, 2, 4, 7, 11, 21)


def _falling(initial: float, hold: float, rate: float, d: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(initial) - rate * F.greatest(F.lit(0.0), d - hold))


def weight(model: str, d: Column) -> Column:
    """The weight that a model leaves after `d` hops."""
    kind, w0, rate, hold, exponent, tiers = MODELS[model]
    if kind == "multi-linear":
        return sum((_falling(w, h, w / n, d) for w, h, n in tiers), F.lit(0.0))
    if kind == "exponential":
        return w0 * F.exp(-rate * d)
    if kind == "power-law":
        return w0 / F.pow(1 + rate * d, F.lit(exponent))
    return _falling(w0, hold, rate, d)


def death(model: str) -> float | None:
    """The distance at which a model reaches 0, null for those that never do."""
    kind, w0, rate, hold, _, tiers = MODELS[model]
    if kind == "multi-linear":
        return float(max(h + n for _, h, n in tiers))
    return hold + w0 / rate if kind in ("linear", "delayed-linear") else None


def curves(spark, most: int = 60) -> DataFrame:
    """model, hops, weight for all models."""
    grid = spark.range(most + 1).select(F.col("id").cast("int").alias("hops"))
    out = None
    for m in MODELS:
        c = grid.select(F.lit(m).alias("model"), "hops", weight(m, F.col("hops").cast("double")).alias("weight"))
        out = c if out is None else out.unionByName(c)
    return out


def curve_area(c: DataFrame) -> DataFrame:
    """The area under each curve by trapezoids, and the first hop at which half of the start is left."""
    w = Window.partitionBy("model").orderBy("hops")
    t = c.withColumn("before", F.lag("weight").over(w)).withColumn("start", F.first("weight").over(w))
    return t.groupBy("model").agg(F.sum((F.col("weight") + F.col("before")) / 2).alias("area"), F.min(F.when(F.col("weight") <= F.col("start") / 2, F.col("hops"))).alias("half_life"))


def hop_bin(d: Column) -> Column:
    c = F
    for lo, hi in zip(HOP_BINS, [*HOP_BINS[1:], None]):
        c = c.when((d >= lo) & (d < hi) if hi else d >= lo, lo)
    return c.otherwise(F.lit(None).cast("int"))
