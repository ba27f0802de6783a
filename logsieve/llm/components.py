"""Connected components by alternating large and small stars, as windows over the neighbours of a node.

A round deals the edges out twice and writes them once. Every edge gives one edge at most, and equal edges stand beside
each other in a window, where all but one go; so no round has more rows than the one before. The number of
edges and a sum of their hashes are observed while they are written: a round that changes neither is the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..scratch import written


def _neighbours(near: DataFrame) -> DataFrame:
    """u, v, once each, and the smallest v of u as ``m``."""
    of = Window.partitionBy("u").orderBy("v")
    so_far = of.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = near.select("u", "v", F.first("v").over(so_far).alias("m"), F.lag("v").over(of).alias("prior"))
    return marked.filter("prior is null or prior <> v").drop("prior")


def _large(edges: DataFrame) -> DataFrame:
    """Points the larger neighbours of every node at the smallest of them all."""
    ends: list[Column] = [F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in (("a", "b"), ("b", "a"))]
    near = _neighbours(edges.select(F.explode(F.array(*ends)).alias("end")).select("end.u", "end.v"))
    return near.filter("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Points every node and its smaller neighbours at the smallest of them."""
    near = _neighbours(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    return near.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))


def _observed(edges: DataFrame, name: str) -> tuple[DataFrame, dict]:
    """The written edges, their number and a sum of their hashes."""
    seen = Observation()
    hashes = F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 32) - 1))
    out = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(hashes).alias("sum")), name)
    return out, seen.get


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of the edges (a, b: long)."""
    now, mark = _observed(edges.filter("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), "edges")
    before = None
    while mark != before:
        before = mark
        now, mark = _observed(_small(_large(now)), "stars")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
