"""Connected components by alternating large-star and small-star rounds; no part of the graph reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Nulls and loops are ignored, repeated edges count once, no edges give no rows. Minima combine before each shuffle,
    so a hub costs a row per task, and the joins back are plain equi-joins that the adaptive planner may split.
    """
    e = edges.where("a is not null and b is not null and a != b")
    e = scratch.keep(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.keep(both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.keep(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(e, large)
        e, before = new, mark
        mark = _mark(e)
        if mark == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
