"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.llm.common import drop_path, stored


def _nearest(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the smallest of u and all v of u; joined rather than windowed, so that a hub's rows can be split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    large = _nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    near = _nearest(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    small = near.select(F.col("v").alias("a"), F.col("m").alias("b")).union(near.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node. Each round is written to the shared folder."""
    now, path = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        after, new = stored(_round(now), "edges")
        drop_path(edges.sparkSession, path)
        now, path = after, new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
