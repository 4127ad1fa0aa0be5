"""Connected components by alternating large-star and small-star steps, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b) of longs: the component is its least node.

    Every step is written to the shared folder; the number of steps grows with the logarithm of the
    longest path.  Hubs are safe: their neighbours meet only in partial minima and in joins that
    Spark splits.  No links give no rows.
    """
    edges = common.stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    before, old = None, [edges]
    while True:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = common.stored(both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "components")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = common.stored(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "components")
        common.done_with(*old, large)
        old = [edges]
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
