"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch


def _star(edges: DataFrame, keep_larger: bool) -> DataFrame:
    """Hang the neighbours of each node on the least of them.

    keep_larger: only larger neighbours move; otherwise the node and its smaller ones do.
    Minima are pre-aggregated and joined back, so adaptive execution can split a hub.
    """
    if keep_larger:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; component is the least node reachable.

    edges: a, b (long). Loops, repeats and nulls are dropped. Each round is written to the shared
    folder; the driver sees only a count and a checksum per round.
    """
    a, b = F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")
    now = scratch(spark, edges.select(a, b).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        now = scratch(spark, _star(_star(now, True), False), "edges")
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == seen or sign[0] == 0:
            break
        seen = sign
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
