"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import scratch


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score -weight / ln(u), u in (0, 1) a hash of key and shard; ties: the
    higher shard. A shard's scores do not depend on the others, so a new shard takes records only to itself
    and a removed one's records spread by weight. A null key is a key of its own. Weights are above zero."""
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))

    def score(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(text, F.lit(f"shard {shard}")), 12).cast("double")
        return F.lit(-float(weight)) / F.log((bits + 0.5) / F.lit(2.0**52))

    best = F.greatest(*[F.struct(score(s, w).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]) if len(weights) > 1 else F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("shard"))
    return best["shard"]


def shard_records(spark: SparkSession, rows: DataFrame, key: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * 8, grown: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row.

    size: UTF-8 bytes of the text plus 1 (null: none). slot numbers a shard's rows without gaps from 0, in
    the order of the written digest's parts: rows get a number within their part, parts a running sum of
    counts, so no shard meets in one task and a hot key or source stays spread. Rows that repeat a key go
    to one shard with slots of their own. grown_shard: the shard with one more of weight `grown`.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    k = F.col(key)
    digest = scratch(spark, rows.select(
        k.alias("doc_id"), (F.octet_length(data).cast("long") + 1).alias("size"), F.crc32(data).alias("text_crc32"),
        rendezvous(k, weights).alias("shard"), rendezvous(k, [*weights, grown]).alias("grown_shard"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "shards")
    counts = digest.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("at")) - 1
    placed = digest.select("*", within.cast("long").alias("within")).join(before, ["shard", "part"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("within")).alias("slot"), "grown_shard")
