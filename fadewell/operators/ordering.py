"""Ordered work on groups of any size.

A plain window over a group puts the whole group into one task. These helpers
cut a group into buckets first, so a group that holds a third of all rows is
still spread over the cluster, and give the same results as the plain window.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 20_000
BLOCK_ROWS = 100_000
BROADCAST_ROWS = 200_000


def bounded_join(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner",
                 limit: int = BROADCAST_ROWS, counted: int | None = None) -> DataFrame:
    """Join facts onto rows; broadcast facts only after counting them.

    Above the limit the join stays a shuffle join, where adaptive execution
    splits hot keys. `counted` is the row count of facts where it is known.
    """
    if counted is None:
        facts = facts.persist()
        counted = facts.count()
    if counted <= limit:
        facts = F.broadcast(facts)
    return rows.join(facts, keys, how)


def sized_groups(df: DataFrame, keys: list[str], out: str = "n") -> tuple[DataFrame, int, int]:
    """Row count per key, kept, with the total of rows and of keys from one job."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)).persist()
    facts = sizes.agg(F.sum(out).alias("rows"), F.count(F.lit(1)).alias("keys")).first()
    return sizes, facts["rows"] or 0, facts["keys"]


def _cut(df: DataFrame, key: str, edges: list[float], out: str) -> DataFrame:
    splits = [-math.inf, *edges, math.inf]
    cut = Bucketizer(splits=splits, inputCol="_key", outputCol=out, handleInvalid="keep")
    keyed = df.withColumn("_key", F.col(key).cast("double"))
    return cut.transform(keyed).drop("_key").withColumn(out, F.col(out).cast("int"))


def with_bucket(df: DataFrame, key: str, rows_per_bucket: int = ROWS_PER_BUCKET,
                total: int | None = None, tie_key: str | None = None) -> tuple[DataFrame, int]:
    """Add `_bucket`, a monotone function of the order keys; also its count.

    The edges are quantiles of `key`. A value that takes several quantiles
    gets a bucket of its own, which `tie_key`, the next numeric order column,
    cuts further.
    """
    total = df.count() if total is None else total
    buckets = min(MAX_BUCKETS, math.ceil(total / rows_per_bucket))
    if buckets == 1 or total == 0:
        return df.withColumn("_bucket", F.lit(0)), 1
    probs = [i / buckets for i in range(1, buckets)]
    found = Counter(df.approxQuantile(key, probs, 0.25 / buckets))
    heavy = sorted(v for v, times in found.items() if times > 1)
    # infinite values lie beyond the largest finite edges
    edges = sorted({max(-sys.float_info.max, min(v, sys.float_info.max)) for v in (*found, *(math.nextafter(v, math.inf) for v in heavy))})
    out = _cut(df, key, edges, "_bucket")
    if not heavy or tie_key is None:
        return out, len(edges) + 1
    tied = F.col(key).cast("double").isin(heavy)
    inner = sorted(set(df.filter(tied).approxQuantile(tie_key, probs, 0.25 / buckets)))
    split = _cut(out, tie_key, inner, "_tie").withColumn(
        "_bucket", F.col("_bucket") * (len(inner) + 1) + F.when(tied, F.col("_tie")).otherwise(0))
    return split.drop("_tie"), (len(edges) + 1) * (len(inner) + 1)


def positions(df: DataFrame, group: list[str], order: list[str | Column], key: str,
              out: str = "pos", rows_per_bucket: int = ROWS_PER_BUCKET, total: int | None = None,
              tie_key: str | None = None) -> DataFrame:
    """row_number() per group; `key` and `tie_key` are the numeric leading order columns.

    Rows are ranked inside (group, bucket) and shifted by the row count of the
    earlier buckets, which is a table of at most MAX_BUCKETS rows per group.
    """
    df, buckets = with_bucket(df, key, rows_per_bucket, total, tie_key)
    if buckets == 1:
        whole = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn(out, F.row_number().over(whole).cast("long")).drop("_bucket")
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(inside))
    sizes = df.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return (
        ranked.join(starts, [*group, "_bucket"])
        .withColumn(out, (F.col("_start") + F.col("_rank")).cast("long"))
        .drop("_rank", "_start", "_bucket")
    )


def keyed_positions(df: DataFrame, group: list[str], key: str, out: str = "pos") -> DataFrame:
    """Positions of wide rows by a unique numeric key: only the keys are sorted."""
    ranks = positions(df.select(*group, key), group, [key], key, out)
    return bounded_join(df, ranks, [*group, key])


def counted_ranks(df: DataFrame, group: list[str], value: str, out: str = "x",
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per group and distinct value: the value, its count `c`, the rank `last` of its last row, its place
    `dense` among the distinct values, and the group's `n`.

    Rows are counted on the map side first, so a value that a group repeats is
    one row from there on. Running counts are taken inside buckets of distinct
    values and shifted by the counts of the earlier buckets.
    """
    counts = df.groupBy(*group, F.col(value).alias(out)).agg(F.count(F.lit(1)).alias("c")).persist()
    distinct, buckets = with_bucket(counts, out, rows_per_bucket)
    upto = Window.partitionBy(*group, "_bucket").orderBy(out).rowsBetween(Window.unboundedPreceding, 0)
    summed = distinct.withColumns({"_upto": F.sum("c").over(upto), "_dense": F.count(F.lit(1)).over(upto)})
    if buckets == 1:
        return summed.withColumn("n", F.sum("c").over(Window.partitionBy(*group, "_bucket"))).select(
            *group, out, "c", F.col("_upto").alias("last"), F.col("_dense").alias("dense"), "n")
    sizes = distinct.groupBy(*group, "_bucket").agg(F.sum("c").alias("_c"), F.count(F.lit(1)).alias("_d"))  # at most MAX_BUCKETS rows per group
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_bucket", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"),
                          F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_dense_start"), F.sum("_c").over(whole).alias("n"))
    return bounded_join(summed, starts, [*group, "_bucket"]).select(
        *group, out, "c", (F.col("_upto") + F.col("_start")).alias("last"), (F.col("_dense") + F.col("_dense_start")).alias("dense"), "n")


def expand_counts(ranked: DataFrame, group: list[str], value: str, out: str = "i", rows_per_chunk: int = BLOCK_ROWS) -> DataFrame:
    """Back to one row per rank, from the rows of counted_ranks.

    A value with many rows is cut into chunks that are dealt out before they
    unfold, so no task makes more than a chunk of one value.
    """
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / rows_per_chunk))
    cut = ranked.withColumn("_chunk", F.explode(chunks))
    facts = ranked.agg(F.max("c").alias("most"), F.sum("c").alias("rows")).first()
    if (facts["most"] or 0) > rows_per_chunk:  # a given count, since adaptive execution would join the few short rows
        cut = cut.repartition(min(MAX_BUCKETS, math.ceil(facts["rows"] / rows_per_chunk)), *group, value, "_chunk")
    first = F.col("last") - F.col("c") + 1 + F.col("_chunk") * rows_per_chunk
    return cut.withColumn(out, F.explode(F.sequence(first, F.least(first + (rows_per_chunk - 1), F.col("last"))))).drop(
        "_chunk", "c", "last", "dense")


def range_positions(df: DataFrame, group: list[str], order: list[str], out: str = "pos", parts: int = 200) -> DataFrame:
    """row_number() per group for any sortable columns, by one range shuffle.

    The boundaries are whole rows of (group, order) that Spark samples, so long
    common prefixes or ties in the leading columns do not meet in one part.
    The sorted parts are written to the shared folder, because the counted
    offsets must belong to the same parts as the ranks.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/ranks-{uuid.uuid4().hex}"
    ranged = df.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    ranged.withColumn("_at", F.monotonically_increasing_id()).write.parquet(folder)
    kept = spark.read.parquet(folder)
    part, inner = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = kept.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(
        "_all", (F.col("_start") + inner).cast("long"))
    if not group:
        return placed.withColumn(out, F.col("_all") + 1).drop("_part", "_start", "_at", "_all")
    firsts = placed.groupBy(*group).agg(F.min("_all").alias("_first"))
    return bounded_join(placed, firsts, group).withColumn(out, F.col("_all") - F.col("_first") + 1).drop(
        "_part", "_start", "_at", "_all", "_first")


def text_positions(df: DataFrame, group: list[str], text: str, order: list[str], out: str = "pos",
                   rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Positions by a text column and then `order`, in byte order; null text comes first."""
    total = df.count()
    if total <= rows_per_bucket:
        whole = Window.partitionBy(*group).orderBy(text, *order)
        return df.withColumn(out, F.row_number().over(whole).cast("long"))
    return range_positions(df, group, [text, *order], out, math.ceil(total / rows_per_bucket))


def block_of(pos: str | Column, block_rows: int) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor((pos - 1) / block_rows).cast("long")


def halo_blocks(df: DataFrame, pos: str, before: int = 0, after: int = 0,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Copy each row into every block that needs it as a neighbour.

    Adds `_block` and `_own`; a window over (group, _block) sees `before`
    earlier and `after` later rows around each row it owns.
    """
    own = block_of(pos, block_rows)
    first = block_of(F.greatest(F.col(pos) - after, F.lit(1)), block_rows)
    last = block_of(F.col(pos) + before, block_rows)
    return (
        df.withColumn("_home", own)
        .withColumn("_block", F.explode(F.sequence(first, last)))
        .withColumn("_own", F.col("_home") == F.col("_block"))
        .drop("_home")
    )


def lagged(df: DataFrame, group: list[str], pos: str, columns: dict[str, str],
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """lag(column, 1) by dense position, for groups of any size."""
    wide = halo_blocks(df, pos, before=1, block_rows=block_rows)
    w = Window.partitionBy(*group, "_block").orderBy(pos)
    for out, source in columns.items():
        wide = wide.withColumn(out, F.lag(source).over(w))
    return wide.filter("_own").drop("_own", "_block")


def running(df: DataFrame, group: list[str], pos: str, columns: dict[str, tuple[str, str]],
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Running sum/min/max per group: local running value plus earlier blocks.

    The kind `min_before` leaves out the row itself.
    """
    fold = {"sum": F.sum, "min": F.min, "max": F.max, "min_before": F.min}
    merge = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
             "min": F.least, "max": F.greatest, "min_before": F.least}
    df = df.withColumn("_block", block_of(pos, block_rows))
    order = Window.partitionBy(*group, "_block").orderBy(pos)
    upto, before = (order.rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = df.groupBy(*group, "_block").agg(
        *[fold[kind](source).alias(f"_b_{out}") for out, (kind, source) in columns.items()]
    )
    carried = per_block.select(
        *group, "_block",
        *[fold[kind](f"_b_{out}").over(earlier).alias(f"_c_{out}") for out, (kind, _) in columns.items()],
    )
    for out, (kind, source) in columns.items():
        df = df.withColumn(f"_l_{out}", fold[kind](source).over(before if kind == "min_before" else upto))
    df = df.join(carried, [*group, "_block"])
    for out, (kind, _) in columns.items():
        df = df.withColumn(out, merge[kind](F.col(f"_l_{out}"), F.col(f"_c_{out}")))
    return df.drop("_block", *[f"_l_{o}" for o in columns], *[f"_c_{o}" for o in columns])
