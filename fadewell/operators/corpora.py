"""Training corpora over nested parameter bundles.

The bundles are prefixes of one parameter list (P2, P4, P6, P8), so windows are
made once with all parameters in one array column. A row's level is the number
of its leading finite parameters; a window serves every bundle up to the lowest
level in it. Splits, normalization and examples of all bundles and tasks follow
from that one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_finite
from .ordering import BLOCK_ROWS, bounded_join, halo_blocks
from .sequences import BUNDLES, DEFAULT_BOUNDS, INF, INTEGER_PARAMETERS, LAYOUT, group_split

D = "dataset_id"
KEYS = [D, "task", "bundle"]


def with_level(seq: DataFrame, params: list[str]) -> DataFrame:
    """Adds `level`, the number of leading finite parameters (0 for a failed row), and the array `values`."""
    level = F.when(F.upper("quality_status") == "FAIL", 0)
    for i, p in enumerate(params):
        level = level.when(~is_finite(p), i)
    return seq.withColumns({"level": level.otherwise(len(params)),
                            "values": F.array(*[F.col(p).cast("double") for p in params])})


def leveled_spans(leveled: DataFrame, length: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every gapless span of `length` rows of a group with its lowest level and its cells."""
    wide = halo_blocks(leveled.select(D, "group_id", "pos", "idx", "label_source", "level", "values"), "pos",
                       after=length - 1, block_rows=block_rows)
    order = Window.partitionBy(D, "group_id", "_block").orderBy("pos")
    frame = order.rowsBetween(0, length - 1)
    stepped = wide.withColumn("_gap", (F.col("idx") - F.lag("idx").over(order) != 1).cast("int"))
    s = stepped.withColumns({
        "_n": F.count(F.lit(1)).over(frame), "_lowest": F.min("level").over(frame),
        "_gaps": F.sum("_gap").over(order.rowsBetween(1, length - 1)),
        "cells": F.collect_list(F.struct("idx", "label_source", "values")).over(frame)})
    kept = F.col("_own") & (F.col("_n") == length) & (F.coalesce("_gaps", F.lit(0)) == 0)
    return s.filter(kept).select(D, "group_id", F.col("idx").alias("start_idx"), F.col("_lowest").alias("level"), "cells")


def nested_examples(leveled: DataFrame, bundles: dict[str, int] | None = None,
                    layouts: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """Examples of every task and bundle: inputs and targets as arrays of (idx, values), values cut to the bundle."""
    bundles, layouts = bundles or BUNDLES, layouts or LAYOUT
    made = None
    for length in sorted({sum(shape) for shape in layouts.values()}):  # tasks of one length share their windows
        sets = F.array(*[F.struct(F.lit(b).alias("bundle"), F.lit(n).alias("size")) for b, n in bundles.items()])
        spans = leveled_spans(leveled, length).withColumn("_b", F.explode(F.filter(sets, lambda b: b["size"] <= F.col("level"))))
        tasks = [F.struct(F.lit(t).alias("task"), F.lit(a).alias("left"), F.lit(b).alias("right"), F.lit(c).alias("target"))
                 for t, (a, b, c) in layouts.items() if a + b + c == length]
        spread = spans.withColumn("_t", F.explode(F.array(*tasks)))
        left, right, target = (F.col(f"_t.{c}") for c in ("left", "right", "target"))

        def cut(cells: Column) -> Column:
            return F.transform(cells, lambda c: F.struct(c["idx"].alias("idx"), F.slice(c["values"], F.lit(1), F.col("_b.size")).alias("values")))

        one = spread.select(
            D, F.col("_t.task").alias("task"), F.col("_b.bundle").alias("bundle"), F.col("_b.size").alias("size"), "group_id", "start_idx",
            cut(F.concat(F.slice("cells", F.lit(1), left), F.slice("cells", left + target + 1, right))).alias("inputs"),
            cut(F.slice("cells", left + 1, target)).alias("targets"),
            F.array_join(F.array_distinct("cells.label_source"), "+").alias("label_sources"))
        made = one if made is None else made.unionByName(one)
    return made


def bundle_split(examples: DataFrame, order_key: str = "group_id") -> DataFrame:
    """Partition code per dataset, task, bundle and group, among the groups that have examples there."""
    groups = examples.select(*KEYS, "size", "group_id").distinct()
    return group_split(groups.drop("size"), order_key, keys=KEYS).join(groups, [*KEYS, "group_id"])


def level_moments(leveled: DataFrame, params: list[str]) -> DataFrame:
    """Row count and per-parameter mean and variance of each dataset, group and level, from one aggregate."""
    # the level is the same in the whole group, so it cuts the results, not each row
    of = lambda fold: F.array(*[F.when(F.col("level") > i, fold(F.col("values")[i])) for i in range(len(params))])
    return leveled.filter("level > 0").groupBy(D, "group_id", "level").agg(
        F.count(F.lit(1)).alias("n"), of(F.avg).alias("means"), of(F.var_pop).alias("vars"))


def bundle_normalization(leveled: DataFrame, params: list[str], split: DataFrame,
                         bounds: dict[str, tuple[float, float]] | None = None, eps: float = 1e-12) -> DataFrame:
    """Train-only z-score table per dataset, task, bundle and parameter.

    The sequence is reduced once to moments per group and level; a bundle adds
    up the levels that hold all its parameters. Sums are taken around the mean
    of all rows, so large offsets cost no digits.
    """
    moments = level_moments(leveled, params).persist()  # rows per group and level, read twice
    cells = F.posexplode(F.arrays_zip("means", "vars")).alias("i", "m")
    flat = moments.select(D, "group_id", "level", "n", cells).filter("i < level")
    around = flat.groupBy(D, "i").agg((F.sum(F.col("n") * F.col("m.means")) / F.sum("n")).alias("around"))
    train = split.filter("partition_code = 1").select(*KEYS, "size", "group_id")
    joined = bounded_join(flat.join(train, [D, "group_id"]).filter((F.col("level") >= F.col("size")) & (F.col("i") < F.col("size"))), around, [D, "i"])
    gap = F.col("m.means") - F.col("around")
    sums = joined.groupBy(*KEYS, "i").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * gap).alias("_s"), F.sum(F.col("n") * (F.col("m.vars") + gap * gap)).alias("_q"),
        F.first("around").alias("around"))
    rows = F.col("rows")
    raw = F.when(rows > 1, F.sqrt(F.greatest(F.col("_q") - F.col("_s") ** 2 / rows, F.lit(0.0)) / (rows - 1)))
    limits = [(bounds or {}).get(p, DEFAULT_BOUNDS.get(p, (-INF, INF))) for p in params]
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("i"))
    zero = F.col("raw_std").isNull() | (F.col("raw_std") < eps)
    return sums.withColumn("raw_std", raw).select(
        *KEYS, "i", pick(params).alias("param"), (F.col("around") + F.col("_s") / rows).alias("mean"),
        F.when(zero, 1.0).otherwise(F.col("raw_std")).alias("std"), "raw_std", zero.alias("zero_variance"),
        pick([float(a) for a, _ in limits]).alias("lo"), pick([float(b) for _, b in limits]).alias("hi"),
        pick([p in INTEGER_PARAMETERS for p in params]).alias("is_int"), "rows")


def normalized_examples(examples: DataFrame, norm: DataFrame) -> DataFrame:
    """Inputs and targets in z units of their dataset, task and bundle."""
    cell = F.array_sort(F.collect_list(F.struct("i", "mean", "std")))
    table = norm.groupBy(*KEYS).agg(cell.alias("_z"))

    def scaled(column: str) -> Column:
        return F.transform(column, lambda c: F.struct(c["idx"].alias("idx"), F.zip_with(
            c["values"], F.col("_z"), lambda v, z: (v - z["mean"]) / z["std"]).alias("values")))

    return bounded_join(examples, table, KEYS).withColumns({"inputs": scaled("inputs"), "targets": scaled("targets")}).drop("_z")
