"""Windows, leakage-safe splits and train-only normalization of sequences.

Windows run over halo blocks, so a sequence that holds a large share of all
rows is cut over many tasks; see `ordering`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_finite
from .ordering import BLOCK_ROWS, bounded_join, halo_blocks, positions, sized_groups
from .splines import blend_on_common_grid, cubic_spline, pchip  # noqa: F401

D = "dataset_id"

# Fixed values.
PARAMETERS = ["DS_mu", "KF_mu", "DS_sigma", "KF_sigma", "r_DS", "LNS_ksi", "num_clusters", "num_rays"]
BUNDLES = {"P2": 2, "P4": 4, "P6": 6, "P8": 8}
INTEGER_PARAMETERS = ["num_clusters", "num_rays"]
SEQUENCE_UNITS = {
    "DS_mu": "log10_s", "DS_sigma": "log10_s_std", "r_DS": "dimensionless", "num_clusters": "count",
    "num_rays": "count", "LNS_ksi": "dB", "KF_mu": "dB", "KF_sigma": "dB",
}
INF = float("inf")
EPS = 2.220446049250313e-16
DEFAULT_BOUNDS = {
    "DS_sigma": (0.0, INF), "KF_sigma": (0.0, INF), "r_DS": (EPS, INF), "LNS_ksi": (EPS, INF),
    "num_clusters": (1.0, INF), "num_rays": (1.0, INF),
}
SOURCE_TYPES = ["real_train", "real_validation", "real_test", "synthetic_generated",
                "measurement_calibrated_synthetic"]
GENERATED_TYPES = SOURCE_TYPES[3:]
LAYOUT = {"extrapolation": (16, 0, 4), "interpolation": (8, 8, 4)}  # left, right, target
SCENARIO_CYCLE = [
    ("sub-6 GHz_UMa_LoS", 3.5e9), ("sub-6 GHz_UMa_NLoS", 3.5e9),
    ("sub-6 GHz_UMi_LoS", 3.5e9), ("sub-6 GHz_UMi_NLoS", 3.5e9),
    ("sub-6 GHz_RMa_LoS", 3.5e9), ("sub-6 GHz_RMa_NLoS", 3.5e9),
    ("sub-6 GHz_Indoor_LoS", 3.5e9), ("sub-6 GHz_Indoor_NLoS", 3.5e9),
    ("cmWave_UMa_LoS", 16e9), ("cmWave_UMa_NLoS", 16e9),
    ("mmWave_UMi_LoS", 28e9), ("mmWave_UMi_NLoS", 28e9),
]


# ---- sliding windows -------------------------------------------------------

def sliding_windows(rows: DataFrame, group: list[str], pos: str, value: str, length: int,
                    horizon: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Inputs of `length` values with the value `horizon` steps later as target."""
    ahead = length + horizon - 1
    wide = halo_blocks(rows, pos, after=ahead, block_rows=block_rows)
    order = Window.partitionBy(*group, "_block").orderBy(pos)
    frame = order.rowsBetween(0, length - 1)
    return (
        wide.withColumn("inputs", F.collect_list(value).over(frame))
        .withColumn("target", F.lead(value, ahead).over(order))
        .withColumn("target_pos", F.lead(pos, ahead).over(order))
        .filter(F.col("_own") & F.col("target_pos").isNotNull())
        .select(*group, F.col(pos).alias("start_pos"), "inputs", "target", "target_pos")
    )


def chronological_blocks(rows: DataFrame, keys: list[str], pos: str, train: float = 0.70,
                         validation: float = 0.15) -> DataFrame:
    """Partition name and position inside the partition, before any windowing."""
    n = rows.groupBy(*keys).agg(F.max(pos).alias("n"))
    t = F.floor(F.col("n") * F.lit(train))
    v = t + F.floor(F.col("n") * F.lit(validation))
    p = F.col(pos)
    return bounded_join(rows, n, keys).withColumn(
        "partition", F.when(p <= t, "train").when(p <= v, "validation").otherwise("test")
    ).withColumn("block_pos", p - F.when(p <= t, F.lit(0)).when(p <= v, t).otherwise(v)).drop("n")


def chronological_windows(rows: DataFrame, keys: list[str], group: list[str], pos: str, value: str,
                          length: int = 10, horizon: int = 1, train: float = 0.70,
                          validation: float = 0.15) -> DataFrame:
    """Windows built inside each chronological block; no window crosses a cut."""
    split = chronological_blocks(rows, keys, pos, train, validation)
    w = sliding_windows(split, [*group, "partition"], "block_pos", value, length, horizon)
    offset = split.groupBy(*keys, "partition").agg(F.min(F.col(pos) - F.col("block_pos")).alias("_offset"))
    return bounded_join(w, offset, [*keys, "partition"]).withColumn(
        "target_index", F.col("target_pos") + F.col("_offset")).drop("_offset")


def two_way_split(rows: DataFrame, keys: list[str], pos: str, test_fraction: float = 0.2) -> DataFrame:
    """The last max(1, round(n*f)) positions are test."""
    n = rows.groupBy(*keys).agg(F.max(pos).alias("n"))
    test = F.greatest(F.lit(1), F.round(F.col("n") * F.lit(test_fraction)))
    return bounded_join(rows, n, keys).withColumn(
        "partition", F.when(F.col(pos) <= F.col("n") - test, "train").otherwise("test")).drop("n")


# ---- examples over grouped parameter sequences -----------------------------

def spans(seq: DataFrame, params: list[str], length: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every span of `length` rows inside a group with its state.

    state is `ok`, `invalid` (a failed or non-finite row) or `boundary` (an
    index gap), tested in that order. `pos` is the dense order in the group.
    """
    finite = is_finite(params[0])
    for p in params[1:]:
        finite = finite & is_finite(p)
    bad = (F.upper("quality_status") == "FAIL") | ~finite
    wide = halo_blocks(seq.select(D, "group_id", "pos", "idx", "label_source", bad.cast("int").alias("_bad"), *params),
                       "pos", after=length - 1, block_rows=block_rows)
    order = Window.partitionBy(D, "group_id", "_block").orderBy("pos")
    frame = order.rowsBetween(0, length - 1)
    stepped = wide.withColumn("_gap", (F.col("idx") - F.lag("idx").over(order) != 1).cast("int"))
    # A plan that does not use `cells` drops that window expression.
    s = stepped.withColumns({
        "_n": F.count(F.lit(1)).over(frame), "_bads": F.sum("_bad").over(frame),
        "_gaps": F.sum("_gap").over(order.rowsBetween(1, length - 1)),
        "cells": F.collect_list(F.struct("idx", "label_source", *params)).over(frame)})
    return s.filter(F.col("_own") & (F.col("_n") == length)).select(
        D, "group_id", F.col("idx").alias("start_idx"), "cells",
        F.when(F.col("_bads") > 0, "invalid").when(F.col("_gaps") > 0, "boundary").otherwise("ok").alias("state"))


def examples(seq: DataFrame, params: list[str], task: str,
             layout: tuple[int, int, int] | None = None) -> DataFrame:
    """Supervised examples: input and target cells plus the joined label sources."""
    left, right, target = layout or LAYOUT[task]
    s = spans(seq, params, left + right + target).filter("state = 'ok'")
    inputs = F.slice("cells", 1, left)
    if right:
        inputs = F.concat(inputs, F.slice("cells", left + target + 1, right))
    sources = F.array_join(F.array_distinct(F.col("cells.label_source")), "+")
    return s.select(D, "group_id", "start_idx", inputs.alias("inputs"),
                    F.slice("cells", left + 1, target).alias("targets"), sources.alias("label_sources"))


def span_counts(seq: DataFrame, params: list[str], length: int) -> DataFrame:
    """Example count and skip counts per dataset.

    Spans over a group border are counted from the group sizes; the stacked
    order itself is never built.
    """
    inside = spans(seq, params, length).groupBy(D).agg(
        F.count_if(F.col("state") == "ok").alias("n_example"),
        F.count_if(F.col("state") == "invalid").alias("skipped_invalid"),
        F.count_if(F.col("state") == "boundary").alias("gaps"), F.count(F.lit(1)).alias("inside"))
    total = seq.groupBy(D).agg(F.greatest(F.count(F.lit(1)) - (length - 1), F.lit(0)).alias("candidates"))
    return total.join(inside, D, "left").select(
        D, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_example", "skipped_invalid")],
        (F.coalesce("gaps", F.lit(0)) + F.col("candidates") - F.coalesce("inside", F.lit(0))).alias("skipped_boundary"))


def long_targets(ex: DataFrame, params: list[str], column: str = "targets") -> DataFrame:
    """One row per example, cell and parameter."""
    cells = ex.select(D, "group_id", "start_idx", F.posexplode(column).alias("step", "c"))
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.col(f"c.{p}").cast("double").alias("value"))
                                for p in params]))
    return cells.select(D, "group_id", "start_idx", "step", F.col("c.idx").alias("idx"), pairs.alias("v")).select(
        D, "group_id", "start_idx", "step", "idx", "v.param", "v.value")


# ---- group split -----------------------------------------------------------

def group_split(groups: DataFrame, order_key: str, fractions: tuple[float, float] = (0.70, 0.15),
                keys: list[str] | None = None) -> DataFrame:
    """Partition code per group (1 train, 2 validation, 3 test) in order of appearance, in each dataset or other keys.

    `groups` has one row per group and is kept, since deriving it may read the
    whole sequence; one or two groups are special cases.
    """
    keys = keys or [D]
    groups = groups.persist()
    n, total, datasets = sized_groups(groups, keys)
    ranked = positions(groups, keys, [order_key, "group_id"], order_key, "g", total=total)
    sized = bounded_join(ranked, n, keys, counted=datasets)
    t = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(fractions[0])))
    v = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(fractions[1])))
    short = F.col("n") - t - v < 1
    take_train = short & (t >= v) & (t > 1)
    t2 = F.when(take_train, t - 1).otherwise(t)
    v2 = F.when(short & ~take_train, v - 1).otherwise(v)
    g, n = F.col("g"), F.col("n")
    code = (
        F.when(n == 1, 1).when(n == 2, F.when(g == 1, 1).otherwise(3))
        .when(g <= t2, 1).when(g <= t2 + v2, 2).otherwise(3)
    )
    return sized.select(*keys, "group_id", "g", "n", code.alias("partition_code"))


def leaked_groups(split: DataFrame) -> DataFrame:
    """Groups found in more than one partition; empty for a clean split."""
    return split.groupBy(D, "group_id").agg(F.countDistinct("partition_code").alias("k")).filter("k > 1")


def leaked_targets(ex: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Adaptation targets inside the forbidden (dataset, group, idx) region."""
    keys = ex.select(D, "group_id", F.explode("targets.idx").alias("idx"))
    return keys.join(forbidden.select(D, "group_id", "idx"), [D, "group_id", "idx"], "left_semi").distinct()


# ---- normalization ---------------------------------------------------------

def to_long(seq: DataFrame, params: list[str], keep: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("value"))
                                for p in params]))
    return seq.select(*keep, pairs.alias("v")).select(*keep, "v.param", "v.value")


def fit_normalization(seq: DataFrame, params: list[str], train_groups: DataFrame,
                      bounds: dict[str, tuple[float, float]] | None = None, eps: float = 1e-12) -> DataFrame:
    """Train-only z-score table: one row per dataset and parameter."""
    ok = F.upper("quality_status") != "FAIL"
    for p in params:
        ok = ok & is_finite(p)
    # The group list can be as long as the sequence has groups, so no broadcast is forced.
    train = seq.filter(ok).join(train_groups.select(D, "group_id"), [D, "group_id"], "left_semi")
    stats = to_long(train, params, [D]).groupBy(D, "param").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("raw_std"), F.count(F.lit(1)).alias("rows"))
    zero = ~is_finite("raw_std") | (F.col("raw_std") < eps)
    limits = {p: (bounds or {}).get(p, DEFAULT_BOUNDS.get(p, (-INF, INF))) for p in params}
    pick = lambda i: F.coalesce(*[F.when(F.col("param") == p, F.lit(float(b[i]))) for p, b in limits.items()])
    return stats.select(
        D, "param", "mean", F.when(zero, 1.0).otherwise(F.col("raw_std")).alias("std"), "raw_std",
        zero.alias("zero_variance"), pick(0).alias("lo"), pick(1).alias("hi"),
        F.col("param").isin(INTEGER_PARAMETERS).alias("is_int"), "rows")


def normalize(long_rows: DataFrame, norm: DataFrame, value: str = "value", out: str = "z") -> DataFrame:
    facts = norm.select(D, "param", "mean", "std")
    return bounded_join(long_rows, facts, [D, "param"]).withColumn(
        out, (F.col(value) - F.col("mean")) / F.col("std")).drop("mean", "std")


def denormalize(long_rows: DataFrame, norm: DataFrame, z: str = "z", out: str = "value",
                project: bool = True) -> DataFrame:
    """Back to units; projects to the bounds and rounds integer parameters."""
    facts = norm.select(D, "param", "mean", "std", "lo", "hi", "is_int")
    x: Column = F.col(z) * F.col("std") + F.col("mean")
    if project:
        x = F.least(F.greatest(x, F.col("lo")), F.col("hi"))
    x = F.when(F.col("is_int"), F.round(x)).otherwise(x)
    return bounded_join(long_rows, facts, [D, "param"]).withColumn(out, x).drop(
        "mean", "std", "lo", "hi", "is_int")


def min_max(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per-sample min-max scaling; a sample without range gives zeros."""
    facts = rows.groupBy(*keys).agg(F.min(value).alias("sample_min"), F.max(value).alias("sample_max"))
    span = F.col("sample_max") - F.col("sample_min")
    joined = rows.join(facts, keys)
    return joined.withColumn("sample_range", span).withColumn(
        "scaled", F.when(span == 0, 0.0).otherwise((F.col(value) - F.col("sample_min")) / span))


def undo_min_max(rows: DataFrame) -> DataFrame:
    return rows.withColumn("restored", F.col("scaled") * F.col("sample_range") + F.col("sample_min"))


# ---- experiments and provenance --------------------------------------------

def feature_stats(train_rows: DataFrame, feature: str, value: str) -> DataFrame:
    """Mean and sample deviation per feature; zero deviation becomes one."""
    s = train_rows.groupBy(D, feature).agg(F.avg(value).alias("mu"), F.stddev_samp(value).alias("sd"))
    return s.withColumn("sd", F.when(F.coalesce("sd", F.lit(0.0)) == 0, 1.0).otherwise(F.col("sd")))


def safe_window(n: int, length: int = 10, horizon: int = 1, train: float = 0.70, validation: float = 0.15) -> int:
    """Window length that fits the smallest chronological block."""
    t, v = int(np.floor(n * train)), int(np.floor(n * validation))
    largest = min(t, v, n - t - v) - horizon
    if largest < 1:
        raise ValueError(f"at least {3 * (horizon + 1)} snapshots are needed")
    return min(length, largest)


def scaled_windows(windows: DataFrame, stats: DataFrame, feature: str) -> DataFrame:
    joined = bounded_join(windows, stats, [D, feature])
    scale = lambda x: (x - F.col("mu")) / F.col("sd")
    return joined.withColumn("inputs", F.transform("inputs", scale)).withColumn(
        "target", scale(F.col("target"))).drop("mu", "sd")


def varied_windows(rows: DataFrame, group: list[str], pos: str, value: str, length: str, longest: int,
                   horizon: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """sliding_windows with the window length in a column, at most `longest`; positions are dense in the group."""
    wide = halo_blocks(rows, pos, after=longest + horizon - 1, block_rows=block_rows)
    frame = Window.partitionBy(*group, "_block").orderBy(pos).rowsBetween(0, longest + horizon - 1)
    ahead = F.col(length) + (horizon - 1)
    return (
        wide.withColumn("_seen", F.collect_list(value).over(frame))
        .filter(F.col("_own") & (F.size("_seen") > ahead))
        .select(*group, F.col(pos).alias("start_pos"), F.slice("_seen", F.lit(1), F.col(length)).alias("inputs"),
                F.get("_seen", ahead).alias("target"), (F.col(pos) + ahead).alias("target_pos"))
    )


def temporal_experiment(rows: DataFrame, feature: str, pos: str, value: str, length: int = 10,
                        horizon: int = 1) -> tuple[DataFrame, DataFrame, int]:
    """Chronological windows scaled by the real training rows; also the stats and the longest window.

    Each dataset has the window length that its own rows allow, a column in one
    plan. A dataset with too few rows for any window is left out; only if none
    is long enough the call is an error.
    """
    sizes = rows.groupBy(D).agg(F.max(pos).alias("n"))
    t, v = F.floor(F.col("n") * 0.70), F.floor(F.col("n") * 0.15)
    fitting = F.least(F.lit(length), F.least(t, v, F.col("n") - t - v) - horizon).cast("int")
    sized = sizes.select(D, fitting.alias("_length")).filter("_length >= 1").persist()
    longest = sized.agg(F.max("_length")).first()[0]
    if longest is None:
        raise ValueError(f"at least {3 * (horizon + 1)} snapshots are needed")
    split = chronological_blocks(bounded_join(rows, sized, [D]), [D], pos)
    stats = feature_stats(split.filter("partition = 'train'"), feature, value)
    w = varied_windows(split, [D, feature, "partition"], "block_pos", value, "_length", longest, horizon)
    offset = split.groupBy(D, "partition").agg(F.min(F.col(pos) - F.col("block_pos")).alias("_offset"))
    placed = bounded_join(w, offset, [D, "partition"]).withColumn("target_index", F.col("target_pos") + F.col("_offset")).drop("_offset")
    return scaled_windows(placed, stats, feature), stats, longest


def merge_training(real: DataFrame, generated: DataFrame, generated_type: str = "synthetic_generated",
                   source_id: str = "unspecified") -> DataFrame:
    """Training windows of both origins with provenance tags; shapes must agree."""
    if generated_type not in GENERATED_TYPES:
        raise ValueError(f"generated data must be one of {GENERATED_TYPES}")
    if set(real.columns) != set(generated.columns):
        raise ValueError("real and generated windows must have the same columns")
    tag = lambda df, kind, name: df.withColumn("source_type", F.lit(kind)).withColumn("source_id", F.lit(name))
    return tag(real, "real_train", "real").unionByName(tag(generated, generated_type, source_id))


def provenance(merged: DataFrame) -> DataFrame:
    return merged.groupBy(D, "source_type", "source_id").agg(F.count(F.lit(1)).alias("sample_count"))


def canonical_sequence(rows: DataFrame, params: list[str], bounds: dict | None = None,
                       units: dict | None = None) -> DataFrame:
    """Long parameter sequence; columns the input lacks get their defaults."""
    idx = F.col("idx").cast("double")
    defaults = {
        "raw_window_start": idx, "raw_window_end": idx, "raw_window_center": idx,
        "label_source": F.lit("generator_truth"), "fit_score": F.lit(None).cast("double"),
        "quality_status": F.lit("PASS"),
    }
    for name, fallback in defaults.items():
        given = F.col(name) if name in rows.columns else F.lit(None)
        rows = rows.withColumn(name, F.coalesce(given, fallback))
    long_rows = to_long(rows, params, [D, "group_id", "idx", *defaults])
    names = {p: (units or {}).get(p, SEQUENCE_UNITS.get(p, "engine_native")) for p in params}
    limits = {p: (bounds or {}).get(p, DEFAULT_BOUNDS.get(p, (-INF, INF))) for p in params}
    choose = lambda f: F.coalesce(*[F.when(F.col("param") == p, F.lit(f(p))) for p in params])
    return long_rows.withColumn("unit", choose(lambda p: names[p])).withColumn(
        "lo", choose(lambda p: float(limits[p][0]))).withColumn("hi", choose(lambda p: float(limits[p][1])))


def fine_tuning_flags(seq: DataFrame) -> DataFrame:
    ok = seq.filter(F.upper("quality_status") != "FAIL")
    truth = F.bool_or(F.col("label_source") == "generator_truth")
    fitted = F.bool_or(F.col("label_source").isin("grid_fitted", "sa_fitted"))
    return ok.groupBy(D).agg(truth.alias("contains_generator_truth"), fitted.alias("contains_fitted_labels"),
                             truth.alias("pretraining_eligible"), fitted.alias("fine_tuning_candidate"))


# ---- local windows over samples --------------------------------------------

def local_windows(samples: DataFrame, pos: str, length: int = 16, stride: int = 4) -> DataFrame:
    """Window starts from the sample positions themselves: start, end, center."""
    n = samples.groupBy(D).agg(F.max(pos).alias("n"))
    starts = bounded_join(samples.select(D, F.col(pos).alias("start")), n, [D]).filter(
        (F.pmod(F.col("start") - 1, F.lit(stride)) == 0) & (F.col("start") + length - 1 <= F.col("n")))
    return starts.select(
        D, ((F.col("start") - 1) / stride + 1).cast("long").alias("window"), "start",
        (F.col("start") + length - 1).alias("end"), (F.col("start") + (length - 1) / 2).alias("center"))


def window_members(samples: DataFrame, pos: str, length: int = 16, stride: int = 4) -> DataFrame:
    """Each sample with the windows that hold it; at most length/stride rows per sample."""
    n = samples.groupBy(D).agg(F.max(pos).alias("_n"))
    p = F.col(pos)
    first = F.greatest(F.ceil((p - length) / stride), F.lit(0))
    last = F.floor((p - 1) / stride)
    windows = F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))
    return bounded_join(samples, n, [D]).withColumn("_w", windows).filter(
        F.col("_w") * stride + length <= F.col("_n")).withColumn("window", F.col("_w") + 1).drop("_w", "_n")


# ---- catalogue -------------------------------------------------------------

def group_catalogue(groups: DataFrame, order_key: str) -> DataFrame:
    """Cyclic scenario and carrier per group in order of the key."""
    ranked = positions(groups, [D], [order_key], order_key, "group_index")
    cycle = F.array(*[F.struct(F.lit(s).alias("scenario_name"), F.lit(f).alias("carrier_hz")) for s, f in SCENARIO_CYCLE])
    at = F.get(cycle, F.pmod(F.col("group_index") - 1, F.lit(len(SCENARIO_CYCLE))).cast("int"))
    return ranked.withColumn("_c", at).select("*", "_c.*").drop("_c")
