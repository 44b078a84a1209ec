"""Statistical building blocks: distributions, histograms, quantiles, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bin_index, col, dbm_to_watts, is_finite
from .ordering import bounded_join, counted_ranks, expand_counts, positions, sized_groups


def empirical_cdf(df: DataFrame, value: str, keys: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """Sorted finite values with y = i/n. Ties are kept, in the order of `carry`, columns that stay. Adds i and n.

    Without `carry` tied rows are alike, so only distinct values are ranked.
    With it rows are ranked; they are usually derived (one per sample) and read
    for the size, the bucket edges and the ranks, so they are kept.
    """
    finite = df.filter(is_finite(value)).select(*keys, *carry, F.col(value).alias("x"))
    if not carry:
        return expand_counts(counted_ranks(finite, keys, "x"), keys, "x").withColumn("y", F.col("i") / F.col("n"))
    finite = finite.persist()
    sizes, total, groups = sized_groups(finite, keys)
    ranked = positions(finite, keys, ["x", *carry], "x", "i", total=total, tie_key=carry[0])
    return bounded_join(ranked, sizes, keys, counted=groups).withColumn("y", F.col("i") / F.col("n"))


def quantiles(df: DataFrame, value: str, keys: list[str], probs: list[float]) -> DataFrame:
    """Linear-interpolated quantiles: keys, p_index, p, q.

    Reads them from the running counts of the distinct values: a value serves
    every quantile one of whose two neighbouring ranks lies in its run. No task
    or aggregation buffer ever holds the values of a group.
    """
    ranked = counted_ranks(df.filter(is_finite(value)), keys, value)
    listed = F.split(F.lit(",".join(repr(float(p)) for p in probs)), ",").cast("array<double>")  # one literal, folded once
    at = F.col("w.at")
    placed = F.transform(listed, lambda p, j: F.struct(
        j.alias("p_index"), p.alias("p"), (1 + (F.col("n") - 1) * p).alias("at")))
    inside = lambda rank: (rank > F.col("last") - F.col("c")) & (rank <= F.col("last"))
    near = F.filter(placed, lambda w: inside(F.floor(w["at"])) | inside(F.ceil(w["at"])))
    hits = ranked.select(*keys, "x", "c", "last", F.explode(near).alias("w"))
    upper = at - F.floor(at)
    share = F.when(inside(F.floor(at)), 1 - upper).otherwise(0.0) + F.when(inside(F.ceil(at)), upper).otherwise(0.0)
    return (
        hits.groupBy(*keys, F.col("w.p_index").alias("p_index"), F.col("w.p").alias("p"))
        .agg(F.sum(F.col("x") * share).alias("q"))
    )


def cdf_summary(df: DataFrame, value: str, keys: list[str], recommended: int = 20) -> DataFrame:
    """Count, median, 90th percentile and the availability flags of a CDF."""
    counts = df.groupBy(*keys).agg(F.count_if(is_finite(value)).alias("sample_count"))
    q = quantiles(df, value, keys, [0.5, 0.9])
    picks = q.groupBy(*keys).agg(
        F.max(F.when(F.col("p_index") == 0, F.col("q"))).alias("median"),
        F.max(F.when(F.col("p_index") == 1, F.col("q"))).alias("percentile_90"),
    )
    n = F.col("sample_count")
    return counts.join(picks, keys, "left").select(
        *keys, "sample_count",
        F.when(n >= 2, F.col("median")).alias("median"),
        F.when(n >= 2, F.col("percentile_90")).alias("percentile_90"),
        (n >= 2).alias("available"),
        (n >= recommended).alias("recommended_met"),
        F.when(n == 0, "No finite samples are available.")
        .when(n == 1, "An empirical CDF requires at least two samples.")
        .when(n < recommended, F.format_string(
            "CDF uses %d samples; at least %d are recommended.", n, F.lit(recommended)))
        .otherwise("").alias("warning"),
    )


def step_ecdf(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Classic ECDF: distinct x with F(x), after a leading (min, 0) point."""
    ranked = counted_ranks(df.filter(is_finite(value)), keys, value)
    steps = ranked.select(*keys, F.col("dense").alias("i"), "x", (F.col("last") / F.col("n")).alias("f"))
    start = ranked.filter("dense = 1").select(*keys, F.lit(0).cast("long").alias("i"), "x", F.lit(0.0).alias("f"))
    return steps.unionByName(start)


def weighted_histogram(df: DataFrame, x: str | Column, weight: str | Column, keys: list[str],
                       lo: Column, width: Column, bins: Column) -> DataFrame:
    """Sum of weights per bin; values outside the grid are dropped."""
    ok = is_finite(x) & is_finite(weight) & (col(weight) >= 0)
    return (
        df.filter(ok)
        .select(*keys, bin_index(x, lo, width, bins).alias("bin"), col(weight).alias("_w"))
        .filter(F.col("bin").isNotNull())
        .groupBy(*keys, "bin").agg(F.sum("_w").alias("weight"))
    )


def js_distance(pairs: DataFrame, keys: list[str], p: str, q: str, bins: int,
                eps: float = 1e-12) -> DataFrame:
    """Base-2 Jensen-Shannon distance of two distributions joined on bin.

    p and q sum to one per key. Bins empty on both sides add nothing, so the
    rows may be sparse.
    """
    total = F.lit(1.0 + bins * eps)
    a = (F.coalesce(F.col(p), F.lit(0.0)) + eps) / total
    b = (F.coalesce(F.col(q), F.lit(0.0)) + eps) / total
    m = (a + b) / 2
    part = (a * F.log2(a / m) + b * F.log2(b / m)) / 2
    d = F.sum(part)
    return pairs.groupBy(*keys).agg(
        F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), d))).alias("js_distance"))


def log_quantile_distance(pairs: DataFrame, keys: list[str], a: str, b: str,
                          decades: float = 1.0, eps: float = 1e-12) -> DataFrame:
    """Mean |log10| distance of two quantile grids, in decades, capped at one."""
    gap = F.abs(F.log10(F.greatest(F.col(a), F.lit(eps))) - F.log10(F.greatest(F.col(b), F.lit(eps))))
    return pairs.groupBy(*keys).agg(
        F.least(F.lit(1.0), F.avg(gap) / decades).alias("quantile_distance"))


def snapshot_power(dpsd: DataFrame, keys: list[str]) -> DataFrame:
    return dpsd.groupBy(*keys).agg(F.sum(dbm_to_watts("dbm")).alias("total_w"))
