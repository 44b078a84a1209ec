"""Forecast evaluation, model choice and parameter resolution.

Every score is an aggregate with map-side combine; first-per-group uses
min-by instead of a window, so a hot group is reduced before it moves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import db_eps, dbm_to_watts, is_finite
from .ordering import bounded_join

D = "dataset_id"
EPS = 2.220446049250313e-16

# Fixed values.
NOISE_DBM = [-95.0, -100.0, -105.0, -110.0, -115.0]
RESOLVED_PARAMETERS = ["DS_mu", "DS_sigma", "r_DS", "num_clusters", "num_rays", "LNS_ksi", "KF_mu", "KF_sigma", "doppler_hz"]
RESOLVER_BOUNDS = {
    "DS_mu": (-12.0, -3.0), "DS_sigma": (0.0, 3.0), "r_DS": (EPS, 20.0), "num_clusters": (1.0, 100.0),
    "num_rays": (1.0, 1000.0), "LNS_ksi": (EPS, 50.0), "KF_mu": (-50.0, 50.0), "KF_sigma": (0.0, 50.0),
    "doppler_hz": (0.0, 1e6),
}
SOURCES = ["predicted", "module2_calibrated", "scenario_config", "versioned_default"]


def rms(e: Column) -> Column:
    return F.sqrt(F.avg(e * e))


def with_z_error(fc: DataFrame, norm: DataFrame) -> DataFrame:
    joined = bounded_join(fc, norm.select(D, "param", "std"), [D, "param"])
    return joined.withColumn("err", F.col("predicted") - F.col("truth")).withColumn(
        "z_err", F.col("err") / F.col("std"))


def metric_bundle(scored: DataFrame) -> DataFrame:
    """Normalized RMSE overall and per parameter, raw RMSE per parameter."""
    sets = [[D, "model", "param"], [D, "model"]]
    return scored.groupingSets(sets, D, "model", "param").agg(
        F.count(F.lit(1)).alias("n"), rms(F.col("z_err")).alias("normalized_rmse"), rms(F.col("err")).alias("_raw")
    ).withColumn("raw_rmse", F.when(F.col("param").isNotNull(), F.col("_raw"))).drop("_raw")


def error_sums(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Row count and squared error per key; sums of coarser keys follow from them."""
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("z_err") ** 2).alias("sse"))


def score_of(sums: DataFrame, keys: list[str]) -> DataFrame:
    return sums.groupBy(*keys).agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("nrmse"))


def group_scores(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(rms(F.col("z_err")).alias("nrmse"))


def rmse_and_range(fc: DataFrame, keys: list[str]) -> DataFrame:
    span = F.nullif(F.max("truth") - F.min("truth"), F.lit(0.0))
    return fc.groupBy(*keys).agg(
        rms(F.col("predicted") - F.col("truth")).alias("rmse"), span.alias("_span")
    ).withColumn("nrmse_percent", F.col("rmse") / F.col("_span") * 100).drop("_span")


def block_rmse(fc: DataFrame, pos: str, extra: list[str] | None = None) -> DataFrame:
    """RMSE of consecutive blocks of max(1, floor(n/10)) samples; the rest is dropped."""
    n = fc.groupBy(D).agg(F.max(pos).alias("n"))
    size = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    rows = bounded_join(fc, n, [D]).withColumn("block", F.floor((F.col(pos) - 1) / size)).filter(
        F.col("block") < F.floor(F.col("n") / size))
    return rows.groupBy(D, *(extra or []), "block").agg(rms(F.col("predicted") - F.col("truth")).alias("rmse"))


def worst_block_profile(fc: DataFrame, pos: str, feature: str, extra: list[str] | None = None) -> DataFrame:
    """Mean profile of truth and prediction over the block with the largest RMSE."""
    keys = [D, *(extra or [])]
    blocks = block_rmse(fc, pos, extra)
    worst = blocks.groupBy(*keys).agg(F.max_by("block", F.struct("rmse", -F.col("block"))).alias("worst"))
    n = fc.groupBy(D).agg(F.max(pos).alias("n"))
    size = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    rows = bounded_join(bounded_join(fc, n, [D]), worst, keys).filter(
        F.floor((F.col(pos) - 1) / size) == F.col("worst"))
    mean_db = lambda c: db_eps(F.avg(F.pow(F.lit(10.0), F.col(c) / 10)))
    return rows.groupBy(*keys, "worst", feature).agg(
        mean_db("truth").alias("truth_db"), mean_db("predicted").alias("predicted_db"))


def capacity(fc: DataFrame, snapshot: str, bandwidth_hz: float, noise_dbm: list[float] | None = None) -> DataFrame:
    """Mean capacity of truth and prediction, SNR and accuracy per noise level."""
    per = fc.groupBy(D, snapshot).agg(
        F.avg(dbm_to_watts("predicted")).alias("wp"), F.avg(dbm_to_watts("truth")).alias("wo"))
    levels = F.explode(F.array(*[F.lit(float(x)) for x in (noise_dbm or NOISE_DBM)])).alias("noise_dbm")
    grid = per.select(D, "wp", "wo", levels).withColumn("nw", dbm_to_watts("noise_dbm"))
    bits = lambda c: F.avg(F.lit(bandwidth_hz) * F.log2(1 + F.col(c) / F.col("nw"))) / 1e9
    rows = grid.groupBy(D, "noise_dbm").agg(
        bits("wp").alias("c_pred"), bits("wo").alias("c_truth"),
        (10 * F.log10(F.avg("wo") / F.first("nw"))).alias("snr_db"))
    gap = F.abs(F.col("c_pred") - F.col("c_truth")) / F.col("c_truth")
    acc = rows.groupBy(D).agg((F.greatest(F.lit(0.0), 1 - F.avg(gap)) * 100).alias("accuracy_percent"))
    return rows.join(acc, D)


def profile_spreads(fc: DataFrame, snapshot: str, feature: str, bandwidth_hz: float) -> DataFrame:
    """Delay spread in ns of truth and prediction per snapshot."""
    x, dt = F.col(feature).cast("double"), 1e9 / bandwidth_hz

    def spread(c: str) -> Column:
        w = dbm_to_watts(c)
        mean = F.sum(x * w) / F.sum(w)
        return F.sqrt(F.greatest(F.sum(x * x * w) / F.sum(w) - mean * mean, F.lit(0.0))) * dt

    return fc.groupBy(D, snapshot).agg(spread("predicted").alias("tau_pred"), spread("truth").alias("tau_truth"))


def spread_moments(spreads: DataFrame) -> DataFrame:
    return spreads.groupBy(D).agg(
        F.avg("tau_pred").alias("mu_pred"), F.stddev_samp("tau_pred").alias("sd_pred"),
        F.avg("tau_truth").alias("mu_truth"), F.stddev_samp("tau_truth").alias("sd_truth"),
        F.least(F.min("tau_pred"), F.min("tau_truth")).alias("lo"),
        F.greatest(F.max("tau_pred"), F.max("tau_truth")).alias("hi"))


ERF_TERMS = 120


def erf(x: Column) -> Column:
    """Error function by its series of positive terms, nested; beyond 6 it is one to double precision."""
    x = F.greatest(F.least(x, F.lit(6.0)), F.lit(-6.0))
    nested = F.aggregate(F.sequence(F.lit(ERF_TERMS), F.lit(1)), F.lit(1.0), lambda acc, n: 1 + acc * 2 * x * x / (2 * n + 1))
    return F.lit(2 / math.sqrt(math.pi)) * x * F.exp(-x * x) * nested


def gaussian_spread_cdf(moments: DataFrame, points: int = 1000) -> DataFrame:
    """Gaussian approximation of both spread distributions on one grid."""
    k = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")
    grid = moments.select("*", k).withColumn(
        "x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / F.lit(points - 1))
    cdf = lambda mu, sd: 0.5 * (1 + erf((F.col("x") - F.col(mu)) / (
        F.greatest(F.coalesce(F.col(sd), F.lit(0.0)), F.lit(1e-6)) * F.sqrt(F.lit(2.0)))))
    return grid.select(D, "k", "x", cdf("mu_pred", "sd_pred").alias("f_pred"), cdf("mu_truth", "sd_truth").alias("f_truth"))


# ---- model choice ----------------------------------------------------------

def accept_if_improved(scores: DataFrame, base: str, candidate: str, threshold: float) -> DataFrame:
    gain = (F.col(base) - F.col(candidate)) / F.greatest(F.col(base), F.lit(EPS))
    ok = gain >= threshold
    return scores.withColumn("relative_improvement", gain).withColumn("accepted", ok).withColumn(
        "status", F.when(ok, "accepted").otherwise("rolled_back")).withColumn(
        "reason", F.when(ok, "validation_improved").otherwise("minimum_validation_improvement_not_met"))


def best_model(scores: DataFrame, keys: list[str], score: str = "nrmse") -> DataFrame:
    order = F.struct(F.col(score), F.col("model"))
    return scores.groupBy(*keys).agg(F.min_by("model", order).alias("model"), F.min(score).alias(score))


def pick_model(scores: DataFrame, keys: list[str], mode: str = "auto", requested: str | None = None) -> DataFrame:
    """Automatic choice by the frozen score, or the requested model."""
    if mode == "auto":
        return best_model(scores, keys)
    if mode != "manual" or requested is None:
        raise ValueError("selection is auto, or manual with a model name")
    return scores.filter(F.col("model") == requested)


def seed_summary(seed_scores: DataFrame) -> DataFrame:
    return seed_scores.groupBy(D, "model").agg(
        F.count(F.lit(1)).alias("seeds"), F.avg("nrmse").alias("mean"), F.stddev_pop("nrmse").alias("std"),
        F.min_by("seed", F.struct("nrmse", "seed")).alias("best_seed"))


def qualification(sums: DataFrame, baselines: list[str], min_gain: float = 0.10,
                  min_wins: float = 0.60, max_ratio: float = 2.0) -> DataFrame:
    """Candidates against the best baseline: gain, group win rate, worst ratio, verdict.

    `sums` are the validation error sums per (dataset, model, group) and, where
    models have several runs, seed. Scores are averaged over seeds, overall and
    per group. The best baseline is the least of a struct in the aggregate that
    also gathers the models' scores, so nothing is joined back to choose it. The
    sums are kept, so the forecasts are read once.
    """
    sums = sums.persist()
    runs = [D, "model", *(["seed"] if "seed" in sums.columns else [])]
    score = F.struct("nrmse", "model")
    models = score_of(sums, runs).groupBy(D, "model").agg(F.avg("nrmse").alias("nrmse"))
    chosen = models.groupBy(D).agg(
        F.min(F.when(F.col("model").isin(baselines), score)).alias("_base"),
        F.collect_list(F.when(~F.col("model").isin(baselines), score)).alias("_models"))  # one entry per model
    by_group = score_of(sums, [*runs, "group_id"]).groupBy(D, "group_id", "model").agg(F.avg("nrmse").alias("nrmse"))
    of_group = by_group.groupBy(D, "group_id").agg(F.map_from_entries(F.collect_list(F.struct("model", "nrmse"))).alias("_of"))
    rated = bounded_join(of_group, chosen, [D]).withColumn("_m", F.explode("_models"))
    mine, theirs = F.try_element_at("_of", F.col("_m.model")), F.try_element_at("_of", F.col("_base.model"))
    ratio = mine / F.greatest(theirs, F.lit(1e-12))
    out = rated.groupBy(D, F.col("_m.model").alias("model"), F.col("_m.nrmse").alias("nrmse"),
                        F.col("_base.model").alias("baseline"), F.col("_base.nrmse").alias("base_score")).agg(
        F.avg((ratio < 1).cast("double")).alias("win_rate"), F.max(ratio).alias("worst_ratio"))
    gain = 1 - F.col("nrmse") / F.greatest(F.col("base_score"), F.lit(1e-12))
    passed = (gain >= min_gain) & (F.col("win_rate") >= min_wins) & (F.col("worst_ratio") <= max_ratio)
    return out.withColumn("improvement", gain).withColumn("passed", passed)


def selected_model(qualified: DataFrame) -> DataFrame:
    """Best passing candidate, else the baseline."""
    best = F.min_by("model", F.struct(F.when(F.col("passed"), F.col("nrmse")).otherwise(float("inf")), F.col("model")))
    any_pass = F.bool_or("passed")
    return qualified.groupBy(D).agg(
        F.when(any_pass, best).otherwise(F.first("baseline")).alias("selected"),
        F.when(any_pass, "qualified_candidate").otherwise("baseline_fallback").alias("reason"))


# ---- pairs -----------------------------------------------------------------

def pair_table(truth: DataFrame, predicted: DataFrame, params: list[str], integer: list[str]) -> DataFrame:
    """One row per (group, example, step) with truth_* and predicted_* columns.

    Integer parameters round half to even.
    """
    def wide(df: DataFrame, prefix: str) -> DataFrame:
        def value(p: str) -> Column:
            v = F.max(F.when(F.col("param") == p, F.col("value")))
            return (F.bround(v) if p in integer else v).alias(f"{prefix}_{p}")
        return df.groupBy(D, "group_id", "start_idx", "step", "idx").agg(*[value(p) for p in params])
    return wide(truth, "truth").join(wide(predicted, "predicted"), [D, "group_id", "start_idx", "step", "idx"])


PAIR_KEYS = [D, "group_id", "start_idx", "step", "idx"]


def pair_sides(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row per key of either side with in_truth and in_predicted, from one aggregate of both."""
    sides = [rows.select(*PAIR_KEYS, F.lit(a).alias("a"), F.lit(b).alias("b")) for rows, a, b in ((truth, True, False), (predicted, False, True))]
    return sides[0].unionByName(sides[1]).groupBy(*PAIR_KEYS).agg(F.bool_or("a").alias("in_truth"), F.bool_or("b").alias("in_predicted"))


def misaligned(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Keys that only one side has; empty when the sides align."""
    return pair_sides(truth, predicted).filter("in_truth <> in_predicted").select(
        *PAIR_KEYS, F.when(F.col("in_truth"), "truth").otherwise("predicted").alias("side"))


def first_per_group(rows: DataFrame, group: str, order: list[str], n: int | None = None) -> DataFrame:
    """First row of each group in stable order, optionally the first n groups."""
    columns = [c for c in rows.columns if c not in order]
    row = F.min(F.struct(*order, *columns)).alias("r")
    firsts = rows.groupBy(F.col(group).alias("_g")).agg(row).select("r.*")
    return firsts if n is None else firsts.orderBy(*order).limit(n)


# ---- parameter resolution --------------------------------------------------

def resolve_parameters(targets: DataFrame, predicted: DataFrame, calibrated: DataFrame, scenario: DataFrame,
                       defaults: dict[str, float], versions: dict[str, str]) -> DataFrame:
    """Predicted, else calibrated, else scenario, else default, with source and checks.

    `targets` has `target`; `predicted` has (target, param, value); the other
    two have (param, value) and hold at most one row per parameter.
    """
    lo_hi = {p: RESOLVER_BOUNDS[p] for p in RESOLVED_PARAMETERS}
    names = F.explode(F.array(*[F.struct(
        F.lit(p).alias("param"), F.lit(defaults.get(p)).cast("double").alias("fallback"),
        F.lit(lo_hi[p][0]).alias("lo"), F.lit(lo_hi[p][1]).alias("hi")) for p in RESOLVED_PARAMETERS])).alias("v")
    grid = targets.select("target", names).select("target", "v.*")
    joined = grid.join(predicted.select("target", "param", F.col("value").alias("p1")), ["target", "param"], "left")
    for name, source in (("p2", calibrated), ("p3", scenario)):
        joined = bounded_join(joined, source.select("param", F.col("value").alias(name)), ["param"], "left")
    ranked = [("p1", SOURCES[0]), ("p2", SOURCES[1]), ("p3", SOURCES[2]), ("fallback", SOURCES[3])]
    usable = [F.when(F.col(c).isNotNull() if c == "p1" else is_finite(c), F.col(c)) for c, _ in ranked]
    source = F.coalesce(*[F.when(u.isNotNull(), F.lit(s)) for u, (_, s) in zip(usable, ranked)])
    value = F.coalesce(*usable)
    table = F.create_map(*[F.lit(x) for kv in versions.items() for x in kv])
    return joined.withColumn("value", value).withColumn("source", source).select(
        "target", "param", "value", "source", F.coalesce(F.try_element_at(table, "source"), F.lit("unspecified")).alias("source_version"),
        (is_finite("value") & F.col("value").between(F.col("lo"), F.col("hi"))).alias("in_bounds"),
        (~F.col("param").isin("num_clusters", "num_rays") | (F.floor("value") == F.col("value"))).alias("integer_ok"))


def source_counts(resolved: DataFrame) -> DataFrame:
    return resolved.agg(*[F.count_if(F.col("source") == s).alias(s) for s in SOURCES])


# ---- end-to-end scores -----------------------------------------------------

def profile_pair_scores(truth: DataFrame, generated: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """PDP NRMSE, RMS delay error and overflow shares of two frozen-grid feature tables."""
    side = lambda df, s: df.select(*keys, "bin", F.col("pdp").alias(f"pdp_{s}"), F.col("rms_delay_s").alias(f"rms_{s}"),
                                   F.col("overflow_fraction").alias(f"over_{s}"))
    j = side(truth, "t").join(side(generated, "g"), [*keys, "bin"], "full_outer")
    a, b = F.coalesce("pdp_t", F.lit(0.0)), F.coalesce("pdp_g", F.lit(0.0))
    n = F.lit(float(bins + 1))
    s = j.groupBy(*keys).agg(
        (F.sqrt(F.sum((a - b) ** 2) / n) / F.greatest(F.sqrt(F.sum(a * a) / n), F.lit(EPS))).alias("pdp_nrmse"),
        F.max("rms_t").alias("rms_t"), F.max("rms_g").alias("rms_g"),
        F.max("over_t").alias("truth_overflow"), F.max("over_g").alias("generated_overflow"))
    both = s.filter("rms_t IS NOT NULL AND rms_g IS NOT NULL")
    return both.withColumn("rms_delay_abs_error_s", F.abs(F.col("rms_t") - F.col("rms_g"))).drop("rms_t", "rms_g")


def parameter_nrmse(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """RMS error over parameters relative to the RMS of the truth."""
    e = F.col("truth") - F.col("predicted")
    return pairs.groupBy(*keys).agg(
        (F.sqrt(F.avg(e * e)) / F.greatest(F.sqrt(F.avg(F.col("truth") ** 2)), F.lit(EPS))).alias("parameter_nrmse"))


def bundle_summary(rows: DataFrame, scores: list[str]) -> DataFrame:
    """Group count and mean scores per dataset, task and bundle."""
    return rows.groupBy(D, "task", "bundle").agg(F.count(F.lit(1)).alias("group_count"),
                                              *[F.avg(s).alias(f"mean_{s}") for s in scores])


def smallest_good_bundle(summary: DataFrame, score: str, tolerance: float = 0.05) -> DataFrame:
    """Smallest bundle within the tolerance of the best score, per dataset and task."""
    best = summary.groupBy(D, "task").agg(F.min(score).alias("best"))
    rank = F.substring("bundle", 2, 9).cast("int")
    ok = summary.join(best, [D, "task"]).filter(F.col(score) <= F.col("best") * (1 + tolerance))
    return ok.groupBy(D, "task").agg(
        F.min_by("bundle", rank).alias("selected_bundle"), F.first("best").alias("best_score"),
        F.min_by(score, rank).alias("selected_score"))


def selected_files(files: DataFrame, decisions: DataFrame) -> DataFrame:
    """Files of the selected (task, bundle); anything but one file is an error row."""
    hits = decisions.join(files, ["task", "bundle"], "left").groupBy("task", "bundle").agg(
        F.count("path").alias("matches"), F.min("path").alias("path"))
    return hits.withColumn("ok", F.col("matches") == 1)


def narrowband_fallback(summary: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Default parameters for narrowband datasets with their known mean power.

    The reference power field is read here, so the known power is reported.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("param"), F.lit(float(v)).alias("value"))
                                for k, v in defaults.items()])).alias("v")
    ok = summary.filter(F.col("classification") == "narrowband_static_siso")
    return ok.select(D, "mean_power", F.lit("capability_defaults").alias("strategy"),
                     F.lit("NARROWBAND_PDP_NOT_IDENTIFIABLE").alias("reason_code"), pairs).select(
        D, "mean_power", "strategy", "reason_code", "v.param", "v.value")
