"""Forecast baselines over supervised examples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import D, LAYOUT

# Parameters per task and their display units.
CALIBRATED_PARAMETERS = {
    "extrapolation": ["DS_mu", "KF_mu", "DS_sigma", "KF_sigma", "r_DS", "LNS_ksi"],
    "interpolation": ["DS_mu", "KF_mu", "DS_sigma", "KF_sigma", "r_DS", "LNS_ksi", "num_clusters", "num_rays"],
}
DISPLAY_UNITS = {
    "DS_mu": "log10(s)", "DS_sigma": "log10(s)", "KF_mu": "dB", "KF_sigma": "dB", "LNS_ksi": "dB",
    "r_DS": "ratio", "num_clusters": "count", "num_rays": "count",
}


def baseline_weights(model: str, task: str) -> list[list[float]]:
    """Weights [target][input]; both baselines are linear in the inputs."""
    left, right, target = LAYOUT[task]
    n = left + right
    if model == "persistence":
        w = np.zeros((target, n))
        if task == "extrapolation":
            w[:, n - 1] = 1.0
        else:
            w[:, left - 1] = w[:, left] = 0.5
        return w.tolist()
    if model == "linear":
        known = np.concatenate([np.arange(left), left + target + np.arange(right)]).astype(float)
        at = left + np.arange(target)
        centred = known - known.mean()
        slope = centred / np.sum(centred**2)
        return (1.0 / n + np.outer(at - known.mean(), slope)).tolist()
    if model == "blend":  # mean of the two baselines
        pair = [np.array(baseline_weights(m, task)) for m in ("persistence", "linear")]
        return (sum(pair) / 2).tolist()
    raise ValueError(f"unknown baseline {model}")


def forecast(ex: DataFrame, params: list[str], task: str,
             models: tuple[str, ...] = ("persistence", "linear")) -> DataFrame:
    """Long truth/prediction rows: one per example, step, parameter and model.

    The prediction is a fixed-weight sum over the input array, so it runs in
    the projection that unpacks the example; nothing shuffles.
    """
    def predict(model: str, p: str):
        # Plain arithmetic over the input cells compiles; zero weights are left out.
        sums = [" + ".join(f"inputs[{i}].`{p}` * {w!r}D" for i, w in enumerate(row) if w != 0.0)
                for row in baseline_weights(model, task)]
        return F.expr(f"array({', '.join(sums)})")

    series = [
        F.struct(F.lit(m).alias("model"), F.lit(p).alias("param"), predict(m, p).alias("predicted"),
                 F.transform("targets", lambda c: c[p].cast("double")).alias("truth"))
        for m in models for p in params
    ]
    flat = ex.select(D, "group_id", "start_idx", F.col("targets.idx").alias("idx"), F.explode(F.array(*series)).alias("s"))
    cells = F.posexplode(F.arrays_zip(F.col("idx"), F.col("s.truth"), F.col("s.predicted"))).alias("step", "c")
    return flat.select(D, "group_id", "start_idx", "s.model", "s.param", cells).select(
        D, "group_id", "start_idx", "step", F.col("c.idx").alias("idx"), "param",
        F.col("c.truth").alias("truth"), F.col("c.predicted").alias("predicted"), "model")


def calibrated_persistence(targets: DataFrame, calibrated: DataFrame, defaults: dict[str, float],
                           task: str) -> DataFrame:
    """Constant forecast per target index: calibrated value, else default.

    `calibrated` has one row per (dataset, parameter) at most.
    """
    names = CALIBRATED_PARAMETERS[task]
    missing = [p for p in names if p not in defaults]
    if missing:
        raise ValueError(f"no default for {missing}")
    pairs = F.explode(F.array(*[
        F.struct(F.lit(p).alias("param"), F.lit(float(defaults[p])).alias("fallback"), F.lit(DISPLAY_UNITS[p]).alias("unit"))
        for p in names]))
    grid = targets.select("*", pairs.alias("v")).select(*targets.columns, "v.param", "v.fallback", "v.unit")
    from .ordering import bounded_join
    joined = bounded_join(grid, calibrated.select(D, "param", F.col("value").alias("_cal")), [D, "param"], "left")
    return joined.withColumn("predicted", F.coalesce("_cal", "fallback")).withColumn(
        "origin", F.when(F.col("_cal").isNotNull(), "calibrated").otherwise("default")).drop("_cal", "fallback")
