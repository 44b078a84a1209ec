"""Data rules, capability flags and task rules as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_finite
from ..sources.bundles import shared_copy
from .blocks import quantiles
from .ordering import lagged, positions

D = "dataset_id"

# Metric ids in display order, standard sets per class, units.
METRICS = [
    "power", "pdp", "frequency_autocorrelation", "delay_spread_cdf", "angular_power_spectrum",
    "spatial_correlation", "angular_spread_cdf", "doppler_power_spectrum", "time_autocorrelation",
    "doppler_spread_cdf", "delay_sample_heatmap",
]
STANDARD_COUNT = {
    "narrowband_static_siso": 1,
    "wideband_static_siso": 3,
    "wideband_static_mimo": 6,
    "wideband_dynamic_mimo": 9,
}
ADDITIONAL = {"delay_sample_heatmap"}
# What a capability or a metric says, word for word.
CAPABILITY_REASONS = {
    "frequency": ("Frequency axis is available.", "Need Nf > 1 plus frequency_hz or center/subcarrier spacing."),
    "time": ("Continuous time information is available.", "Need Nt > 1 plus time_s or snapshot_interval_s."),
    "angle": ("Path angles or explicit ULA geometry are available.",
              "Need CIR aoa_rad/aod_rad or explicit ULA geometry for angle-domain plots."),
    "sample": ("Multiple samples are available.", "Need N_sample > 1 for an empirical distribution."),
    "order": ("Samples have declared physical order.",
              "Heatmaps need ordered sample semantics, not independent samples."),
}
NO_DELAY = "Need more than one valid path/tap and a physical delay definition."
NO_CDF = "An empirical CDF requires at least two samples."
NO_ARRAY = "Dimension-based angle plots require Tx > 1 or Rx > 1."
NO_ANGLE = "Need explicit AoA/AoD or a complex array response with ULA geometry."
NO_SPREAD = "Angular spread needs explicit path angles or valid beamspace spectra."
NO_SPREAD_CDF = "Angular spread CDF requires at least two finite samples."
NO_CORRELATION_ARRAY = "Spatial correlation requires Tx > 1 or Rx > 1."
NO_CORRELATION = "Spatial correlation requires at least two channel observations."
NO_HEATMAP_SAMPLES = "Heatmap requires N_sample > 1."
NO_HEATMAP_ORDER = "Heatmap requires declared ordered sample semantics."
UNITS = {"frequency": "Hz", "time": "s", "delay": "s", "position": "m", "angle": "rad", "power": "linear"}
ORDERED_SEMANTICS = ["ordered_route", "ordered_time", "ordered_frequency", "other_ordered"]
SEMANTICS = ["independent", *ORDERED_SEMANTICS]


def standard_metrics(classification: str) -> list[str]:
    if classification == "narrowband_static_siso":
        return ["power"]
    return METRICS[1:1 + STANDARD_COUNT.get(classification, 0)]


def axis_counts(cir: DataFrame, **facts: Column) -> DataFrame:
    """Number of values on each axis of each dataset, with additive facts.

    One pass over the rows: the combinations of the short axes and the samples
    are two grouping sets, which the map side reduces, so no row is copied once
    per axis. `facts` are counts; they are added up.
    """
    axes = ["tx", "rx", "path", "t"]
    cells = cir.groupingSets([[D, *axes], [D, "sample"]], D, *axes, "sample").agg(
        (F.grouping("sample") == 0).alias("_is_sample"), F.count(F.lit(1)).alias("rows"), *[f.alias(n) for n, f in facts.items()])
    once = lambda n: F.sum(F.when(~F.col("_is_sample"), F.col(n))).alias(n)
    return cells.groupBy(D).agg(
        *[F.countDistinct(F.when(~F.col("_is_sample"), F.col(c))).alias(f"n_{c}") for c in axes],
        once("rows"), *[once(n) for n in facts], F.count_if("_is_sample").alias("n_sample"))


def dataset_summary(cir: DataFrame) -> DataFrame:
    """Dimensions and content flags per dataset."""
    angled = F.col("aoa_rad").isNotNull() | F.col("aod_rad").isNotNull()
    s = axis_counts(cir, valid_rows=F.count_if("path_valid"), angled=F.count_if(angled))
    return s.withColumn("has_angles", F.col("angled") > 0).drop("angled")


def angular_source(summary: DataFrame) -> DataFrame:
    """Path angles first, else beamspace with a ULA and a carrier, else none."""
    array = (F.col("n_tx") > 1) | (F.col("n_rx") > 1)
    ula = (F.col("element_spacing_m") > 0) & (F.col("center_hz") > 0)
    return summary.withColumn(
        "source", F.when(~array, "none").when(F.col("has_angles"), "path_angles")
        .when(F.coalesce(ula, F.lit(False)), "beamspace").otherwise("none"))


def axis_steps(axis: DataFrame, keys: list[str], x: str, order: str) -> DataFrame:
    """Axis rows with the previous value in `_prev`."""
    ranked = positions(axis, keys, [order], order, "_pos")
    return lagged(ranked, keys, "_pos", {"_prev": x})


def axis_rules(axis: DataFrame, keys: list[str], x: str, order: str) -> DataFrame:
    """Length, non-finite values and steps that do not increase."""
    return axis_steps(axis, keys, x, order).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~is_finite(x)).alias("non_finite"),
        F.count_if(F.col(x) <= F.col("_prev")).alias("not_increasing"))


def uniform_spacing(axis: DataFrame, keys: list[str], x: str, order: str) -> DataFrame:
    """Median step and whether every step equals it within max(1e-6*step, eps)."""
    steps = axis_steps(axis, keys, x, order).withColumn("_step", F.col(x) - F.col("_prev"))
    q = quantiles(steps.filter("_step IS NOT NULL"), "_step", keys, [0.5]).select(*keys, F.col("q").alias("spacing"))
    facts = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(x)).alias("_top"), F.min("_step").alias("_lo"),
        F.max("_step").alias("_hi"), F.bool_and(is_finite(x)).alias("_finite"))
    step = F.col("spacing")
    ulp = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest("_top", F.lit(1e-300)))) - 52)
    tolerance = F.greatest(F.abs(step) * 1e-6, ulp)
    fits = F.greatest(F.abs(F.col("_lo") - step), F.abs(F.col("_hi") - step)) <= tolerance
    return facts.join(q, keys, "left").select(
        *keys, "n", "spacing",
        F.coalesce(F.col("_finite") & (F.col("_lo") > 0) & fits, F.lit(False)).alias("uniform"))


def classify(has_wideband, has_time, has_array):
    """One of six dataset classes."""
    return (
        F.when(~has_wideband & ~has_time & ~has_array, "narrowband_static_siso")
        .when(has_wideband & ~has_time & ~has_array, "wideband_static_siso")
        .when(has_wideband & ~has_time & has_array, "wideband_static_mimo")
        .when(has_wideband & has_time & has_array, "wideband_dynamic_mimo")
        .when(has_time, "dynamic_channel").otherwise("other_channel")
    )


# ---- dataset rules ---------------------------------------------------------

def report(facts: DataFrame, keys: list[str], errors: list[str], warnings: list[str]) -> DataFrame:
    """Unpivot violation counts to (rule, violations, severity), one row per rule and key."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(r).cast("long").alias("violations"), F.lit(s).alias("severity"))
        for s, names in (("error", errors), ("warning", warnings)) for r in names]))
    return facts.select(*keys, rows.alias("r")).select(*keys, "r.*")


def overall_status(rules: DataFrame, keys: list[str]) -> DataFrame:
    """FAIL with any broken error rule, WARNING with any broken warning rule, else PASS."""
    broken = F.col("violations") > 0
    fail = F.bool_or(broken & (F.col("severity") == "error"))
    warn = F.bool_or(broken & (F.col("severity") == "warning"))
    return rules.groupBy(*keys).agg(F.when(fail, "FAIL").when(warn, "WARNING").otherwise("PASS").alias("status"))


CIR_ERRORS = ["no_valid_path", "non_finite_coefficient", "bad_delay", "tx_mismatch", "rx_mismatch", "path_mismatch",
              "time_mismatch", "sample_mismatch", "wrong_unit", "unknown_semantics"]
CIR_WARNINGS = ["real_valued", "source_unspecified", "time_axis_missing", "sample_index_missing", "position_missing"]


def cir_rules(cir: DataFrame, metadata: DataFrame) -> DataFrame:
    """All path-table rules in one pass over the rows.

    `metadata` has one row per dataset: declared n_tx, n_rx, n_path, n_t,
    n_sample, units (map), source, sample_semantics, has_time_axis,
    has_sample_index, has_position.
    """
    valid = F.col("path_valid")
    facts = axis_counts(
        cir, v=F.count_if(valid), nf=F.count_if(valid & ~(is_finite("re") & is_finite("im"))),
        bd=F.count_if(valid & ~(is_finite("delay_s") & (F.col("delay_s") >= 0))), complex=F.count_if(F.col("im") != 0))
    facts = facts.withColumnsRenamed({f"n_{c}": f"c_{c}" for c in ("tx", "rx", "path", "t", "sample")})
    m = facts.join(metadata, D)
    unit_errors = sum((F.coalesce(F.try_element_at("units", F.lit(k)) != v, F.lit(True)).cast("int") for k, v in UNITS.items()), F.lit(0))
    text = F.lower(F.trim(F.coalesce("source", F.lit(""))))
    semantics = F.lower(F.coalesce("sample_semantics", F.lit("independent")))
    counts = m.select(
        D, (F.col("v") == 0).cast("int").alias("no_valid_path"), F.col("nf").alias("non_finite_coefficient"),
        F.col("bd").alias("bad_delay"),
        *[(F.col(f"c_{c}") != F.col(d)).cast("int").alias(r) for c, d, r in (
            ("tx", "n_tx", "tx_mismatch"), ("rx", "n_rx", "rx_mismatch"), ("path", "n_path", "path_mismatch"),
            ("t", "n_t", "time_mismatch"), ("sample", "n_sample", "sample_mismatch"))],
        unit_errors.alias("wrong_unit"), (~semantics.isin(SEMANTICS)).cast("int").alias("unknown_semantics"),
        (F.col("complex") == 0).cast("int").alias("real_valued"),
        text.isin("", "unknown", "unspecified").cast("int").alias("source_unspecified"),
        ((F.col("c_t") > 1) & ~F.col("has_time_axis")).cast("int").alias("time_axis_missing"),
        (~F.col("has_sample_index")).cast("int").alias("sample_index_missing"),
        ((semantics == "ordered_route") & ~F.col("has_position")).cast("int").alias("position_missing"))
    return report(counts, [D], CIR_ERRORS, CIR_WARNINGS)


# ---- capabilities ----------------------------------------------------------

def capabilities(datasets: DataFrame) -> DataFrame:
    """Capability flags, class and reasons per dataset; the has_* columns are what the flags are made of.

    Needs domain, n_tx, n_rx, n_f, n_path, n_t, n_sample, has_frequency_axis,
    has_time_axis, has_angles, tx_ula, rx_ula, sample_semantics.
    """
    c = F.col
    array = (c("n_tx") > 1) | (c("n_rx") > 1)
    frequency = (c("n_f") > 1) & c("has_frequency_axis")
    time = (c("n_t") > 1) & c("has_time_axis")
    many = c("n_sample") > 1
    ordered = many & F.lower("sample_semantics").isin(ORDERED_SEMANTICS)
    paths = (c("domain") == "cir") & (c("n_path") > 1)
    geometry = ((c("n_tx") > 1) & c("tx_ula")) | ((c("n_rx") > 1) & c("rx_ula"))
    angle = ((c("domain") == "cir") & c("has_angles")) | (array & geometry & ((c("n_f") > 1) | paths))
    wide = frequency | paths
    flags = {
        "power": F.lit(True), "pdp": wide, "frequency_autocorrelation": frequency, "delay_spread_cdf": wide & many,
        "angular_power_spectrum": array & angle, "spatial_correlation": array & (c("n_t") * c("n_sample") > 1),
        "angular_spread_cdf": array & angle & many, "doppler_power_spectrum": time, "time_autocorrelation": time,
        "doppler_spread_cdf": time & many, "delay_sample_heatmap": wide & ordered,
    }
    out = datasets.withColumns({**flags, "classification": classify(wide, time, array),
                                "cdf_minimum_met": c("n_sample") >= 2, "cdf_recommended_met": c("n_sample") >= 20})
    states = {"frequency": frequency, "time": time, "angle": angle, "sample": many, "order": ordered}
    said = {f"{n}_reason": F.when(ok, CAPABILITY_REASONS[n][0]).otherwise(CAPABILITY_REASONS[n][1]) for n, ok in states.items()}
    return out.withColumns({**said, "has_wideband": wide, "has_array": array, "has_angle": angle, "has_time": time,
                            "has_samples": many, "has_order": ordered})


def _why_not() -> dict[str, Column]:
    """What each metric lacks first, from the columns of `capabilities`; null where it lacks nothing."""
    lacks = lambda flag, text: F.when(~F.col(flag), text)
    delay, array, time = lacks("has_wideband", NO_DELAY), lacks("has_array", NO_ARRAY), lacks("has_time", CAPABILITY_REASONS["time"][1])
    return {
        "power": F.lit(None).cast("string"), "pdp": delay,
        "frequency_autocorrelation": lacks("frequency_autocorrelation", CAPABILITY_REASONS["frequency"][1]),
        "delay_spread_cdf": F.coalesce(delay, lacks("has_samples", NO_CDF)),
        "angular_power_spectrum": F.coalesce(array, lacks("has_angle", NO_ANGLE)),
        "spatial_correlation": F.coalesce(lacks("has_array", NO_CORRELATION_ARRAY), lacks("spatial_correlation", NO_CORRELATION)),
        "angular_spread_cdf": F.coalesce(lacks("angular_power_spectrum", NO_SPREAD), lacks("has_samples", NO_SPREAD_CDF)),
        "doppler_power_spectrum": time, "time_autocorrelation": time,
        "doppler_spread_cdf": F.coalesce(time, lacks("has_samples", NO_CDF)),
        "delay_sample_heatmap": F.coalesce(delay, lacks("has_samples", NO_HEATMAP_SAMPLES), lacks("has_order", NO_HEATMAP_ORDER)),
    }


def metric_status(caps: DataFrame) -> DataFrame:
    """Unpivot the flags: one row per dataset and metric, with what an unavailable metric lacks."""
    why = _why_not()
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("available"), F.coalesce(why[m], F.lit("")).alias("reason"))
                               for m in METRICS]))
    return caps.select(D, "classification", rows.alias("r")).select(D, "classification", "r.*")


def pair_capabilities(cir_caps: DataFrame, ctf_caps: DataFrame) -> DataFrame:
    """Union of the two domain reports of one channel with its ordered standard metrics."""
    f = ctf_caps.select(D, F.col("pdp").alias("_pdp"), F.col("frequency_autocorrelation").alias("_fac"),
                        F.col("time_autocorrelation").alias("_tac"), F.col("n_f").alias("_n_f"),
                        F.col("n_t").alias("_n_t"), F.col("n_tx").alias("_n_tx"), F.col("n_rx").alias("_n_rx"))
    j = cir_caps.drop("classification", "frequency_autocorrelation", "time_autocorrelation").join(f, D).withColumn(
        "pdp", F.col("pdp") | F.col("_pdp")).withColumn("frequency_autocorrelation", F.col("_fac")).withColumn(
        "time_autocorrelation", F.col("_tac"))
    label = classify(F.col("_n_f") > 1, F.col("_n_t") > 1, (F.col("_n_tx") > 1) | (F.col("_n_rx") > 1))
    label = F.when(label == "dynamic_channel", "other_channel").otherwise(label)
    wide = F.array_compact(F.array(*[F.when(F.col(m), m) for m in METRICS[1:10]]))
    plots = F.when(label == "narrowband_static_siso", F.array(F.lit("power"))).otherwise(wide)
    return j.select(D, label.alias("classification"), *METRICS, plots.alias("standard_metrics"),
                    F.size(plots).cast("long").alias("standard_metric_count"))


def metric_registry(status: DataFrame) -> DataFrame:
    """Metric status with the standard and additional marks and the counts per dataset."""
    cls = F.col("classification")
    standard = F.coalesce(*[F.when(cls == c, F.col("metric").isin(standard_metrics(c))) for c in STANDARD_COUNT], F.lit(False))
    marked = status.withColumn("is_standard", standard).withColumn(
        "is_additional", F.col("metric").isin(list(ADDITIONAL))).withColumn(
        "standard_class", cls.isin(list(STANDARD_COUNT)))
    counts = marked.groupBy(D).agg(
        F.count_if("available").alias("available_count"),
        F.count_if(F.col("available") & F.col("is_standard")).alias("available_standard"),
        F.count_if(F.col("available") & F.col("is_additional")).alias("available_additional"))
    return marked.join(counts, D)


def visible_metrics(registry: DataFrame) -> DataFrame:
    return registry.filter("available AND (is_standard OR is_additional OR NOT standard_class)")


CONTINUITY_REASON = ("Predicted targets were generated independently; cross-target route continuity is not "
                     "scientifically available.")


def apply_continuity(status: DataFrame, points: DataFrame, analysis_status, continuity: str):
    """Block the cross-target metric of independently generated targets.

    Gives the new metric status, the remaining points and the new analysis status.
    """
    if continuity != "independent_targets":
        return status, points, analysis_status
    live = analysis_status.select(D, F.col("status").alias("_s"))
    hit = (F.col("metric") == "delay_sample_heatmap") & (F.col("_s") != "FAIL")
    j = status.join(live, D)
    changed = j.withColumn("available", F.col("available") & ~hit).withColumn(
        "reason", F.when(hit, CONTINUITY_REASON).otherwise(F.col("reason"))).drop("_s")
    blocked = j.filter(hit).select(D, "metric")
    lower = analysis_status.withColumn("status", F.when(F.col("status") == "PASS", "WARNING").otherwise(F.col("status")))
    return changed, points.join(blocked, [D, "metric"], "left_anti"), lower


# ---- task rules ------------------------------------------------------------

def preset_task(axis: DataFrame, keys: list[str], pos: str, mode: str, unit: str = "index") -> DataFrame:
    """80/20 split of an axis: the target is the middle block or the tail."""
    n = axis.groupBy(*keys).agg(F.max(pos).alias("n"))
    least = 3 if mode == "interpolation" else 2
    if mode not in ("interpolation", "extrapolation"):
        raise ValueError("mode is interpolation or extrapolation")
    want = F.greatest(F.lit(1), F.round(F.col("n") * F.lit(0.20)))
    count = F.least(want, F.col("n") - (least - 1))
    start = F.floor((F.col("n") - count) / 2) + 1 if mode == "interpolation" else F.col("n") - count + 1
    p = F.col(pos)
    sized = n.filter(F.col("n") >= least).select(*keys, "n", start.alias("_a"), (start + count - 1).alias("_b"))
    from .ordering import bounded_join
    return bounded_join(axis, sized, keys).withColumn(
        "region", F.when((p >= F.col("_a")) & (p <= F.col("_b")), "target").otherwise("known")).withColumn(
        "mode", F.lit(mode)).withColumn("axis_unit", F.lit(unit)).drop("_a", "_b", "n")


def manual_task(lists: DataFrame, keys: list[str], item: str, order: str) -> DataFrame:
    """Index lists without repeats, in first-seen order."""
    firsts = lists.groupBy(*keys, item).agg(F.min(order).alias("first_seen"))
    return positions(firsts, keys, ["first_seen"], "first_seen", "place")


def task_rules(tasks: DataFrame, axis_length: DataFrame) -> DataFrame:
    """All task rules per task.

    `tasks` has task_id, mode, axis, region, idx; `axis_length` has task_id,
    n, n_f, n_t, has_position.
    """
    k, t = F.col("region") == "known", F.col("region") == "target"
    per_idx = shared_copy(tasks.groupBy("task_id", "mode", "axis", "idx").agg(F.count_if(k).alias("k"), F.count_if(t).alias("t")), "indices")  # read twice
    bad = ~is_finite("idx") | (F.col("idx") < 1) | (F.floor("idx") != F.col("idx"))
    facts = per_idx.groupBy("task_id", "mode", "axis").agg(
        (F.sum("k") == 0).cast("int").alias("no_known"), (F.sum("t") == 0).cast("int").alias("no_target"),
        F.count_if(bad).alias("not_positive_integer"), F.count_if(F.col("k") > 1).alias("duplicate_known"),
        F.count_if(F.col("t") > 1).alias("duplicate_target"),
        F.count_if((F.col("k") > 0) & (F.col("t") > 0)).alias("overlap"),
        F.min(F.when(F.col("k") > 0, F.col("idx"))).alias("lo"), F.max(F.when(F.col("k") > 0, F.col("idx"))).alias("hi"),
        F.max("idx").alias("top"))
    inside = per_idx.filter("t > 0").join(facts.select("task_id", "lo", "hi"), "task_id").groupBy("task_id").agg(
        F.count_if((F.col("idx") > F.col("lo")) & (F.col("idx") < F.col("hi"))).alias("inside"),
        F.count_if((F.col("idx") <= F.col("lo")) | (F.col("idx") >= F.col("hi"))).alias("outside"))
    j = facts.join(inside, "task_id", "left").join(axis_length, "task_id")
    simple = ["no_known", "no_target", "not_positive_integer", "duplicate_known", "duplicate_target", "overlap", "out_of_range"]
    j = j.withColumn("out_of_range", (F.col("top") > F.col("n")).cast("int"))
    clean = F.lit(True)
    for r in simple:
        clean = clean & (F.col(r) == 0)
    wrong = F.when(F.col("mode") == "interpolation", F.col("outside")).otherwise(F.col("inside"))
    j = j.withColumn("wrong_side", F.when(clean, F.coalesce(wrong, F.lit(0))).otherwise(0))
    needs = ((F.col("axis") == "frequency") & (F.col("n_f") <= 1)) | ((F.col("axis") == "time") & (F.col("n_t") <= 1)) | (
        (F.col("axis") == "position") & ~F.col("has_position"))
    j = j.withColumn("axis_requirement", needs.cast("int"))
    return report(j, ["task_id"], [*simple, "wrong_side", "axis_requirement"], [])


def parse_ranges(texts: DataFrame, keys: list[str], text: str, axis: DataFrame | None = None) -> DataFrame:
    """`0:30,40` to indices by axis value; a value without a match has a null idx.

    A malformed token raises. `axis` has keys, value and idx; without it the
    numbers are indices.
    """
    bad = F.raise_error(F.concat(F.lit("cannot parse range "), F.col("token"))).cast("array<double>")
    tokens = texts.select(*keys, F.posexplode(F.split(F.regexp_replace(text, "，", ","), ",")).alias("_at", "token")).withColumn(
        "token", F.trim("token"))
    ends = F.split("token", ":")
    first = F.trim(F.get(ends, F.lit(0))).try_cast("double")
    last = F.trim(F.get(ends, F.lit(1))).try_cast("double")
    n = F.size(ends)
    whole = (F.floor(first) == first) & (F.floor(last) == last) & (last >= first)
    numbers = F.when((n == 1) & first.isNotNull(), F.array(first)).when(
        (n == 2) & F.coalesce(whole, F.lit(False)),
        F.transform(F.sequence(first.cast("long"), last.cast("long")), lambda v: v.cast("double"))).otherwise(bad)
    values = tokens.select(*keys, "_at", F.posexplode(numbers).alias("_in", "value"))
    distinct = values.groupBy(*keys, "value").agg(F.min(F.struct("_at", "_in")).alias("seen"))
    if axis is None:
        return distinct.select(*keys, "value", "seen", F.col("value").cast("long").alias("idx"))
    return distinct.join(axis, [*keys, "value"], "left").select(*keys, "value", "seen", "idx")


def select_region(rows: DataFrame, task: DataFrame, axis: str, region: str = "known") -> DataFrame:
    """Rows whose axis index lies in the task region; `all` keeps everything."""
    if region == "all":
        return rows
    chosen = task.filter(F.col("region") == region).select(D, F.col("idx").alias(axis))
    return rows.join(chosen, [D, axis], "left_semi")


def combine_reports(stages: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Stage reports as one report with prefixed rules."""
    out = None
    for stage, rules in stages.items():
        part = rules.select(*keys, F.concat(F.lit(f"{stage}: "), F.col("rule")).alias("rule"), "violations", "severity")
        out = part if out is None else out.unionByName(part)
    return out


# ---- sequence and example rules --------------------------------------------

def sequence_rules(seq: DataFrame, params: list[str], bounds: dict[str, tuple[float, float]]) -> DataFrame:
    from .sequences import PARAMETERS
    if len(set(params)) != len(params) or any(p not in PARAMETERS for p in params):
        raise ValueError("parameter names must be supported and unique")
    if any(bounds[p][0] > bounds[p][1] for p in params):
        raise ValueError("every lower bound must not exceed its upper bound")
    failed = F.upper("quality_status") == "FAIL"
    finite, inside = F.lit(True), F.lit(True)
    for p in params:
        finite = finite & is_finite(p)
        inside = inside & F.col(p).between(*[F.lit(float(b)) for b in bounds[p]])
    facts = seq.groupBy(D).agg(
        F.count_if(~F.col("label_source").isin("generator_truth", "grid_fitted", "sa_fitted")).alias("unsupported_source"),
        F.count_if(~F.upper("quality_status").isin("PASS", "WARNING", "FAIL")).alias("unsupported_quality"),
        F.count_if(F.length(F.trim(F.col("group_id").cast("string"))) == 0).alias("empty_group"),
        F.count_if(F.col("raw_window_end") < F.col("raw_window_start")).alias("window_order"),
        F.count_if(~failed & ~finite).alias("non_finite"), F.count_if(~failed & finite & ~inside).alias("out_of_bounds"),
        F.count_if(failed).alias("failed_rows"))
    return report(facts, [D], ["unsupported_source", "unsupported_quality", "empty_group", "window_order", "non_finite",
                               "out_of_bounds"], ["failed_rows"])


def example_rules(ex: DataFrame, params: list[str], layout: tuple[int, int, int]) -> DataFrame:
    left, right, target = layout
    cells = F.concat("inputs", "targets")
    finite = F.lit(True)
    for p in params:
        finite = finite & F.forall(cells, lambda c: is_finite(c[p]))
    facts = ex.groupBy(D).agg(
        F.count_if(F.size("inputs") != left + right).alias("input_shape"),
        F.count_if(F.size("targets") != target).alias("target_shape"),
        F.count_if(~finite).alias("non_finite"),
        F.count_if(F.arrays_overlap("inputs.idx", "targets.idx")).alias("index_overlap"),
        (F.count(F.lit(1)) == 0).cast("int").alias("no_examples"))
    return report(facts, [D], ["input_shape", "target_shape", "non_finite", "index_overlap"], ["no_examples"])


# ---- dataset cards and files -----------------------------------------------

def card_rules(cards: DataFrame, core: list[str], recommended: list[str], types: list[str]) -> DataFrame:
    """Rules over a metadata map `card`: core and recommended fields, type, visibility."""
    from ..functions.text import usable_text
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(s).alias("severity"))
                                 for s, names in (("error", core), ("warning", recommended)) for f in names]))
    missing = cards.select("card_id", "card", fields.alias("f")).select(
        "card_id", F.concat(F.lit("missing_"), F.col("f.field")).alias("rule"),
        (~usable_text(F.try_element_at("card", F.col("f.field")))).cast("long").alias("violations"),
        F.col("f.severity").alias("severity"))
    kind = F.try_element_at("card", F.lit("data_type"))
    known = F.lower(kind).isin([t.lower() for t in types])
    private = F.lower(F.try_element_at("card", F.lit("visibility"))).isin("private_measured", "restricted", "internal_only")
    extra = cards.select(
        "card_id", (usable_text(kind) & ~known).cast("int").alias("unsupported_type"),
        F.coalesce(private, F.lit(False)).cast("int").alias("private_visibility"))
    return missing.unionByName(report(extra, ["card_id"], ["unsupported_type"], ["private_visibility"]))


REQUIRED_ATTRIBUTES = ["schema_version", "domain", "dimension_order_json", "units_json", "metadata_json"]
REQUIRED_DATASETS = {
    "ctf": ["/ctf/H_real_values", "/ctf/H_real_shape", "/ctf/H_imag_values", "/ctf/H_imag_shape"],
    "cir": ["/cir/coefficient_real_values", "/cir/coefficient_real_shape", "/cir/coefficient_imag_values",
            "/cir/coefficient_imag_shape", "/cir/delay_s_values", "/cir/delay_s_shape", "/cir/path_valid_values",
            "/cir/path_valid_shape"],
}


def classify_files(inventory: DataFrame) -> DataFrame:
    """Category of each inventory row.

    Needs extension, readable, attributes (array), datasets (array), variables
    (array of lower-case names), domain.
    """
    a, d, v = F.col("attributes"), F.col("datasets"), F.col("variables")
    def all_in(array, names):
        return F.size(F.array_except(F.array(*[F.lit(n) for n in names]), array)) == 0
    attributes = all_in(a, REQUIRED_ATTRIBUTES)
    legacy = F.array_contains(d, "/csi/real") & F.array_contains(d, "/csi/imag")
    payload = F.when(F.col("domain") == "ctf", all_in(d, REQUIRED_DATASETS["ctf"])).when(
        F.col("domain") == "cir", all_in(d, REQUIRED_DATASETS["cir"])).otherwise(False)
    model = F.arrays_overlap(v, F.array(*[F.lit(x) for x in ("input", "output", "predictions", "ground_truth")]))
    mat = (
        F.when(~F.col("readable"), "invalid_mat").when(F.array_contains(v, "sage"), "legacy_sage_mat")
        .when(F.exists(v, lambda n: n.contains("dpsd") | n.contains("pdp")), "power_feature_mat")
        .when(model, "model_feature_mat").otherwise("unsupported_mat"))
    h5 = (
        F.when(~F.col("readable"), "invalid_hdf5").when(~attributes & legacy, "legacy_wifo_hdf5")
        .when(~attributes, "non_v3_hdf5").when(payload, "v3_channel_hdf5").otherwise("incomplete_v3_hdf5"))
    return inventory.withColumn(
        "category", F.when(F.col("extension") == ".mat", mat).when(F.col("extension") == ".h5", h5)
        .otherwise("unsupported_file_format"))


def manifest_check(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Compare (path, sha256) of a frozen manifest with the files found."""
    j = expected.select("path", F.col("sha256").alias("want")).join(
        found.select("path", F.col("sha256").alias("have")), "path", "full_outer")
    return j.withColumn("state", F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected")
                        .when(F.lower("want") != F.lower("have"), "changed").otherwise("ok"))
