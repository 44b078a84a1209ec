"""Invariants of the statistics on a small closed-form channel."""

import math

import pytest
from pyspark.sql import functions as F

from fadewell.operators import blocks, metrics, rules
from fadewell.plans.analysis import analyze

D = "dataset_id"
SCHEMA = ("dataset_id string, sample long, tx int, rx int, path int, t int, re double, im double, power double, "
          "delay_s double, path_valid boolean, aoa_rad double, aod_rad double")


def channel(name, samples=24, tx=2, rx=4, paths=6, times=16, scale=lambda s: 1.0):
    out = []
    for s in range(1, samples + 1):
        for a in range(tx):
            for b in range(rx):
                for p in range(1, paths + 1):
                    for t in range(times):
                        g = scale(s) * math.exp(-0.4 * p)
                        ph = 0.3 * s + 0.7 * a + 1.1 * b * math.sin(0.2 * p) + 0.5 * p * t / 16
                        out.append((name, s, a, b, p, t, g * math.cos(ph), g * math.sin(ph), g * g,
                                    (p - 1) * 5e-8 + s * 1e-10, not (p == 6 and s % 5 == 0), 0.3 * p - 1, 0.2 * p - 0.5))
    return out


@pytest.fixture(scope="module")
def cir(spark):
    rows = channel("dyn") + channel("siso", tx=1, rx=1, paths=4, times=1) + channel("one", samples=1, tx=1, rx=1, paths=1, times=1)
    return spark.createDataFrame(rows, SCHEMA).persist()


def metadata(cir):
    return cir.groupBy(D).agg(F.lit(1).alias("n_f")).withColumns({
        "has_frequency_axis": F.lit(False), "has_time_axis": F.lit(True), "tx_ula": F.lit(False), "rx_ula": F.lit(False),
        "sample_semantics": F.lit("ordered_route")})


def test_profile_is_sorted_and_peaks_at_zero(cir):
    rows = metrics.power_delay_profile(cir.filter("dataset_id = 'dyn'")).orderBy("delay_s").collect()
    assert len(rows) == 6
    assert max(r["normalized_db"] for r in rows) == 0
    assert [r["path"] for r in rows] == sorted(r["path"] for r in rows)


def test_datasets_do_not_mix(cir):
    both = {tuple(r) for r in metrics.delay_spread(cir).select(D, "sample", F.round(F.col("spread_s") * 1e9, 9)).collect()}
    alone = {tuple(r) for n in ("dyn", "siso", "one")
             for r in metrics.delay_spread(cir.filter(F.col(D) == n)).select(D, "sample", F.round(F.col("spread_s") * 1e9, 9)).collect()}
    assert both == alone and len(both) == 49


def test_cdf_is_monotone_and_ends_at_one(cir):
    cdf = blocks.empirical_cdf(metrics.delay_spread(cir), "spread_s", [D]).filter("dataset_id = 'dyn'").orderBy("i").collect()
    assert [r["y"] for r in cdf] == [i / 24 for i in range(1, 25)]
    assert all(a["x"] <= b["x"] for a, b in zip(cdf, cdf[1:]))


def test_summary_degrades_with_few_samples(cir):
    s = {r[D]: r for r in blocks.cdf_summary(metrics.delay_spread(cir), "spread_s", [D]).collect()}
    assert s["dyn"]["available"] and s["dyn"]["recommended_met"] and s["dyn"]["warning"] == ""
    assert not s["one"]["available"] and s["one"]["median"] is None and "two samples" in s["one"]["warning"]


def test_quantiles_interpolate(spark):
    v = spark.createDataFrame([("a", float(x)) for x in (4, 1, 3, 2)] + [("b", 7.0)], "dataset_id string, x double")
    q = {(r[D], r["p"]): r["q"] for r in blocks.quantiles(v, "x", [D], [0.0, 0.5, 0.9, 1.0]).collect()}
    assert q["a", 0.0] == 1 and q["a", 1.0] == 4 and q["a", 0.5] == 2.5 and q["a", 0.9] == pytest.approx(3.7)
    assert all(q["b", p] == 7 for p in (0.0, 0.5, 0.9, 1.0))


def test_analysis_offers_only_supported_metrics(cir):
    points, registry = analyze(cir, metadata(cir), spacing_s=1e-3)
    state = {(r[D], r["metric"]): r for r in registry.collect()}
    seen = {(r[D], r["metric"]) for r in points.select(D, "metric").distinct().collect()}
    assert state["dyn", "power"]["classification"] == "wideband_dynamic_mimo"
    assert state["siso", "power"]["classification"] == "wideband_static_siso"
    assert state["one", "power"]["classification"] == "narrowband_static_siso"
    assert state["one", "power"]["is_standard"] and not state["one", "pdp"]["available"]
    assert seen == {k for k, r in state.items() if r["available"]}
    acf = points.filter("dataset_id = 'dyn' AND metric = 'time_autocorrelation' AND x = 0").first()
    assert acf["y"] == pytest.approx(1.0)


def test_analysis_degrades_per_dataset(spark):
    """Beams where a linear array has no angles; no time axis, one sample and one observation each lose their metrics."""
    small = dict(samples=3, paths=3, times=4)
    rows = channel("beams", **small) + channel("bare", **small) + channel("still", **small)
    rows += channel("single", samples=1, paths=3, times=4) + channel("lone", samples=1, paths=3, times=1)
    cir = spark.createDataFrame(rows, SCHEMA)
    angle = lambda name: F.when(~F.col(D).isin("beams", "bare"), F.col(name)).alias(name)
    cir = cir.withColumns({"aoa_rad": angle("aoa_rad"), "aod_rad": angle("aod_rad")})
    meta = metadata(cir).withColumns({
        "n_f": F.lit(4), "has_frequency_axis": F.lit(True), "has_time_axis": F.col(D) != "still",
        "tx_ula": F.col(D) == "beams", "rx_ula": F.col(D) == "beams"})
    points, registry = analyze(cir, meta, spacing_s=1e-3, offsets_hz=[-3e5, -1e5, 1e5, 3e5], element_wavelengths=0.5)
    state = {(r[D], r["metric"]): r["available"] for r in registry.collect()}
    got = points.groupBy(D, "metric", "series").agg(F.count("*").alias("n"), F.max("y").alias("top")).collect()
    assert {(r[D], r["metric"]) for r in got} == {k for k, v in state.items() if v}
    spectra = {(r[D], r["series"]): (r["n"], r["top"]) for r in got if r["metric"] == "angular_power_spectrum"}
    assert spectra["beams", "rx beamspace"] == spectra["beams", "tx beamspace"] == (181, 0.0)
    assert {k[1] for k in spectra if k[0] == "still"} == {"aoa", "aod"}
    assert not state["bare", "angular_power_spectrum"] and not state["bare", "angular_spread_cdf"]
    assert state["bare", "doppler_power_spectrum"] and not state["still", "doppler_power_spectrum"] and not state["still", "time_autocorrelation"]
    for cdf in ("delay_spread_cdf", "angular_spread_cdf", "doppler_spread_cdf", "delay_sample_heatmap"):
        assert not state["single", cdf]
    assert state["single", "spatial_correlation"] and not state["lone", "spatial_correlation"]
    assert {(r["series"]) for r in got if r[D] == "single" and r["metric"] == "spatial_correlation"} == {f"rx {i}" for i in range(4)} | {f"tx {i}" for i in range(2)}


def test_known_region_ignores_the_target(spark, cir):
    dyn = cir.filter("dataset_id = 'dyn'")
    axis = dyn.select(D, F.col("sample").alias("idx")).distinct()
    task = rules.preset_task(axis, [D], "idx", "extrapolation")
    loud = dyn.join(task.filter("region = 'target'").select(D, F.col("idx").alias("sample"), F.lit(1000.0).alias("g")), [D, "sample"], "left")
    g = F.coalesce("g", F.lit(1.0))
    loud = loud.withColumns({"re": F.col("re") * g, "im": F.col("im") * g}).drop("g")
    profile = lambda df: sorted(tuple(r) for r in metrics.power_delay_profile(rules.select_region(df, task, "sample")).collect())
    assert profile(dyn) == profile(loud)
    assert rules.select_region(dyn, task, "sample").select("sample").distinct().count() == 19


def test_conversion_to_frequency_matches_the_sum(cir):
    row = metrics.cir_to_ctf(cir, [-1e6, 2e6]).filter("dataset_id = 'siso' AND sample = 3 AND f = 1").first()
    want = sum(complex(r["re"], r["im"]) * complex(math.cos(-2 * math.pi * 2e6 * r["delay_s"]), math.sin(-2 * math.pi * 2e6 * r["delay_s"]))
               for r in cir.filter("dataset_id = 'siso' AND sample = 3").collect())
    assert abs(complex(row["re"], row["im"]) - want) < 1e-9


def test_snapshot_spread_of_silence_is_zero_and_negative_power_raises(spark):
    d = spark.createDataFrame([("d", 1, b, 0.0) for b in range(4)], "dataset_id string, snapshot int, bin int, p double")
    s = metrics.profile_delay_spread(d, 1e8, F.col("p")).first()
    assert s["spread_s"] == 0.0
    with pytest.raises(Exception, match="negative"):
        metrics.profile_delay_spread(d, 1e8, F.col("p") - 1).collect()


def test_task_rules_find_each_fault(spark):
    rows = [("t1", "interpolation", "sample", "known", i) for i in (1, 2, 5, 6)] + [("t1", "interpolation", "sample", "target", i) for i in (3, 4)]
    rows += [("t2", "extrapolation", "sample", "known", i) for i in (1, 5)] + [("t2", "extrapolation", "sample", "target", 3)]
    rows += [("t3", "extrapolation", "sample", "known", 1), ("t3", "extrapolation", "sample", "target", 99)]
    tasks = spark.createDataFrame(rows, "task_id string, mode string, axis string, region string, idx long")
    length = tasks.select("task_id").distinct().withColumns({"n": F.lit(6), "n_f": F.lit(1), "n_t": F.lit(1), "has_position": F.lit(False)})
    r = rules.task_rules(tasks, length)
    broken = {(x["task_id"], x["rule"]) for x in r.filter("violations > 0").collect()}
    assert broken == {("t2", "wrong_side"), ("t3", "out_of_range")}


def test_bad_range_text_raises(spark):
    t = spark.createDataFrame([("g", "1:3:5")], "g string, text string")
    with pytest.raises(Exception, match="cannot parse range"):
        rules.parse_ranges(t, ["g"], "text").collect()


def test_frequency_sums_shuffle_one_row_per_block(spark):
    """11 offsets are two blocks: two summed rows per observation, and the values of a plain sum."""
    import numpy as np
    from pyspark.sql import functions as F

    paths = [("d", 0, 0, 0, t, 1.0 + t, 0.5 * p, p * 3e-8, p != 2) for t in range(2) for p in range(4)]
    cir = spark.createDataFrame(paths, "dataset_id string, sample int, tx int, rx int, t int, re double, im double, delay_s double, path_valid boolean")
    offsets = metrics.centred_offsets(11, 120e3)
    grid = F.array(*[F.struct(F.lit(i).alias("f"), F.lit(x).alias("hz")) for i, x in enumerate(offsets)])
    assert metrics._rotated(cir, grid).count() == 4
    axis = spark.createDataFrame([("d", i, x) for i, x in enumerate(offsets)], "dataset_id string, f int, offset_hz double")
    for h in (metrics.cir_to_ctf(cir, offsets), metrics.cir_to_ctf_on_axis(cir, axis)):
        got = {(r["t"], r["f"]): complex(r["re"], r["im"]) for r in h.collect()}
        want = {(t, f): sum(complex(p[5], p[6]) * np.exp(-2j * np.pi * x * p[7]) for p in paths if p[4] == t and p[8])
                for t in range(2) for f, x in enumerate(offsets)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("count", [1, 4, 9, 17])
def test_rotated_sums_are_as_many_as_the_offsets(cir, count):
    offsets = metrics.centred_offsets(count, 15e3)
    h = metrics.cir_to_ctf(cir, offsets)
    sums = h._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[1].count("sum(")
    assert sums <= 2 * math.ceil(count / math.ceil(count / 8))
    got = {r["f"]: complex(r["re"], r["im"]) for r in h.filter("dataset_id = 'dyn' AND sample = 3 AND tx = 1 AND rx = 2 AND t = 5").collect()}
    paths = cir.filter("dataset_id = 'dyn' AND sample = 3 AND tx = 1 AND rx = 2 AND t = 5 AND path_valid").collect()
    for f, hz in enumerate(offsets):
        turned = [complex(p["re"], p["im"]) * complex(math.cos(-2 * math.pi * hz * p["delay_s"]), math.sin(-2 * math.pi * hz * p["delay_s"])) for p in paths]
        assert abs(got[f] - sum(turned)) < 1e-9
    assert len(got) == count


def test_task_rules_read_their_tasks_once(spark):
    rows = [("t", "interpolation", "sample", r, i) for i, r in enumerate(["known", "known", "target", "known", "known"], 1)]
    tasks = spark.createDataFrame(rows, "task_id string, mode string, axis string, region string, idx long")
    length = spark.createDataFrame([("t", 5, 1, 1, False)], "task_id string, n long, n_f int, n_t int, has_position boolean")
    r = rules.task_rules(tasks, length)
    assert r._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1  # the axis length only
    assert sum(x["violations"] for x in r.collect()) == 0


def test_heat_map_keeps_samples_not_their_cells(cir):
    """The unfolded cells, 64 and more a sample, are not held for the two passes; peaks stay those of each dataset."""
    heat = metrics.delay_sample_heatmap(cir)
    held = [line for line in heat._jdf.queryExecution().optimizedPlan().toString().splitlines() if "InMemoryRelation" in line]
    assert not any("delay_s" in line or "linear" in line for line in held)
    tops = {r[D]: (r["top"], r["n"]) for r in heat.groupBy(D).agg(F.max("normalized_db").alias("top"), F.count("*").alias("n")).collect()}
    assert tops == {"dyn": (0.0, 24 * 64), "siso": (0.0, 24 * 64), "one": (0.0, 64)}
