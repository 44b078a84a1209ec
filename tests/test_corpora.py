"""Nested bundles against one pass per bundle; layouts, guards and reasons per dataset."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fadewell.operators import corpora, evaluate, metrics, rules, sequences, tensors
from fadewell.operators.metrics import D

NAMES = sequences.PARAMETERS


@pytest.fixture(scope="module")
def routes(spark):
    """Two datasets of ten routes with 40 rows; failed rows, gaps and missing later parameters."""
    rng, rows = random.Random(4), []
    for d in "ab":
        for g in range(10):
            idx = 0
            for pos in range(1, 41):
                idx += 2 if rng.random() < 0.01 else 1
                values = [rng.gauss(50, 3) for _ in NAMES]
                for i in range(len(values)):
                    if rng.random() < 0.004 * i:
                        values[i] = rng.choice([None, float("nan")])
                rows.append((d, f"r{g:02d}", pos, idx, "FAIL" if rng.random() < 0.01 else "PASS", rng.choice(["x", "y"]), *values))
    fields = ", ".join(f"`{p}` double" for p in NAMES)
    return spark.createDataFrame(rows, f"{D} string, group_id string, pos long, idx int, quality_status string, label_source string, {fields}").persist()


def test_nested_bundles_equal_one_pass_per_bundle(routes):
    leveled = corpora.with_level(routes, NAMES)
    ex = corpora.nested_examples(leveled).persist()
    split = corpora.bundle_split(ex)
    norm = corpora.bundle_normalization(leveled, NAMES, split)
    got_norm = {(r[D], r["task"], r["bundle"], r["param"]): (r["rows"], r["mean"], r["std"], r["is_int"]) for r in norm.collect()}
    codes = {(r[D], r["task"], r["bundle"], r["group_id"]): r["partition_code"] for r in split.collect()}
    seen = 0
    for bundle, size in sequences.BUNDLES.items():
        for task in sequences.LAYOUT:
            one = sequences.examples(routes, NAMES[:size], task)
            keys = lambda df: sorted((r[D], r["group_id"], r["start_idx"], r["label_sources"]) for r in df.collect())
            mine = ex.filter((F.col("bundle") == bundle) & (F.col("task") == task))
            assert keys(mine) == keys(one)
            flat = lambda df, value: sorted((r[D], r["group_id"], r["start_idx"], *value(r)) for r in df.collect())
            assert flat(mine, lambda r: [x for c in r["targets"] for x in c["values"]]) == flat(one, lambda r: [c[p] for c in r["targets"] for p in NAMES[:size]])
            groups = sequences.group_split(one.select(D, "group_id").distinct(), "group_id")
            assert {(r[D], r["group_id"]): r["partition_code"] for r in groups.collect()} == {(d, g): c for (d, t, b, g), c in codes.items() if (t, b) == (task, bundle)}
            for r in sequences.fit_normalization(routes, NAMES[:size], groups.filter("partition_code = 1")).collect():
                rows, mean, std, is_int = got_norm[r[D], task, bundle, r["param"]]
                assert (rows, is_int) == (r["rows"], r["is_int"]) and abs(mean - r["mean"]) < 1e-9 and abs(std - r["std"]) < 1e-9
                seen += 1
    assert seen == len(got_norm) == 2 * 2 * (2 + 4 + 6 + 8)
    z = corpora.normalized_examples(ex, norm).filter("bundle = 'P4' AND task = 'extrapolation' AND dataset_id = 'a'").first()
    raw = ex.filter((F.col("bundle") == "P4") & (F.col("task") == "extrapolation") & (F.col(D) == "a") & (F.col("group_id") == z["group_id"]) & (F.col("start_idx") == z["start_idx"])).first()
    want = [(v - got_norm["a", "extrapolation", "P4", p][1]) / got_norm["a", "extrapolation", "P4", p][2] for c in raw["inputs"] for p, v in zip(NAMES, c["values"])]
    assert np.allclose([v for c in z["inputs"] for v in c["values"]], want)


def test_empty_sequence_gives_no_examples(routes):
    leveled = corpora.with_level(routes.limit(0), NAMES)
    ex = corpora.nested_examples(leveled)
    assert ex.count() == 0 and corpora.bundle_normalization(leveled, NAMES, corpora.bundle_split(ex)).count() == 0


def test_each_dataset_keeps_its_own_layout(spark):
    rows = [("three", tx, p, s, float(tx + 10 * p + 100 * s)) for tx in range(2) for p in (4, 9) for s in (1, 5, 8)]
    rows += [("two", tx, p, 1, float(tx + 10 * p)) for tx in (3, 7) for p in range(3)] + [("one", 0, p, 1, float(p)) for p in (2, 6)] + [("none", 5, 5, 5, 1.0)]
    df = spark.createDataFrame(rows, f"{D} string, tx int, path int, sample int, x double")
    got = {(r[D], r["antenna"], r["delay"], r["snapshot"]): r["x"] for r in tensors.canonical_axes(df, ["tx", "path", "sample"], ["x"]).collect()}
    assert got["three", 2, 1, 3] == 1 + 40 + 800 and got["two", 2, 3, 1] == 7 + 20 and got["one", 1, 2, 1] == 6 and got["none", 1, 1, 1] == 1
    wide = df.withColumns({"a": F.col("path"), "b": F.col("path")})
    with pytest.raises(ValueError, match="three has 5"):
        tensors.canonical_axes(wide.withColumn("a", F.col("x")), ["tx", "path", "sample", "a", "b"], ["x"])


def test_best_baseline_and_seed_means(spark):
    """Scores are means over seeds; the baseline is the better one by its own score."""
    rows = [("d", "persistence", 0, g, 10, 40.0 if g == 1 else 10.0) for g in (1, 2)] + [("d", "linear", 0, g, 10, 16.0) for g in (1, 2)]
    rows += [("d", "net", s, g, 10, e) for s, e in ((1, 4.0), (2, 9.0)) for g in (1, 2)] + [("e", "linear", 0, 1, 10, 90.0), ("e", "persistence", 0, 1, 10, 40.0), ("e", "net", 1, 1, 10, 39.0)]
    sums = spark.createDataFrame(rows, f"{D} string, model string, seed int, group_id int, n long, sse double")
    got = {r[D]: r for r in evaluate.qualification(sums, ["persistence", "linear"]).collect()}
    mean = (0.4**0.5 + 0.9**0.5) / 2
    d = got["d"]
    assert d["baseline"] == "linear" and abs(d["nrmse"] - mean) < 1e-12 and abs(d["worst_ratio"] - mean / 1.6**0.5) < 1e-12
    assert d["win_rate"] == 1.0 and d["passed"] and abs(d["improvement"] - (1 - mean / 1.6**0.5)) < 1e-12
    assert got["e"]["baseline"] == "persistence" and not got["e"]["passed"]


def test_paths_that_cannot_be_placed_are_an_error(spark):
    schema = f"{D} string, sample int, path int, re double, im double, delay_s double"
    good = [("d", 1, 1, 1.0, 0.0, 1e-9), ("d", 1, 2, 1.0, 0.0, 3e-9)]
    grid = spark.createDataFrame([("d", 4e-9, 4)], f"{D} string, finite_max double, bins int")
    run = lambda rows: metrics.frozen_grid_features(spark.createDataFrame(rows, schema), [D, "sample"], grid).collect()
    assert sorted(r["bin"] for r in run(good)) == [1, 3]
    for bad in (("d", 1, 3, 1.0, 0.0, -1e-9), ("d", 1, 3, float("nan"), 0.0, 1e-9), ("d", 1, 3, 1.0, 0.0, float("inf"))):
        with pytest.raises(Exception, match="finite and nonnegative"):
            run([*good, bad])


def test_metrics_say_what_they_lack(spark):
    base = {"domain": "cir", "n_tx": 2, "n_rx": 4, "n_f": 1, "n_path": 6, "n_t": 16, "n_sample": 32, "has_frequency_axis": False, "has_time_axis": True,
            "has_angles": True, "tx_ula": False, "rx_ula": False, "sample_semantics": "ordered_route"}
    cases = {"full": {}, "one": {"n_sample": 1}, "unordered": {"sample_semantics": "independent"}, "no_time": {"has_time_axis": False}, "no_angle": {"has_angles": False},
             "single": {"n_tx": 2, "n_rx": 1, "n_path": 1, "n_t": 1, "n_sample": 1, "has_angles": False}}
    rows = [{D: name, **base, **case} for name, case in cases.items()]
    said = {(r[D], r["metric"]): (r["available"], r["reason"]) for r in rules.metric_status(rules.capabilities(spark.createDataFrame(rows))).collect()}
    assert all(available == (reason == "") for available, reason in said.values())
    assert said["one", "delay_spread_cdf"][1] == rules.NO_CDF and said["one", "angular_spread_cdf"][1] == rules.NO_SPREAD_CDF
    assert "ordered" in said["unordered", "delay_sample_heatmap"][1] and said["no_time", "doppler_spread_cdf"][1].startswith("Need Nt > 1")
    assert said["no_angle", "angular_power_spectrum"][1] == rules.NO_ANGLE and said["no_angle", "spatial_correlation"][0]
    assert said["single", "spatial_correlation"][1] == rules.NO_CORRELATION and said["single", "pdp"][1] == rules.NO_DELAY
    assert [m for (d, m), (ok, _) in said.items() if d == "single" and ok] == ["power"]


def test_short_dataset_is_left_out(spark):
    ramp = lambda name, n: spark.range(1, n + 1).select(F.lit(name).alias(D), F.lit(0).alias("bin"), F.col("id").alias("pos"), (F.col("id") * 1.5).alias("x"))
    both = ramp("long", 60).union(ramp("short", 4))
    w, _, longest = sequences.temporal_experiment(both, "bin", "pos", "x")
    alone, _, _ = sequences.temporal_experiment(ramp("long", 60), "bin", "pos", "x")
    rows = lambda df: sorted((r[D], r["partition"], r["start_pos"], r["target_index"], tuple(r["inputs"]), r["target"]) for r in df.collect())
    assert rows(w) == rows(alone) and longest == 8
    with pytest.raises(ValueError):
        sequences.temporal_experiment(ramp("short", 4), "bin", "pos", "x")


def test_axis_counts_read_the_rows_once(spark):
    from fadewell.plans import views

    cir = views.cir(spark, "/root/testdata/sf0.001")
    counts = rules.axis_counts(cir, valid=F.count_if("path_valid"))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    got, rows = counts.first(), cir.collect()
    for name, axis in (("n_tx", "tx"), ("n_rx", "rx"), ("n_path", "path"), ("n_t", "t"), ("n_sample", "sample")):
        assert got[name] == len({r[axis] for r in rows})
    assert got["rows"] == len(rows) and got["valid"] == sum(r["path_valid"] for r in rows)


def test_moments_cut_by_level_ignore_what_lies_beyond_it(spark):
    rows = [("d", 1, 1, [1.0, float("nan")]), ("d", 1, 1, [3.0, None]), ("d", 1, 2, [2.0, 5.0]), ("d", 1, 0, [9.0, 9.0])]
    leveled = spark.createDataFrame(rows, "dataset_id string, group_id long, level int, values array<double>")
    made = corpora.level_moments(leveled, ["x", "y"])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Aggregate"):].split("\n")[0].count("avg(values") == 2 and "avg(CASE" not in plan
    got = {r["level"]: (r["n"], r["means"], r["vars"]) for r in made.collect()}
    assert got == {1: (2, [2.0, None], [1.0, None]), 2: (1, [2.0, 5.0], [0.0, 0.0])}
