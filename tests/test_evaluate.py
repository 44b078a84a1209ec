import math

import pytest

from pyspark.sql import functions as F

from fadewell.operators import evaluate as ev
from fadewell.operators import fitting as fit

D = "dataset_id"


def test_gaussian_cdf_matches_erf(spark):
    m = spark.createDataFrame([("d", 5.0, 2.0, 6.0, 0.0, 1.0, 9.0)],
                              "dataset_id string, mu_pred double, sd_pred double, mu_truth double, sd_truth double, lo double, hi double")
    rows = ev.gaussian_spread_cdf(m).orderBy("k").collect()
    assert len(rows) == 1000 and rows[0]["x"] == 1.0 and rows[-1]["x"] == 9.0
    for r in rows[::111]:
        assert r["f_pred"] == pytest.approx(0.5 * (1 + math.erf((r["x"] - 5) / (2 * math.sqrt(2)))))
        assert r["f_truth"] == pytest.approx(0.5 * (1 + math.erf((r["x"] - 6) / (1e-6 * math.sqrt(2)))))


SUMS = "dataset_id string, model string, group_id int, n long, sse double"


def test_candidate_must_pass_every_safeguard(spark):
    rows = [("d", "persistence", g, 4, 4.0) for g in range(5)]
    rows += [("d", "good", g, 4, 1.0) for g in range(5)]                              # half the error everywhere
    rows += [("d", "spiky", g, 4, 0.04 if g else 36.0) for g in range(5)]             # three times worse in one group
    q = {r["model"]: r for r in ev.qualification(spark.createDataFrame(rows, SUMS), ["persistence"]).collect()}
    assert q["good"]["passed"] and q["good"]["improvement"] == pytest.approx(0.5)
    assert not q["spiky"]["passed"] and q["spiky"]["worst_ratio"] == pytest.approx(3.0) and q["spiky"]["win_rate"] == 0.8
    chosen = ev.selected_model(ev.qualification(spark.createDataFrame(rows, SUMS), ["persistence"])).first()
    assert (chosen["selected"], chosen["reason"]) == ("good", "qualified_candidate")
    only_bad = [r for r in rows if r[1] != "good"]
    chosen = ev.selected_model(ev.qualification(spark.createDataFrame(only_bad, SUMS), ["persistence"])).first()
    assert (chosen["selected"], chosen["reason"]) == ("persistence", "baseline_fallback")


def test_block_rmse_drops_the_remainder(spark):
    fc = spark.createDataFrame([("d", i, float(i), 0.0) for i in range(1, 26)], "dataset_id string, pos long, predicted double, truth double")
    rows = ev.block_rmse(fc, "pos").orderBy("block").collect()
    assert len(rows) == 12 and rows[0]["rmse"] == pytest.approx(math.sqrt(2.5))


def test_resolution_order_and_checks(spark):
    targets = spark.createDataFrame([(1,)], "target int")
    predicted = spark.createDataFrame([(1, "DS_mu", -20.0), (1, "num_rays", 2.5)], "target int, param string, value double")
    calibrated = spark.createDataFrame([("DS_mu", -7.0), ("KF_mu", float("nan")), ("KF_sigma", 3.0)], "param string, value double")
    scenario = spark.createDataFrame([("KF_mu", 4.0), ("KF_sigma", 9.0)], "param string, value double")
    defaults = {p: 1.0 for p in ev.RESOLVED_PARAMETERS}
    r = {x["param"]: x for x in ev.resolve_parameters(targets, predicted, calibrated, scenario, defaults, {"predicted": "v1"}).collect()}
    assert len(r) == 9
    assert r["DS_mu"]["source"] == "predicted" and not r["DS_mu"]["in_bounds"] and r["DS_mu"]["source_version"] == "v1"
    assert not r["num_rays"]["integer_ok"]
    assert (r["KF_mu"]["source"], r["KF_mu"]["value"]) == ("scenario_config", 4.0)
    assert (r["KF_sigma"]["source"], r["KF_sigma"]["value"]) == ("module2_calibrated", 3.0)
    assert r["r_DS"]["source"] == "versioned_default" and r["r_DS"]["source_version"] == "unspecified"


def test_pairs_round_half_to_even_and_report_misalignment(spark):
    schema = "dataset_id string, group_id int, start_idx long, step int, idx long, param string, value double"
    truth = spark.createDataFrame([("d", 1, 1, 0, 5, "num_rays", 2.5), ("d", 1, 1, 1, 6, "num_rays", 3.5)], schema)
    predicted = spark.createDataFrame([("d", 1, 1, 0, 5, "num_rays", 4.5)], schema)
    p = ev.pair_table(truth, predicted, ["num_rays"], ["num_rays"]).collect()
    assert [(r["truth_num_rays"], r["predicted_num_rays"]) for r in p] == [(2.0, 4.0)]
    assert [(r["idx"], r["side"]) for r in ev.misaligned(truth, predicted).collect()] == [(6, "truth")]


def test_smallest_bundle_within_tolerance(spark):
    rows = [("d", "e", "P2", 1.2), ("d", "e", "P4", 1.04), ("d", "e", "P8", 1.0), ("d", "i", "P2", 1.0), ("f", "e", "P2", 5.0), ("f", "e", "P4", 6.0)]
    s = spark.createDataFrame(rows, "dataset_id string, task string, bundle string, v double")
    got = {(r["dataset_id"], r["task"]): r["selected_bundle"] for r in ev.smallest_good_bundle(s, "v").collect()}
    assert got == {("d", "e"): "P4", ("d", "i"): "P2", ("f", "e"): "P2"}
    means = {(r["dataset_id"], r["bundle"]): (r["group_count"], r["mean_v"]) for r in ev.bundle_summary(s.withColumn("task", F.lit("e")), ["v"]).collect()}
    assert means["d", "P2"] == (2, 1.1) and means["f", "P2"] == (1, 5.0)


# ---- candidate fitting -----------------------------------------------------

PATHS = ("dataset_id string, candidate_id int, sample long, t int, path int, re double, im double, delay_s double, path_valid boolean")


def paths(candidate, shift):
    return [("d", candidate, s, 0, p, math.exp(-0.3 * p), 0.1 * s, (p + shift * p * p) * 1e-8 + s * 1e-11, True)
            for s in range(1, 6) for p in range(1, 6)]


def test_exact_candidate_is_recovered_and_failures_stay(spark):
    known = spark.createDataFrame(paths(0, 0.0), PATHS)
    cand = spark.createDataFrame([r for c, k in ((1, 0.3), (2, 0.0), (3, 0.1)) for r in paths(c, k)], PATHS)
    scores = fit.score_candidates(fit.known_targets(known), [D], fit.candidate_features(cand))
    every = spark.createDataFrame([("d", c) for c in range(1, 5)], "dataset_id string, candidate_id int")
    ranked = fit.rank_candidates(fit.evaluate_candidates(every, scores)).orderBy("place").collect()
    assert [r["candidate_id"] for r in ranked] == [2, 3, 1, 4]
    assert ranked[0]["total_score"] < 1e-12 and ranked[0]["rank"] == 1
    assert ranked[3]["rank"] is None and ranked[3]["outcome"] == "FAILED" and math.isinf(ranked[3]["total_score"])


def test_grid_order_and_ids(spark):
    v = spark.createDataFrame([([1.0, 2.0], [5, 6, 7])], "a array<double>, b array<int>")
    g = fit.parameter_grid(v, ["a", "b"]).orderBy("candidate").collect()
    assert [(r["id"], r["a"], r["b"]) for r in g[:4]] == [("GS-000001", 1.0, 5), ("GS-000002", 1.0, 6), ("GS-000003", 1.0, 7), ("GS-000004", 2.0, 5)]


def test_search_history_over_blocks(spark):
    values = [5.0, 6.0, 4.0, 4.0, 7.0, 3.0, 9.0, 9.0]
    h = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate(values)], "g string, i long, score double")
    rows = fit.search_history(h, ["g"], "i", "score").orderBy("i").collect()
    assert [r["best"] for r in rows] == [5, 5, 4, 4, 4, 3, 3, 3]
    assert [r["improved"] for r in rows] == [True, False, True, False, False, True, False, False]
    assert [r["streak"] for r in rows] == [0, 1, 0, 1, 2, 0, 1, 2]


def test_alignment_counts_keys_of_both_sides_in_one_shuffle(spark):
    keys = "dataset_id string, group_id long, start_idx long, step int, idx long, value double"
    truth = spark.createDataFrame([("d", 1, 1, s, 16 + s, float(v)) for s in range(4) for v in range(3)], keys)
    predicted = spark.createDataFrame([("d", 1, 1, s, 16 + s, 0.0) for s in range(1, 4)] + [("d", 2, 1, 0, 16, 0.0), (None, 2, 1, 0, 16, 0.0)], keys)
    bad = ev.misaligned(truth, predicted)
    assert bad._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    assert bad._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r["group_id"], r["step"], r["side"]) for r in bad.collect()) == [(1, 0, "truth"), (2, 0, "predicted"), (2, 0, "predicted")]
