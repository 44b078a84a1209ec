"""Pruned search, the parameter grid, ranks of failed candidates."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fadewell.operators import fitting as fit
from fadewell.operators.metrics import D

FEATURES = "window_s double, bins array<int>, shares array<double>, tq array<double>"


@pytest.fixture(scope="module")
def features(spark):
    """120 candidates and 60 targets in each of two datasets, with spread levels over four decades."""
    rng = np.random.default_rng(2)

    def grid(level):
        return np.sort(level + 0.05 * rng.normal(size=101)).tolist()

    cand, target = [], []
    for d in "ab":
        for c in range(120):
            n = int(rng.integers(1, 9))
            cand.append((d, c, np.sort(rng.uniform(0, 5e-8, n)).tolist(), rng.exponential(size=n).tolist(), grid(-9 + c / 30 + (d == "b"))))
        cand.append((d, 120, *cand[-1][2:]))  # an equal candidate with a greater id
        mine = [r for r in cand if r[0] == d]
        for t in range(60):  # a noisy copy of a candidate
            _, _, delays, powers, cq = mine[int(rng.integers(0, 120))]
            w = max(delays) * 1.05
            h = np.bincount(np.minimum(np.floor(np.array(delays) / (w / 128)), 127).astype(int), powers, minlength=128)
            h[int(rng.integers(0, 128))] += 0.02 * h.sum()
            at = np.flatnonzero(h)
            target.append((d, t, w, at.tolist(), (h[at] / h.sum()).tolist(), (np.array(cq) + 0.01 * rng.normal(size=101)).tolist()))
    c = spark.createDataFrame(cand, f"{D} string, candidate_id int, delays array<double>, powers array<double>, cq array<double>")
    t = spark.createDataFrame(target, f"{D} string, window int, {FEATURES}")
    return c.persist(), t.persist()


def all_pairs(candidates, targets):
    scored = fit.score_pairs(targets.join(candidates, D))
    return scored.groupBy(D, "window").agg(F.min(F.struct("total_score", "candidate_id")).alias("b")).select(D, "window", "b.*")


@pytest.mark.parametrize("cell", [0.01, 0.05, 5.0])
def test_pruned_search_finds_the_minimum_of_all_pairs(features, cell):
    candidates, targets = features
    want = {(r[D], r["window"]): (r["candidate_id"], r["total_score"]) for r in all_pairs(candidates, targets).collect()}
    got = fit.best_candidates(targets, [D, "window"], candidates, cell=cell, count_pairs=True, all_pairs=0).collect()
    assert {(r[D], r["window"]): (r["candidate_id"], r["total_score"]) for r in got} == want
    assert sum(r["n_scored"] for r in got) < (0.25 if cell < 1 else 1.2) * 120 * len(want)


def test_a_bound_that_excludes_nothing_scores_all(features):
    """Targets far from every candidate have a bound of one half or more from the spread alone."""
    candidates, targets = features
    far = targets.withColumn("tq", F.transform("tq", lambda x: x + 6)).filter("window < 5")
    want = {(r[D], r["window"]): r["candidate_id"] for r in all_pairs(candidates, far).collect()}
    assert {(r[D], r["window"]): r["candidate_id"] for r in fit.best_candidates(far, [D, "window"], candidates, all_pairs=0).collect()} == want


def test_few_and_no_candidates(features):
    candidates, targets = features
    few = candidates.filter("candidate_id < 3")
    want = {(r[D], r["window"]): r["candidate_id"] for r in all_pairs(few, targets).collect()}
    for limit in (0, 64):
        best = fit.best_candidates(targets, [D, "window"], few, all_pairs=limit)
        assert {(r[D], r["window"]): r["candidate_id"] for r in best.collect()} == want
        assert fit.best_candidates(targets, [D, "window"], candidates.limit(0), all_pairs=limit).count() == 0
        assert fit.best_candidates(targets.limit(0), [D, "window"], candidates, all_pairs=limit).count() == 0


def test_kernel_against_one_pair_by_hand(spark):
    row = ("d", 1, 1.28e-7, [0, 127], [0.25, 0.75], [-8.0] * 101, [0.0, 1.5e-9, 1.0], [1.0, 1.0, 2.0], [-8.5] * 101)
    s = fit.score_pairs(spark.createDataFrame([row], f"{D} string, window int, {FEATURES}, delays array<double>, powers array<double>, cq array<double>")).first()
    t, q = np.zeros(128), np.zeros(128)
    t[[0, 127]] = 0.25, 0.75
    q[[0, 1, 127]] = 0.25, 0.25, 0.5
    a, b = ((x + 1e-12) / (1 + 128e-12) for x in (t, q))
    js = np.sqrt((a * np.log2(a / ((a + b) / 2)) + b * np.log2(b / ((a + b) / 2))).sum() / 2)
    assert abs(s["pdp_score"] - js) < 1e-12 and abs(s["delay_spread_score"] - 0.5) < 1e-12 and abs(s["total_score"] - (js + 0.5) / 2) < 1e-12


def test_grid_is_an_even_range(spark):
    v = spark.createDataFrame([(list(range(40)), [0.5, 1.5], [f"n{i}" for i in range(50)])], "a array<int>, b array<double>, c array<string>")
    g = fit.parameter_grid(v, ["a", "b", "c"])
    rows = g.orderBy("candidate").collect()
    want = [(a, b, c) for a in range(40) for b in (0.5, 1.5) for c in (f"n{i}" for i in range(50))]
    assert [(r["a"], r["b"], r["c"]) for r in rows] == want and rows[-1]["id"] == "GS-004000"
    parts = [r["count"] for r in g.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) > 1 and max(parts) - min(parts) <= 1
    assert fit.parameter_grid(v.withColumn("b", F.array().cast("array<double>")), ["a", "b"]).count() == 0


def test_failed_candidates_share_no_bucket(spark, monkeypatch):
    """Failures tie at an infinite score; their ids cut them into buckets of their own."""
    from fadewell.operators import ordering

    rows = spark.createDataFrame([("d", i, i % 10 == 0, float(i) if i % 10 == 0 else float("inf")) for i in range(600)],
                                 f"{D} string, candidate_id int, success boolean, total_score double")
    seen = {}
    real = ordering.with_bucket

    def small(df, key, rows_per_bucket, total=None, tie_key=None):
        out, n = real(df, key, 50, total, tie_key)
        seen["most"] = max(r["count"] for r in out.groupBy("_bucket").count().collect())
        return out, n

    monkeypatch.setattr(ordering, "with_bucket", small)
    ranked = fit.rank_candidates(rows).orderBy("place").collect()
    assert [r["candidate_id"] for r in ranked] == [*range(0, 600, 10), *[i for i in range(600) if i % 10]]
    assert seen["most"] < 150
