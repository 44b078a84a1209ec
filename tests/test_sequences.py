import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fadewell.operators import forecast, sequences as s

D = "dataset_id"
P = ["DS_mu", "KF_mu"]


def routes(groups=10, rows=28):
    out = []
    for g in range(1, groups + 1):
        for i in range(1, rows + 1):
            ph = 2 * math.pi * (i - 1) / rows
            out.append(("d", f"route-{g:02d}", g, i, i, -8.02 + 0.015 * g + 0.055 * math.sin(ph),
                        -0.8 + 0.08 * g + 0.55 * math.cos(ph + 0.2 * g), "PASS", "generator_truth"))
    return out


SCHEMA = "dataset_id string, group_id string, g int, pos long, idx long, DS_mu double, KF_mu double, quality_status string, label_source string"


@pytest.fixture(scope="module")
def seq(spark):
    return spark.createDataFrame(routes(), SCHEMA).persist()


def split_of(ex):
    groups = ex.select(D, "group_id", F.substring("group_id", 7, 2).cast("int").alias("k")).distinct()
    return s.group_split(groups, "k")


@pytest.mark.parametrize("task", ["extrapolation", "interpolation"])
def test_fixture_gives_ninety_examples_in_63_9_18(seq, task):
    ex = s.examples(seq, P, task)
    parts = {r["partition_code"]: r["count"] for r in ex.join(split_of(ex), [D, "group_id"]).groupBy("partition_code").count().collect()}
    assert parts == {1: 63, 2: 9, 3: 18}


def test_skip_counts_follow_the_stacked_order(spark):
    rows = [list(r) for r in routes(3, 28)]
    rows[10][7] = "FAIL"             # one failed row in the first route
    for r in rows[28 + 15:56]:
        r[4] += 1                    # one index gap in the second route
    seq = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    c = s.span_counts(seq, P, 20).first()
    # 65 stacked spans: 38 cross a route border, 9 hold the failed row, 9 hold the gap.
    assert (c["n_example"], c["skipped_invalid"], c["skipped_boundary"]) == (9, 9, 47)
    assert s.spans(seq, P, 20, block_rows=21).groupBy("state").count().count() == 3


def test_blocks_do_not_change_the_spans(seq):
    key = lambda df: sorted(tuple(r) for r in df.select("group_id", "start_idx", "state", F.col("cells.idx").cast("string")).collect())
    assert key(s.spans(seq, P, 20)) == key(s.spans(seq, P, 20, block_rows=20))


@pytest.mark.parametrize("n,want", [(1, [1]), (2, [1, 3]), (3, [1, 2, 3]), (4, [1, 1, 2, 3]), (40, [1] * 28 + [2] * 6 + [3] * 6)])
def test_group_split_counts(spark, n, want):
    groups = spark.createDataFrame([("d", f"g{i:03d}", i) for i in range(n)], "dataset_id string, group_id string, k int")
    assert [r["partition_code"] for r in s.group_split(groups, "k").orderBy("g").collect()] == want


def test_normalization_reads_training_rows_only(seq):
    train = seq.filter("g <= 7").select(D, "group_id").distinct()
    base = s.fit_normalization(seq, P, train)
    changed = seq.withColumn("DS_mu", F.when(F.col("g") > 7, F.col("DS_mu") + 1000).otherwise(F.col("DS_mu"))).withColumn(
        "quality_status", F.when((F.col("g") == 1) & (F.col("idx") == 1), "FAIL").otherwise("PASS"))
    a = {r["param"]: r for r in base.collect()}
    b = {r["param"]: r for r in s.fit_normalization(changed, P, train).collect()}
    assert a["DS_mu"]["rows"] == 196 and b["DS_mu"]["rows"] == 195
    assert abs(a["DS_mu"]["mean"] - b["DS_mu"]["mean"]) < 1e-3
    z = s.normalize(s.to_long(seq, P, [D, "group_id", "idx"]), base)
    back = s.denormalize(z.withColumnRenamed("value", "was"), base)
    assert back.filter("abs(value - was) > 1e-9").count() == 0


def test_constant_parameter_gets_unit_deviation(seq):
    flat = seq.withColumn("DS_mu", F.lit(-8.0))
    n = {r["param"]: r for r in s.fit_normalization(flat, P, seq.select(D, "group_id").distinct()).collect()}
    assert n["DS_mu"]["zero_variance"] and n["DS_mu"]["std"] == 1.0


def ramp(spark, n, k):
    return spark.createDataFrame([("d", i, b, float(i * 10 + b)) for i in range(1, n + 1) for b in range(k)],
                                 "dataset_id string, pos long, bin int, x double")


def test_chronological_windows_do_not_cross_cuts(spark):
    w = s.chronological_windows(ramp(spark, 60, 2), [D], [D, "bin"], "pos", "x", 3)
    got = {r["partition"]: (r["n"], r["lo"], r["hi"]) for r in w.filter("bin = 0").groupBy("partition").agg(
        F.count(F.lit(1)).alias("n"), F.min("target_index").alias("lo"), F.max("target_index").alias("hi")).collect()}
    assert got == {"train": (39, 4, 42), "validation": (6, 46, 51), "test": (6, 55, 60)}


def test_temporal_experiment_shrinks_the_window(spark):
    assert s.safe_window(90) == 10 and s.safe_window(50) == 6
    with pytest.raises(ValueError):
        s.safe_window(8)
    w, stats, length = s.temporal_experiment(ramp(spark, 50, 2), "bin", "pos", "x")
    assert length == 6
    mu = {r["bin"]: r["mu"] for r in stats.collect()}
    assert mu[0] == pytest.approx(np.mean([i * 10 for i in range(1, 36)]))
    first = w.filter("partition = 'train' AND bin = 0 AND start_pos = 1").first()
    assert len(first["inputs"]) == 6 and first["target"] == pytest.approx((70 - 180) / np.std(np.arange(10, 360, 10), ddof=1))


def test_merge_refuses_real_tags_for_generated_rows(spark):
    a = ramp(spark, 3, 1)
    with pytest.raises(ValueError):
        s.merge_training(a, a, "real_train")
    with pytest.raises(ValueError):
        s.merge_training(a, a.drop("x"))
    counts = {r["source_type"]: r["sample_count"] for r in s.provenance(s.merge_training(a, a)).collect()}
    assert counts == {"real_train": 3, "synthetic_generated": 3}


def test_leakage_guard_finds_shared_targets(seq):
    ex = s.examples(seq, P, "extrapolation")
    train = ex.filter("group_id <= 'route-07'")
    assert s.leaked_targets(train, seq.filter("g > 7")).count() == 0
    assert s.leaked_targets(train, seq.filter("g = 3 AND idx >= 27")).count() == 2


def test_linear_baseline_continues_a_line(spark):
    rows = [("d", "a", 1, i, i, 2.0 * i + 1, -1.0 * i, "PASS", "x") for i in range(1, 21)]
    line = spark.createDataFrame(rows, SCHEMA)
    for task in ("extrapolation", "interpolation"):
        f = forecast.forecast(s.examples(line, P, task), P, task)
        assert f.filter("model = 'linear' AND abs(predicted - truth) > 1e-9").count() == 0
        assert f.filter("model = 'linear'").count() == 8
    flat = forecast.forecast(s.examples(line, P, "extrapolation"), P, "extrapolation", ("persistence",))
    assert {r["predicted"] for r in flat.filter("param = 'DS_mu'").collect()} == {33.0}


def test_min_max_of_a_flat_sample_is_zero(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 5.0)], "k string, x double")
    got = sorted((r["k"], r["scaled"], r["restored"]) for r in s.undo_min_max(s.min_max(rows, ["k"], "x")).collect())
    assert got == [("a", 0.0, 1.0), ("a", 1.0, 3.0), ("b", 0.0, 5.0), ("b", 0.0, 5.0)]


def test_interpolators():
    x = np.arange(9.0)
    at = np.linspace(0, 8, 33)
    cubic = lambda v: 0.5 * v**3 - 2 * v**2 + v - 3
    assert np.allclose(s.cubic_spline(x, cubic(x), at), cubic(at))
    y = np.array([0.0, 0, 1, 3, 3, 2, 2, 5, 9])
    p = s.pchip(x, y, at)
    assert np.allclose(s.pchip(x, y, x), y)
    for i in range(8):  # stays between neighbours
        seg = p[(at >= i) & (at <= i + 1)]
        assert seg.min() >= min(y[i:i + 2]) - 1e-12 and seg.max() <= max(y[i:i + 2]) + 1e-12


def test_blend_matches_brute_force_in_any_block_size(spark):
    rng = np.random.default_rng(5)
    real, syn = rng.normal(size=150), rng.normal(size=90) + 4
    frame = lambda v: spark.createDataFrame([("d", 0, i + 1, float(x)) for i, x in enumerate(v)],
                                            "dataset_id string, bin int, pos long, x double")
    k = np.arange(240)
    want = s.pchip(np.arange(150.0), real, k * 149 / 239) + 0.15 * s.cubic_spline(np.arange(90.0), syn - syn.mean(), k * 89 / 239)
    for block in (4096, 32):
        got = s.blend_on_common_grid(frame(real), frame(syn), "bin", "pos", "x", block_rows=block).orderBy("pos").collect()
        assert [r["pos"] for r in got] == list(range(1, 241))
        assert np.allclose([r["x"] for r in got], want, atol=1e-12)


def test_blend_takes_lengths_per_series(spark):
    """Two datasets and a feature of other lengths in one table; cuts of the solve lie inside every series."""
    rng = np.random.default_rng(6)
    sizes = {("a", 0): (150, 90), ("b", 0): (40, 33), ("b", 1): (61, 20), ("c", 0): (5, 1), ("d", 0): (1, 3), ("e", 0): (2, 2)}
    real, syn = ({k: rng.normal(size=n[i]) + 3 * i for k, n in sizes.items()} for i in (0, 1))
    frame = lambda v: spark.createDataFrame([(*k, i + 1, float(x)) for k, y in v.items() for i, x in enumerate(y)],
                                            "dataset_id string, bin int, pos long, x double")
    only = {("z", 0): rng.normal(size=8)}
    for block in (4096, 32, 4):
        got = {}
        for r in s.blend_on_common_grid(frame(real | only), frame(syn), "bin", "pos", "x", block_rows=block).orderBy("pos").collect():
            got.setdefault((r["dataset_id"], r["bin"]), []).append(r["x"])
        assert set(got) == set(sizes)
        for key, (n, m) in sizes.items():
            k = np.arange(n + m)
            a = s.pchip(np.arange(float(n)), real[key], k * ((n - 1) / (n + m - 1)))
            b = s.cubic_spline(np.arange(float(m)), syn[key] - syn[key].mean(), k * ((m - 1) / (n + m - 1)))
            assert np.allclose(got[key], a + 0.15 * b, atol=1e-12), (block, key)


def test_partitioned_solve_equals_the_whole_one():
    import pandas as pd

    from fadewell.operators import splines

    rng = np.random.default_rng(1)
    for n in (4, 5, 9, 50, 333):
        y = rng.normal(size=n)
        m, rhs, inner = np.zeros((n, n)), np.zeros(n), np.arange(1, n - 1)
        m[inner, inner - 1] = m[inner, inner + 1] = 1.0
        m[inner, inner] = 4.0
        rhs[inner] = 3 * (y[2:] - y[:-2])
        m[0, :2], rhs[0] = (1.0, 2.0), (-5 * y[0] + 4 * y[1] + y[2]) / 2
        m[-1, -2:], rhs[-1] = (2.0, 1.0), (5 * y[-1] - 4 * y[-2] - y[-3]) / 2
        want = np.linalg.solve(m, rhs)
        for size in (4, 5, 16):
            count = max(1, n // size)
            blocks = []
            for b in range(count):
                start, stop = splines._bounds(b, count, n, size)
                lo = max(start - 2, 0)
                blocks.append((start, splines._Block(y[lo:min(n, stop + 3)], lo, start, stop, n)))
            ends = splines.join_borders(pd.DataFrame([{"block": b, **x.border()} for b, (_, x) in enumerate(blocks)])) if count > 1 else pd.DataFrame({"own": [0.0], "after": [0.0]})
            for b, (start, x) in enumerate(blocks):
                got = x.slopes(ends["own"].iloc[b], ends["after"].iloc[b])
                assert np.allclose(got, want[start:start + len(got)], atol=1e-12)


def test_resampled_points_leave_python_row_by_row(spark):
    from fadewell.operators import splines

    rows = spark.createDataFrame([("d", b, k + 1, float((k * 7 + b) % 11)) for b in range(3) for k in range(40)], "dataset_id string, bin int, pos long, v double")
    totals = spark.createDataFrame([("d", b, 90) for b in range(3)], "dataset_id string, bin int, total long")
    for kind, whole in (("pchip", splines.pchip), ("spline", splines.cubic_spline)):
        made = splines.resample(rows, ["dataset_id", "bin"], "pos", "v", totals, kind, 8)
        assert "ArrowEvalPython" not in made._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]  # no array of a batch's points
        got = {(r["bin"], r["pos"]): r["v"] for r in made.collect()}
        assert len(got) == 270
        y = np.array([float((k * 7 + 1) % 11) for k in range(40)])
        want = whole(np.arange(40), y, np.arange(90) * 39 / 89)
        assert np.allclose([got[1, p + 1] for p in range(90)], want)
