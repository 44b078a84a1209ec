"""Several datasets in one table, ties, and sparse tables give what each would give alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fadewell.operators import blocks, evaluate, fitting, sequences
from fadewell.operators.metrics import D
from fadewell.plans import analysis


def ramp(spark, name, n):
    return spark.range(1, n + 1).select(F.lit(name).alias(D), F.lit(0).alias("bin"), F.col("id").alias("pos"), (F.col("id") * 1.5).alias("x"))


def test_short_dataset_beside_a_long_one(spark):
    both = ramp(spark, "a", 40).union(ramp(spark, "b", 200))
    count = lambda w: {(r[D], r["partition"]): r["count"] for r in w.groupBy(D, "partition").count().collect()}
    w, _, longest = sequences.temporal_experiment(both, "bin", "pos", "x")
    alone = {}
    for rows in (ramp(spark, "a", 40), ramp(spark, "b", 200)):
        alone |= count(sequences.temporal_experiment(rows, "bin", "pos", "x")[0])
    assert count(w) == alone and longest == 10
    assert alone["a", "train"] == 23 and alone["a", "validation"] == 1 and alone["a", "test"] == 1


def test_top_k_of_each_dataset(spark):
    rows = spark.createDataFrame([(d, i, True, float(i) + (d == "b") * 100) for d in "ab" for i in range(8)], f"{D} string, candidate_id int, success boolean, total_score double")
    got = sorted((r[D], r["candidate_id"]) for r in fitting.top_k(rows, 3).collect())
    assert got == [(d, i) for d in "ab" for i in range(3)]


def test_keys_of_two_datasets_do_not_meet(spark):
    ex = spark.createDataFrame([("a", 1, [(5,)]), ("b", 1, [(6,)])], f"{D} string, group_id long, targets array<struct<idx:int>>")
    bad = spark.createDataFrame([("b", 1, 5), ("b", 1, 6)], f"{D} string, group_id long, idx int")
    assert [tuple(r) for r in sequences.leaked_targets(ex, bad).collect()] == [("b", 1, 6)]
    schema = f"{D} string, group_id long, start_idx int, step int, idx int"
    a, b = spark.createDataFrame([("a", 1, 0, 0, 5)], schema), spark.createDataFrame([("b", 1, 0, 0, 5)], schema)
    assert sorted((r[D], r["side"]) for r in evaluate.misaligned(a, b).collect()) == [("a", "truth"), ("b", "predicted")]


def test_cdf_of_ties_has_one_row_each(spark):
    rows = spark.range(300).select(F.lit("d").alias(D), "id", F.when(F.col("id") < 200, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    got = blocks.empirical_cdf(rows, "v", [D], ("id",)).orderBy("i").collect()
    assert [r["id"] for r in got] == list(range(300)) and got[-1]["y"] == 1.0


def test_missing_cells_are_zero(spark):
    rows = [("d", 0, 0, 0, 0, t, float(t + 1), 0.5) for t in (0, 1, 2, 3)] + [("d", 1, 0, 0, 0, t, 2.0, -1.0) for t in (1, 3)]
    channel = spark.createDataFrame(rows, f"{D} string, sample long, tx int, rx int, f int, t int, re double, im double")
    got = {r["sample"]: np.array(r["re"]) + 1j * np.array(r["im"]) for r in analysis.complete_vectors(channel, "t").collect()}
    assert got[0].tolist() == [1 + 0.5j, 2 + 0.5j, 3 + 0.5j, 4 + 0.5j]
    assert got[1].tolist() == [0, 2 - 1j, 0, 2 - 1j]
