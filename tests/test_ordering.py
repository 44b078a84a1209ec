"""The bucketed forms equal the plain windows, also with one hot group."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fadewell.operators import ordering as o


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", round(rng.uniform(0, 50), 1), i) for i in range(900)]
    return spark.createDataFrame(data, "g string, x double, id long").persist()


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("group", [["g"], []])
def test_positions_equal_row_number(rows, group):
    plain = rows.withColumn("pos", F.row_number().over(Window.partitionBy(*group).orderBy("x", "id")).cast("long"))
    cut = o.positions(rows, group, ["x", "id"], "x", rows_per_bucket=40)
    assert as_set(cut.select("g", "x", "id", "pos")) == as_set(plain)


def test_heavy_tie_is_split_by_the_next_column(spark):
    data = [("g", 5.0 if i % 3 else float(i % 11), i) for i in range(600)]
    df = spark.createDataFrame(data, "g string, x double, id long")
    plain = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("x", "id")).cast("long"))
    cut = o.positions(df, ["g"], ["x", "id"], "x", rows_per_bucket=50, tie_key="id")
    assert as_set(cut.select("g", "x", "id", "pos")) == as_set(plain)
    bucketed, _ = o.with_bucket(df, "x", 50, tie_key="id")
    assert max(r["count"] for r in bucketed.groupBy("_bucket").count().collect()) < 150


def test_text_positions_equal_row_number(spark):
    names = spark.createDataFrame([(f"snap{i % 97:06d}-{i}", i) for i in range(400)], "name string, id long")
    plain = names.withColumn("pos", F.row_number().over(Window.orderBy("name", "id")).cast("long"))
    assert as_set(o.text_positions(names, [], "name", ["id"], rows_per_bucket=30).select("name", "id", "pos")) == as_set(plain)


def test_lag_and_running_over_small_blocks(rows):
    ranked = o.positions(rows, ["g"], ["x", "id"], "x")
    w = Window.partitionBy("g").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = ranked.select("g", "pos", F.lag("id").over(w).alias("p"), F.sum("id").over(upto).alias("s"),
                          F.min("id").over(upto).alias("m"),
                          F.min("id").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("b"))
    lag = o.lagged(ranked, ["g"], "pos", {"p": "id"}, block_rows=16)
    run = o.running(lag, ["g"], "pos", {"s": ("sum", "id"), "m": ("min", "id"), "b": ("min_before", "id")}, block_rows=16)
    key = lambda r: (r["g"], r["pos"])
    assert sorted(run.select("g", "pos", "p", "s", "m", "b").collect(), key=key) == sorted(plain.collect(), key=key)


def test_bounded_join_keeps_rows_without_broadcast(rows):
    facts = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    big = o.bounded_join(rows, facts, ["g"], limit=0)
    assert big.count() == rows.count()
    assert "BroadcastHint" not in big._jdf.queryExecution().logical().toString()


def test_text_positions_below_a_deep_folder(spark):
    """Names that differ only after a long common path: no part gets twice its share."""
    deep = "/data/" + "very/long/common/folder/" * 8
    rows = [(f"{deep}{'x' * (i % 3)}snap{i % 997:05d}", i) for i in range(4000)] + [(None, 4000), ("", 4001)]
    names = spark.createDataFrame(rows, "name string, id long").repartition(8)
    plain = names.withColumn("pos", F.row_number().over(Window.orderBy("name", "id")).cast("long"))
    cut = o.range_positions(names, [], ["name", "id"], "pos", parts=20)
    assert as_set(cut.select("name", "id", "pos")) == as_set(plain)
    ranged = names.repartitionByRange(20, "name", "id")
    assert max(r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()) < 2 * 4002 / 20
    grouped = names.withColumn("g", F.col("id") % 3)
    want = grouped.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("name", "id")).cast("long"))
    got = o.text_positions(grouped, ["g"], "name", ["id"], rows_per_bucket=300)
    assert as_set(got.select("name", "id", "g", "pos")) == as_set(want.select("name", "id", "g", "pos"))


@pytest.mark.parametrize("rows_per_bucket", [7, 1_000_000])
def test_counted_ranks(spark, rows_per_bucket):
    data = [(f"g{i % 3}", float((i * i) % 37) if i % 2 else 5.0) for i in range(600)] + [("one", -0.0), ("one", 0.0)]
    df = spark.createDataFrame(data, "g string, x double")
    got = sorted(tuple(r) for r in o.counted_ranks(df, ["g"], "x", rows_per_bucket=rows_per_bucket).collect())
    want = []
    for g in sorted({d[0] for d in data}):
        values = [x for k, x in data if k == g]
        for i, x in enumerate(sorted(set(values)), 1):
            want.append((g, x, values.count(x), sum(v <= x for v in values), i, len(values)))
    assert got == want


def test_one_value_a_million_times(spark):
    """An all-equal column is one row per group from the map side on, also while quantiles are read."""
    from fadewell.operators import blocks

    df = spark.range(1_000_000).select(F.lit("d").alias("g"), F.lit(2.5).alias("x"), "id")
    ranked = o.counted_ranks(df, ["g"], "x")
    assert [tuple(r) for r in ranked.collect()] == [("d", 2.5, 1_000_000, 1_000_000, 1, 1_000_000)]
    q = blocks.quantiles(df, "x", ["g"], [0.0, 0.3, 1.0]).collect()
    assert sorted((r["p_index"], r["q"]) for r in q) == [(0, 2.5), (1, 2.5), (2, 2.5)]
    steps = sorted((r["i"], r["x"], r["f"]) for r in blocks.step_ecdf(df, "x", ["g"]).collect())
    assert steps == [(0, 2.5, 0.0), (1, 2.5, 1.0)]
    cdf = blocks.empirical_cdf(df, "x", ["g"])
    assert cdf.agg(F.count("*"), F.countDistinct("i"), F.max("y")).first() == (1_000_000, 1_000_000, 1.0)
    parts = [r["count"] for r in cdf.groupBy(F.spark_partition_id()).count().collect()]
    assert max(parts) < 700_000  # chunks of the value are dealt out


def test_quantiles_equal_numpy(spark):
    import numpy as np

    from fadewell.operators import blocks

    rng = np.random.default_rng(1)
    values = {"a": rng.normal(size=501), "b": rng.integers(0, 4, 300).astype(float), "c": np.array([3.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("a", float("nan"))], "g string, x double")
    probs = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    for r in blocks.quantiles(df, "x", ["g"], probs).collect():
        assert abs(r["q"] - np.quantile(values[r["g"]], r["p"])) < 1e-12
