import hashlib

import pytest
from pyspark.sql import functions as F

from fadewell.functions import text
from fadewell.operators import tensors
from fadewell.sources import bundles, files

D = "dataset_id"


def test_writer_refuses_to_overwrite(spark):
    folder = bundles.scratch_folder(spark, "t")
    df = spark.range(3)
    bundles.write_table(df, folder)
    with pytest.raises(Exception, match="(?i)exist"):
        bundles.write_table(df, folder)
    assert spark.read.parquet(folder).count() == 3


def test_profile_folder_uses_natural_name_order(spark, tmp_path):
    for k in (1, 2, 10, 11):
        name = tmp_path / f"w{k}"
        spark.createDataFrame([([float(k)] * 4,)], "dbm array<double>").coalesce(1).write.parquet(str(name))
        part = next(name.glob("part-*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / "in" / f"s{k}.parquet")
    got = files.profile_folder(spark, str(tmp_path / "in")).orderBy("snapshot").collect()
    assert [r["name"] for r in got] == ["s1.parquet", "s2.parquet", "s10.parquet", "s11.parquet"]
    assert [r["dbm"][0] for r in got] == [1, 2, 10, 11] and {r["lengths"] for r in got} == {1}


def test_manifest_of_real_files(spark, tmp_path):
    for k in ("b", "a"):
        (tmp_path / f"{k}.bin").write_bytes(k.encode() * 3)
    rows = files.binary_listing(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    m = files.manifest_digest(rows.withColumn(D, F.lit("d"))).first()
    lines = [f"{hashlib.sha256(k.encode() * 3).hexdigest()}  3  {k}.bin" for k in ("a", "b")]
    assert (m["file_count"], m["total_bytes"]) == (2, 6)
    whole = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert m["aggregate_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    two = files.manifest_digest(rows.withColumn(D, F.lit("d")), files_per_digest=1).first()
    parts = "\n".join(hashlib.sha256(x.encode()).hexdigest() for x in lines)
    assert two["aggregate_sha256"] == hashlib.sha256(parts.encode()).hexdigest()


def test_failed_analysis_is_not_exported(spark):
    status = spark.createDataFrame([("d", "FAIL", "pdp", True, "")], "dataset_id string, status string, metric string, available boolean, reason string")
    points = spark.createDataFrame([], "dataset_id string, metric string, series string, x double, y double")
    tasks = spark.createDataFrame([("d", "t")], "dataset_id string, task string")
    with pytest.raises(Exception, match="failed analysis"):
        bundles.analysis_export(status, points, tasks).collect()


def test_pair_file_with_wrong_partition_raises(spark):
    folder = bundles.write_pairs_csv(spark.createDataFrame([("test", 1)], "split_part string, x int"), bundles.scratch_folder(spark, "p"))
    with pytest.raises(Exception, match="wrong partition"):
        bundles.read_pairs_csv(spark, folder, "split_part string, x int", "validation").collect()


def test_flatten_and_unflatten_are_inverse(spark):
    flat = spark.createDataFrame([(1, [float(i) for i in range(24)])], "k int, v array<double>")
    u = tensors.unflatten(flat, ["k"], "v", [2, 3, 4], ["a", "b", "c"])
    assert u.filter("a = 1 AND b = 2 AND c = 3").first()["value"] == 23.0
    assert u.filter("a = 1 AND b = 0 AND c = 2").first()["value"] == 13.0
    assert tensors.flatten(u, ["k"], ["a", "b", "c"], [2, 3, 4], "value").first()["values"] == [float(i) for i in range(24)]
    with pytest.raises(Exception, match="24 values"):
        tensors.unflatten(flat.withColumn("v", F.slice("v", 1, 23)), ["k"], "v", [2, 3, 4], ["a", "b", "c"]).collect()


def test_padding_and_combination(spark):
    schema = "dataset_id string, sample int, path int, re double, im double, delay_s double, path_valid boolean"
    a = spark.createDataFrame([("d", 1, 3, 1.0, 0.0, 1e-9, True), ("d", 1, 5, 2.0, 0.0, 2e-9, True)], schema)
    b = spark.createDataFrame([("d", 1, 1, 7.0, 0.0, 3e-9, True)], schema)
    c = tensors.combine_targets([b, a], ["first", "second"], ["aoa_rad"], ["sample"]).orderBy("target", "path").collect()
    assert [(r["target_name"], r["path"], r["re"], r["path_valid"]) for r in c] == [
        ("first", 1, 7.0, True), ("first", 2, 0.0, False), ("second", 1, 1.0, True), ("second", 2, 2.0, True)]
    with pytest.raises(ValueError):
        tensors.combine_targets([a], ["first", "second"], [], ["sample"])


def test_legacy_time_needs_an_interval(spark):
    with pytest.raises(ValueError):
        tensors.remap_legacy(spark.range(1).withColumnRenamed("id", "seq"), "time")


def test_natural_order_and_names(spark):
    names = spark.createDataFrame([(n,) for n in ("f10.mat", "F2.mat", "f1.mat", "f002b.mat")], "n string")
    assert [r["n"] for r in names.orderBy(text.natural_key("n")).collect()] == ["f1.mat", "F2.mat", "f002b.mat", "f10.mat"]
    row = spark.createDataFrame([("Pol_V_x_SAGE_f28_trajA_w3",), ("plain",)], "stem string").select(
        *[v.alias(k) for k, v in text.name_tokens("stem").items()]).collect()
    assert tuple(row[0]) == ("Pol_V", "f28", "trajA", "w3")
    assert set(row[1]) == {"unspecified"}


def test_last_scenario_rule_wins(spark):
    row = spark.createDataFrame([("mmWave UAV over sea, IoT",), ("nothing",)], "s string").select(
        text.band("s").alias("b"), text.scenario("s").alias("c")).collect()
    assert tuple(row[0]) == ("mmWave", "Industrial IoT")
    assert row[1]["b"] is None
