"""Queries against their SQL twins in DuckDB.

A sample of each family by default; FADEWELL_ALL_ORACLES=1 runs every query.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "a02_complex_assembly", "a12_canonical_axes", "a15_file_manifest", "b01_dataset_rules", "b07_metric_registry",
    "b13_range_text", "c03_power_delay_profile", "c05_delay_spread", "c09_path_angle_spectrum", "c20_cir_to_ctf",
    "c25_path_length_axis", "c27_analysis_points", "c32_snapshot_preparation", "d02_step_ecdf", "d08_js_distance", "e01_natural_key",
    "f01_sliding_windows", "f02_span_counts", "f07_normalize_and_back", "g04_metric_bundle", "g09_capacity_accuracy",
    "g10_gaussian_spread_cdf",
    "h01_parameter_grid", "h03_candidate_scores",
]
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("FADEWELL_ALL_ORACLES") else SAMPLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(check.cell(r[i]) for i in order) for r in cur.fetchall())
    got = sorted(tuple(check.cell(v) for v in r) for r in df.select(*columns).collect())
    assert got == want
    spark.catalog.clearCache()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
