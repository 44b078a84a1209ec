import numpy as np
import pytest
from pyspark.sql import functions as F

from fadewell.operators import metrics, signal

RNG = np.random.default_rng(3)
X = RNG.normal(size=(40, 12)) + 1j * RNG.normal(size=(40, 12))


@pytest.fixture(scope="module")
def vectors(spark):
    data = [("a" if i % 3 else "b", i, X[i].real.tolist(), X[i].imag.tolist()) for i in range(len(X))]
    return spark.createDataFrame(data, "dataset_id string, obs int, re array<double>, im array<double>").repartition(3)


def side(name):
    return X[[i for i in range(len(X)) if ("a" if i % 3 else "b") == name]]


def test_autocorrelation_matches_definition(vectors):
    rows = signal.autocorrelation(vectors, ["dataset_id"]).collect()
    assert len(rows) == 24
    for r in rows:
        x = side(r["dataset_id"])
        left, right = x[:, :12 - r["lag"]], x[:, r["lag"]:]
        want = np.mean(left * right.conj()) / np.sqrt(np.mean(abs(left) ** 2) * np.mean(abs(right) ** 2))
        assert abs(complex(r["re"], r["im"]) - want) < 1e-12
        if r["lag"] == 0:
            assert r["magnitude"] == pytest.approx(1.0)


def test_doppler_spectrum_matches_definition(vectors):
    got = metrics.doppler_spectrum(vectors, ["dataset_id"], 0.01).filter("dataset_id = 'a'").orderBy("q").collect()
    x = side("a")
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(12) / 11)
    y = np.fft.fftshift(np.fft.fft((x - x.mean(axis=1, keepdims=True)) * w, 16, axis=1), axes=1)
    want = (abs(y) ** 2 / np.sum(w**2)).mean(axis=0)
    assert np.allclose([r["power"] for r in got], want)
    assert np.allclose([r["frequency_hz"] for r in got], np.arange(-8, 8) / 0.16)


def test_spatial_correlation_has_unit_diagonal(vectors):
    got = {(r["i"], r["j"]): complex(r["re"], r["im"])
           for r in signal.correlation_matrix(vectors, ["dataset_id"]).filter("dataset_id = 'b'").collect()}
    x = side("b")
    m = x.T @ x.conj() / len(x)
    d = np.sqrt(np.real(np.diag(m)))
    for (i, j), v in got.items():
        assert abs(v - m[i, j] / (d[i] * d[j])) < 1e-12
    assert all(abs(got[i, i] - 1) < 1e-12 for i in range(12))


def test_inverse_dft_round_trip_and_pack(spark, vectors):
    h = signal.inverse_dft_shifted(vectors.select("obs", "re", "im"), ["obs"])
    long_rows = signal.unpack_axis(h, ["obs"], "tap")
    back = {r["obs"]: np.array(r["re"]) + 1j * np.array(r["im"]) for r in signal.pack_axis(long_rows, ["obs"], "tap").collect()}
    for i in (0, 7, 39):
        assert np.allclose(back[i], np.fft.ifft(np.fft.ifftshift(X[i])))


@pytest.mark.parametrize("n", [2, 8, 37, 1000])
def test_long_fft_matches_numpy(spark, n):
    x = RNG.normal(size=n)
    s = spark.createDataFrame([(i, float(v), 0.0) for i, v in enumerate(x)], "k long, re double, im double")
    got = signal.long_fft(s, n).orderBy("q").collect()
    want = np.fft.fft(x, signal.next_pow2(n))
    assert [r["q"] for r in got] == list(range(len(want)))
    assert np.allclose([complex(r["re"], r["im"]) for r in got], want)


def test_beam_peaks_at_the_arrival_angle(spark):
    e = np.exp(2j * np.pi * 0.5 * np.arange(8) * np.sin(np.deg2rad(25)))
    v = spark.createDataFrame([("d", e.real.tolist(), e.imag.tolist())], "dataset_id string, re array<double>, im array<double>")
    top = signal.beam_power(v, ["dataset_id"], 0.5, list(range(-90, 91))).orderBy(F.desc("power")).first()
    assert top["angle"] == 25


def test_long_fft_of_a_million_values_in_bounded_pieces(spark, monkeypatch):
    """A million values; the dense block that a call holds stays within its limit."""
    from pyspark.sql import functions as F

    n = 1_000_000
    s = spark.range(n).select(F.col("id").alias("k"), (F.pmod(F.col("id") * 7919, F.lit(1009)) / 1009 - 0.5).alias("re"), F.lit(0.0).alias("im"))
    k = np.arange(n)
    want = np.fft.fft((k * 7919 % 1009) / 1009 - 0.5, signal.next_pow2(n))
    got = signal.long_fft(s, n).toPandas().sort_values("q")
    assert np.allclose(got["re"].to_numpy() + 1j * got["im"].to_numpy(), want, atol=1e-6)
    made = []
    real = np.zeros
    monkeypatch.setattr(signal, "FFT_VALUES", 4096)
    monkeypatch.setattr(signal.np, "zeros", lambda shape, **k: (made.append(int(np.prod(shape))), real(shape, **k))[1])
    import pyarrow as pa

    cells = pa.array([[{"at": i, "re": 1.0, "im": 0.0}] for i in range(100)], pa.list_(pa.struct([("at", pa.int64()), ("re", pa.float64()), ("im", pa.float64())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), cells], names=["piece", "cells"])
    out = list(signal._pieces_fft(iter([batch]), 1024, 1 << 20, True))
    assert sum(b.num_rows for b in out) == 100 and max(made) <= 4096


def test_spread_per_sample_keeps_three_sums_and_matches_the_spectrum(vectors):
    keys = ["dataset_id", "obs"]
    sums = signal.beam_moments(vectors, keys, 0.5, list(range(-90, 91)))
    assert sums.count() == len(X)  # one row a sample, not one for each angle
    got = {r["obs"]: r["spread_deg"] for r in metrics.beam_spread(vectors, keys, 0.5).collect()}
    angles = np.arange(-90, 91)
    steer = np.exp(2j * np.pi * 0.5 * np.outer(np.arange(12), np.sin(np.deg2rad(angles)))) / np.sqrt(12)
    for i in (0, 7, 39):
        p = abs(X[i] @ steer.conj()) ** 2
        mean = p @ angles / p.sum()
        assert got[i] == pytest.approx(np.sqrt(p @ (angles - mean) ** 2 / p.sum()))


def test_vectors_of_every_axis_come_from_packed_samples_without_a_shuffle(spark):
    from pyspark.errors import PythonException

    from fadewell.plans import analysis

    cells = [("a", s, 0, r, f, t, float(100 * s + 10 * r + t), float(f)) for s in (1, 2) for r in (0, 1) for f in (3, 5) for t in (0, 2, 4) if (s, t) != (2, 2)]
    rows = spark.createDataFrame([*cells, ("b", 1, None, 0, 0, 9, 7.0, None)], "dataset_id string, sample long, tx int, rx int, f int, t int, re double, im double")
    packed = analysis.sample_cells(rows)
    found = analysis.cell_vectors(packed, "t")
    assert "Exchange hashpartitioning(dataset_id" not in found._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    got = {(r["dataset_id"], r["sample"], r["tx"], r["rx"], r["f"]): (r["re"], r["im"]) for r in found.collect()}
    assert len(got) == 9 and got["a", 2, 0, 1, 5] == ([210.0, 0.0, 214.0], [5.0, 0.0, 5.0]) and got["b", 1, None, 0, 0] == ([7.0], [0.0])
    assert {len(r["re"]) for r in analysis.cell_vectors(packed, "rx").filter("dataset_id = 'a'").collect()} == {2}
    with pytest.raises(PythonException, match="twice"):
        analysis.complete_vectors(rows.union(rows), "t").collect()


def test_rows_are_laid_out_in_slices_of_bounded_cells(monkeypatch):
    import pyarrow as pa

    lists = [[{"f": list(range(3)), "re": [1.0] * 3} for _ in range(n)] for n in (4, 1, 30, 2, 0, 5)]
    cells = pa.array(lists, pa.list_(pa.struct([("f", pa.list_(pa.int32())), ("re", pa.list_(pa.float64()))])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), cells], names=["sample", "cells"])
    monkeypatch.setattr(signal, "CELLS_AT_ONCE", 21)
    cut = [part.column("sample").to_pylist() for part in signal._row_slices(batch)]
    assert cut == [[0, 1], [2], [3, 4, 5]]  # 15 cells, one row of 90, 21 cells
    monkeypatch.setattr(signal, "CELLS_AT_ONCE", 10**6)
    assert [p.num_rows for p in signal._row_slices(batch)] == [6]


def test_sums_of_every_axis_come_from_one_pass_and_match_the_vectors(spark):
    from fadewell.operators import metrics
    from fadewell.plans import analysis

    rng = np.random.default_rng(5)
    cells = [(d, s, a, b, f, t, float(rng.normal()), float(rng.normal())) for d, n in (("a", 7), ("b", 3)) for s in range(n)
             for a in range(2) for b in range(3 if d == "a" else 1) for f in range(4) for t in range(5) if (s + a + t) % 6]
    schema = "dataset_id string, sample long, tx int, rx int, f int, t int, re double, im double"
    rows = spark.createDataFrame(cells, schema)
    side = rows.orderBy("f").groupBy("dataset_id", "sample", "tx", "rx", "t").agg(
        F.array_sort(F.collect_list(F.struct("f", "re", "im"))).alias("c")).select(
        "dataset_id", "sample", "tx", "rx", "t", "c.f", "c.re", "c.im")
    caps = spark.createDataFrame([("a", 2, 3, False, False, True), ("b", 2, 1, False, True, True)],
                                 "dataset_id string, n_tx int, n_rx int, has_angles boolean, tx_ula boolean, rx_ula boolean")
    plain = analysis.sample_cells(rows)
    near = lambda df, *keys: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*keys).collect())
    for packed in (plain, analysis.sample_cells(side)):
        sums = analysis.channel_sums(packed, caps, 1e-3, 1e5, 0.5)
        for axis in ("t", "f"):
            want = signal.autocorrelation(analysis.cell_vectors(plain, axis), ["dataset_id"])
            got = signal.normalized_lags(signal.named_sums(sums, f"lags {axis}", ["dataset_id"], signal.LAG_SUMS), ["dataset_id"])
            assert near(got, "dataset_id", "lag", "re", "im") == near(want, "dataset_id", "lag", "re", "im")
        keys = ["dataset_id", "sample"]
        want = metrics.doppler_spread(analysis.cell_vectors(plain, "t"), keys, 1e-3)
        got = metrics.moment_spread(signal.named_sums(sums, "doppler moments", keys, signal.MOMENTS, True), keys, "spread_hz")
        assert len(near(got, *keys, "spread_hz")) == 10 and near(got, *keys, "spread_hz") == near(want, *keys, "spread_hz")
        want = signal.correlation_matrix(analysis.cell_vectors(plain, "tx"), ["dataset_id"])
        got = signal.correlation_from(signal.named_sums(sums, "correlation tx", ["dataset_id"], signal.CORRELATION_SUMS), ["dataset_id"])
        assert near(got, "dataset_id", "i", "j", "n_rows", "re", "im") == near(want, "dataset_id", "i", "j", "n_rows", "re", "im")
        named = {(r["dataset_id"], r["name"]) for r in sums.select("dataset_id", "name").distinct().collect()}
        assert {n for d, n in named if d == "a"} == {"doppler", "lags t", "lags f", "doppler moments", "correlation tx", "correlation rx", "beams rx", "beam moments rx"}
        assert {n for d, n in named if d == "b"} == {"doppler", "lags t", "lags f", "doppler moments", "correlation tx", "beams tx", "beam moments tx"}


def test_python_workers_are_handed_bounded_batches(spark):
    from fadewell.sources import bundles

    def run(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    before = spark.conf.get(bundles.ARROW_ROWS)
    sizes = [r["n"] for r in bundles.shared_copy(spark.range(0, 1000, 1, 2).mapInArrow(run, "n long"), "sizes", 70).collect()]
    assert sum(sizes) == 1000 and max(sizes) == 70 and spark.conf.get(bundles.ARROW_ROWS) == before


def test_points_read_sums_and_run_no_python(spark):
    from fadewell.plans import analysis, queries_analysis, views

    folder = "/root/testdata/sf0.001"
    cir = views.cir(spark, folder)
    points, _ = analysis.analyze(cir, queries_analysis.metadata(cir, False), spacing_s=1e-3, offsets_hz=[-1e5, 0.0, 1e5])
    plan = points._jdf.queryExecution().optimizedPlan().toString()
    assert "MapIn" not in plan and "time_autocorrelation" in plan
