"""Channel statistics over long path (CIR) and frequency (CTF) tables.

`D` is the dataset key; one table may hold any number of datasets. Sums are
plain aggregates with map-side combine, so a hot dataset, sample or path does
not gather its rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import (
    bin_index, circular_spread, clip_db, db, db_eps, degrees, finite_or_null, is_finite,
    peak_db, power, weighted_spread,
)
from . import signal
from .blocks import weighted_histogram
from .ordering import bounded_join, lagged, running
from .rules import uniform_spacing
from ..sources.bundles import shared_copy

D = "dataset_id"


# Fixed value: the text of the error.
INVALID_PATHS = "CIR power/delay values must be finite and nonnegative."


def valid_path():
    return F.col("path_valid") & is_finite("delay_s")


def cir_power(cir: DataFrame) -> DataFrame:
    """Linear power per sample: invalid paths count as zero power."""
    p = F.when(F.col("path_valid"), power()).otherwise(0.0)
    cells = cir.groupBy(D, "sample", "tx", "rx", "t").agg(F.sum(p).alias("p"))
    return cells.groupBy(D, "sample").agg(F.avg("p").alias("linear"))


def ctf_power(ctf: DataFrame) -> DataFrame:
    return ctf.groupBy(D, "sample").agg(F.avg(power()).alias("linear"))


def peak_normalized(rows: DataFrame, linear: str = "linear", out: str = "normalized_db") -> DataFrame:
    """dB below the dataset peak for row sets of any size.

    The rows are already reduced per sample; they are kept for the two passes.
    """
    rows = rows.persist()
    peak = rows.groupBy(D).agg(F.max(db(linear)).alias("_peak"))
    return bounded_join(rows, peak, [D]).withColumn(out, clip_db(db(linear) - F.col("_peak"))).drop("_peak")


def power_delay_profile(cir: DataFrame) -> DataFrame:
    """Mean power and power-weighted delay per path over valid rows."""
    p = power()
    paths = cir.filter(valid_path()).groupBy(D, "path").agg(
        F.avg(p).alias("linear"), F.sum(p).alias("total"),
        F.sum(F.col("delay_s") * p).alias("moment"))
    kept = paths.filter("total > 0").withColumn("delay_s", F.col("moment") / F.col("total"))
    return peak_db(kept, "linear", [D], "normalized_db").select(
        D, "path", "delay_s", "linear", "normalized_db")


def snapshot_delay_spread(cir: DataFrame, keys: list[str]) -> DataFrame:
    return cir.filter(valid_path()).groupBy(*keys).agg(weighted_spread("delay_s", power()).alias("spread_s"))


def delay_spread(cir: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """RMS delay spread per snapshot, averaged per sample."""
    keys = keys or [D, "sample"]
    by_time = snapshot_delay_spread(cir, [*keys, "t"])
    return by_time.groupBy(*keys).agg(F.avg("spread_s").alias("spread_s")).filter("spread_s IS NOT NULL")


def angle_series(cir: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Unpivot the angle columns: series, angle_rad, p with invalid rows at zero power."""
    columns = columns or {"aoa": "aoa_rad", "aod": "aod_rad"}
    pairs = F.explode(F.array(*[
        F.struct(F.lit(name).alias("series"), F.col(c).alias("angle_rad")) for name, c in columns.items()]))
    p = F.when(F.col("path_valid"), power()).otherwise(0.0)
    return cir.select(D, "sample", "path_valid", p.alias("p"), pairs.alias("a")).select(
        D, "sample", "path_valid", "p", "a.series", "a.angle_rad")


def path_angle_spectrum(cir: DataFrame) -> DataFrame:
    """Power histogram over 2-degree bins on [-180, 180] for each angle series."""
    h = weighted_histogram(angle_series(cir), degrees("angle_rad"), "p", [D, "series"],
                           F.lit(-180.0), F.lit(2.0), F.lit(180))
    # Dense grid of 180 bins per series; the grouped rows are bounded.
    packed = h.groupBy(D, "series").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "weight"))).alias("m"), F.sum("weight").alias("total"))
    grid = packed.filter("total > 0").select(
        D, "series", "m", F.explode(F.sequence(F.lit(0), F.lit(179))).alias("bin"))
    dense = grid.select(D, "series", (F.col("bin") * 2.0 - 179.0).alias("angle_deg"),
                        F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0.0)).alias("linear"))
    return peak_db(dense, "linear", [D, "series"], "normalized_db")


def angular_spread(cir: DataFrame) -> DataFrame:
    """Circular spread in degrees per sample and series."""
    rows = angle_series(cir).filter(F.col("path_valid") & is_finite("angle_rad"))
    return rows.groupBy(D, "series", "sample").agg(
        degrees(circular_spread("angle_rad", "p")).alias("spread_deg")).filter("spread_deg IS NOT NULL")


def doppler_spectrum(vectors: DataFrame, keys: list[str], spacing_s: float) -> DataFrame:
    """Hann-windowed mean periodogram on a shifted frequency axis."""
    return doppler_axis(signal.power_spectrum(vectors, keys, demean=True, hann=True, shift=True), keys, spacing_s)


def doppler_axis(s: DataFrame, keys: list[str], spacing_s: float) -> DataFrame:
    """Adds the frequency of each place of a shifted spectrum."""
    nfft = F.count(F.lit(1)).over(Window.partitionBy(*keys))  # at most nfft rows per key
    return s.withColumn("nfft", nfft).withColumn(
        "frequency_hz", (F.col("q") - F.floor(F.col("nfft") / 2)) / (F.col("nfft") * F.lit(spacing_s)))


def moment_spread(moments: DataFrame, keys: list[str], out: str) -> DataFrame:
    """RMS spread from the sums p, px and pxx of each key; keys without power are left out."""
    mean = F.col("px") / F.col("p")
    spread = F.sqrt(F.greatest(F.col("pxx") / F.col("p") - mean * mean, F.lit(0.0)))
    return moments.filter("p > 0").select(*keys, spread.alias(out)).filter(F.col(out).isNotNull())


def doppler_spread(vectors: DataFrame, keys: list[str], spacing_s: float) -> DataFrame:
    return moment_spread(signal.doppler_moments(vectors, keys, spacing_s), keys, "spread_hz")


def beam_spread(vectors: DataFrame, keys: list[str], spacing_wavelengths: float) -> DataFrame:
    return moment_spread(signal.beam_moments(vectors, keys, spacing_wavelengths, list(range(-90, 91))), keys, "spread_deg")


def delay_sample_heatmap(cir: DataFrame) -> DataFrame:
    """Power per sample on one common delay grid of 64 to 256 bins."""
    valid = valid_path() & is_finite(power())
    cells = cir.groupBy(D, "path", "t").agg(
        F.min(F.when(valid, F.col("delay_s"))).alias("lo"), F.max(F.when(valid, F.col("delay_s"))).alias("hi"))
    limits = cells.groupBy(D).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                  F.countDistinct("path").alias("paths"), F.countDistinct("t").alias("times"))
    pad = F.when(F.col("hi") <= F.col("lo"),
                 F.greatest(F.abs("lo") * 1e-6, F.lit(1e-12))).otherwise(0.0)
    grid = limits.filter("lo IS NOT NULL").select(
        D, (F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi"),
        F.least(F.greatest("paths", F.lit(64)), F.lit(256)).cast("int").alias("bins"), "times")
    grid = grid.withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    rows = bounded_join(cir.filter(valid), grid, [D])
    binned = rows.groupBy(
        D, "sample", "lo", "width", "bins", "times",
        bin_index("delay_s", F.col("lo"), F.col("width"), F.col("bins")).alias("bin"),
    ).agg(F.sum(power()).alias("p"))
    # At most 256 cells per sample are packed; they are read for the peak and for the grid, and unfold last.
    per_sample = shared_copy(binned.groupBy(D, "sample", "lo", "width", "bins", "times").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "p"))).alias("m")), "heatmap")
    peak = per_sample.groupBy(D).agg(F.max(db(F.array_max(F.map_values("m")) / F.col("times"))).alias("_peak"))
    dense = bounded_join(per_sample, peak, [D]).withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1))).select(
        D, "sample", "bin", (F.col("lo") + (F.col("bin") + 0.5) * F.col("width")).alias("delay_s"),
        (F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0.0)) / F.col("times")).alias("linear"), "_peak")
    return dense.withColumn("normalized_db", clip_db(db("linear") - F.col("_peak"))).drop("_peak")


def cir_to_ctf(cir: DataFrame, offsets_hz: list[float]) -> DataFrame:
    """Sum of rotated path coefficients at each frequency offset.

    A row gets the sums of FREQUENCIES_AT_ONCE offsets side by side; only one such row per observation and
    block of offsets shuffles.
    """
    return _long_cells(*_offset_sums(cir, offsets_hz))


def _offset_sums(cir: DataFrame, offsets_hz: list[float]) -> tuple[DataFrame, Column, int]:
    """The sums of _rotated, their grid and the number of offsets side by side."""
    cells = ", ".join(f"named_struct('f', {i}, 'hz', {float(x)!r}D)" for i, x in enumerate(offsets_hz))
    grid = F.expr(f"array({cells})")
    blocks = max(1, -(-len(offsets_hz) // FREQUENCIES_AT_ONCE))
    at_once = max(1, -(-len(offsets_hz) // blocks))  # no more sums than there are offsets
    return _rotated(cir, grid, at_once), grid, at_once


def cir_to_ctf_blocks(cir: DataFrame, offsets_hz: list[float]) -> DataFrame:
    """The sums of cir_to_ctf with f, re and im of a block of offsets as arrays side by side."""
    sums, grid, at_once = _offset_sums(cir, offsets_hz)
    f = F.slice(grid["f"], F.col("_block") * at_once + 1, at_once)
    cut = lambda c: F.slice(c, 1, F.size("f")).alias(c[1:])
    return sums.withColumn("f", f).select(D, "sample", "tx", "rx", "t", "f", cut("_re"), cut("_im"))


def cir_to_ctf_on_axis(cir: DataFrame, axis: DataFrame) -> DataFrame:
    """The same on each dataset's own axis (dataset_id, f, offset_hz); adds the axis spacing.

    The spacing is the median step of the axis itself. Datasets without an axis are left out.
    """
    steps = uniform_spacing(axis, [D], "offset_hz", "f").select(D, F.col("spacing").alias("spacing_hz"))
    cells = axis.groupBy(D).agg(F.array_sort(F.collect_list(F.struct("f", F.col("offset_hz").alias("hz")))).alias("_axis"))
    sums = _rotated(bounded_join(cir, cells, [D]), F.col("_axis"))
    h = _long_cells(bounded_join(sums, cells, [D]), F.col("_axis"))
    return bounded_join(h, steps, [D])


FREQUENCIES_AT_ONCE = 8


def _rotated(cir: DataFrame, grid: Column, at_once: int = FREQUENCIES_AT_ONCE) -> DataFrame:
    """Sums of each observation in blocks of the grid: _block, _re and _im of its cells in order."""
    blocks = F.when(F.size(grid) > 0, F.sequence(F.lit(0), F.floor((F.size(grid) - 1) / at_once).cast("int")))
    rows = cir.filter("path_valid").select(
        D, "sample", "tx", "rx", "t", "re", "im", "delay_s", grid.alias("_grid"), F.explode(blocks).alias("_block"))
    re, im = [], []
    for i in range(at_once):
        angle = -2 * F.pi() * F.get("_grid", F.col("_block") * at_once + i)["hz"] * F.col("delay_s")
        c, s = F.cos(angle), F.sin(angle)
        re.append(F.sum(F.col("re") * c - F.col("im") * s))
        im.append(F.sum(F.col("re") * s + F.col("im") * c))
    return rows.groupBy(D, "sample", "tx", "rx", "t", "_block").agg(F.array(*re).alias("_re"), F.array(*im).alias("_im"))


def _long_cells(sums: DataFrame, grid: Column, at_once: int = FREQUENCIES_AT_ONCE) -> DataFrame:
    """One row per observation and grid cell."""
    cells = F.slice(grid, F.col("_block") * at_once + 1, at_once)
    return sums.select(D, "sample", "tx", "rx", "t", "_re", "_im", F.posexplode(cells).alias("_i", "_c")).select(
        D, "sample", "tx", "rx", "t", F.col("_c.f").alias("f"), F.get("_re", F.col("_i")).alias("re"), F.get("_im", F.col("_i")).alias("im"))


def narrowband(cir: DataFrame) -> DataFrame:
    """Complex sum of the valid paths of each observation."""
    def part(c):
        return F.sum(F.when(F.col("path_valid"), F.col(c)).otherwise(0.0)).alias(c)
    return cir.groupBy(D, "sample", "tx", "rx", "t").agg(part("re"), part("im"))


def centred_offsets(count: int, spacing_hz: float) -> list[float]:
    return [(i - (count - 1) / 2) * spacing_hz for i in range(count)]


def frequency_axis(datasets: DataFrame) -> DataFrame:
    """Absolute axis per dataset from count, centre and spacing columns."""
    ok = "n_f > 1 AND spacing_hz > 0 AND center_hz IS NOT NULL"
    f = F.explode(F.sequence(F.lit(0), F.col("n_f").cast("int") - 1))
    return datasets.filter(ok).select("*", f.alias("f")).select(
        D, "f", ((F.col("f") - (F.col("n_f") - 1) / 2.0) * F.col("spacing_hz")).alias("offset_hz")
    ).join(datasets.select(D, "center_hz"), D).withColumn("frequency_hz", F.col("center_hz") + F.col("offset_hz"))


def time_axis(axis: DataFrame, interval_s: Column) -> DataFrame:
    """Adds x, the given time_s or else the index times the interval, per dataset; and whether it was given."""
    given = F.col("time_s").isNotNull()
    return axis.withColumns({"x": F.coalesce("time_s", F.col("t") * interval_s), "explicit": given})


def discrete_delay(n: int, spacing_hz: float):
    return F.col("tap") / F.lit(n * spacing_hz)


def path_length_axis(points: DataFrame, group: list[str], pos: str, dims: list[str]) -> DataFrame:
    """Sample axis in metres: position itself in 1-D, else cumulative path length."""
    if len(dims) == 1:
        return points.withColumn("x", F.col(dims[0]))
    prior = lagged(points, group, pos, {f"_prev_{d}": d for d in dims})
    squares = [F.pow(F.col(d) - F.col(f"_prev_{d}"), 2) for d in dims]
    step = F.coalesce(F.sqrt(sum(squares[1:], squares[0])), F.lit(0.0))
    return running(prior.withColumn("_step", step), group, pos, {"x": ("sum", "_step")}).drop(
        "_step", *[f"_prev_{d}" for d in dims])


# ---- power profiles in dBm -------------------------------------------------

def mean_profile(dpsd: DataFrame, bandwidth_hz: float) -> DataFrame:
    """Mean linear power per bin in display dB against delay."""
    m = dpsd.groupBy(D, "bin").agg(F.avg(F.pow(F.lit(10.0), F.col("dbm") / 10)).alias("linear"))
    return m.select(D, "bin", (F.col("bin") / F.lit(bandwidth_hz) * 1e9).alias("delay_ns"),
                    db_eps("linear").alias("profile_db"))


def profile_delay_spread(dpsd: DataFrame, bandwidth_hz: float, linear=None) -> DataFrame:
    """sqrt(|E[tau^2] - E[tau]^2|) per snapshot; zero power gives zero."""
    p = F.pow(F.lit(10.0), F.col("dbm") / 10) if linear is None else linear
    bad = F.raise_error(F.lit("profile values must not be negative")).cast("double")
    p = F.when(p < 0, bad).otherwise(p)
    tau = F.col("bin") / F.lit(bandwidth_hz)
    total = F.sum(p)
    spread = F.sqrt(F.abs(F.sum(tau * tau * p) / total - F.pow(F.sum(tau * p) / total, 2)))
    return dpsd.groupBy(D, "snapshot").agg(
        F.when(total == 0, 0.0).otherwise(spread).alias("spread_s"))


def clean_dbm(dpsd: DataFrame) -> DataFrame:
    return dpsd.withColumn("dbm", F.coalesce(finite_or_null("dbm"), F.lit(-130.0)))


def pad_bins(dpsd: DataFrame, keys: list[str], length: int) -> DataFrame:
    """Exactly `length` bins per key: cut the rest, fill gaps with -130 dBm."""
    cut = dpsd.filter(F.col("bin") < length)
    packed = cut.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "dbm"))).alias("m"))
    return packed.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).select(
        *keys, "bin", F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(-130.0)).alias("dbm"))


def series_spectrum(series: DataFrame, n: int) -> DataFrame:
    """Peak-normalized spectrum of one demeaned series on an axis from -1 to 1.

    `series` holds a 0-based k and a value x; the series may be of any length.
    """
    mean = series.agg(F.avg("x").alias("_m")).first()["_m"]
    centred = series.select("k", (F.col("x") - F.lit(mean)).alias("re"), F.lit(0.0).alias("im"))
    nfft = signal.next_pow2(n)
    y = signal.long_fft(centred, n).withColumn("p", power()).persist()
    top = y.agg(F.max("p").alias("top")).first()["top"]
    at = F.pmod(F.col("q") + nfft // 2, F.lit(nfft))
    return y.select(
        at.cast("long").alias("q"), (-1 + 2 * at / F.lit(max(nfft - 1, 1))).alias("x"),
        db_eps(F.col("p") / F.lit(top)).alias("spectrum_db"))


def antenna_fft_spectrum(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """128-point spatial spectrum, mean over observations, peak at 0 dB."""
    s = signal.power_spectrum(vectors, keys, demean=False, hann=False, shift=True, nfft=128)
    level = db_eps("power")
    top = F.max(level).over(Window.partitionBy(*keys))  # 128 rows per key
    return s.select(*keys, "q", (-90 + F.col("q") * F.lit(180.0 / 127)).alias("angle_deg"),
                    (level - top).alias("spectrum_db"))


def frozen_grid_features(cir: DataFrame, keys: list[str], grid: DataFrame) -> DataFrame:
    """Profile on a frozen delay grid with an overflow bin, RMS delay, overflow share.

    Path power is summed and path delay averaged over all rows; the valid mask
    is not used. `grid` has dataset_id, finite_max, bins. Gives keys, bin
    (0..bins, the last is overflow), pdp, rms_delay_s, overflow_fraction. A
    path whose power or delay is negative or not finite is an error.
    """
    sums = cir.groupBy(*keys, "path").agg(F.sum(power()).alias("p"), F.avg("delay_s").alias("d"))
    sound = is_finite("p") & is_finite("d") & (F.col("p") >= 0) & (F.col("d") >= 0)
    paths = sums.withColumn("d", F.when(sound, F.col("d")).otherwise(F.raise_error(F.lit(INVALID_PATHS)).cast("double")))
    eps = F.lit(2.220446049250313e-16)
    placed = bounded_join(paths, grid, [D]).withColumn(
        "bin", F.when(F.col("d") >= F.col("finite_max"), F.col("bins")).otherwise(
            F.least(F.floor(F.col("d") / (F.col("finite_max") / F.col("bins"))).cast("int"), F.col("bins") - 1)))
    total = F.sum("p")
    mean = F.sum(F.col("p") * F.col("d")) / F.greatest(total, eps)
    moment2 = F.sum(F.col("p") * F.col("d") * F.col("d")) / F.greatest(total, eps)
    facts = placed.groupBy(*keys).agg(
        total.alias("total"), F.sqrt(F.greatest(moment2 - mean * mean, F.lit(0.0))).alias("rms_delay_s"),
        (F.sum(F.when(F.col("bin") == F.col("bins"), F.col("p")).otherwise(0.0)) / F.greatest(total, eps)
         ).alias("overflow_fraction"))
    bins = placed.groupBy(*keys, "bin").agg(F.sum("p").alias("binned"))
    return bins.join(facts, keys).select(
        *keys, "bin", (F.col("binned") / F.greatest("total", eps)).alias("pdp"), "rms_delay_s", "overflow_fraction")


def delay_grid(truth: DataFrame, headroom: float = 0.2, bins: int = 64) -> DataFrame:
    """Frozen delay grid from validation truth only: one row per dataset."""
    return truth.groupBy(D).agg(F.greatest(F.lit(1e-9), F.max("delay_s") * (1 + headroom)).alias("finite_max")).withColumn(
        "bins", F.lit(bins))


def prepare_snapshots(vectors: DataFrame, keys: list[str], length: int) -> DataFrame:
    """dBm profile of `length` bins per snapshot from antenna vectors (keys, f, re, im, scenario).

    RIS sums the antennas and transforms to delay, Sub-6 sums antenna power,
    every other scenario keeps the first antenna.
    """
    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    squares = F.zip_with("re", "im", lambda a, b: a * a + b * b)
    per_f = vectors.select(*keys, "f", "scenario", total("re").alias("re"), total("im").alias("im"),
                           F.when(F.col("scenario").contains("Sub-6"), total(squares))
                           .otherwise(squares[0]).alias("w"))
    ris = per_f.filter(F.col("scenario").contains("RIS"))
    taps = signal.inverse_dft(signal.pack_axis(ris, keys, "f"), keys)
    ris_power = signal.unpack_axis(taps, keys, "bin").select(*keys, "bin", power().alias("w"))
    other = per_f.filter(~F.col("scenario").contains("RIS")).select(*keys, F.col("f").alias("bin"), "w")
    levels = ris_power.unionByName(other).select(*keys, "bin", db_eps(F.col("w") / 1e-3).alias("dbm"))
    return pad_bins(levels, keys, length)


def profile_from_taps(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """FFT over the delay taps of every snapshot, power in dBm."""
    y = signal.map_vectors(vectors, keys, signal.plain_fft)
    return signal.unpack_axis(y, keys, "bin").select(*keys, "bin", db_eps(power() / 1e-3).alias("dbm"))
