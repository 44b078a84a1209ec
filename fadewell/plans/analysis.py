"""Full characterization of path tables: points, status and registry in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import peak_db
from ..operators import blocks, metrics, rules, signal
from ..sources import bundles

D = metrics.D


def describe(cir: DataFrame, metadata: DataFrame) -> DataFrame:
    """Measured dimensions joined with the metadata flags of each dataset."""
    dims = rules.dataset_summary(cir)
    return dims.join(metadata, D).withColumn("domain", F.lit("cir")).withColumn(
        "n_f", F.coalesce("n_f", F.lit(1)))


INNER = ["tx", "rx", "f", "t"]
CELL_ROWS = 2_000  # packed samples that a Python worker is handed at a time
ANGLES = list(range(-90, 91))


def sample_cells(channel: DataFrame) -> DataFrame:
    """The channel with the cells of a sample in one row, as many as its instrument axes give.

    f, re and im are single cells or arrays of cells side by side. Written to the shared folder: the vectors
    along every axis are cut from these rows without a shuffle.
    """
    def numbers(name):
        many = isinstance(channel.schema[name].dataType, T.ArrayType)
        return F.col(name).cast("array<double>" if many else "double").alias(name)

    cell = F.struct(*INNER, numbers("re"), numbers("im"))
    return bundles.shared_copy(channel.groupBy(D, "sample").agg(F.collect_list(cell).alias("cells")), "channel")


def cell_places(packed: DataFrame) -> DataFrame:
    """The sorted places of every instrument axis of each dataset, from one pass: dataset_id and _places_<axis>.

    The places are those of one instrument axis, so each list is as small as one vector.
    """
    types = {f.name: f.dataType for f in packed.schema["cells"].dataType.elementType.fields}
    lists = {a: F.flatten(f"cells.{a}") if isinstance(types[a], T.ArrayType) else F.col(f"cells.{a}") for a in INNER}
    at = packed.select(D, F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.array_distinct(v).alias("at")) for a, v in lists.items()])).alias("v"))
    distinct = at.select(D, "v.axis", F.explode("v.at").alias("at")).distinct()  # few rows leave a task
    return distinct.groupBy(D).agg(*[F.array_sort(F.collect_list(F.when(F.col("axis") == a, F.col("at")))).alias(f"_places_{a}") for a in INNER])


def cell_vectors(packed: DataFrame, axis: str) -> DataFrame:
    """Vectors along one axis of the channel over all its places in the dataset; missing cells are zero."""
    places = cell_places(packed).select(D, f"_places_{axis}")
    return signal.axis_vectors(metrics.bounded_join(packed, places, [D]), [D, "sample"], INNER, axis, f"_places_{axis}")


def complete_vectors(channel: DataFrame, axis: str) -> DataFrame:
    return cell_vectors(sample_cells(channel), axis)


def points(metric: str, df: DataFrame, x, y, series="") -> DataFrame:
    s = F.col(series) if series else F.lit("")
    return df.select(D, F.lit(metric).alias("metric"), s.cast("string").alias("series"),
                     x.cast("double").alias("x"), y.cast("double").alias("y"))


def discrete_cir(packed: DataFrame, step_hz: float) -> DataFrame:
    """Delay taps of a frequency response (sample_cells) as path rows without angles: path is the tap."""
    keys = [D, "sample", "tx", "rx", "t"]
    transformed = signal.inverse_dft_shifted(cell_vectors(packed, "f"), keys).withColumn("_n", F.size("re"))  # a vector has all places
    none = F.lit(None).cast("double")
    taps = transformed.select(*keys, "_n", F.posexplode(F.arrays_zip("re", "im")).alias("path", "v"))
    return taps.select(
        *keys, "path", "v.re", "v.im", (F.col("path") / (F.col("_n") * F.lit(step_hz))).alias("delay_s"),
        F.col("v.re").isNotNull().alias("path_valid"), none.alias("aoa_rad"), none.alias("aod_rad"))


def channel_sums(packed: DataFrame, caps: DataFrame, spacing_s: float, step_hz: float | None,
                 element_wavelengths: float | None) -> DataFrame:
    """What the channel metrics need of every vector, from one pass over the packed samples (signal.axis_sums).

    Written to the shared folder, since each metric reads its own rows; only sums are in it.
    """
    c = F.col
    sums = [signal.AxisSum("doppler", "t", signal.doppler_power), signal.AxisSum("lags t", "t", signal.lag_products),
            signal.AxisSum("doppler moments", "t", signal.doppler_moment_kernel(spacing_s), True)]
    if step_hz:
        sums.append(signal.AxisSum("lags f", "f", signal.lag_products))
    asked = [F.lit(s.name) for s in sums]
    for side in ("rx", "tx"):  # a real array on that side; beams where it is linear and no path has angles
        sums.append(signal.AxisSum(f"correlation {side}", side, signal.outer_products))
        array = c(f"n_{side}") > 1
        asked.append(F.when(array, F.lit(f"correlation {side}")))
        if element_wavelengths:
            sums += [signal.AxisSum(f"beams {side}", side, signal.beam_kernel(element_wavelengths, ANGLES)),
                     signal.AxisSum(f"beam moments {side}", side, signal.beam_moment_kernel(element_wavelengths, ANGLES), True)]
            asked += [F.when(array & ~c("has_angles") & c(f"{side}_ula"), F.lit(f"{kind} {side}")) for kind in ("beams", "beam moments")]
    facts = cell_places(packed).join(caps.select(D, F.array_compact(F.array(*asked)).alias("_wanted")), D)  # one row per dataset
    rows = metrics.bounded_join(packed, facts, [D])
    places = {axis: f"_places_{axis}" for axis in INNER}
    return bundles.shared_copy(signal.axis_sums(rows, [D, "sample"], INNER, sums, places, "_wanted"), "sums", CELL_ROWS)


def angular_points(cir: DataFrame, sums: DataFrame, element_wavelengths: float | None) -> list[DataFrame]:
    """Path angles where the dataset has them, else beams of each side with a declared linear array."""
    c = F.col
    spectra = [(metrics.path_angle_spectrum(cir), "angle_deg", "normalized_db")]
    spreads = [metrics.angular_spread(cir)]
    if element_wavelengths:
        for side in ("rx", "tx"):
            named = F.lit(f"{side} beamspace").alias("series")
            beams = signal.mean_beams(signal.named_sums(sums, f"beams {side}", [D], ["p"]), [D], ANGLES).select("*", named)
            spectra.append((peak_db(beams, "power", [D, "series"], "db"), "angle", "db"))
            moments = signal.named_sums(sums, f"beam moments {side}", [D, "sample"], signal.MOMENTS, True).select("*", named)
            spreads.append(metrics.moment_spread(moments, [D, "series", "sample"], "spread_deg"))
    cdfs = [blocks.empirical_cdf(s, "spread_deg", [D, "series"]) for s in spreads]
    return [points("angular_power_spectrum", s, c(x), c(y), "series") for s, x, y in spectra] + [
        points("angular_spread_cdf", cdf.filter("n >= 2"), c("x"), c("y"), "series") for cdf in cdfs]


def spatial_points(sums: DataFrame) -> list[DataFrame]:
    """Magnitudes of the receive and the transmit correlation matrix; a series is one row of a matrix."""
    out = []
    for side in ("rx", "tx"):
        m = signal.correlation_from(signal.named_sums(sums, f"correlation {side}", [D], signal.CORRELATION_SUMS), [D]).filter("n_rows >= 2")
        out.append(points("spatial_correlation", m.withColumn("series", F.concat(F.lit(f"{side} "), F.col("i").cast("string"))),
                          F.col("j"), F.hypot("re", "im"), "series"))
    return out


def characterize(cir: DataFrame, packed: DataFrame, power: DataFrame, caps: DataFrame, *, spacing_s: float,
                 step_hz: float | None, element_wavelengths: float | None) -> tuple[DataFrame, DataFrame]:
    """Points and registry from path rows, the channel's sample_cells, power per sample and flags."""
    c = F.col
    caps = bundles.shared_copy(caps, "capabilities")  # one row per dataset, read by status, arrays and registry
    status = rules.metric_status(caps)
    spread = metrics.delay_spread(cir).withColumn("ns", c("spread_s") * 1e9)
    delay_cdf = blocks.empirical_cdf(spread, "ns", [D])
    sums = channel_sums(packed, caps, spacing_s, step_hz, element_wavelengths)
    doppler = peak_db(metrics.doppler_axis(signal.mean_spectrum(signal.named_sums(sums, "doppler", [D], ["p"]), [D]), [D], spacing_s), "power", [D], "db")
    moments = signal.named_sums(sums, "doppler moments", [D, "sample"], signal.MOMENTS, True)
    doppler_cdf = blocks.empirical_cdf(metrics.moment_spread(moments, [D, "sample"], "spread_hz"), "spread_hz", [D])
    lags = lambda axis: signal.normalized_lags(signal.named_sums(sums, f"lags {axis}", [D], signal.LAG_SUMS), [D])
    heat = metrics.delay_sample_heatmap(cir)
    pdp = metrics.power_delay_profile(cir)
    parts = [
        points("power", metrics.peak_normalized(power), c("sample"), c("normalized_db")),
        points("pdp", pdp, c("delay_s") * 1e9, c("normalized_db")),
        points("delay_spread_cdf", delay_cdf.filter("n >= 2"), c("x"), c("y")),
        *angular_points(cir, sums, element_wavelengths),
        *spatial_points(sums),
        points("doppler_power_spectrum", doppler, c("frequency_hz"), c("db")),
        points("time_autocorrelation", lags("t"), c("lag") * spacing_s, c("magnitude")),
        points("doppler_spread_cdf", doppler_cdf.filter("n >= 2"), c("x"), c("y")),
        points("delay_sample_heatmap", heat, c("delay_s") * 1e9, c("normalized_db"), "sample"),
    ]
    if step_hz:
        parts.append(points("frequency_autocorrelation", lags("f"), c("lag") * step_hz, c("magnitude")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # The status has eleven rows per dataset.
    allowed = status.filter("available").select(D, "metric")
    return metrics.bounded_join(out, allowed, [D, "metric"], "left_semi"), rules.metric_registry(status)


def without_arrays(metadata: DataFrame) -> DataFrame:
    return metadata.withColumns({"tx_ula": F.lit(False), "rx_ula": F.lit(False)})


def analyze(cir: DataFrame, metadata: DataFrame, *, spacing_s: float, offsets_hz: list[float] | None = None,
            element_wavelengths: float | None = None, task: DataFrame | None = None, axis: str = "sample",
            region: str = "known") -> tuple[DataFrame, DataFrame]:
    """Metric points and the metric registry of every dataset of path rows.

    The region filter comes first, so each metric reads the kept rows only. A metric that its dataset cannot
    support gives no points and an unavailable registry row. Beams need frequency offsets and the element
    spacing in wavelengths; without them a declared array does not count as geometry.
    """
    if task is not None:
        cir = rules.select_region(cir, task, axis, region)
    if not (offsets_hz and element_wavelengths):
        metadata, element_wavelengths = without_arrays(metadata), None
    channel = metrics.cir_to_ctf_blocks(cir, offsets_hz) if offsets_hz else metrics.narrowband(cir).withColumn("f", F.lit(0))
    step = offsets_hz[1] - offsets_hz[0] if offsets_hz else None
    return characterize(cir, sample_cells(channel), metrics.cir_power(cir), rules.capabilities(describe(cir, metadata)),
                        spacing_s=spacing_s, step_hz=step, element_wavelengths=element_wavelengths)


def analyze_ctf(ctf: DataFrame, metadata: DataFrame, *, spacing_s: float, step_hz: float,
                element_wavelengths: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The same for frequency responses (dataset_id, sample, tx, rx, f, t, re, im) on a uniform grid.

    Delay metrics come from the delay taps of each response; angles come from beams only.
    """
    if not element_wavelengths:
        metadata = without_arrays(metadata)
    dims = rules.axis_counts(ctf.withColumnRenamed("f", "path")).withColumnRenamed("n_path", "n_f")
    described = dims.join(metadata.drop("n_f"), D).withColumns(
        {"domain": F.lit("ctf"), "has_angles": F.lit(False), "n_path": F.lit(1)})
    packed = sample_cells(ctf)
    taps = bundles.shared_copy(discrete_cir(packed, step_hz), "taps")  # read by the delay metrics
    return characterize(taps, packed, metrics.ctf_power(ctf), rules.capabilities(described),
                        spacing_s=spacing_s, step_hz=step_hz, element_wavelengths=element_wavelengths)
