"""Array work along one bounded axis.

A vector row holds the values of one observation along one axis (frequency,
time, path or antenna element) as `re` and `im` arrays. The axis length is a
property of the instrument, so an array is bounded; the number of observations
is not, so observations are never gathered. Kernels run per Arrow batch and
give partial sums that Spark adds up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pack_axis(df: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """Long rows to one vector per observation, ordered by the axis index."""
    cell = F.struct(F.col(axis).alias("k"), F.col("re").cast("double").alias("re"),
                    F.col("im").cast("double").alias("im"))
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("v"))
    return packed.select(*keys, F.col("v.re").alias("re"), F.col("v.im").alias("im"))


def unpack_axis(vectors: DataFrame, keys: list[str], axis: str) -> DataFrame:
    zipped = F.posexplode(F.arrays_zip("re", "im")).alias(axis, "v")
    return vectors.select(*keys, zipped).select(
        *keys, axis, F.col("v.re").alias("re"), F.col("v.im").alias("im"))


CELLS_AT_ONCE = 250_000  # cells of the rows that are laid out at a time


def _row_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows with at most CELLS_AT_ONCE cells together, or one row."""
    cells = batch.column("cells")
    ends = cells.offsets.to_numpy()
    values = cells.values.field("re")
    if pa.types.is_list(values.type):
        ends = values.offsets.to_numpy()[ends]
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + CELLS_AT_ONCE, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def _flat_cells(cells: pa.ListArray, inner: list[str]) -> tuple[np.ndarray, dict[str, pa.Array], np.ndarray, np.ndarray]:
    """Row of each cell, its inner axes, re and im; lists in the struct hold neighbouring cells side by side."""
    flat, row = cells.flatten(), np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
    fields = {n: flat.field(n) for n in (*inner, "re", "im")}
    if pa.types.is_list(fields["re"].type):
        cell = np.repeat(np.arange(len(flat)), np.diff(fields["re"].offsets.to_numpy()))
        row, at = row[cell], pa.array(cell)
        fields = {n: v.flatten() if pa.types.is_list(v.type) else v.take(at) for n, v in fields.items()}
    parts = [fields.pop(n).fill_null(0.0).to_numpy() for n in ("re", "im")]
    return row, fields, *parts


def _dense_vectors(row: np.ndarray, sets: np.ndarray, fields: dict[str, pa.Array], axis: str, re: np.ndarray, im: np.ndarray,
                   grids: Callable[[int], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each set: a cell of every vector along the axis, by row, and the vectors as a complex matrix."""
    key = row.astype(np.int64)
    for name, values in fields.items():
        if name != axis:
            codes = values.dictionary_encode(null_encoding="encode")
            key = key * max(1, len(codes.dictionary)) + codes.indices.to_numpy()
    at, cell_set = fields[axis].to_numpy(zero_copy_only=False), sets[row]
    for one in np.unique(cell_set):
        mine = np.flatnonzero(cell_set == one)
        grid = grids(one)
        _, head, local = np.unique(key[mine], return_index=True, return_inverse=True)
        slot = local.ravel() * len(grid) + np.searchsorted(grid, at[mine])
        if len(slot) and np.bincount(slot).max() > 1:
            raise ValueError(f"an observation has a place of {axis} twice")
        x = np.zeros(len(head) * len(grid), complex)
        x[slot] = re[mine] + 1j * im[mine]
        yield one, mine[head], x.reshape(len(head), len(grid))


def axis_vectors(rows: DataFrame, keys: list[str], inner: list[str], axis: str, places: str) -> DataFrame:
    """Vectors along one inner axis of the cells of each row: keys, the other inner axes, re, im; no shuffle.

    `cells` holds structs of the inner axes, re and im; `places` the sorted places of the axis, one list for
    each value of the first key. Missing cells are zero; a place that a vector has twice is an error.
    """
    others = [k for k in inner if k != axis]
    types = {f.name: f for f in rows.schema["cells"].dataType.elementType.fields}
    numbers = T.ArrayType(T.DoubleType())
    plain = [T.StructField(k, getattr(types[k].dataType, "elementType", types[k].dataType)) for k in others]
    schema = T.StructType([*[rows.schema[k] for k in keys], *plain, T.StructField("re", numbers), T.StructField("im", numbers)])

    def run(batches):
        for batch in (part for whole in batches for part in _row_slices(whole)):
            row, fields, re, im = _flat_cells(batch.column("cells"), inner)
            sets = batch.column(keys[0]).dictionary_encode(null_encoding="encode").indices.to_numpy()
            grids = lambda one: batch.column(places)[int(np.argmax(sets == one))].values.to_numpy()  # noqa: B023, E731
            for _, head, x in _dense_vectors(row, sets, fields, axis, re, im, grids):
                ends = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(v).ravel())) for v in (x.real, x.imag)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(pa.array(row[head])) for k in keys], *[fields[k].take(pa.array(head)) for k in others], *lists],
                    names=schema.names)

    return rows.select(*keys, "cells", places).mapInArrow(run, schema)


class AxisSum(NamedTuple):
    """Sums of a row-wise kernel over the vectors along one axis, of each row or of each value of the first key."""

    name: str
    axis: str
    kernel: Callable[[np.ndarray], list[np.ndarray]]
    per_row: bool = False


def axis_sums(rows: DataFrame, keys: list[str], inner: list[str], sums: list[AxisSum], places: dict[str, str], wanted: str) -> DataFrame:
    """All sums from one pass over the cells of each row: name, keys, n_rows, values (a list for each output).

    A row is laid out along every axis in turn and only sums leave the task. `places` names the column with the
    sorted places of each axis, `wanted` the one with the names of the sums that a value of the first key needs;
    both are the same for all rows of such a value. Sums over rows are partial, one for each slice of a batch,
    and have null for the other keys.
    """
    schema = T.StructType([T.StructField("name", T.StringType()), *[T.StructField(k, rows.schema[k].dataType) for k in keys],
                           T.StructField("n_rows", T.LongType()), T.StructField("values", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def run(batches):
        for batch in (part for whole in batches for part in _row_slices(whole)):
            row, fields, re, im = _flat_cells(batch.column("cells"), inner)
            sets = batch.column(keys[0]).dictionary_encode(null_encoding="encode").indices.to_numpy()
            firsts = {int(one): int(np.argmax(sets == one)) for one in np.unique(sets)}
            asked = {one: set(batch.column(wanted)[at].as_py()) for one, at in firsts.items()}
            names, rows_of, counts, values = [], [], [], []
            for axis in dict.fromkeys(s.axis for s in sums):
                here = [s for s in sums if s.axis == axis and any(s.name in a for a in asked.values())]
                grids = lambda one: batch.column(places[axis])[firsts[int(one)]].values.to_numpy()  # noqa: B023, E731
                for one, head, x in _dense_vectors(row, sets, fields, axis, re, im, grids) if here else ():
                    own, starts = np.unique(row[head], return_index=True)
                    for s in here:
                        if s.name not in asked[int(one)]:
                            continue
                        parts = s.kernel(x)
                        if s.per_row:
                            names += [s.name] * len(own)
                            rows_of += own.tolist()
                            counts += np.diff([*starts, len(x)]).tolist()
                            values += np.stack([np.add.reduceat(p, starts, axis=0) for p in parts], axis=1).tolist()
                        else:
                            names.append(s.name)
                            rows_of.append(-1 - firsts[int(one)])
                            counts.append(len(x))
                            values.append([p.sum(axis=0).tolist() for p in parts])
            if not names:
                continue
            at = np.array(rows_of)
            mine = [batch.column(k).take(pa.array(np.where(at < 0, -1 - at, at), mask=(at < 0) & (i > 0))) for i, k in enumerate(keys)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *mine, pa.array(counts, pa.int64()), pa.array(values, pa.list_(pa.list_(pa.float64())))], names=schema.names)

    return rows.select(*keys, "cells", *places.values(), wanted).mapInArrow(run, schema)


def named_sums(sums: DataFrame, name: str, keys: list[str], outputs: list[str], per_row: bool = False) -> DataFrame:
    """The sums of one name from axis_sums: keys, pos, n_rows and one column per output; those of rows are whole as they are."""
    lists = F.arrays_zip(*[F.get("values", F.lit(i)).alias(o) for i, o in enumerate(outputs)])
    cells = sums.filter(F.col("name") == name).select(*keys, "n_rows", F.posexplode(lists).alias("pos", "v")).select(
        *keys, "pos", "n_rows", *[F.col(f"v.{o}").alias(o) for o in outputs])
    if per_row:
        return cells
    return cells.groupBy(*keys, "pos").agg(F.sum("n_rows").alias("n_rows"), *[F.sum(o).alias(o) for o in outputs])


def _matrices(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sub-frames of equal vector length with their complex matrix."""
    for _, part in pdf.groupby(pdf["re"].str.len(), sort=False):
        yield part, np.stack(part["re"].to_numpy()) + 1j * np.stack(part["im"].to_numpy())


def sum_over_rows(vectors: DataFrame, keys: list[str], outputs: list[str],
                  kernel: Callable[[np.ndarray], list[np.ndarray]], width: Callable[[int], int] | None = None) -> DataFrame:
    """Per-key sums of a row-wise kernel: keys, pos, n_rows, one column per output.

    `width` gives the number of values the kernel makes per row from the length
    of its vector (about four times that length by default); it sets how many
    rows one call gets, so memory stays bounded.
    """
    slim = vectors.select(*keys, "re", "im")
    width = width or (lambda n: max(512, 4 * n))
    fields = [slim.schema[k] for k in keys] + [T.StructField("n_rows", T.LongType())]
    fields += [T.StructField(o, T.ArrayType(T.DoubleType())) for o in outputs]

    def run(batches):
        for pdf in batches:
            for part, x in _matrices(pdf):
                index = pd.MultiIndex.from_frame(part[keys])
                step = max(1, 4_000_000 // width(x.shape[1]))
                for at in range(0, len(x), step):
                    codes, names = pd.factorize(index[at:at + step])
                    out = pd.DataFrame(list(names), columns=keys)
                    out["n_rows"] = np.bincount(codes, minlength=len(names))
                    for name, rows in zip(outputs, kernel(x[at:at + step])):
                        acc = np.zeros((len(names), rows.shape[1]))
                        np.add.at(acc, codes, rows)
                        out[name] = list(acc)
                    yield out

    partial = slim.mapInPandas(run, T.StructType(fields))
    cells = partial.select(*keys, "n_rows", F.posexplode(F.arrays_zip(*outputs)).alias("pos", "v"))
    return cells.groupBy(*keys, "pos").agg(
        F.sum("n_rows").alias("n_rows"), *[F.sum(f"v.{o}").alias(o) for o in outputs])


def map_vectors(vectors: DataFrame, keys: list[str],
                kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Row-wise complex transform of every vector."""
    slim = vectors.select(*keys, "re", "im")

    def run(batches):
        for pdf in batches:
            for part, x in _matrices(pdf):
                y = kernel(x)
                out = part[keys].copy()
                out["re"] = list(np.ascontiguousarray(y.real))
                out["im"] = list(np.ascontiguousarray(y.imag))
                yield out

    return slim.mapInPandas(run, slim.schema)


def next_pow2(n: int) -> int:
    return 1 << max(0, int(n - 1).bit_length())


LAG_SUMS = ["cr", "ci", "lp", "rp"]


def lag_products(x: np.ndarray) -> list[np.ndarray]:
    """Sums of x[i] * conj(x[i + lag]) of each vector and the powers of both ends, from one zero-padded FFT."""
    n = x.shape[1]
    f = np.fft.fft(x, 2 * n, axis=1)
    cross = np.conj(np.fft.ifft(np.abs(f) ** 2, axis=1)[:, :n])
    p = np.abs(x) ** 2
    left = np.cumsum(p, axis=1)[:, ::-1]
    right = np.cumsum(p[:, ::-1], axis=1)[:, ::-1]
    return [cross.real, cross.imag, left, right]


def normalized_lags(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Normalized complex autocorrelation from the sums of lag_products: lag, re, im, magnitude."""
    scale = F.sqrt(F.col("lp") * F.col("rp"))
    return sums.select(
        *keys, F.col("pos").alias("lag"),
        F.when(scale > 0, F.col("cr") / scale).alias("re"),
        F.when(scale > 0, F.col("ci") / scale).alias("im"),
    ).withColumn("magnitude", F.hypot("re", "im"))


def autocorrelation(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Normalized complex autocorrelation per key: lag, re, im, magnitude.

    The lag products of a vector come from one zero-padded FFT, so the cost is
    N log N per observation and no pair rows are made.
    """
    return normalized_lags(sum_over_rows(vectors, keys, LAG_SUMS, lag_products), keys)


def _periodograms(x: np.ndarray, demean: bool, hann: bool, shift: bool, nfft: int | None = None) -> np.ndarray:
    n = x.shape[1]
    w = np.ones(n)
    if hann and n > 1:
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    if demean:
        x = x - x.mean(axis=1, keepdims=True)
    y = np.fft.fft(x * w, nfft or next_pow2(n), axis=1)
    if shift:
        y = np.fft.fftshift(y, axes=1)
    p = np.abs(y) ** 2
    return p / max(np.sum(w**2), np.finfo(float).eps) if hann else p


def power_spectrum(vectors: DataFrame, keys: list[str], *, demean: bool, hann: bool,
                   shift: bool, nfft: int | None = None) -> DataFrame:
    """Mean power spectrum per key: q (0-based, shifted if asked), n, power.

    Zero-pads to nfft or to the next power of two; the window and its energy
    use the unpadded length.
    """
    return mean_spectrum(sum_over_rows(vectors, keys, ["p"], lambda x: [_periodograms(x, demean, hann, shift, nfft)]), keys)


def mean_spectrum(sums: DataFrame, keys: list[str]) -> DataFrame:
    return sums.select(*keys, F.col("pos").alias("q"), (F.col("p") / F.col("n_rows")).alias("power"))


def doppler_power(x: np.ndarray) -> list[np.ndarray]:
    """Hann-windowed periodogram of each vector on a shifted axis."""
    return [_periodograms(x, True, True, True)]


def inverse_dft_shifted(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """ifft(ifftshift(x)) of every vector."""
    return map_vectors(vectors, keys, lambda x: np.fft.ifft(np.fft.ifftshift(x, axes=1), axis=1))


def inverse_dft(vectors: DataFrame, keys: list[str]) -> DataFrame:
    return map_vectors(vectors, keys, lambda x: np.fft.ifft(x, axis=1))


def _beams(x: np.ndarray, spacing_wavelengths: float, angles_deg: list[int]) -> np.ndarray:
    sines = np.sin(np.deg2rad(np.asarray(angles_deg, dtype=float)))
    e = x.shape[1]
    steer = np.exp(2j * np.pi * spacing_wavelengths * np.outer(np.arange(e), sines)) / np.sqrt(e)
    return np.abs(x @ np.conj(steer)) ** 2


def beam_power(vectors: DataFrame, keys: list[str], spacing_wavelengths: float,
               angles_deg: list[int]) -> DataFrame:
    """Mean beamformed power of a uniform linear array per key and angle."""
    return mean_beams(sum_over_rows(vectors, keys, ["p"], beam_kernel(spacing_wavelengths, angles_deg)), keys, angles_deg)


def beam_kernel(spacing_wavelengths: float, angles_deg: list[int]) -> Callable[[np.ndarray], list[np.ndarray]]:
    return lambda x: [_beams(x, spacing_wavelengths, angles_deg)]


def mean_beams(sums: DataFrame, keys: list[str], angles_deg: list[int]) -> DataFrame:
    return sums.select(*keys, (F.col("pos") + F.lit(int(angles_deg[0]))).alias("angle"),
                       (F.col("p") / F.col("n_rows")).alias("power"))


MOMENTS = ["p", "px", "pxx"]


def moment_kernel(power: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Callable[[np.ndarray], list[np.ndarray]]:
    """Sums of p, p*x and p*x*x of each row; `power` gives the axis x and the powers p of each row.

    The spectrum itself is as long as its axis; what leaves a batch is three numbers a key.
    """
    def kernel(v):
        x, p = power(v)
        return [(p @ x**i)[:, None] for i in range(3)]

    return kernel


def doppler_moment_kernel(spacing_s: float) -> Callable[[np.ndarray], list[np.ndarray]]:
    """Moments of the Hann-windowed periodogram over frequency."""
    def power(x):
        p = _periodograms(x, True, True, True)
        nfft = p.shape[1]
        return (np.arange(nfft) - nfft // 2) / (nfft * spacing_s), p

    return moment_kernel(power)


def beam_moment_kernel(spacing_wavelengths: float, angles_deg: list[int]) -> Callable[[np.ndarray], list[np.ndarray]]:
    """Moments of the beamformed power over angle."""
    angles = np.asarray(angles_deg, dtype=float)
    return moment_kernel(lambda x: (angles, _beams(x, spacing_wavelengths, angles_deg)))


def doppler_moments(vectors: DataFrame, keys: list[str], spacing_s: float) -> DataFrame:
    return sum_over_rows(vectors, keys, MOMENTS, doppler_moment_kernel(spacing_s))


def beam_moments(vectors: DataFrame, keys: list[str], spacing_wavelengths: float, angles_deg: list[int]) -> DataFrame:
    return sum_over_rows(vectors, keys, MOMENTS, beam_moment_kernel(spacing_wavelengths, angles_deg))


CORRELATION_SUMS = ["cr", "ci", "elements"]


def outer_products(x: np.ndarray) -> list[np.ndarray]:
    outer = (x[:, :, None] * np.conj(x[:, None, :])).reshape(len(x), -1)
    return [outer.real, outer.imag, np.full((len(x), outer.shape[1]), float(x.shape[1]))]


def correlation_matrix(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """E[x_i conj(x_j)] with unit diagonal: i, j, re, im; zero scale gives zero.

    One outer product per observation inside the batch; only E*E sums shuffle.
    """
    return correlation_from(sum_over_rows(vectors, keys, CORRELATION_SUMS, outer_products, width=lambda n: 3 * n * n), keys)


def correlation_from(s: DataFrame, keys: list[str]) -> DataFrame:
    """The matrix from the sums of outer_products."""
    e = F.round(F.col("elements") / F.col("n_rows")).cast("int")
    cells = s.select(*keys, F.floor(F.col("pos") / e).cast("int").alias("i"),
                     F.pmod(F.col("pos"), e).alias("j"), "n_rows",
                     (F.col("cr") / F.col("n_rows")).alias("cr"), (F.col("ci") / F.col("n_rows")).alias("ci"))
    # At most elements**2 rows per key from here on.
    diag = cells.filter("i = j").select(*keys, F.col("i").alias("d"), F.col("cr").alias("g"))
    di = diag.select(*keys, F.col("d").alias("i"), F.col("g").alias("gi"))
    dj = diag.select(*keys, F.col("d").alias("j"), F.col("g").alias("gj"))
    scale = F.sqrt(F.greatest(F.col("gi"), F.lit(0.0)) * F.greatest(F.col("gj"), F.lit(0.0)))
    full = cells.join(di, [*keys, "i"]).join(dj, [*keys, "j"])
    return full.select(
        *keys, "i", "j", "n_rows",
        F.when(scale > 0, F.col("cr") / scale).otherwise(0.0).alias("re"),
        F.when(scale > 0, F.col("ci") / scale).otherwise(0.0).alias("im"))


FFT_VALUES = 2_000_000  # complex values of the pieces transformed at a time, 32 MB and as much again for the result


def _pieces_fft(batches: Iterator[pa.RecordBatch], size: int, total: int, twiddle: bool) -> Iterator[pa.RecordBatch]:
    """FFT of each sparse piece; used by the two passes of long_fft.

    Cells are read as flat arrays and at most FFT_VALUES values, or one piece,
    are held dense.
    """
    step = max(1, FFT_VALUES // size)
    for batch in batches:
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            cells, piece = part.column("cells"), part.column("piece").to_numpy()
            flat = cells.flatten()
            row = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
            x = np.zeros((len(cells), size), dtype=complex)
            x[row, flat.field("at").to_numpy()] = flat.field("re").to_numpy() + 1j * flat.field("im").to_numpy()
            y = np.fft.fft(x, axis=1)
            if twiddle:
                y *= np.exp(-2j * np.pi * np.outer(piece, np.arange(size)) / total)
            ends = pa.array(np.arange(0, len(cells) * size + 1, size), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(v).ravel())) for v in (y.real, y.imag)]
            yield pa.RecordBatch.from_arrays([part.column("piece"), *lists], names=["piece", "re", "im"])


def long_fft(series: DataFrame, n: int) -> DataFrame:
    """FFT of one series of any length, zero-padded to a power of two: q, re, im.

    `series` has a 0-based `k` with `re` and `im`. The transform is split into
    two passes over pieces of about sqrt(n) values with one shuffle each, so
    no task holds the series. A task holds one Arrow batch of sparse pieces and
    FFT_VALUES dense values.
    """
    nfft = next_pow2(n)
    first = 1 << ((nfft.bit_length() - 1) // 2)
    second = nfft // first

    def one_pass(df: DataFrame, size: int, twiddle: bool) -> DataFrame:
        packed = df.groupBy("piece").agg(F.collect_list(F.struct("at", "re", "im")).alias("cells"))
        done = packed.mapInArrow(
            lambda b: _pieces_fft(b, size, nfft, twiddle),
            "piece long, re array<double>, im array<double>")
        return done.select("piece", F.posexplode(F.arrays_zip("re", "im")).alias("q", "v")).select(
            "piece", F.col("q").cast("long").alias("q"), F.col("v.re").alias("re"), F.col("v.im").alias("im"))

    columns = series.select(
        F.pmod(F.col("k"), F.lit(second)).cast("long").alias("piece"),
        F.floor(F.col("k") / second).cast("long").alias("at"), "re", "im")
    rows = one_pass(columns, first, True).select(
        F.col("q").alias("piece"), F.col("piece").alias("at"), "re", "im")
    return one_pass(rows, second, False).select(
        (F.col("piece") + F.col("q") * first).alias("q"), "re", "im")


def plain_fft(x: np.ndarray) -> np.ndarray:
    return np.fft.fft(x, axis=1)
