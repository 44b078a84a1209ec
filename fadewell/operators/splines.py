"""Resampling of series of any length on unit-spaced knots.

A series is cut into blocks of knots, one row each, with the few neighbours that
slopes at its ends look at. The slopes of a shape-preserving cubic follow from
those neighbours. The slopes of a cubic spline solve one tridiagonal system over
the whole series: each block eliminates its inner knots, a small system joins
the first knots of the blocks, and each block then substitutes back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import bounded_join

D = "dataset_id"
BLOCK_KNOTS = 4096
OUT_ROWS = 65_536  # output points that one row of arrays makes
BEFORE, AFTER = 2, 2  # neighbours of a block, beyond the next block's first knot


# ---- whole series ----------------------------------------------------------

def solve_tridiagonal(low: np.ndarray, diag: np.ndarray, high: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solution for each column of rhs by cyclic reduction; the matrix is diagonally dominant.

    low[0] and high[-1] are not used. Every round removes the neighbours at the
    present distance, so the work is vectorized and log2(n) rounds suffice.
    """
    n = len(diag)
    a, b, c, d = low.astype(float), diag.astype(float), high.astype(float), rhs.reshape(n, -1).astype(float)
    a[0] = c[-1] = 0.0
    step = 1
    while step < n:
        up, down = np.zeros(n), np.zeros(n)
        up[step:] = -a[step:] / b[:-step]
        down[:-step] = -c[:-step] / b[step:]
        shift = lambda x, by: np.concatenate([np.zeros_like(x[:by]), x[:-by]]) if by > 0 else np.concatenate([x[-by:], np.zeros_like(x[:-by])])
        b, d = b + up * shift(c, step) + down * shift(a, -step), d + up[:, None] * shift(d, step) + down[:, None] * shift(d, -step)
        a, c = up * shift(a, step), down * shift(c, -step)
        step *= 2
    return (d / b[:, None]).reshape(rhs.shape)


def _hermite(y: np.ndarray, slope: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic pieces on knots 0, 1, ..., from values and slopes."""
    i = np.clip(np.floor(at).astype(np.int64), 0, len(y) - 2)
    t = at - i
    return ((1 + 2 * t) * (1 - t) ** 2 * y[i] + t * (1 - t) ** 2 * slope[i]
            + t**2 * (3 - 2 * t) * y[i + 1] + t**2 * (t - 1) * slope[i + 1])


def pchip_slopes(y: np.ndarray, starts: bool = True, stops: bool = True) -> np.ndarray:
    """Monotone slopes; at a cut end of a part (not `starts`, not `stops`) the slope is zero and not meant for use."""
    d = np.diff(y)
    if len(y) == 2:
        return np.array([d[0], d[0]])
    slope = np.zeros(len(y))
    a, b = d[:-1], d[1:]
    same = a * b > 0
    slope[1:-1][same] = 2 * a[same] * b[same] / (a[same] + b[same])

    def edge(d0, d1):
        s = (3 * d0 - d1) / 2
        if s * d0 <= 0:
            return 0.0
        return 3 * d0 if d0 * d1 <= 0 and abs(s) > 3 * abs(d0) else s

    if starts:
        slope[0] = edge(d[0], d[1])
    if stops:
        slope[-1] = edge(d[-1], d[-2])
    return slope


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone piecewise cubic on unit-spaced knots."""
    if len(x) < 2:
        return np.full(len(at), y[0])
    return _hermite(y, pchip_slopes(y), at - x[0])


def _end_rows(y: np.ndarray) -> tuple[float, float]:
    """Right sides of the not-a-knot rows m0 + 2 m1 and 2 m[n-2] + m[n-1], from the first and last three values."""
    return (-5 * y[0] + 4 * y[1] + y[2]) / 2, (5 * y[-1] - 4 * y[-2] - y[-3]) / 2


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Not-a-knot cubic spline on unit-spaced knots, solved whole."""
    n = len(x)
    if n < 4:
        return _short_series(y, at - x[0])
    slopes = _Block(y, 0, 0, n, n).slopes(0.0, 0.0)
    return _hermite(y, slopes, at - x[0])


def _short_series(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fewer than four knots: the polynomial through them."""
    return np.full(len(at), y[0]) if len(y) < 2 else np.polyval(np.polyfit(np.arange(len(y)), y, len(y) - 1), at)


class _Block:
    """Spline rows of knots start..stop-1 of a series of n knots, with values y from knot `lo` on.

    Inner knots depend on the slopes of the block's own first knot and of the
    next block's: inner = free + left * own + right * next. The end knots of the
    series follow from their neighbours, so the ends of the first and last block
    depend on nothing.
    """

    def __init__(self, y: np.ndarray, lo: int, start: int, stop: int, n: int):
        self.y, self.first, self.last = y, start == 0, stop == n
        a, b = start + 1, stop - (1 if self.last else 0)  # inner knots a..b-1
        k = np.arange(a, b) - lo
        rhs = np.zeros((b - a, 3))
        rhs[:, 0] = 3 * (y[k + 1] - y[k - 1])
        diag = np.full(b - a, 4.0)
        if self.first:
            self.head = _end_rows(y[:3])[0]
            rhs[0, 0] -= self.head
            diag[0] -= 2
        else:
            rhs[0, 1] = -1.0
            self.own = 3 * (y[start - lo + 1] - y[start - lo - 1])  # right side of the own first knot's row
        if self.last:
            self.tail = _end_rows(y[-3:])[1]
            rhs[-1, 0] -= self.tail
            diag[-1] -= 2
        else:
            rhs[-1, 2] = -1.0
        ones = np.ones(b - a)
        self.parts = solve_tridiagonal(ones, diag, ones, rhs)

    def border(self) -> dict:
        """What the joining system needs: the right side and the ends of the inner solution."""
        first, last = self.parts[0], self.parts[-1]
        return {"rhs": 0.0 if self.first else self.own, "free_first": first[0], "left_first": first[1], "right_first": first[2],
                "free_last": last[0], "left_last": last[1], "right_last": last[2]}

    def slopes(self, own: float, after: float) -> np.ndarray:
        """Slopes of knots start..stop (the last one of the series, or the next block's first)."""
        inner = self.parts @ np.array([1.0, own, after])
        head = self.head - 2 * inner[0] if self.first else own
        tail = self.tail - 2 * inner[-1] if self.last else after
        return np.concatenate([[head], inner, [tail]])


def join_borders(part: pd.DataFrame) -> pd.DataFrame:
    """Slopes of the blocks' first knots of one series from its blocks' borders: columns own and after."""
    part = part.sort_values("block")
    up, here = part.iloc[:-1], part.iloc[1:]
    diag = 4 + up["right_last"].to_numpy() + here["left_first"].to_numpy()
    rhs = here["rhs"].to_numpy() - up["free_last"].to_numpy() - here["free_first"].to_numpy()
    x = solve_tridiagonal(up["left_last"].to_numpy(), diag, here["right_first"].to_numpy(), rhs)
    return part.assign(own=np.concatenate([[0.0], x]), after=np.concatenate([x, [0.0]]))


# ---- blocks of series ------------------------------------------------------

def knot_blocks(rows: DataFrame, keys: list[str], pos: str, value: str, block_knots: int) -> DataFrame:
    """One row per block: keys, n, blocks, block, lo, y. Positions are dense from 1 in each series.

    The last block also takes the remainder, so a block has up to twice
    `block_knots` knots, and every block of a cut series at least four.
    """
    if block_knots < 4:
        raise ValueError("a block has at least four knots")
    sizes = rows.groupBy(*keys).agg(F.max(pos).cast("long").alias("n"))
    sizes = sizes.withColumn("blocks", F.greatest(F.lit(1), F.floor(F.col("n") / block_knots)))
    k = (F.col(pos) - 1).cast("long")
    home = F.least(F.floor(k / block_knots), F.col("blocks") - 1)
    start = home * block_knots
    also_left = F.when((home > 0) & (k <= start + AFTER), home - 1)
    also_right = F.when((home < F.col("blocks") - 1) & (k >= start + (block_knots - BEFORE)), home + 1)
    copies = bounded_join(rows, sizes, keys).select(
        *keys, "n", "blocks", k.alias("k"), F.col(value).cast("double").alias("y"),
        F.explode(F.array_compact(F.array(home, also_left, also_right))).alias("block"))
    cells = copies.groupBy(*keys, "n", "blocks", "block").agg(F.array_sort(F.collect_list(F.struct("k", "y"))).alias("c"))
    return cells.select(*keys, "n", "blocks", "block", F.col("c")[0]["k"].alias("lo"), F.col("c.y").alias("y"))


def _rows(*columns: pa.Array):
    return zip(*(c.to_pylist() for c in columns[:-1]), columns[-1])


def _bounds(block: int, blocks: int, n: int, size: int) -> tuple[int, int]:
    return block * size, n if block == blocks - 1 else (block + 1) * size


def spline_borders(blocks: DataFrame, keys: list[str], block_knots: int) -> DataFrame:
    """keys, block, own, after: the slopes at the cuts of series with more than one block.

    Only seven numbers a block are gathered per series.
    """
    names = ["rhs", "free_first", "left_first", "right_first", "free_last", "left_last", "right_last"]

    def local(n: pa.Array, count: pa.Array, block: pa.Array, lo: pa.Array, y: pa.Array) -> pa.Array:
        found = []
        for size, number, at, first, values in _rows(n, count, block, lo, y):
            found.append(_Block(values.values.to_numpy(), first, *_bounds(at, number, size, block_knots), size).border())
        return pa.StructArray.from_arrays([pa.array([f[c] for f in found], pa.float64()) for c in names], names)

    kernel = F.arrow_udf(local, "struct<" + ", ".join(f"{c}: double" for c in names) + ">")
    cut = blocks.filter("blocks > 1")
    ends = cut.select(*keys, "block", kernel("n", "blocks", "block", "lo", "y").alias("_e")).select(*keys, "block", "_e.*")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ends.select(*keys, "block", *names).schema)
    joined = ends.groupBy(*keys).applyInPandas(join_borders, f"{fields}, own double, after double")
    return joined.select(*keys, "block", "own", "after")


def resample(rows: DataFrame, keys: list[str], pos: str, value: str, totals: DataFrame, kind: str,
             block_knots: int = BLOCK_KNOTS, out: str = "pos") -> DataFrame:
    """Each series on `total` equally spaced points: keys, out (1..total), value. kind is `pchip` or `spline`.

    `totals` has keys and total; a series without a total is left out. A series
    of one point is constant; splines of two or three points are the polynomial
    through them.
    """
    if kind not in ("pchip", "spline"):
        raise ValueError("kind is pchip or spline")
    blocks = bounded_join(knot_blocks(rows, keys, pos, value, block_knots), totals.select(*keys, "total"), keys)
    if kind == "spline":
        blocks = blocks.join(spline_borders(blocks, keys, block_knots), [*keys, "block"], "left")
    else:
        blocks = blocks.withColumns({"own": F.lit(None).cast("double"), "after": F.lit(None).cast("double")})
    # output points over the block's knots, in pieces; a point on a cut belongs to the right block
    scale = (F.col("n") - 1) / F.greatest(F.col("total") - 1, F.lit(1))
    last = F.col("block") == F.col("blocks") - 1
    edge = lambda knot: F.least(F.greatest(F.ceil(knot / scale) - 1, F.lit(0)), F.col("total"))
    one = scale == 0
    first = F.when(one, 0).otherwise(edge(F.col("block") * block_knots)).cast("long")
    stop = F.when(one | last, F.col("total")).otherwise(F.least(edge((F.col("block") + 1) * block_knots) + 2, F.col("total"))).cast("long")
    cut = blocks.withColumn("_k", F.explode(F.when(first < stop, F.sequence(first, stop - 1, F.lit(OUT_ROWS))).otherwise(F.array().cast("array<bigint>"))))
    cut = cut.withColumn("_stop", F.least(F.col("_k") + OUT_ROWS, stop))
    most = totals.agg(F.max("total")).first()[0] or 0
    if most > OUT_ROWS:  # a short series can have many pieces, which would all lie in one task
        cut = cut.repartition(*keys, "block", "_k")

    inputs = ["n", "blocks", "total", "block", "lo", "own", "after", "_k", "_stop", "y"]
    schema = T.StructType([*[cut.schema[k] for k in keys], T.StructField(out, T.LongType()), T.StructField(value, T.DoubleType())])

    def evaluate(batches):
        # the points of one piece leave before those of the next are made
        for batch in batches:
            for row, (size, number, points, at_block, low, x, z, begin, end, values) in enumerate(_rows(*(batch.column(c) for c in inputs))):
                values = values.values.to_numpy()
                a, b = _bounds(at_block, number, size, block_knots)
                places = np.arange(begin, end)
                at = places * ((size - 1) / max(points - 1, 1))
                segment = np.minimum(np.floor(at), max(size - 2, 0))
                mine = (segment >= a) & (segment < b)
                places, at = places[mine], at[mine]
                if size == 1:
                    made = np.full(len(at), values[0])
                elif kind == "spline" and size < 4:
                    made = _short_series(values, at)
                elif kind == "spline":
                    slopes = _Block(values, low, a, b, size).slopes(x or 0.0, z or 0.0)
                    made = _hermite(values[a - low : a - low + len(slopes)], slopes, at - a)
                else:
                    made = _hermite(values, pchip_slopes(values, low == 0, low + len(values) == size), at - low)
                same = pa.array(np.full(len(places), row))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(same) for k in keys], pa.array(places + 1, pa.int64()), pa.array(made, pa.float64())], names=schema.names)

    return cut.select(*keys, *[c for c in inputs if c not in keys]).mapInArrow(evaluate, schema)


def blend_on_common_grid(real: DataFrame, synthetic: DataFrame, feature: str, pos: str, value: str,
                         alpha: float = 0.15, block_rows: int = BLOCK_KNOTS) -> DataFrame:
    """Real series plus alpha times the zero-mean synthetic one, both on n_real + n_synthetic points.

    Lengths are those of each (dataset, feature); a series that one side lacks is
    left out. The real side is shape-preserving cubic, the synthetic side a
    not-a-knot cubic spline.
    """
    keys = [D, feature]
    n_real = real.groupBy(*keys).agg(F.max(pos).alias("_r"))
    mean: Column = F.avg(value)
    n_syn = synthetic.groupBy(*keys).agg(F.max(pos).alias("_s"), mean.alias("_mean"))
    totals = n_real.join(n_syn, keys).select(*keys, (F.col("_r") + F.col("_s")).cast("long").alias("total"), "_mean").persist()
    centred = bounded_join(synthetic.select(*keys, pos, value), totals.select(*keys, "_mean"), keys).withColumn(value, F.col(value) - F.col("_mean"))
    one = resample(real.select(*keys, pos, value), keys, pos, value, totals, "pchip", block_rows)
    two = resample(centred, keys, pos, value, totals, "spline", block_rows)
    scaled = two.withColumn(value, F.lit(alpha) * F.col(value))
    return one.unionByName(scaled).groupBy(*keys, "pos").agg(F.sum(value).alias(value))
