"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
SMALLEST_NORMAL = 2.2250738585072014e-308
DB_FLOOR = -120.0
DBM_PAD = -130.0
SPECTRUM_EPS = 1e-20
SPEED_OF_LIGHT = 299792458.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def power(re: str | Column = "re", im: str | Column = "im") -> Column:
    re, im = col(re), col(im)
    return re * re + im * im


def is_finite(c: str | Column) -> Column:
    c = col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite_or_null(c: str | Column) -> Column:
    return F.when(is_finite(c), col(c))


def db(x: str | Column) -> Column:
    """10*log10 with a floor at the smallest normal double."""
    return 10 * F.log10(F.greatest(col(x), F.lit(SMALLEST_NORMAL)))


def db_eps(x: str | Column) -> Column:
    """10*log10(x + 1e-20), the display form of the power-profile metrics."""
    return 10 * F.log10(col(x) + F.lit(SPECTRUM_EPS))


def clip_db(x: Column) -> Column:
    return F.greatest(x, F.lit(DB_FLOOR))


def peak_db(df: DataFrame, linear: str, keys: list[str], out: str) -> DataFrame:
    """Peak-normalized dB for rows already reduced to a bounded grid per key."""
    top = F.max(db(linear)).over(Window.partitionBy(*keys))
    return df.withColumn(out, clip_db(db(linear) - top))


def watts_to_dbm(w: str | Column) -> Column:
    """Negative power is an error in the data, so it raises."""
    w = col(w)
    bad = F.raise_error(F.lit("power must not be negative")).cast("double")
    return F.when(w < 0, bad).otherwise(
        10 * F.log10(F.greatest(w, F.lit(SMALLEST_NORMAL)) / F.lit(1e-3))
    )


def dbm_to_watts(x: str | Column) -> Column:
    return F.pow(F.lit(10.0), col(x) / 10 - 3)


def degrees(rad: str | Column) -> Column:
    return col(rad) * (F.lit(180.0) / F.pi())


def radians(deg: Column) -> Column:
    return deg * (F.pi() / F.lit(180.0))


def weighted_spread(x: str | Column, p: str | Column) -> Column:
    """RMS spread of x under weights p as one aggregate; null without power.

    One pass and combinable on the map side, so a hot group never gathers in
    one task before it is reduced.
    """
    x, p = col(x), col(p)
    total = F.sum(p)
    mean = F.sum(p * x) / total
    var = F.sum(p * x * x) / total - mean * mean
    return F.when(total > 0, F.sqrt(F.greatest(var, F.lit(0.0))))


def circular_spread(angle: str | Column, p: str | Column) -> Column:
    angle, p = col(angle), col(p)
    total = F.sum(p)
    length = F.hypot(F.sum(p * F.cos(angle)), F.sum(p * F.sin(angle))) / total
    r = F.least(F.greatest(length, F.lit(2.220446049250313e-16)), F.lit(1.0))
    return F.when(total > 0, F.sqrt(F.greatest(-2 * F.log(r), F.lit(0.0))))


def bin_index(x: str | Column, lo: Column, width: Column, bins: Column) -> Column:
    """0-based bin; left-closed, the last bin also holds its right edge.

    Null outside [lo, lo + bins*width].
    """
    x = col(x)
    raw = F.floor((x - lo) / width).cast("int")
    inside = (x >= lo) & (x <= lo + width * bins)
    return F.when(inside, F.least(raw, bins.cast("int") - 1))


def r6(c: str | Column, out: str) -> Column:
    """Round for comparison; adding zero removes the sign of -0.0."""
    return (F.round(col(c), 6) + F.lit(0.0)).alias(out)
