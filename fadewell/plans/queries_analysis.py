"""Values of the full analysis, from path rows and from frequency responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators.metrics import D, centred_offsets
from . import views
from .analysis import analyze, analyze_ctf
from .queries_blocks import DELAY_SPREAD_SQL
from .queries_metrics import CIRC_SQL, CTF_SQL, POWER_SQL, SNAPSHOT_S, SPACING_WL, SUBCARRIER_HZ
from .registry import query, s6

FLOOR = "2.2250738585072014e-308"
KEYS = ("sample", "tx", "rx", "f", "t")


def db_sql(p: str, over: str = "") -> str:
    """dB below the peak of p, at least -120."""
    level = f"10*log10(greatest({p},{FLOOR}))"
    return f"greatest({level}-max({level}) OVER ({over}),-120)"


def points_sql(metric: str, x: str, y: str, source: str, series: str = "''") -> str:
    return f"SELECT '{metric}' AS metric, {series} AS series, {s6(x, 'x')}, {s6(y, 'y')} FROM {source}"


def dense_sql(axis: str) -> str:
    """v_<axis>: each vector of h along the axis; k counts its places from 0, missing cells are zero."""
    keys = [k for k in KEYS if k != axis]
    same = " AND ".join(f"h.{k}=v.{k}" for k in keys)
    return f"""a_{axis} AS (SELECT {axis} AS place, row_number() OVER (ORDER BY {axis})-1 AS k FROM (SELECT DISTINCT {axis} FROM h)),
v_{axis} AS (SELECT v.*, k, coalesce(h.re,0) AS re, coalesce(h.im,0) AS im FROM (SELECT DISTINCT {','.join(keys)} FROM h) v CROSS JOIN a_{axis} LEFT JOIN h ON {same} AND h.{axis}=place)"""


def pairs_sql(name: str, axis: str, key: str, on: str) -> str:
    keys = ",".join(k for k in KEYS if k != axis)
    return f"""{name} AS (SELECT {key}, sum(a.re*b.re+a.im*b.im) AS cr, sum(a.im*b.re-a.re*b.im) AS ci,
 sqrt(sum(a.re*a.re+a.im*a.im)*sum(b.re*b.re+b.im*b.im)) AS s FROM v_{axis} a JOIN v_{axis} b USING ({keys}) WHERE {on} GROUP BY ALL)"""


def channel_sql(n_t: int, nfft: int) -> str:
    """Autocorrelations, correlation matrices and Doppler of h."""
    hann = f"(0.5-0.5*cos(2*pi()*k/{n_t - 1}))"
    arg = f"2*pi()*q*k/{nfft}"
    return ",\n".join([
        *map(dense_sql, ("t", "f", "rx", "tx")),
        *(pairs_sql(f"acf_{a}", a, "b.k-a.k AS lag", "b.k>=a.k") for a in ("t", "f")),
        *(pairs_sql(f"cor_{a}", a, "a.k AS i, b.k AS j", "true") for a in ("rx", "tx")),
        f"""cen AS (SELECT sample, tx, rx, f, k, (re-avg(re) OVER w)*{hann} AS re, (im-avg(im) OVER w)*{hann} AS im FROM v_t WINDOW w AS (PARTITION BY sample, tx, rx, f)),
dft AS (SELECT sample, q, sum(re*cos({arg})+im*sin({arg})) AS yr, sum(im*cos({arg})-re*sin({arg})) AS yi FROM cen, range({nfft}) r(q) GROUP BY sample, tx, rx, f, q),
per AS (SELECT sample, ((q+{nfft // 2})%{nfft}-{nfft // 2})/({nfft}*CAST({SNAPSHOT_S} AS DOUBLE)) AS hz, avg(yr*yr+yi*yi)/(SELECT sum(pow({hann},2)) FROM range({n_t}) r(k)) AS p, count(*) AS n FROM dft GROUP BY 1,2),
dop AS (SELECT hz, sum(p*n)/sum(n) AS p FROM per GROUP BY 1),
mid AS (SELECT sample, sum(hz*p)/sum(p) AS mu FROM per GROUP BY 1),
dsd AS (SELECT sample, sqrt(sum(p*pow(hz-mu,2))/sum(p)) AS s FROM per JOIN mid USING (sample) GROUP BY 1)"""])


def cdf_sql(metric: str, s: str, source: str, series: str = "") -> str:
    over = f"PARTITION BY {series} " if series else ""
    y = f"row_number() OVER ({over}ORDER BY {s})/CAST(count(*) OVER ({over}) AS DOUBLE)"
    return points_sql(metric, s, y, source, series or "''")


GRID_SQL = """edge AS (SELECT min(delay_s) AS lo, (max(delay_s)-min(delay_s))/64 AS w FROM cir WHERE path_valid),
heat AS (SELECT sample, least(floor((delay_s-lo)/w),63) AS bin, sum(power) AS p FROM cir, edge WHERE path_valid GROUP BY 1,2),
cells_64 AS (SELECT s.sample, b AS bin, coalesce(p,0)/(SELECT count(DISTINCT t) FROM cir) AS p FROM (SELECT DISTINCT sample FROM heat) s CROSS JOIN range(64) r(b) LEFT JOIN heat ON heat.sample=s.sample AND heat.bin=b),
prof AS (SELECT path, avg(power) AS p, sum(delay_s*power)/sum(power) AS d FROM cir WHERE path_valid GROUP BY 1 HAVING sum(power)>0)"""

COMMON_SQL = " UNION ALL ".join([
    points_sql("power", "sample", db_sql("linear"), "pw"),
    points_sql("pdp", "d*1e9", db_sql("p"), "prof"),
    cdf_sql("delay_spread_cdf", "s*1e9", "ds"),
    points_sql("spatial_correlation", "j", "sqrt(cr*cr+ci*ci)/s", "cor_rx", "'rx '||i"),
    points_sql("doppler_power_spectrum", "hz", db_sql("p"), "dop"),
    points_sql("time_autocorrelation", f"lag*{SNAPSHOT_S}", "sqrt(cr*cr+ci*ci)/s", "acf_t"),
    points_sql("frequency_autocorrelation", f"lag*{SUBCARRIER_HZ}", "sqrt(cr*cr+ci*ci)/s", "acf_f"),
    cdf_sql("doppler_spread_cdf", "s", "dsd"),
    points_sql("delay_sample_heatmap", "(lo+(bin+0.5)*w)*1e9", db_sql("p"), "cells_64, edge", "CAST(sample AS VARCHAR)"),
])

PATH_ANGLES_SQL = f"""turn AS (SELECT 'aoa' AS series, aoa_rad*(180/pi()) AS a, CASE WHEN path_valid THEN power ELSE 0 END AS p FROM cir UNION ALL
 SELECT 'aod', aod_rad*(180/pi()), CASE WHEN path_valid THEN power ELSE 0 END FROM cir),
hist AS (SELECT series, least(floor((a+180)/2),179) AS bin, sum(p) AS p FROM turn WHERE a BETWEEN -180 AND 180 GROUP BY 1,2),
ring AS (SELECT s.series, b AS bin, coalesce(p,0) AS p FROM (SELECT DISTINCT series FROM hist) s CROSS JOIN range(180) r(b) LEFT JOIN hist ON hist.series=s.series AND hist.bin=b),
{CIRC_SQL}"""

#: Frequency responses: 32 values as 4 frequencies, 4 times and 2 receive elements; every vector is a sample.
RESPONSE_SQL = """h AS (SELECT obs AS sample, 0 AS tx, k%2 AS rx, (k//2)%4 AS t, k//8 AS f, re, im FROM ctf),
taps AS (SELECT sample, tx, rx, t, CAST(q AS INTEGER) AS path, sum(re*cos(pi()*q*((f+2)%4)/2)-im*sin(pi()*q*((f+2)%4)/2))/4 AS re,
 sum(re*sin(pi()*q*((f+2)%4)/2)+im*cos(pi()*q*((f+2)%4)/2))/4 AS im FROM h, range(4) r(q) GROUP BY ALL),
cir AS (SELECT *, re*re+im*im AS power, path/(4*CAST(120000 AS DOUBLE)) AS delay_s, true AS path_valid FROM taps),
pw AS (SELECT sample, avg(re*re+im*im) AS linear FROM h GROUP BY 1)"""

RESPONSE_BEAM_SQL = f"""turned AS (SELECT sample, CAST(a AS INTEGER) AS angle, f, t, sum(re*cos(ph)+im*sin(ph)) AS yr, sum(im*cos(ph)-re*sin(ph)) AS yi
 FROM (SELECT *, 2*pi()*CAST({SPACING_WL!r} AS DOUBLE)*rx*sin(a*pi()/180) AS ph FROM h, range(-90, 91) r(a)) GROUP BY ALL),
beam AS (SELECT sample, angle, avg(yr*yr+yi*yi)/2 AS p FROM turned GROUP BY 1,2),
ring AS (SELECT 'rx beamspace' AS series, angle, avg(p) AS p FROM beam GROUP BY 2),
bm AS (SELECT sample, sum(angle*p)/sum(p) AS mu FROM beam GROUP BY 1),
wide AS (SELECT 'rx beamspace' AS series, sample, sqrt(sum(pow(angle-mu,2)*p)/sum(p)) AS s FROM beam JOIN bm USING (sample) GROUP BY 2)"""


def rounded(points):
    return points.select("metric", "series", r6("x", "x"), r6("y", "y"))


def metadata(rows, ula: bool):
    return rows.groupBy(D).agg(F.lit(8).alias("n_f")).withColumns({
        "has_frequency_axis": F.lit(True), "has_time_axis": F.lit(True), "tx_ula": F.lit(ula), "rx_ula": F.lit(ula),
        "sample_semantics": F.lit("ordered_route")})


@query("c27_analysis_points", "cir", f"""WITH {POWER_SQL}, {DELAY_SPREAD_SQL}, {CTF_SQL}, {GRID_SQL}, {channel_sql(12, 16)}, {PATH_ANGLES_SQL}
{COMMON_SQL} UNION ALL {points_sql('spatial_correlation', 'j', 'sqrt(cr*cr+ci*ci)/s', 'cor_tx', "'tx '||i")}
UNION ALL {points_sql('angular_power_spectrum', 'bin*2-179', db_sql('p', 'PARTITION BY series'), 'ring', 'series')}
UNION ALL {cdf_sql('angular_spread_cdf', 's', 'circ', 'series')}""")
def _(spark, sf):
    cir = views.cir(spark, sf)
    p, _ = analyze(cir, metadata(cir, False), spacing_s=SNAPSHOT_S, offsets_hz=centred_offsets(8, SUBCARRIER_HZ))
    return rounded(p)


@query("c27_response_analysis_points", "ctf", f"""WITH {RESPONSE_SQL}, {DELAY_SPREAD_SQL}, {GRID_SQL}, {channel_sql(4, 4)}, {RESPONSE_BEAM_SQL}
{COMMON_SQL} UNION ALL {points_sql('angular_power_spectrum', 'angle', db_sql('p'), 'ring', 'series')}
UNION ALL {cdf_sql('angular_spread_cdf', 's', 'wide', 'series')}""")
def _(spark, sf):
    k = F.col("k")
    whole = lambda x: F.floor(x).cast("int")
    ctf = views.ctf(spark, sf).select(
        D, F.col("obs").alias("sample"), F.lit(0).alias("tx"), (k % 2).alias("rx"), (whole(k / 2) % 4).alias("t"),
        whole(k / 8).alias("f"), "re", "im")
    p, _ = analyze_ctf(ctf, metadata(ctf, True), spacing_s=SNAPSHOT_S, step_hz=SUBCARRIER_HZ, element_wavelengths=SPACING_WL)
    return rounded(p)
