"""Statistical building blocks on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import power, r6, watts_to_dbm
from ..operators import blocks, metrics, signal
from ..operators.metrics import D
from . import views
from .registry import query, s6

DELAY_SPREAD_SQL = """snap AS (SELECT sample, t, sum(power*delay_s)/sum(power) AS mu FROM cir WHERE path_valid GROUP BY 1,2),
by_time AS (SELECT c.sample, c.t, sqrt(sum(c.power*pow(c.delay_s-s.mu,2))/sum(c.power)) AS s
  FROM cir c JOIN snap s ON c.sample=s.sample AND c.t=s.t WHERE c.path_valid GROUP BY 1,2),
ds AS (SELECT sample, avg(s) AS s FROM by_time GROUP BY 1)"""


def delay_spread_ns(spark, sf):
    return metrics.delay_spread(views.cir(spark, sf)).withColumn("ds_ns", F.col("spread_s") * 1e9)


@query("d01_empirical_cdf", "cir", f"""WITH {DELAY_SPREAD_SQL}
SELECT row_number() OVER (ORDER BY s) AS i, {s6('s*1e9', 'x')},
 {s6('row_number() OVER (ORDER BY s) / CAST(count(*) OVER () AS DOUBLE)', 'y')} FROM ds""")
def _(spark, sf):
    cdf = blocks.empirical_cdf(delay_spread_ns(spark, sf), "ds_ns", [D])
    return cdf.select("i", r6("x", "x"), r6("y", "y"))


@query("d01_cdf_summary", "cir", f"""WITH {DELAY_SPREAD_SQL}
SELECT count(*) AS sample_count, {s6('quantile_cont(s, 0.5)*1e9', 'median')},
 {s6('quantile_cont(s, 0.9)*1e9', 'percentile_90')}, count(*)>=2 AS available, count(*)>=20 AS recommended_met,
 CASE WHEN count(*)<20 THEN 'CDF uses '||count(*)||' samples; at least 20 are recommended.' ELSE '' END AS warning FROM ds""")
def _(spark, sf):
    s = blocks.cdf_summary(delay_spread_ns(spark, sf), "ds_ns", [D])
    return s.select("sample_count", r6("median", "median"), r6("percentile_90", "percentile_90"),
                    "available", "recommended_met", "warning")


@query("d02_step_ecdf", "dpsd", f"""WITH v AS (SELECT round(max(dbm), 1) AS x FROM dpsd GROUP BY snapshot),
c AS (SELECT x, count(*) AS c FROM v GROUP BY 1),
r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(c) OVER (ORDER BY x) / CAST(sum(c) OVER () AS DOUBLE) AS f FROM c)
SELECT i, {s6('x','x')}, {s6('f','f')} FROM r UNION ALL SELECT 0, {s6('min(x)','x')}, CAST(0 AS DOUBLE) FROM c""")
def _(spark, sf):
    peaks = views.dpsd(spark, sf).groupBy(D, "snapshot").agg(F.round(F.max("dbm"), 1).alias("peak"))
    return blocks.step_ecdf(peaks, "peak", [D]).select("i", r6("x", "x"), r6("f", "f"))


@query("d03_weighted_histogram", "cir", f"""WITH g AS (SELECT min(delay_s) AS lo, (max(delay_s)-min(delay_s))/64 AS w FROM cir)
SELECT CAST(least(floor((delay_s-lo)/w), 63) AS INTEGER) AS bin, {s6('ln(sum(power))', 'log_weight')} FROM cir, g GROUP BY 1""")
def _(spark, sf):
    cir = views.cir(spark, sf)
    grid = cir.groupBy(D).agg(F.min("delay_s").alias("lo"), ((F.max("delay_s") - F.min("delay_s")) / 64).alias("w"))
    rows = metrics.bounded_join(cir, grid, [D])
    h = blocks.weighted_histogram(rows, "delay_s", power(), [D], F.col("lo"), F.col("w"), F.lit(64))
    return h.select("bin", r6(F.log("weight"), "log_weight"))


ACF_SQL = """SELECT b.k-a.k AS lag,
 sum(a.re*b.re + a.im*b.im) AS cr, sum(a.im*b.re - a.re*b.im) AS ci,
 sqrt(sum(a.re*a.re+a.im*a.im) * sum(b.re*b.re+b.im*b.im)) AS s
 FROM ctf a JOIN ctf b ON a.obs=b.obs AND b.k>=a.k GROUP BY 1"""


@query("d04_autocorrelation", "ctf", f"""WITH p AS ({ACF_SQL})
SELECT lag, {s6('cr/s','re')}, {s6('ci/s','im')}, {s6('sqrt(cr*cr+ci*ci)/s','magnitude')} FROM p""")
def _(spark, sf):
    a = signal.autocorrelation(views.ctf_vectors(spark, sf), [D])
    return a.select("lag", r6("re", "re"), r6("im", "im"), r6("magnitude", "magnitude"))


@query("d05_dft_power", "ctf", f"""WITH y AS (SELECT obs, CAST(q AS INTEGER) AS q,
  sum(re*cos(2*pi()*q*k/32)+im*sin(2*pi()*q*k/32)) AS yr,
  sum(im*cos(2*pi()*q*k/32)-re*sin(2*pi()*q*k/32)) AS yi FROM ctf, range(32) r(q) GROUP BY 1,2)
SELECT q, {s6('avg(yr*yr+yi*yi)','power')} FROM y GROUP BY 1""")
def _(spark, sf):
    p = signal.power_spectrum(views.ctf_vectors(spark, sf), [D], demean=False, hann=False, shift=False)
    return p.select("q", r6("power", "power"))


IDFT_SQL = """SELECT obs, CAST(n AS INTEGER) AS tap,
  sum(re*cos(2*pi()*n*((k+16)%32)/32)-im*sin(2*pi()*n*((k+16)%32)/32))/32 AS re,
  sum(im*cos(2*pi()*n*((k+16)%32)/32)+re*sin(2*pi()*n*((k+16)%32)/32))/32 AS im
  FROM ctf, range(32) r(n) GROUP BY 1,2"""


@query("d06_inverse_dft", "ctf", f"""WITH h AS ({IDFT_SQL}) SELECT obs, tap, {s6('re','re')}, {s6('im','im')} FROM h""")
def _(spark, sf):
    h = signal.inverse_dft_shifted(views.ctf_vectors(spark, sf), ["obs"])
    return signal.unpack_axis(h, ["obs"], "tap").select("obs", "tap", r6("re", "re"), r6("im", "im"))


@query("d07_quantile_grid", "cir", f"""WITH {DELAY_SPREAD_SQL},
r AS (SELECT s, row_number() OVER (ORDER BY s) AS i, count(*) OVER () AS n FROM ds),
g AS (SELECT j, 1+(n-1)*(j/CAST(100 AS DOUBLE)) AS pos FROM range(101) t(j), (SELECT max(n) AS n FROM r))
SELECT CAST(j AS INTEGER) AS p_index,
 {s6('(lo.s*(1-(pos-floor(pos))) + hi.s*(pos-floor(pos)))*1e9', 'q')}
FROM g JOIN r lo ON lo.i=floor(pos) JOIN r hi ON hi.i=ceil(pos)""")
def _(spark, sf):
    q = blocks.quantiles(delay_spread_ns(spark, sf), "ds_ns", [D], [j / 100 for j in range(101)])
    return q.select("p_index", r6("q", "q"))


HIST_PAIR_SQL = """h AS (SELECT candidate_id, CAST(least(floor(delay_s*1e9/(50/CAST(16 AS DOUBLE))), 15) AS INTEGER) AS bin, sum(power) AS w
  FROM cand WHERE path_valid GROUP BY 1,2),
p AS (SELECT candidate_id, bin, w/sum(w) OVER (PARTITION BY candidate_id) AS p FROM h),
t AS (SELECT bin, sum(w) AS w FROM h GROUP BY 1), q AS (SELECT bin, w/sum(w) OVER () AS q FROM t)"""


def delay_histograms(spark, sf):
    """Delay probability per candidate and over all candidates on 16 bins of [0, 50] ns."""
    cand = views.cand(spark, sf).filter("path_valid").withColumn(
        "ns", F.least(F.col("delay_s") * 1e9, F.lit(50.0)))
    h = blocks.weighted_histogram(cand, "ns", power(), [D, "candidate_id"], F.lit(0.0), F.lit(50 / 16.0), F.lit(16))
    return h


@query("d08_js_distance", "cand", f"""WITH {HIST_PAIR_SQL},
e AS (SELECT candidate_id, (coalesce(p,0)+1e-12)/(1+16e-12) AS a, (q+1e-12)/(1+16e-12) AS b
  FROM (SELECT DISTINCT candidate_id FROM h) c CROSS JOIN q LEFT JOIN p USING (candidate_id, bin))
SELECT candidate_id, {s6('sqrt(greatest(0, least(1, sum(a*log2(a/((a+b)/2)) + b*log2(b/((a+b)/2)))/2)))', 'js_distance')}
FROM e GROUP BY 1""")
def _(spark, sf):
    h = delay_histograms(spark, sf)
    # All tables from here on have at most 16 rows per candidate.
    sums = h.groupBy(D, "candidate_id").agg(F.sum("weight").alias("s"))
    all_bins = h.groupBy(D, "bin").agg(F.sum("weight").alias("w"))
    total = h.groupBy(D).agg(F.sum("weight").alias("s"))
    q = all_bins.join(total, D).select(D, "bin", (F.col("w") / F.col("s")).alias("q"))
    grid = sums.join(q, D)
    pairs = grid.join(h, [D, "candidate_id", "bin"], "left").withColumn("p", F.col("weight") / F.col("s"))
    return blocks.js_distance(pairs, ["candidate_id"], "p", "q", 16).select(
        "candidate_id", r6("js_distance", "js_distance"))


@query("d09_log_quantile_distance", "cir", f"""WITH {DELAY_SPREAD_SQL},
r AS (SELECT sample%2 AS side, s, row_number() OVER (PARTITION BY sample%2 ORDER BY s) AS i, count(*) OVER (PARTITION BY sample%2) AS n FROM ds),
g AS (SELECT side, j, 1+(max(n)-1)*(j/CAST(100 AS DOUBLE)) AS pos FROM r, range(101) t(j) GROUP BY side, j),
q AS (SELECT g.side, j, lo.s*(1-(pos-floor(pos))) + hi.s*(pos-floor(pos)) AS q
  FROM g JOIN r lo ON lo.side=g.side AND lo.i=floor(pos) JOIN r hi ON hi.side=g.side AND hi.i=ceil(pos))
SELECT {s6('least(1, avg(abs(log10(greatest(a.q,1e-12))-log10(greatest(b.q,1e-12)))))', 'quantile_distance')}
FROM q a JOIN q b USING (j) WHERE a.side=0 AND b.side=1""")
def _(spark, sf):
    ds = metrics.delay_spread(views.cir(spark, sf)).withColumn("side", F.col("sample") % 2)
    q = blocks.quantiles(ds, "spread_s", [D, "side"], [j / 100 for j in range(101)])
    a = q.filter("side = 0").select(D, "p_index", F.col("q").alias("a"))
    b = q.filter("side = 1").select(D, "p_index", F.col("q").alias("b"))
    return blocks.log_quantile_distance(a.join(b, [D, "p_index"]), [D], "a", "b").select(
        r6("quantile_distance", "quantile_distance"))


@query("d10_watts_to_dbm", "cir", f"""SELECT sample, {s6('avg(10*log10(greatest(power, 2.2250738585072014e-308)/1e-3))', 'mean_dbm')},
 {s6('max(10*log10(greatest(power, 2.2250738585072014e-308)/1e-3))', 'max_dbm')} FROM cir GROUP BY 1""")
def _(spark, sf):
    return views.cir(spark, sf).groupBy("sample").agg(
        r6(F.avg(watts_to_dbm("power")), "mean_dbm"), r6(F.max(watts_to_dbm("power")), "max_dbm"))


@query("d11_snapshot_power", "dpsd", f"""SELECT snapshot, {s6('sum(pow(10, dbm/10-3))*1e6', 'total_uw')} FROM dpsd GROUP BY 1""")
def _(spark, sf):
    s = blocks.snapshot_power(views.dpsd(spark, sf), ["snapshot"])
    return s.select("snapshot", r6(F.col("total_w") * 1e6, "total_uw"))
