"""Channel statistics on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import SPEED_OF_LIGHT, db, peak_db, power, r6
from ..operators.ordering import positions
from ..operators import blocks, metrics, signal
from ..operators.metrics import D
from . import views
from .queries_blocks import ACF_SQL, DELAY_SPREAD_SQL, IDFT_SQL, delay_spread_ns
from .registry import query, s6

# Geometry and sampling of the bound tables.
CARRIER_HZ = 3.0e9
SPACING_M = 0.05
SPACING_WL = SPACING_M / (SPEED_OF_LIGHT / CARRIER_HZ)
SNAPSHOT_S = 0.001
SUBCARRIER_HZ = 120e3
BANDWIDTH_HZ = 100e6

POWER_SQL = """cells AS (SELECT sample, tx, rx, t, sum(CASE WHEN path_valid THEN power ELSE 0 END) AS p FROM cir GROUP BY 1,2,3,4),
pw AS (SELECT sample, avg(p) AS linear FROM cells GROUP BY 1)"""


@query("c01_power_per_sample", "cir", f"""WITH {POWER_SQL}
SELECT sample, {s6('10*log10(linear)', 'level_db')}, {s6('greatest(10*log10(linear/max(linear) OVER ()), -120)', 'normalized_db')} FROM pw""")
def _(spark, sf):
    p = metrics.peak_normalized(metrics.cir_power(views.cir(spark, sf)))
    return p.select("sample", r6(db("linear"), "level_db"), r6("normalized_db", "normalized_db"))


@query("c01_power_per_sample_ctf", "ctf", f"""WITH p AS (SELECT sample, avg(re*re+im*im) AS linear FROM ctf GROUP BY 1)
SELECT sample, {s6('linear', 'linear')}, {s6('10*log10(linear/max(linear) OVER ())', 'normalized_db')} FROM p""")
def _(spark, sf):
    p = metrics.peak_normalized(metrics.ctf_power(views.ctf(spark, sf)))
    return p.select("sample", r6("linear", "linear"), r6("normalized_db", "normalized_db"))


@query("c02_db_floor_and_clip", "cir", f"""WITH v AS (SELECT sample, path, avg(CASE WHEN l THEN power ELSE 0 END) AS p FROM
  (SELECT *, path_valid AND path%3<>0 AS l FROM cir) GROUP BY 1,2)
SELECT sample, path, {s6('10*log10(greatest(p, 2.2250738585072014e-308))', 'level_db')},
 {s6('greatest(10*log10(greatest(p, 2.2250738585072014e-308)) - max(10*log10(greatest(p, 2.2250738585072014e-308))) OVER (PARTITION BY sample), -120)', 'clipped_db')} FROM v""")
def _(spark, sf):
    p = F.when(F.col("path_valid") & (F.col("path") % 3 != 0), power()).otherwise(0.0)
    rows = views.cir(spark, sf).groupBy(D, "sample", "path").agg(F.avg(p).alias("p"))
    return peak_db(rows, "p", [D, "sample"], "clipped").select(
        "sample", "path", r6(db("p"), "level_db"), r6("clipped", "clipped_db"))


@query("c03_power_delay_profile", "cir", f"""WITH p AS (SELECT path, avg(power) AS linear, sum(delay_s*power)/sum(power) AS d
  FROM cir WHERE path_valid GROUP BY 1 HAVING sum(power)>0)
SELECT path, row_number() OVER (ORDER BY d) AS delay_rank, {s6('d*1e9', 'delay_ns')}, {s6('10*log10(linear)', 'level_db')},
 {s6('greatest(10*log10(linear/max(linear) OVER ()), -120)', 'normalized_db')} FROM p""")
def _(spark, sf):
    from pyspark.sql import Window
    p = metrics.power_delay_profile(views.cir(spark, sf))
    rank = F.row_number().over(Window.partitionBy(D).orderBy("delay_s", "path"))  # one row per path
    return p.select("path", rank.cast("long").alias("delay_rank"), r6(F.col("delay_s") * 1e9, "delay_ns"),
                    r6(db("linear"), "level_db"), r6("normalized_db", "normalized_db"))


@query("c04_weighted_spread", "cir", f"""WITH m AS (SELECT path, sum(power*delay_s)/sum(power) AS mu FROM cir GROUP BY 1)
SELECT path, {s6('sqrt(sum(power*pow(delay_s-mu,2))/sum(power))*1e9', 'spread_ns')} FROM cir JOIN m USING (path) GROUP BY 1""")
def _(spark, sf):
    from ..functions.scalars import weighted_spread
    s = views.cir(spark, sf).groupBy("path").agg((weighted_spread("delay_s", power()) * 1e9).alias("s"))
    return s.select("path", r6("s", "spread_ns"))


@query("c05_delay_spread", "cir", f"WITH {DELAY_SPREAD_SQL} SELECT sample, {s6('s*1e9', 'spread_ns')} FROM ds")
def _(spark, sf):
    return delay_spread_ns(spark, sf).select("sample", r6("ds_ns", "spread_ns"))


@query("c06_delay_spread_cdf", "cir", f"""WITH {DELAY_SPREAD_SQL}
SELECT sample, {s6('s*1e9', 'spread_ns')}, {s6('row_number() OVER (ORDER BY s, sample)/CAST(count(*) OVER () AS DOUBLE)', 'cdf')} FROM ds""")
def _(spark, sf):
    spreads = metrics.delay_spread(views.cir(spark, sf)).withColumn("ns", F.col("spread_s") * 1e9)
    return blocks.empirical_cdf(spreads, "ns", [D], ("sample",)).select("sample", r6("x", "spread_ns"), r6("y", "cdf"))


@query("c07_frequency_autocorrelation", "ctf", f"""WITH p AS ({ACF_SQL})
SELECT CAST(lag*120000 AS DOUBLE) AS lag_hz, {s6('cr/s','re')}, {s6('ci/s','im')}, {s6('sqrt(cr*cr+ci*ci)/s','magnitude')} FROM p""")
def _(spark, sf):
    a = signal.autocorrelation(views.ctf_vectors(spark, sf), [D])
    return a.select((F.col("lag") * F.lit(SUBCARRIER_HZ)).alias("lag_hz"),
                    r6("re", "re"), r6("im", "im"), r6("magnitude", "magnitude"))


@query("c08_time_autocorrelation", "ctf", f"""WITH p AS (SELECT a.sample, b.k-a.k AS lag,
 sum(a.re*b.re + a.im*b.im) AS cr, sum(a.im*b.re - a.re*b.im) AS ci,
 sqrt(sum(a.re*a.re+a.im*a.im) * sum(b.re*b.re+b.im*b.im)) AS s
 FROM ctf a JOIN ctf b ON a.obs=b.obs AND b.k>=a.k GROUP BY 1,2)
SELECT sample, {s6('lag','lag_ms')}, {s6('sqrt(cr*cr+ci*ci)/s','magnitude')}, {s6('atan2(ci/s, cr/s)','phase_rad')} FROM p WHERE lag>0""")
def _(spark, sf):
    a = signal.autocorrelation(views.ctf_vectors(spark, sf), [D, "sample"]).filter("lag > 0")
    return a.select("sample", r6(F.col("lag") * SNAPSHOT_S * 1e3, "lag_ms"), r6("magnitude", "magnitude"),
                    r6(F.atan2("im", "re"), "phase_rad"))


@query("c09_path_angle_spectrum", "cir", f"""WITH a AS (
  SELECT 'aoa' AS series, aoa_rad AS a, CASE WHEN path_valid THEN power ELSE 0 END AS p FROM cir UNION ALL
  SELECT 'aod', aod_rad, CASE WHEN path_valid THEN power ELSE 0 END FROM cir),
h AS (SELECT series, least(floor((a*(180/pi())+180)/2), 179) AS bin, sum(p) AS w FROM a
  WHERE a*(180/pi()) BETWEEN -180 AND 180 GROUP BY 1,2),
g AS (SELECT s.series, CAST(b AS INTEGER) AS bin, coalesce(w, 0) AS w FROM (SELECT DISTINCT series FROM h) s CROSS JOIN range(180) r(b)
  LEFT JOIN h ON h.series=s.series AND h.bin=b)
SELECT series, bin, {s6('bin*2-179', 'angle_deg')}, {s6('ln(1+w)', 'log_weight')},
 {s6('greatest(10*log10(greatest(w,2.2250738585072014e-308)) - max(10*log10(greatest(w,2.2250738585072014e-308))) OVER (PARTITION BY series), -120)', 'normalized_db')} FROM g""")
def _(spark, sf):
    s = metrics.path_angle_spectrum(views.cir(spark, sf))
    return s.select("series", ((F.col("angle_deg") + 179) / 2).cast("int").alias("bin"), r6("angle_deg", "angle_deg"),
                    r6(F.log1p("linear"), "log_weight"), r6("normalized_db", "normalized_db"))


CIRC_SQL = """ang AS (SELECT 'aoa' AS series, sample, aoa_rad AS a, power AS p FROM cir WHERE path_valid UNION ALL
  SELECT 'aod', sample, aod_rad, power FROM cir WHERE path_valid),
circ AS (SELECT series, sample, sqrt(greatest(0, -2*ln(least(greatest(sqrt(pow(sum(p*cos(a)),2)+pow(sum(p*sin(a)),2))/sum(p), 2.220446049250313e-16), 1))))*180/pi() AS s
  FROM ang GROUP BY 1,2)"""


@query("c10_circular_spread", "cir", f"WITH {CIRC_SQL} SELECT series, sample, {s6('s', 'spread_deg')} FROM circ")
def _(spark, sf):
    s = metrics.angular_spread(views.cir(spark, sf))
    return s.select("series", "sample", r6("spread_deg", "spread_deg"))


@query("c11_angular_spread_cdf", "cir", f"""WITH {CIRC_SQL}
SELECT series, row_number() OVER (PARTITION BY series ORDER BY s) AS i, {s6('s', 'spread_deg')},
 {s6('row_number() OVER (PARTITION BY series ORDER BY s)/CAST(count(*) OVER (PARTITION BY series) AS DOUBLE)', 'cdf')} FROM circ
 QUALIFY count(*) OVER (PARTITION BY series) >= 2""")
def _(spark, sf):
    cdf = blocks.empirical_cdf(metrics.angular_spread(views.cir(spark, sf)), "spread_deg", [D, "series"])
    return cdf.filter("n >= 2").select("series", "i", r6("x", "spread_deg"), r6("y", "cdf"))


BEAM_SQL = """resp AS (SELECT sample, obs, k//4 AS f, CAST(a AS INTEGER) AS angle,
  sum(re*cos(ph)+im*sin(ph))/2 AS yr, sum(im*cos(ph)-re*sin(ph))/2 AS yi FROM
  (SELECT *, 2*pi()*0.05/(CAST(299792458 AS DOUBLE)/3e9)*(k%4)*sin(a*pi()/180) AS ph FROM ctf, range(-90, 91) r(a)) GROUP BY 1,2,3,4)"""


@query("c12_beamspace_spectrum", "ctf", f"""WITH {BEAM_SQL},
s AS (SELECT angle, avg(yr*yr+yi*yi) AS p FROM resp GROUP BY 1)
SELECT angle, {s6('p', 'power')}, {s6('greatest(10*log10(p/max(p) OVER ()), -120)', 'normalized_db')} FROM s""")
def _(spark, sf):
    s = signal.beam_power(views.antenna_vectors(spark, sf), [D], SPACING_WL, list(range(-90, 91)))
    return peak_db(s, "power", [D], "n").select("angle", r6("power", "power"), r6("n", "normalized_db"))


@query("c13_beamspace_spread", "ctf", f"""WITH {BEAM_SQL},
s AS (SELECT sample, angle, avg(yr*yr+yi*yi) AS p FROM resp GROUP BY 1,2),
m AS (SELECT sample, sum(angle*p)/sum(p) AS mu FROM s GROUP BY 1)
SELECT sample, {s6('sqrt(sum(pow(angle-mu,2)*p)/sum(p))', 'spread_deg')} FROM s JOIN m USING (sample) GROUP BY 1""")
def _(spark, sf):
    s = metrics.beam_spread(views.antenna_vectors(spark, sf), [D, "sample"], SPACING_WL)
    return s.select("sample", r6("spread_deg", "spread_deg"))


@query("c14_angular_source", "cir", """SELECT 'lineitem' AS dataset_id,
 count(DISTINCT rx) AS n_rx, count(DISTINCT tx) AS n_tx,
 CASE WHEN count(DISTINCT rx)<=1 AND count(DISTINCT tx)<=1 THEN 'none' WHEN count(aoa_rad)+count(aod_rad)>0 THEN 'path_angles' ELSE 'beamspace' END AS source FROM cir
UNION ALL SELECT 'embeddings', 4, 1, 'beamspace' FROM (SELECT count(*) AS c FROM embeddings) WHERE c>0""")
def _(spark, sf):
    from ..operators import rules
    paths = rules.dataset_summary(views.cir(spark, sf)).withColumn("element_spacing_m", F.lit(None).cast("double"))
    rows = views.antenna_vectors(spark, sf)
    beams = rows.groupBy(D).agg(F.max(F.size("re")).cast("long").alias("n_rx")).select(
        D, F.lit(1).cast("long").alias("n_tx"), "n_rx", F.lit(False).alias("has_angles"),
        F.lit(CARRIER_HZ).alias("center_hz"), F.lit(SPACING_M).alias("element_spacing_m"))
    both = paths.select(D, "n_tx", "n_rx", "has_angles", F.lit(None).cast("double").alias("center_hz"),
                        "element_spacing_m").unionByName(beams)
    return rules.angular_source(both).select(D, "n_rx", "n_tx", "source")


@query("c15_spatial_correlation", "ctf", f"""WITH m AS (SELECT a.k%4 AS i, b.k%4 AS j,
  avg(a.re*b.re+a.im*b.im) AS cr, avg(a.im*b.re-a.re*b.im) AS ci FROM ctf a JOIN ctf b ON a.obs=b.obs AND a.k//4=b.k//4 GROUP BY 1,2),
g AS (SELECT i, cr AS g FROM m WHERE i=j)
SELECT CAST(m.i AS INTEGER) AS i, CAST(m.j AS INTEGER) AS j, {s6('cr/sqrt(a.g*b.g)','re')}, {s6('ci/sqrt(a.g*b.g)','im')}
FROM m JOIN g a ON a.i=m.i JOIN g b ON b.i=m.j""")
def _(spark, sf):
    m = signal.correlation_matrix(views.antenna_vectors(spark, sf), [D]).filter("n_rows >= 2")
    return m.select("i", "j", r6("re", "re"), r6("im", "im"))


DOPPLER_SQL = """cen AS (SELECT sample, obs, k, (re - avg(re) OVER (PARTITION BY obs))*(0.5-0.5*cos(2*pi()*k/31)) AS re,
  (im - avg(im) OVER (PARTITION BY obs))*(0.5-0.5*cos(2*pi()*k/31)) AS im FROM ctf),
dft AS (SELECT sample, obs, CAST((q+16)%32 AS INTEGER) AS q, sum(re*cos(2*pi()*q*k/32)+im*sin(2*pi()*q*k/32)) AS yr,
  sum(im*cos(2*pi()*q*k/32)-re*sin(2*pi()*q*k/32)) AS yi FROM cen, range(32) r(q) GROUP BY 1,2,3),
win AS (SELECT sum(pow(0.5-0.5*cos(2*pi()*k/31),2)) AS e FROM range(32) r(k)),
per AS (SELECT sample, obs, q, (q-16)/CAST(0.032 AS DOUBLE) AS f, (yr*yr+yi*yi)/e AS p FROM dft, win)"""


@query("c16_doppler_spectrum", "ctf", f"""WITH {DOPPLER_SQL}, s AS (SELECT q, f, avg(p) AS p FROM per GROUP BY 1,2)
SELECT q, {s6('f','frequency_hz')}, {s6('p','power')}, {s6('greatest(10*log10(p/max(p) OVER ()), -120)','normalized_db')} FROM s""")
def _(spark, sf):
    s = metrics.doppler_spectrum(views.ctf_vectors(spark, sf), [D], SNAPSHOT_S)
    return peak_db(s, "power", [D], "n").select(
        "q", r6("frequency_hz", "frequency_hz"), r6("power", "power"), r6("n", "normalized_db"))


DSPREAD_SQL = f"""{DOPPLER_SQL}, s AS (SELECT sample, f, avg(p) AS p FROM per GROUP BY 1,2),
mu AS (SELECT sample, sum(f*p)/sum(p) AS mu FROM s GROUP BY 1),
dsp AS (SELECT sample, sqrt(sum(p*pow(f-mu,2))/sum(p)) AS s FROM s JOIN mu USING (sample) GROUP BY 1)"""


@query("c17_doppler_spread", "ctf", f"WITH {DSPREAD_SQL} SELECT sample, {s6('s','spread_hz')} FROM dsp")
def _(spark, sf):
    s = metrics.doppler_spread(views.ctf_vectors(spark, sf), [D, "sample"], SNAPSHOT_S)
    return s.select("sample", r6("spread_hz", "spread_hz"))


@query("c18_doppler_spread_cdf", "ctf", f"""WITH {DSPREAD_SQL}
SELECT row_number() OVER (ORDER BY s) AS i, {s6('s','spread_hz')}, {s6('row_number() OVER (ORDER BY s)/CAST(count(*) OVER () AS DOUBLE)','cdf')} FROM dsp""")
def _(spark, sf):
    s = metrics.doppler_spread(views.ctf_vectors(spark, sf), [D, "sample"], SNAPSHOT_S)
    cdf = blocks.empirical_cdf(s, "spread_hz", [D])
    return cdf.select("i", r6("x", "spread_hz"), r6("y", "cdf"))


@query("c19_delay_sample_heatmap", "cir", f"""WITH g AS (SELECT min(delay_s) AS lo, (max(delay_s)-min(delay_s))/64 AS w FROM cir WHERE path_valid),
n AS (SELECT count(DISTINCT t) AS nt FROM cir),
h AS (SELECT sample, CAST(least(floor((delay_s-lo)/w),63) AS INTEGER) AS bin, sum(power) AS p FROM cir, g WHERE path_valid GROUP BY 1,2),
d AS (SELECT s.sample, CAST(b AS INTEGER) AS bin, coalesce(p,0)/nt AS p FROM (SELECT DISTINCT sample FROM h) s CROSS JOIN range(64) r(b) CROSS JOIN n
  LEFT JOIN h ON h.sample=s.sample AND h.bin=b)
SELECT sample, bin, {s6('(lo+(bin+0.5)*w)*1e9','delay_ns')}, {s6('10*log10(greatest(p,2.2250738585072014e-308))','level_db')},
 {s6('greatest(10*log10(greatest(p,2.2250738585072014e-308)) - max(10*log10(greatest(p,2.2250738585072014e-308))) OVER (), -120)','normalized_db')} FROM d, g""")
def _(spark, sf):
    h = metrics.delay_sample_heatmap(views.cir(spark, sf))
    return h.select("sample", "bin", r6(F.col("delay_s") * 1e9, "delay_ns"), r6(db("linear"), "level_db"),
                    r6("normalized_db", "normalized_db"))


CTF_SQL = """h AS (SELECT sample, tx, rx, t, CAST(f AS INTEGER) AS f,
  sum(re*cos(a)-im*sin(a)) AS re, sum(re*sin(a)+im*cos(a)) AS im FROM
  (SELECT *, -2*pi()*((f-3.5)*120000)*delay_s AS a FROM cir, range(8) r(f) WHERE path_valid) GROUP BY 1,2,3,4,5)"""


@query("c20_cir_to_ctf", "cir", f"WITH {CTF_SQL} SELECT sample, tx, rx, t, f, {s6('re','re')}, {s6('im','im')} FROM h")
def _(spark, sf):
    h = metrics.cir_to_ctf(views.cir(spark, sf), metrics.centred_offsets(8, SUBCARRIER_HZ))
    return h.select("sample", "tx", "rx", "t", "f", r6("re", "re"), r6("im", "im"))


@query("c21_ctf_dataset", "cir", f"""WITH {CTF_SQL}
SELECT sample, f, {s6('(3e9+(f-3.5)*120000)/1e6','frequency_mhz')}, {s6('120','spacing_khz')}, {s6('10*log10(avg(re*re+im*im))','level_db')} FROM h GROUP BY 1,2""")
def _(spark, sf):
    cir = views.cir(spark, sf)
    declared = cir.select(D).distinct().select(
        D, F.lit(8).alias("n_f"), F.lit(SUBCARRIER_HZ).alias("spacing_hz"), F.lit(CARRIER_HZ).alias("center_hz"))
    axis = metrics.frequency_axis(declared)
    h = metrics.cir_to_ctf_on_axis(cir, axis)
    mean = h.groupBy(D, "sample", "f").agg(F.avg(power()).alias("p"), F.first("spacing_hz").alias("spacing_hz"))
    return mean.join(axis, [D, "f"]).select(
        "sample", "f", r6(F.col("frequency_hz") / 1e6, "frequency_mhz"), r6(F.col("spacing_hz") / 1e3, "spacing_khz"), r6(db("p"), "level_db"))


@query("c22_ctf_to_discrete_cir", "ctf", f"""WITH h AS ({IDFT_SQL})
SELECT tap, {s6('tap/(32*CAST(120000 AS DOUBLE))*1e9','delay_ns')}, {s6('avg(re*re+im*im)*1e3','power_m')} FROM h GROUP BY 1""")
def _(spark, sf):
    h = signal.inverse_dft_shifted(views.ctf_vectors(spark, sf), ["obs"])
    taps = signal.unpack_axis(h, ["obs"], "tap").groupBy("tap").agg(F.avg(power()).alias("p"))
    return taps.select("tap", r6(metrics.discrete_delay(views.AXIS, SUBCARRIER_HZ) * 1e9, "delay_ns"),
                       r6(F.col("p") * 1e3, "power_m"))


@query("c23_frequency_axis", "ctf", f"""WITH d AS (SELECT max(k)+1 AS n FROM ctf)
SELECT CAST(f AS INTEGER) AS f, {s6('(f-(n-1)/2.0)*120000/1e3','offset_khz')}, {s6('(3e9+(f-(n-1)/2.0)*120000)/1e6','frequency_mhz')} FROM d, range(32) r(f)""")
def _(spark, sf):
    ds = views.ctf_vectors(spark, sf).groupBy(D).agg(F.max(F.size("re")).alias("n_f")).select(
        D, "n_f", F.lit(SUBCARRIER_HZ).alias("spacing_hz"), F.lit(CARRIER_HZ).alias("center_hz"))
    return metrics.frequency_axis(ds).select(
        "f", r6(F.col("offset_hz") / 1e3, "offset_khz"), r6(F.col("frequency_hz") / 1e6, "frequency_mhz"))


@query("c24_time_axis", "cir", f"""WITH a AS (SELECT DISTINCT t FROM cir), b AS (SELECT t, t*CAST(0.001 AS DOUBLE) AS s, t*CAST(0.001 AS DOUBLE)-lag(t*CAST(0.001 AS DOUBLE)) OVER (ORDER BY t) AS d FROM a),
m AS (SELECT median(d) AS m, max(abs(s)) AS top FROM b)
SELECT CAST(count(*) AS BIGINT) AS n, {s6('max(m)*1e3','spacing_ms')}, min(d)>0 AND bool_and(d IS NULL OR abs(d-m)<=greatest(m*1e-6, 1e-15)) AS uniform FROM b, m""")
def _(spark, sf):
    from ..operators import rules
    axis = metrics.time_axis(views.cir(spark, sf).groupBy(D, "t").agg(F.lit(None).cast("double").alias("time_s")), F.lit(SNAPSHOT_S))
    return rules.uniform_spacing(axis, [D], "x", "t").select("n", r6(F.col("spacing") * 1e3, "spacing_ms"), "uniform")


@query("c24_explicit_time_axis", "cand", f"""WITH a AS (SELECT DISTINCT candidate_id, t FROM cand), x AS (SELECT candidate_id, t, candidate_id%3<>0 AS explicit,
 CASE candidate_id%3 WHEN 1 THEN t*CAST(0.002 AS DOUBLE)+1 WHEN 2 THEN t*t*CAST(0.001 AS DOUBLE) ELSE t*CAST(0.001 AS DOUBLE) END AS s FROM a),
b AS (SELECT *, s-lag(s) OVER (PARTITION BY candidate_id ORDER BY t) AS d FROM x), m AS (SELECT candidate_id, median(d) AS m FROM b GROUP BY 1)
SELECT candidate_id AS dataset_id, explicit, CAST(count(*) AS BIGINT) AS n, {s6('any_value(m)*1e3','spacing_ms')}, coalesce(min(d)>0 AND bool_and(d IS NULL OR abs(d-m)<=greatest(m*1e-6, 1e-15)), false) AS uniform FROM b JOIN m USING (candidate_id) GROUP BY 1,2""")
def _(spark, sf):
    """Two of three datasets declare their times; one of those is not uniform."""
    from ..operators import rules
    k, t = F.col(D) % 3, F.col("t")
    axis = views.cand(spark, sf).select(F.col("candidate_id").alias(D), "t").distinct().withColumn(
        "time_s", F.when(k == 1, t * F.lit(0.002) + 1).when(k == 2, (t * t) * F.lit(0.001)))
    axis = metrics.time_axis(axis, F.lit(SNAPSHOT_S))
    u = rules.uniform_spacing(axis, [D], "x", "t")
    return u.join(axis.select(D, "explicit").distinct(), D).select(D, "explicit", "n", r6(F.col("spacing") * 1e3, "spacing_ms"), "uniform")


@query("c25_path_length_axis", "pseq", f"""WITH d AS (SELECT group_id, idx, sqrt(pow(DS_mu-lag(DS_mu) OVER w,2)+pow(KF_mu-lag(KF_mu) OVER w,2)) AS s
  FROM pseq WINDOW w AS (PARTITION BY group_id ORDER BY idx))
SELECT group_id, idx, {s6('sum(coalesce(s,0)) OVER (PARTITION BY group_id ORDER BY idx)','x')} FROM d""")
def _(spark, sf):
    axis = metrics.path_length_axis(views.pseq(spark, sf), [D, "group_id"], "idx", ["DS_mu", "KF_mu"])
    return axis.select("group_id", "idx", r6("x", "x"))


@query("c26_narrowband_collapse", "cir", f"""SELECT sample, tx, rx, t, {s6('sum(CASE WHEN path_valid THEN re ELSE 0 END)','re')},
 {s6('sum(CASE WHEN path_valid THEN im ELSE 0 END)','im')} FROM cir GROUP BY 1,2,3,4""")
def _(spark, sf):
    n = metrics.narrowband(views.cir(spark, sf))
    return n.select("sample", "tx", "rx", "t", r6("re", "re"), r6("im", "im"))


@query("c28_profile_metrics", "dpsd", f"""SELECT bin, {s6('bin/CAST(100e6 AS DOUBLE)*1e9','delay_ns')}, {s6('10*log10(avg(pow(10,dbm/10))+1e-20)','profile_db')} FROM dpsd GROUP BY 1""")
def _(spark, sf):
    m = metrics.mean_profile(views.dpsd(spark, sf), BANDWIDTH_HZ)
    return m.select("bin", r6("delay_ns", "delay_ns"), r6("profile_db", "profile_db"))


@query("c29_profile_delay_spread", "dpsd", f"""WITH p AS (SELECT snapshot, bin/CAST(100e6 AS DOUBLE) AS tau, pow(10,dbm/10) AS p FROM dpsd),
m AS (SELECT snapshot, sum(tau*p)/sum(p) AS mu FROM p GROUP BY 1)
SELECT snapshot, {s6('sqrt(sum(p*pow(tau-mu,2))/sum(p))*1e9','spread_ns')} FROM p JOIN m USING (snapshot) GROUP BY 1""")
def _(spark, sf):
    s = metrics.profile_delay_spread(views.dpsd(spark, sf), BANDWIDTH_HZ)
    return s.select("snapshot", r6(F.col("spread_s") * 1e9, "spread_ns"))


@query("c30_series_spectrum", "dpsd", f"""WITH s AS (SELECT row_number() OVER (ORDER BY snapshot)-1 AS k, dbm - avg(dbm) OVER () AS x FROM dpsd WHERE bin=32),
n AS (SELECT CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS n FROM s),
y AS (SELECT q, sum(x*cos(2*pi()*((q*k)%n)/n)) AS yr, sum(x*sin(2*pi()*((q*k)%n)/n)) AS yi, any_value(n) AS n FROM s, (SELECT n, unnest(range(n)) AS q FROM n) GROUP BY 1),
p AS (SELECT (q+n//2)%n AS q, n, yr*yr+yi*yi AS p FROM y)
SELECT q, {s6('-1+2*q/CAST(n-1 AS DOUBLE)','x')}, {s6('10*log10(p/max(p) OVER ()+1e-20)','spectrum_db')} FROM p""")
def _(spark, sf):
    d = views.dpsd(spark, sf).filter(F.col("bin") == 32)
    ranked = positions(d, [D], ["snapshot"], "snapshot", "i").select((F.col("i") - 1).alias("k"), F.col("dbm").alias("x"))
    s = metrics.series_spectrum(ranked, ranked.count())
    return s.select("q", r6("x", "x"), r6("spectrum_db", "spectrum_db"))


ANT_SQL = """ant AS (SELECT obs, k//4 AS f, CAST((q+64)%128 AS INTEGER) AS q, sum(re*cos(2*pi()*q*(k%4)/128)+im*sin(2*pi()*q*(k%4)/128)) AS yr,
  sum(im*cos(2*pi()*q*(k%4)/128)-re*sin(2*pi()*q*(k%4)/128)) AS yi FROM ctf, range(128) r(q) GROUP BY 1,2,3)"""


@query("c31_antenna_spectrum", "ctf", f"""WITH {ANT_SQL}, s AS (SELECT q, 10*log10(avg(yr*yr+yi*yi)+1e-20) AS p FROM ant GROUP BY 1)
SELECT q, {s6('-90+q*(180/CAST(127 AS DOUBLE))','angle_deg')}, {s6('p-max(p) OVER ()','spectrum_db')} FROM s""")
def _(spark, sf):
    s = metrics.antenna_fft_spectrum(views.antenna_vectors(spark, sf), [D])
    return s.select("q", r6("angle_deg", "angle_deg"), r6("spectrum_db", "spectrum_db"))


def snapshot_scenario():
    return F.when(F.col("sample") % 3 == 0, "RIS").when(F.col("sample") % 3 == 1, "Sub-6").otherwise("mmWave")


@query("c32_snapshot_preparation", "ctf", f"""WITH hf AS (SELECT obs, sample, k//4 AS f, sum(re) AS re, sum(im) AS im, sum(re*re+im*im) AS p,
  sum(CASE WHEN k%4=0 THEN re*re+im*im ELSE 0 END) AS p0 FROM ctf GROUP BY 1,2,3),
ht AS (SELECT obs, n, sum(re*cos(2*pi()*n*f/8)-im*sin(2*pi()*n*f/8))/8 AS re, sum(im*cos(2*pi()*n*f/8)+re*sin(2*pi()*n*f/8))/8 AS im FROM hf, range(8) r(n) GROUP BY 1,2),
w AS (SELECT hf.obs, f AS bin, CASE sample%3 WHEN 0 THEN ht.re*ht.re+ht.im*ht.im WHEN 1 THEN p ELSE p0 END AS w FROM hf JOIN ht ON ht.obs=hf.obs AND ht.n=hf.f),
g AS (SELECT vec_id AS obs, b AS bin FROM embeddings, range(12) r(b))
SELECT obs, CAST(bin AS INTEGER) AS bin, {s6('coalesce(10*log10(w/1e-3+1e-20), -130)','dbm')} FROM g LEFT JOIN w USING (obs, bin)""")
def _(spark, sf):
    rows = views.antenna_vectors(spark, sf).withColumn("scenario", snapshot_scenario())
    return metrics.prepare_snapshots(rows, [D, "obs"], 12).select("obs", "bin", r6("dbm", "dbm"))


@query("c33_profile_cleanup", "dpsd", f"""SELECT snapshot, CAST(count_if(bin%7=0 OR bin%11=0) AS BIGINT) AS replaced,
 {s6('avg(CASE WHEN bin%7=0 OR bin%11=0 THEN -130 ELSE dbm END)','mean_dbm')} FROM dpsd GROUP BY 1""")
def _(spark, sf):
    broken = views.dpsd(spark, sf).withColumn(
        "dbm", F.when(F.col("bin") % 7 == 0, float("nan")).when(F.col("bin") % 11 == 0, float("-inf")).otherwise(F.col("dbm")))
    return metrics.clean_dbm(broken).groupBy("snapshot").agg(
        F.count_if(F.col("dbm") == -130.0).alias("replaced"), r6(F.avg("dbm"), "mean_dbm"))


@query("c34_cir_to_profile", "ctf", f"""WITH y AS (SELECT obs, CAST(q AS INTEGER) AS bin,
  sum(re*cos(2*pi()*q*k/32)+im*sin(2*pi()*q*k/32)) AS yr,
  sum(im*cos(2*pi()*q*k/32)-re*sin(2*pi()*q*k/32)) AS yi FROM ctf, range(32) r(q) GROUP BY 1,2)
SELECT obs, bin, {s6('10*log10((yr*yr+yi*yi)/1e-3+1e-20)','dbm')} FROM y""")
def _(spark, sf):
    p = metrics.profile_from_taps(views.ctf_vectors(spark, sf), ["obs"])
    return p.select("obs", "bin", r6("dbm", "dbm"))


@query("c35_average_antenna_spectrum", "ctf", f"""WITH {ANT_SQL}, s AS (SELECT obs, q, 10*log10(avg(yr*yr+yi*yi)+1e-20) AS p FROM ant GROUP BY 1,2),
n AS (SELECT q, p-max(p) OVER (PARTITION BY obs) AS d FROM s)
SELECT q, {s6('-90+q*(180/CAST(127 AS DOUBLE))','angle_deg')}, {s6('avg(d)','mean_db')} FROM n GROUP BY 1""")
def _(spark, sf):
    s = metrics.antenna_fft_spectrum(views.antenna_vectors(spark, sf), [D, "obs"])
    return s.groupBy("q", "angle_deg").agg(F.avg("spectrum_db").alias("m")).select(
        "q", r6("angle_deg", "angle_deg"), r6("m", "mean_db"))


@query("c36_frozen_grid_features", "cir", f"""WITH g AS (SELECT greatest(1e-9, max(delay_s)*(1+CAST(0.2 AS DOUBLE))) AS top FROM cir WHERE sample%10=0),
p AS (SELECT sample, path, sum(power) AS p, avg(delay_s) AS d FROM cir GROUP BY 1,2),
b AS (SELECT sample, CASE WHEN d>=top THEN 64 ELSE least(floor(d/(top/64)),63) END AS bin, sum(p) AS w FROM p, g GROUP BY 1,2),
f AS (SELECT sample, sum(p) AS tot, sum(p*d)/sum(p) AS mu FROM p GROUP BY 1),
r AS (SELECT sample, sqrt(sum(p*pow(d-mu,2))/any_value(tot)) AS rms FROM p JOIN f USING (sample) GROUP BY 1)
SELECT sample, CAST(bin AS INTEGER) AS bin, {s6('w/tot','pdp')}, {s6('rms*1e9','rms_ns')} FROM b JOIN f USING (sample) JOIN r USING (sample)""")
def _(spark, sf):
    cir = views.cir(spark, sf)
    grid = metrics.delay_grid(cir.filter(F.col("sample") % 10 == 0))
    f = metrics.frozen_grid_features(cir, [D, "sample"], grid)
    return f.select("sample", "bin", r6("pdp", "pdp"), r6(F.col("rms_delay_s") * 1e9, "rms_ns"))
