"""Forecasts, their evaluation and model choice on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import power, r6
from ..operators import evaluate as ev
from ..operators import forecast as fcst
from ..operators import metrics, rules
from ..operators import sequences as seqs
from ..operators.sequences import D
from . import views
from .queries_metrics import BANDWIDTH_HZ
from .queries_sequences import (
    NORM_SQL, SEQ_SQL, SPAN_SQL, SPLIT_SQL, example_split, pseq_examples, train_groups,
)
from .registry import query, s6
from .views import PARAMS

FC_SQL = f"""{SPAN_SQL},
exl AS (SELECT group_id, start_idx, 'DS_mu' AS param, a AS y FROM ex UNION ALL SELECT group_id, start_idx, 'KF_mu', b FROM ex),
lin AS (SELECT *, list_avg(y[1:16]) AS m, list_sum(list_transform(range(0, 16), lambda i: (i-7.5)*y[i+1]))/340 AS sl FROM exl),
fc AS (SELECT group_id, start_idx, CAST(j AS INTEGER) AS step, start_idx+16+j AS idx, param, y[17+j] AS truth, y[16] AS predicted, 'persistence' AS model FROM lin, range(4) r(j)
 UNION ALL SELECT group_id, start_idx, CAST(j AS INTEGER), start_idx+16+j, param, y[17+j], m+sl*(16+j-7.5), 'linear' FROM lin, range(4) r(j))"""

Z_SQL = f"""{FC_SQL}, {SPLIT_SQL}, {NORM_SQL},
z AS (SELECT fc.*, (predicted-truth)/std AS e FROM fc JOIN norm USING (param))"""


def pseq_forecast(spark, sf, task="extrapolation", models=("persistence", "linear")):
    return fcst.forecast(pseq_examples(spark, sf, task), PARAMS, task, models)


def scored_forecast(spark, sf):
    seq = views.pseq(spark, sf)
    ex = seqs.examples(seq, PARAMS, "extrapolation")
    norm = seqs.fit_normalization(seq, PARAMS, train_groups(example_split(spark, sf, ex)))
    return ev.with_z_error(fcst.forecast(ex, PARAMS, "extrapolation"), norm)


def forecast_columns(fc):
    return fc.select("group_id", "start_idx", "step", "param", r6("truth", "truth"), r6("predicted", "predicted"))


@query("g01_persistence_extrapolation", "pseq", f"""WITH {FC_SQL} SELECT group_id, start_idx, step, param, {s6('truth','truth')}, {s6('predicted','predicted')} FROM fc WHERE model='persistence'""")
def _(spark, sf):
    return forecast_columns(fcst.forecast(pseq_examples(spark, sf), PARAMS, "extrapolation", ("persistence",)))


INTERP_SQL = f"""{SPAN_SQL},
exl AS (SELECT group_id, start_idx, 'DS_mu' AS param, a AS y FROM ex UNION ALL SELECT group_id, start_idx, 'KF_mu', b FROM ex),
kn AS (SELECT group_id, start_idx, param, CAST(i AS DOUBLE) AS x, y[i+1] AS v FROM exl, range(20) r(i) WHERE i<8 OR i>=12),
rg AS (SELECT group_id, start_idx, param, regr_slope(v, x) AS sl, regr_intercept(v, x) AS ic FROM kn GROUP BY 1,2,3)"""


@query("g01_persistence_interpolation", "pseq", f"""WITH {INTERP_SQL}
SELECT group_id, start_idx, CAST(j AS INTEGER) AS step, param, {s6('y[9+j]','truth')}, {s6('(y[8]+y[13])/2','predicted')} FROM exl, range(4) r(j)""")
def _(spark, sf):
    return forecast_columns(fcst.forecast(pseq_examples(spark, sf, "interpolation"), PARAMS, "interpolation", ("persistence",)))


@query("g02_linear_extrapolation", "pseq", f"""WITH {FC_SQL} SELECT group_id, start_idx, step, param, {s6('truth','truth')}, {s6('predicted','predicted')} FROM fc WHERE model='linear'""")
def _(spark, sf):
    return forecast_columns(fcst.forecast(pseq_examples(spark, sf), PARAMS, "extrapolation", ("linear",)))


@query("g02_linear_interpolation", "pseq", f"""WITH {INTERP_SQL}
SELECT group_id, start_idx, CAST(j AS INTEGER) AS step, param, {s6('y[9+j]','truth')}, {s6('ic+sl*(8+j)','predicted')} FROM exl JOIN rg USING (group_id, start_idx, param), range(4) r(j)""")
def _(spark, sf):
    return forecast_columns(fcst.forecast(pseq_examples(spark, sf, "interpolation"), PARAMS, "interpolation", ("linear",)))


# Default values of the parameters the tables do not carry.
DEFAULTS = {"DS_mu": -7.9, "KF_mu": -0.4, "DS_sigma": 0.4, "KF_sigma": 3.5, "r_DS": 2.3, "LNS_ksi": 3.0,
            "num_clusters": 12.0, "num_rays": 20.0, "doppler_hz": 0.0}


@query("g03_calibrated_persistence", "pseq", f"""WITH c AS (SELECT avg(DS_mu) AS ds, avg(KF_mu) AS kf FROM pseq WHERE quality_status<>'FAIL'),
t AS (SELECT group_id, max(idx)+1 AS idx FROM pseq GROUP BY 1),
p AS (SELECT * FROM (VALUES ('DS_mu','log10(s)',-7.9),('KF_mu','dB',-0.4),('DS_sigma','log10(s)',0.4),('KF_sigma','dB',3.5),('r_DS','ratio',2.3),('LNS_ksi','dB',3.0)) v(param, unit, d))
SELECT group_id, idx, param, unit, {s6("CASE param WHEN 'DS_mu' THEN ds WHEN 'KF_mu' THEN kf ELSE d END",'predicted')},
 CASE WHEN param IN ('DS_mu','KF_mu') THEN 'calibrated' ELSE 'default' END AS origin FROM t, p, c""")
def _(spark, sf):
    seq = views.pseq(spark, sf)
    targets = seq.groupBy(D, "group_id").agg((F.max("idx") + 1).alias("idx"))
    known = seqs.to_long(seq.filter("quality_status <> 'FAIL'"), PARAMS, [D])
    calibrated = known.groupBy(D, "param").agg(F.avg("value").alias("value"))
    p = fcst.calibrated_persistence(targets, calibrated, DEFAULTS, "extrapolation")
    return p.select("group_id", "idx", "param", "unit", r6("predicted", "predicted"), "origin")


@query("g04_metric_bundle", "pseq", f"""WITH {Z_SQL}
SELECT model, coalesce(param, 'all') AS param, count(*) AS n, {s6('sqrt(avg(e*e))','normalized_rmse')},
 round(CASE WHEN param IS NOT NULL THEN sqrt(avg(pow(predicted-truth,2))) END, 6) AS raw_rmse FROM z GROUP BY GROUPING SETS ((model, param), (model))""")
def _(spark, sf):
    b = ev.metric_bundle(scored_forecast(spark, sf))
    return b.select("model", F.coalesce("param", F.lit("all")).alias("param"), "n",
                    r6("normalized_rmse", "normalized_rmse"), F.round("raw_rmse", 6).alias("raw_rmse"))


@query("g05_group_rmse", "pseq", f"WITH {Z_SQL} SELECT model, group_id, {s6('sqrt(avg(e*e))','nrmse')} FROM z GROUP BY 1,2")
def _(spark, sf):
    return ev.group_scores(scored_forecast(spark, sf), ["model", "group_id"]).select("model", "group_id", r6("nrmse", "nrmse"))


@query("g06_rmse_nrmse", "pseq", f"""WITH {FC_SQL} SELECT model, param, {s6('sqrt(avg(pow(predicted-truth,2)))','rmse')},
 {s6('sqrt(avg(pow(predicted-truth,2)))/nullif(max(truth)-min(truth),0)*100','nrmse_percent')} FROM fc GROUP BY 1,2""")
def _(spark, sf):
    s = ev.rmse_and_range(pseq_forecast(spark, sf), ["model", "param"])
    return s.select("model", "param", r6("rmse", "rmse"), r6("nrmse_percent", "nrmse_percent"))


PROFILE_SQL = f"""{SEQ_SQL},
pw AS (SELECT bin, pos AS sample_no, last_value(dbm) OVER (PARTITION BY bin ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS predicted,
  lead(dbm, 10) OVER (PARTITION BY bin ORDER BY pos) AS truth FROM sq),
pf AS (SELECT * FROM pw WHERE truth IS NOT NULL),
pn AS (SELECT max(sample_no) AS n, greatest(1, floor(max(sample_no)/CAST(10 AS DOUBLE))) AS size FROM pf)"""


def profile_forecast(spark, sf):
    """Persistence over profile windows: the last input is the prediction."""
    w = seqs.sliding_windows(views.dpsd_sequence(spark, sf), [D, "bin"], "pos", "dbm", 10)
    return w.select(D, "bin", F.col("start_pos").alias("sample_no"), F.col("inputs")[9].alias("predicted"),
                    F.col("target").alias("truth"))


@query("g07_block_rmse", "dpsd", f"""WITH {PROFILE_SQL}
SELECT CAST(floor((sample_no-1)/size) AS BIGINT) AS block, {s6('sqrt(avg(pow(predicted-truth,2)))','rmse')} FROM pf, pn WHERE floor((sample_no-1)/size) < floor(n/size) GROUP BY 1""")
def _(spark, sf):
    return ev.block_rmse(profile_forecast(spark, sf), "sample_no").select("block", r6("rmse", "rmse"))


@query("g08_worst_block_profile", "dpsd", f"""WITH {PROFILE_SQL},
b AS (SELECT CAST(floor((sample_no-1)/size) AS BIGINT) AS block, sqrt(avg(pow(predicted-truth,2))) AS rmse FROM pf, pn WHERE floor((sample_no-1)/size) < floor(n/size) GROUP BY 1),
w AS (SELECT block AS worst FROM b ORDER BY rmse DESC, block LIMIT 1)
SELECT worst, bin, {s6('10*log10(avg(pow(10,truth/10))+1e-20)','truth_db')}, {s6('10*log10(avg(pow(10,predicted/10))+1e-20)','predicted_db')}
FROM pf, pn, w WHERE floor((sample_no-1)/size)=worst GROUP BY 1,2""")
def _(spark, sf):
    p = ev.worst_block_profile(profile_forecast(spark, sf), "sample_no", "bin")
    return p.select("worst", "bin", r6("truth_db", "truth_db"), r6("predicted_db", "predicted_db"))


@query("g09_capacity_accuracy", "dpsd", f"""WITH {PROFILE_SQL},
s AS (SELECT sample_no, avg(pow(10,predicted/10-3)) AS wp, avg(pow(10,truth/10-3)) AS wo FROM pf GROUP BY 1),
c AS (SELECT CAST(noise AS DOUBLE) AS noise_dbm, avg(1e8*log2(1+wp/pow(10,noise/10.0-3)))/1e9 AS cp, avg(1e8*log2(1+wo/pow(10,noise/10.0-3)))/1e9 AS co,
  10*log10(avg(wo)/pow(10,noise/10.0-3)) AS snr FROM s, (VALUES (-95),(-100),(-105),(-110),(-115)) v(noise) GROUP BY noise)
SELECT noise_dbm, {s6('cp','c_pred')}, {s6('co','c_truth')}, {s6('snr','snr_db')}, {s6('greatest(0, 1-avg(abs(cp-co)/co) OVER ())*100','accuracy_percent')} FROM c""")
def _(spark, sf):
    c = ev.capacity(profile_forecast(spark, sf), "sample_no", BANDWIDTH_HZ)
    return c.select("noise_dbm", r6("c_pred", "c_pred"), r6("c_truth", "c_truth"), r6("snr_db", "snr_db"),
                    r6("accuracy_percent", "accuracy_percent"))


MOMENT_SQL = f"""{PROFILE_SQL},
w AS (SELECT sample_no, bin, pow(10,predicted/10-3) AS wp, pow(10,truth/10-3) AS wo FROM pf),
m AS (SELECT sample_no, sum(bin*wp)/sum(wp) AS mp, sum(bin*wo)/sum(wo) AS mo FROM w GROUP BY 1),
t AS (SELECT sample_no, sqrt(sum(pow(bin-mp,2)*wp)/sum(wp))*10 AS tp, sqrt(sum(pow(bin-mo,2)*wo)/sum(wo))*10 AS t_o FROM w JOIN m USING (sample_no) GROUP BY 1),
mom AS (SELECT avg(tp) AS mu_pred, stddev_samp(tp) AS sd_pred, avg(t_o) AS mu_truth, stddev_samp(t_o) AS sd_truth, least(min(tp),min(t_o)) AS lo, greatest(max(tp),max(t_o)) AS hi FROM t)"""
MOMENTS = ("mu_pred", "sd_pred", "mu_truth", "sd_truth", "lo", "hi")


def normal_cdf_sql(z: str, out: str) -> str:
    """Normal distribution at z by the series of the error function."""
    u = f"greatest(least({z}/sqrt(CAST(2 AS DOUBLE)),6),-6)"
    nested = f"list_reduce(list_transform(range(120, 0, -1), lambda i: CAST(i AS DOUBLE)), lambda acc, n: 1+acc*2*{u}*{u}/(2*n+1), CAST(1 AS DOUBLE))"
    return s6(f"0.5*(1+2/sqrt(pi())*{u}*exp(-{u}*{u})*{nested})", out)


@query("g10_spread_moments", "dpsd", f"WITH {MOMENT_SQL} SELECT {', '.join(s6(c, c) for c in MOMENTS)} FROM mom")
def _(spark, sf):
    m = ev.spread_moments(ev.profile_spreads(profile_forecast(spark, sf), "sample_no", "bin", BANDWIDTH_HZ))
    return m.select(*[r6(c, c) for c in MOMENTS])


@query("g10_gaussian_spread_cdf", "dpsd", f"""WITH {MOMENT_SQL},
gr AS (SELECT k, lo+(hi-lo)*k/999 AS x, mu_pred, mu_truth, greatest(coalesce(sd_pred,0),1e-6) AS sp, greatest(coalesce(sd_truth,0),1e-6) AS st FROM mom, range(1000) r(k)),
zs AS (SELECT k, x, (x-mu_pred)/sp AS zp, (x-mu_truth)/st AS zt FROM gr)
SELECT CAST(k AS INTEGER) AS k, {s6('x','x')}, {normal_cdf_sql('zp','f_pred')}, {normal_cdf_sql('zt','f_truth')} FROM zs""")
def _(spark, sf):
    m = ev.spread_moments(ev.profile_spreads(profile_forecast(spark, sf), "sample_no", "bin", BANDWIDTH_HZ))
    g = ev.gaussian_spread_cdf(m)
    return g.select("k", r6("x", "x"), r6("f_pred", "f_pred"), r6("f_truth", "f_truth"))


@query("g11_accept_if_improved", "pseq", f"""WITH {Z_SQL},
s AS (SELECT group_id, sqrt(avg(e*e) FILTER (model='persistence')) AS base, sqrt(avg(e*e) FILTER (model='linear')) AS cand FROM z GROUP BY 1)
SELECT group_id, {s6('(base-cand)/greatest(base,2.220446049250313e-16)','relative_improvement')}, (base-cand)/greatest(base,2.220446049250313e-16)>=CAST(0.02 AS DOUBLE) AS accepted,
 CASE WHEN (base-cand)/greatest(base,2.220446049250313e-16)>=CAST(0.02 AS DOUBLE) THEN 'accepted' ELSE 'rolled_back' END AS status FROM s""")
def _(spark, sf):
    z = scored_forecast(spark, sf)
    rms_of = lambda m: F.sqrt(F.avg(F.when(F.col("model") == m, F.col("z_err") ** 2)))
    s = z.groupBy("group_id").agg(rms_of("persistence").alias("base"), rms_of("linear").alias("cand"))
    a = ev.accept_if_improved(s, "base", "cand", 0.02)
    return a.select("group_id", r6("relative_improvement", "relative_improvement"), "accepted", "status")


@query("g12_best_model", "pseq", f"""WITH {Z_SQL}, s AS (SELECT group_id, model, sqrt(avg(e*e)) AS v FROM z GROUP BY 1,2)
SELECT 'auto' AS mode, group_id, arg_min(model, v) AS model, {s6('min(v)','nrmse')} FROM s GROUP BY group_id
UNION ALL SELECT 'manual', group_id, model, {s6('v','nrmse')} FROM s WHERE model='linear'""")
def _(spark, sf):
    s = ev.group_scores(scored_forecast(spark, sf), ["group_id", "model"])
    out = lambda mode, df: df.select(F.lit(mode).alias("mode"), "group_id", "model", r6("nrmse", "nrmse"))
    return out("auto", ev.pick_model(s, ["group_id"])).unionByName(
        out("manual", ev.pick_model(s, ["group_id"], "manual", "linear")))


@query("g13_seed_summary", "pseq", f"""WITH {Z_SQL}, s AS (SELECT model, start_idx%3 AS seed, sqrt(avg(e*e)) AS v FROM z GROUP BY 1,2)
SELECT model, count(*) AS seeds, {s6('avg(v)','mean')}, {s6('stddev_pop(v)','std')}, CAST(arg_min(seed, v) AS BIGINT) AS best_seed FROM s GROUP BY 1""")
def _(spark, sf):
    z = scored_forecast(spark, sf).withColumn("seed", F.col("start_idx") % 3)
    s = ev.seed_summary(ev.group_scores(z, [D, "model", "seed"]))
    return s.select("model", "seeds", r6("mean", "mean"), r6("std", "std"), "best_seed")


@query("g13_seed_group_means", "pseq", f"""WITH {Z_SQL}, s AS (SELECT model, group_id, start_idx%3 AS seed, sqrt(avg(e*e)) AS v FROM z GROUP BY 1,2,3)
SELECT model, group_id, {s6('avg(v)','group_mean')} FROM s GROUP BY 1,2""")
def _(spark, sf):
    z = scored_forecast(spark, sf).withColumn("seed", F.col("start_idx") % 3)
    s = ev.group_scores(z, ["model", "group_id", "seed"]).groupBy("model", "group_id").agg(F.avg("nrmse").alias("m"))
    return s.select("model", "group_id", r6("m", "group_mean"))


QUAL_SQL = f"""{Z_SQL},
bl AS (SELECT group_id, start_idx, step, param, avg(e) AS e FROM z GROUP BY 1,2,3,4),
al AS (SELECT group_id, model, e FROM z UNION ALL SELECT group_id, 'blend', e FROM bl),
va AS (SELECT al.* FROM al JOIN split USING (group_id) WHERE partition_code=2),
ov AS (SELECT model, sqrt(avg(e*e)) AS v FROM va GROUP BY 1), gs AS (SELECT model, group_id, sqrt(avg(e*e)) AS v FROM va GROUP BY 1,2),
ql AS (SELECT c.model, c.v, any_value(b.v) AS bv, avg(CASE WHEN g.v/h.v<1 THEN 1.0 ELSE 0 END) AS win, max(g.v/h.v) AS worst FROM ov c, ov b, gs g, gs h
  WHERE b.model='persistence' AND c.model<>'persistence' AND g.model=c.model AND h.model='persistence' AND h.group_id=g.group_id GROUP BY 1,2)"""


def qualified(spark, sf):
    """Two candidates against the persistence baseline on the validation groups."""
    seq = views.pseq(spark, sf)
    ex = seqs.examples(seq, PARAMS, "extrapolation")
    split = example_split(spark, sf, ex)
    norm = seqs.fit_normalization(seq, PARAMS, train_groups(split))
    held = ex.join(split.filter("partition_code = 2").select(D, "group_id"), [D, "group_id"], "left_semi")
    fc = fcst.forecast(held, PARAMS, "extrapolation", ("persistence", "linear", "blend"))
    return ev.qualification(ev.error_sums(ev.with_z_error(fc, norm), [D, "model", "group_id"]), ["persistence"])


@query("g14_qualification", "pseq", f"""WITH {QUAL_SQL}
SELECT model, 'persistence' AS baseline, {s6('1-v/bv','improvement')}, {s6('win','win_rate')}, {s6('worst','worst_ratio')},
 1-v/bv>=CAST(0.1 AS DOUBLE) AND win>=CAST(0.6 AS DOUBLE) AND worst<=2 AS passed FROM ql""")
def _(spark, sf):
    q = qualified(spark, sf)
    return q.select("model", "baseline", r6("improvement", "improvement"), r6("win_rate", "win_rate"),
                    r6("worst_ratio", "worst_ratio"), "passed")


@query("g14_selected_model", "pseq", f"""WITH {QUAL_SQL},
p AS (SELECT model, v FROM ql WHERE 1-v/bv>=CAST(0.1 AS DOUBLE) AND win>=CAST(0.6 AS DOUBLE) AND worst<=2)
SELECT coalesce((SELECT arg_min(model, v) FROM p), 'persistence') AS selected, CASE WHEN (SELECT count(*) FROM p)>0 THEN 'qualified_candidate' ELSE 'baseline_fallback' END AS reason""")
def _(spark, sf):
    return ev.selected_model(qualified(spark, sf)).select("selected", "reason")


SEEDED_SQL = f"""{Z_SQL},
pl AS (SELECT group_id, start_idx, step, param, max(CASE WHEN model='linear' THEN e END) AS l, max(CASE WHEN model='persistence' THEN e END) AS p FROM z GROUP BY 1,2,3,4),
rn AS (SELECT group_id, 'linear' AS model, 0 AS seed, l AS e FROM pl UNION ALL SELECT group_id, 'persistence', 0, p FROM pl
 UNION ALL SELECT group_id, 'mixed', s, l*(CAST(0.2 AS DOUBLE)+CAST(0.2 AS DOUBLE)*s)+p*(CAST(0.8 AS DOUBLE)-CAST(0.2 AS DOUBLE)*s) FROM pl, range(3) r(s)
 UNION ALL SELECT group_id, 'damped', s, p*(CAST(0.7 AS DOUBLE)+CAST(0.1 AS DOUBLE)*s) FROM pl, range(3) r(s)),
va AS (SELECT rn.* FROM rn JOIN split USING (group_id) WHERE partition_code=2),
ov AS (SELECT model, avg(v) AS v FROM (SELECT model, seed, sqrt(avg(e*e)) AS v FROM va GROUP BY 1,2) GROUP BY 1),
gs AS (SELECT model, group_id, avg(v) AS v FROM (SELECT model, group_id, seed, sqrt(avg(e*e)) AS v FROM va GROUP BY 1,2,3) GROUP BY 1,2),
bs AS (SELECT model AS baseline, v AS bv FROM ov WHERE model IN ('persistence','linear') ORDER BY v, model LIMIT 1),
ql AS (SELECT c.model, baseline, c.v, bv, avg(CASE WHEN g.v/greatest(h.v,1e-12)<1 THEN 1.0 ELSE 0 END) AS win, max(g.v/greatest(h.v,1e-12)) AS worst FROM ov c, bs, gs g, gs h
  WHERE c.model IN ('mixed','damped') AND g.model=c.model AND h.model=baseline AND h.group_id=g.group_id GROUP BY 1,2,3,4)"""


@query("g14_seed_qualification", "pseq", f"""WITH {SEEDED_SQL}
SELECT model, baseline, {s6('v','nrmse')}, {s6('1-v/bv','improvement')}, {s6('win','win_rate')}, {s6('worst','worst_ratio')},
 1-v/bv>=CAST(0.1 AS DOUBLE) AND win>=CAST(0.6 AS DOUBLE) AND worst<=2 AS passed FROM ql""")
def _(spark, sf):
    """Two candidates of three seeds each against the better of two baselines, on the validation groups."""
    seq = views.pseq(spark, sf)
    ex = seqs.examples(seq, PARAMS, "extrapolation")
    split = example_split(spark, sf, ex)
    norm = seqs.fit_normalization(seq, PARAMS, train_groups(split))
    held = ex.join(split.filter("partition_code = 2").select(D, "group_id"), [D, "group_id"], "left_semi")
    scored = ev.with_z_error(fcst.forecast(held, PARAMS, "extrapolation", ("persistence", "linear")), norm)
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("z_err")))
    both = scored.groupBy(D, "group_id", "start_idx", "step", "param").agg(of("linear").alias("l"), of("persistence").alias("p"))
    run = lambda model, seed, e: F.struct(F.lit(model).alias("model"), F.lit(seed).alias("seed"), e.alias("z_err"))
    linear, persistence = F.col("l"), F.col("p")
    runs = [run("linear", 0, linear), run("persistence", 0, persistence)]
    runs += [run("mixed", s, linear * (F.lit(0.2) + F.lit(0.2) * s) + persistence * (F.lit(0.8) - F.lit(0.2) * s)) for s in range(3)]
    runs += [run("damped", s, persistence * (F.lit(0.7) + F.lit(0.1) * s)) for s in range(3)]
    rows = both.select(D, "group_id", F.explode(F.array(*runs)).alias("r")).select(D, "group_id", "r.*")
    q = ev.qualification(ev.error_sums(rows, [D, "model", "seed", "group_id"]), ["persistence", "linear"])
    return q.select("model", "baseline", r6("nrmse", "nrmse"), r6("improvement", "improvement"), r6("win_rate", "win_rate"),
                    r6("worst_ratio", "worst_ratio"), "passed")


def truth_and_prediction(spark, sf):
    ex = pseq_examples(spark, sf)
    fc = fcst.forecast(ex, PARAMS, "extrapolation", ("persistence",))
    return seqs.long_targets(ex, PARAMS), fc.withColumnRenamed("predicted", "value").drop("truth", "model")


@query("g15_pair_table", "pseq", f"""WITH {FC_SQL}, {SPLIT_SQL}
SELECT CASE partition_code WHEN 1 THEN 'train' WHEN 2 THEN 'validation' ELSE 'test' END AS split_part, group_id, start_idx, step, idx,
 {s6("max(truth) FILTER (param='DS_mu')",'truth_DS_mu')}, {s6("round_even(max(truth) FILTER (param='KF_mu'), 0)",'truth_KF_mu')},
 {s6("max(predicted) FILTER (param='DS_mu')",'predicted_DS_mu')}, {s6("round_even(max(predicted) FILTER (param='KF_mu'), 0)",'predicted_KF_mu')}
FROM fc JOIN split USING (group_id) WHERE model='persistence' GROUP BY 1,2,3,4,5""")
def _(spark, sf):
    truth, predicted = truth_and_prediction(spark, sf)
    # KF_mu stands in for an integer parameter so that the rounding rule is used.
    pairs = ev.pair_table(truth, predicted, PARAMS, ["KF_mu"]).join(example_split(spark, sf), [D, "group_id"])
    code = F.when(F.col("partition_code") == 1, "train").when(F.col("partition_code") == 2, "validation").otherwise("test")
    return pairs.select(code.alias("split_part"), "group_id", "start_idx", "step", "idx",
                        *[r6(f"{s}_{p}", f"{s}_{p}") for s in ("truth", "predicted") for p in PARAMS])


@query("g15_alignment_check", "pseq", f"""WITH {FC_SQL}
SELECT count(*) AS pair_keys, CAST(0 AS BIGINT) AS misaligned FROM (SELECT DISTINCT group_id, start_idx, step, idx FROM fc)""")
def _(spark, sf):
    truth, predicted = truth_and_prediction(spark, sf)
    return ev.pair_sides(truth, predicted).agg(
        F.count_if("in_truth").alias("pair_keys"), F.count_if(F.col("in_truth") != F.col("in_predicted")).alias("misaligned"))


@query("g16_independent_rows", "pseq", f"""WITH {FC_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY start_idx, step, param, model) AS rn FROM fc)
SELECT group_id, start_idx, step, param, model, {s6('truth','truth')} FROM f WHERE rn=1 ORDER BY group_id LIMIT 50""")
def _(spark, sf):
    rows = pseq_forecast(spark, sf).select("group_id", "start_idx", "step", "param", "model", "truth")
    first = ev.first_per_group(rows, "group_id", ["group_id", "start_idx", "step", "param", "model"], 50)
    return first.select("group_id", "start_idx", "step", "param", "model", r6("truth", "truth"))


VERSIONS = {"predicted": "prediction-1", "module2_calibrated": "calibration-1", "versioned_default": "defaults-1"}
SCENARIO = {"r_DS": 2.5, "doppler_hz": 35.0}
RESOLVE_SQL = """tg AS (SELECT group_id, arg_max(DS_mu, idx) AS ds, arg_max(KF_mu, idx) AS kf FROM pseq GROUP BY 1),
ca AS (SELECT stddev_samp(DS_mu) AS s1, stddev_samp(KF_mu) AS s2 FROM pseq WHERE quality_status<>'FAIL'),
et AS (SELECT avg(CASE WHEN event_type='error' THEN 35 ELSE 10 END) AS dop FROM pseq),
rs AS (SELECT group_id AS target, param, CASE param WHEN 'DS_mu' THEN ds WHEN 'KF_mu' THEN kf WHEN 'DS_sigma' THEN s1 WHEN 'KF_sigma' THEN s2
   WHEN 'doppler_hz' THEN dop ELSE d END AS value,
  CASE WHEN param IN ('DS_mu','KF_mu') THEN 'predicted' WHEN param IN ('DS_sigma','KF_sigma') THEN 'module2_calibrated' WHEN param='doppler_hz' THEN 'scenario_config' ELSE 'versioned_default' END AS source, lo, hi
  FROM tg, ca, et, (VALUES ('DS_mu',-7.9,-12,-3),('DS_sigma',0.4,0,3),('r_DS',2.3,2.220446049250313e-16,20),('num_clusters',12,1,100),('num_rays',20,1,1000),('LNS_ksi',3,2.220446049250313e-16,50),
  ('KF_mu',-0.4,-50,50),('KF_sigma',3.5,0,50),('doppler_hz',0,0,1e6)) v(param,d,lo,hi))"""


def resolved(spark, sf):
    seq = views.pseq(spark, sf)
    last = seq.groupBy("group_id").agg(*[F.max_by(p, "idx").alias(p) for p in PARAMS])
    targets = last.select(F.col("group_id").alias("target"))
    predicted = seqs.to_long(last, PARAMS, ["group_id"]).withColumnRenamed("group_id", "target")
    ok = seq.filter("quality_status <> 'FAIL'")
    sigma = ok.agg(F.stddev_samp("DS_mu").alias("DS_sigma"), F.stddev_samp("KF_mu").alias("KF_sigma"))
    calibrated = seqs.to_long(sigma, ["DS_sigma", "KF_sigma"], [])
    doppler = seq.agg(F.avg(F.when(F.col("event_type") == "error", 35).otherwise(10)).alias("doppler_hz"))
    scenario = seqs.to_long(doppler, ["doppler_hz"], [])
    return ev.resolve_parameters(targets, predicted, calibrated, scenario, DEFAULTS, VERSIONS)


@query("g17_resolved_parameters", "pseq", f"""WITH {RESOLVE_SQL}
SELECT target, param, {s6('value','value')}, source, CASE source WHEN 'predicted' THEN 'prediction-1' WHEN 'module2_calibrated' THEN 'calibration-1' WHEN 'versioned_default' THEN 'defaults-1' ELSE 'unspecified' END AS source_version,
 value BETWEEN lo AND hi AS in_bounds, param NOT IN ('num_clusters','num_rays') OR floor(value)=value AS integer_ok FROM rs""")
def _(spark, sf):
    r = resolved(spark, sf)
    return r.select("target", "param", r6("value", "value"), "source", "source_version", "in_bounds", "integer_ok")


@query("g18_source_counts", "pseq", f"""WITH {RESOLVE_SQL}
SELECT count_if(source='predicted')::BIGINT AS predicted, count_if(source='module2_calibrated')::BIGINT AS module2_calibrated, count_if(source='scenario_config')::BIGINT AS scenario_config,
 count_if(source='versioned_default')::BIGINT AS versioned_default FROM rs""")
def _(spark, sf):
    return ev.source_counts(resolved(spark, sf))


GRID_SQL = "gr AS (SELECT greatest(1e-9, max(delay_s)*(1+CAST(0.2 AS DOUBLE))) AS top FROM cir WHERE sample%2=0)"
PAIR_SQL = f"""{GRID_SQL},
pp AS (SELECT sample//2 AS pair_id, sample%2 AS side, path, sum(power) AS p, avg(delay_s) AS d FROM cir GROUP BY 1,2,3),
ff AS (SELECT pair_id, side, sum(p) AS tot, sum(p*d)/sum(p) AS mu, sum(CASE WHEN d>=top THEN p ELSE 0 END)/sum(p) AS over FROM pp, gr GROUP BY 1,2),
rr AS (SELECT pair_id, side, sqrt(sum(p*pow(d-mu,2))/sum(p)) AS rms, any_value(over) AS over FROM pp JOIN ff USING (pair_id, side) GROUP BY 1,2),
bb AS (SELECT pair_id, side, CASE WHEN d>=top THEN 64 ELSE least(floor(d/(top/64)),63) END AS bin, sum(p/tot) AS w FROM pp JOIN ff USING (pair_id, side), gr GROUP BY 1,2,3),
jj AS (SELECT coalesce(a.pair_id,b.pair_id) AS pair_id, coalesce(a.w,0) AS a, coalesce(b.w,0) AS b FROM (SELECT * FROM bb WHERE side=0) a FULL JOIN (SELECT * FROM bb WHERE side=1) b ON a.pair_id=b.pair_id AND a.bin=b.bin),
nn AS (SELECT pair_id, sqrt(sum(pow(a-b,2))/65)/greatest(sqrt(sum(a*a)/65),2.220446049250313e-16) AS pdp_nrmse FROM jj GROUP BY 1),
sc AS (SELECT n.pair_id, pdp_nrmse, abs(t.rms-g.rms) AS rms_err, t.over AS t_over, g.over AS g_over FROM nn n JOIN rr t ON t.pair_id=n.pair_id AND t.side=0 JOIN rr g ON g.pair_id=n.pair_id AND g.side=1)"""


def pair_scores(spark, sf):
    """Even samples are the truth, the next odd sample is its generated twin."""
    cir = views.cir(spark, sf).withColumn("pair_id", F.floor(F.col("sample") / 2)).withColumn("side", F.col("sample") % 2)
    grid = metrics.delay_grid(cir.filter("side = 0"))
    f = metrics.frozen_grid_features(cir, [D, "pair_id", "side"], grid)
    return ev.profile_pair_scores(f.filter("side = 0"), f.filter("side = 1"), [D, "pair_id"], 64)


@query("g19_profile_pair_scores", "cir", f"""WITH {PAIR_SQL} SELECT pair_id, {s6('pdp_nrmse','pdp_nrmse')}, {s6('rms_err*1e9','rms_error_ns')}, {s6('t_over','truth_overflow')}, {s6('g_over','generated_overflow')} FROM sc""")
def _(spark, sf):
    s = pair_scores(spark, sf)
    return s.select("pair_id", r6("pdp_nrmse", "pdp_nrmse"), r6(F.col("rms_delay_abs_error_s") * 1e9, "rms_error_ns"),
                    r6("truth_overflow", "truth_overflow"), r6("generated_overflow", "generated_overflow"))


@query("g19_parameter_nrmse", "pseq", f"""WITH {FC_SQL} SELECT group_id, start_idx, step, {s6('sqrt(avg(pow(truth-predicted,2)))/greatest(sqrt(avg(truth*truth)),2.220446049250313e-16)','parameter_nrmse')}
FROM fc WHERE model='persistence' GROUP BY 1,2,3""")
def _(spark, sf):
    fc = pseq_forecast(spark, sf, models=("persistence",))
    p = ev.parameter_nrmse(fc, ["group_id", "start_idx", "step"])
    return p.select("group_id", "start_idx", "step", r6("parameter_nrmse", "parameter_nrmse"))


@query("g20_frozen_delay_grid", "cir", f"""WITH {GRID_SQL} SELECT CAST(i AS INTEGER) AS edge, {s6('top*i/64*1e9','edge_ns')}, i=64 AS overflow_starts FROM gr, range(65) r(i)""")
def _(spark, sf):
    g = metrics.delay_grid(views.cir(spark, sf).filter(F.col("sample") % 2 == 0))
    e = g.withColumn("edge", F.explode(F.sequence(F.lit(0), F.col("bins"))))
    return e.select("edge", r6(F.col("finite_max") * F.col("edge") / F.col("bins") * 1e9, "edge_ns"),
                    (F.col("edge") == F.col("bins")).alias("overflow_starts"))


SUMMARY_SQL = f"""{PAIR_SQL},
sm AS (SELECT CASE pair_id%2 WHEN 0 THEN 'interpolation' ELSE 'extrapolation' END AS task, 'P'||CAST(2*(1+(pair_id//2)%4) AS VARCHAR) AS bundle, count(*) AS group_count,
  avg(pdp_nrmse) AS v, avg(rms_err) AS r, avg(g_over) AS o FROM sc GROUP BY 1,2)"""


def pair_summary(spark, sf):
    half = F.floor(F.col("pair_id") / 2)
    rows = pair_scores(spark, sf).withColumn(
        "task", F.when(F.col("pair_id") % 2 == 0, "interpolation").otherwise("extrapolation")).withColumn(
        "bundle", F.concat(F.lit("P"), (2 * (1 + half % 4)).cast("string")))
    return ev.bundle_summary(rows, ["pdp_nrmse", "rms_delay_abs_error_s", "generated_overflow"])


@query("g21_bundle_summary", "cir", f"WITH {SUMMARY_SQL} SELECT task, bundle, group_count, {s6('v','mean_pdp_nrmse')}, {s6('r*1e9','mean_rms_error_ns')}, {s6('o','mean_overflow')} FROM sm")
def _(spark, sf):
    s = pair_summary(spark, sf)
    return s.select("task", "bundle", "group_count", r6("mean_pdp_nrmse", "mean_pdp_nrmse"),
                    r6(F.col("mean_rms_delay_abs_error_s") * 1e9, "mean_rms_error_ns"), r6("mean_generated_overflow", "mean_overflow"))


@query("g22_smallest_good_bundle", "cir", f"""WITH {SUMMARY_SQL}, b AS (SELECT task, min(v) AS best FROM sm GROUP BY 1)
SELECT task, arg_min(bundle, CAST(bundle[2:] AS INTEGER)) AS selected_bundle, {s6('any_value(best)','best_score')}, {s6('arg_min(v, CAST(bundle[2:] AS INTEGER))','selected_score')}
FROM sm JOIN b USING (task) WHERE v<=best*(1+CAST(0.05 AS DOUBLE)) GROUP BY 1""")
def _(spark, sf):
    s = ev.smallest_good_bundle(pair_summary(spark, sf), "mean_pdp_nrmse")
    return s.select("task", "selected_bundle", r6("best_score", "best_score"), r6("selected_score", "selected_score"))


@query("g23_selected_files", "files", """WITH t AS (SELECT tokens[len(tokens)] AS x, path, regexp_extract(path, '/([a-z][a-z])/', 1) AS task, 'P'||CAST(file_id%4*2+2 AS VARCHAR) AS bundle FROM files),
d AS (SELECT task, bundle FROM t GROUP BY 1,2)
SELECT task, bundle, count(path) AS matches, min(path) AS path, count(path)=1 AS ok FROM d JOIN t USING (task, bundle) GROUP BY 1,2""")
def _(spark, sf):
    f = views.files(spark, sf).select(
        "path", F.regexp_extract("path", "/([a-z][a-z])/", 1).alias("task"),
        F.concat(F.lit("P"), (F.col("file_id") % 4 * 2 + 2).cast("string")).alias("bundle"))
    return ev.selected_files(f, f.select("task", "bundle").distinct()).select("task", "bundle", "matches", "path", "ok")


@query("g24_narrowband_fallback", "cir", f"""WITH nb AS (SELECT sample||'/'||tx||'/'||rx||'/'||t AS dataset_id, pow(sum(CASE WHEN path_valid THEN re ELSE 0 END),2)+pow(sum(CASE WHEN path_valid THEN im ELSE 0 END),2) AS p
  FROM cir GROUP BY sample, tx, rx, t)
SELECT dataset_id, {s6('10*log10(1+p)','power_db')}, 'capability_defaults' AS strategy, 'NARROWBAND_PDP_NOT_IDENTIFIABLE' AS reason_code, param, {s6('v','value')}
FROM nb, (VALUES ('DS_mu',-7.9),('KF_mu',-0.4)) d(param, v)""")
def _(spark, sf):
    # Every collapsed link is one narrowband single-antenna dataset.
    nb = metrics.narrowband(views.cir(spark, sf)).select(
        F.concat_ws("/", "sample", "tx", "rx", "t").alias(D), power().alias("mean_power"))
    summary = nb.withColumn("classification", rules.classify(
        has_wideband=F.lit(False), has_time=F.lit(False), has_array=F.lit(False)))
    f = ev.narrowband_fallback(summary, {p: DEFAULTS[p] for p in PARAMS})
    return f.select(D, r6(10 * F.log10(1 + F.col("mean_power")), "power_db"), "strategy", "reason_code", "param", r6("value", "value"))
