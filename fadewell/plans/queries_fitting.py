"""Candidate scoring and search analytics on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import fitting as fit
from ..operators import sequences as seqs
from ..operators.ordering import positions
from ..operators.sequences import D
from . import views
from .queries_evaluate import FC_SQL, pseq_forecast
from .queries_sequences import LOCAL_SQL, ranked_samples
from .registry import query, s6


@query("h01_parameter_grid", "pseq", f"""WITH ds AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM (SELECT round(avg(DS_mu), 3) AS v FROM pseq GROUP BY label_source) GROUP BY v),
kf AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM (SELECT round(KF_mu, 3) AS v FROM pseq GROUP BY 1)),
et AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(length(event_type) AS INTEGER) AS v FROM pseq))
SELECT CAST(((ds.i-1)*kf.n + kf.i-1)*et.n + et.i AS BIGINT) AS candidate, 'GS-'||lpad(CAST(((ds.i-1)*kf.n + kf.i-1)*et.n + et.i AS VARCHAR), 6, '0') AS id,
 {s6('ds.v','ds_mu')}, {s6('kf.v','kf_mu')}, et.v AS num_clusters FROM ds, kf, et""")
def _(spark, sf):
    seq = views.pseq(spark, sf)
    # Each list holds the distinct values of one parameter: a handful of rows.
    ds = seq.groupBy(D, "label_source").agg(F.round(F.avg("DS_mu"), 3).alias("v")).groupBy(D).agg(F.collect_set("v").alias("ds_mu"))
    rest = seq.groupBy(D).agg(F.collect_set(F.round("KF_mu", 3)).alias("kf_mu"),
                              F.collect_set(F.length("event_type")).alias("num_clusters"))
    names = ["ds_mu", "kf_mu", "num_clusters"]
    values = ds.join(rest, D).select(*[F.array_sort(n).alias(n) for n in names])
    g = fit.parameter_grid(values, names)
    return g.select("candidate", "id", r6("ds_mu", "ds_mu"), r6("kf_mu", "kf_mu"), "num_clusters")


@query("h01_candidate_key", "pseq", """SELECT DISTINCT 'DS_mu='||format('{:.3f}', round(DS_mu, 3))||'|KF_mu='||format('{:.3f}', round(KF_mu, 3)) AS candidate_key, count(*) OVER (PARTITION BY round(DS_mu, 3), round(KF_mu, 3)) AS proposals FROM pseq""")
def _(spark, sf):
    from ..functions.text import candidate_key
    seq = views.pseq(spark, sf).select(F.round("DS_mu", 3).alias("DS_mu"), F.round("KF_mu", 3).alias("KF_mu"))
    keyed = seq.select(candidate_key(["DS_mu", "KF_mu"], "%.3f").alias("candidate_key"))
    return keyed.groupBy("candidate_key").agg(F.count(F.lit(1)).alias("proposals"))


def spread_sql(name: str, source: str, keys: str) -> str:
    return f"""{name}_mu AS (SELECT {keys}, sample, t, sum(power*delay_s)/sum(power) AS mu FROM {source} WHERE path_valid GROUP BY ALL),
{name}_t AS (SELECT {', '.join('c.' + k.strip() for k in keys.split(','))}, c.sample, c.t, sqrt(sum(c.power*pow(c.delay_s-m.mu,2))/sum(c.power)) AS s
  FROM {source} c JOIN {name}_mu m ON {' AND '.join(f'c.{k.strip()}=m.{k.strip()}' for k in keys.split(','))} AND c.sample=m.sample AND c.t=m.t WHERE c.path_valid GROUP BY ALL),
{name}_s AS (SELECT {keys}, sample, avg(s) AS s FROM {name}_t GROUP BY ALL),
{name}_l AS (SELECT {keys}, list_sort(list(s)) AS l, count(*) AS n FROM {name}_s GROUP BY ALL),
{name}_q AS (SELECT {keys}, j, l[CAST(floor(1+(n-1)*j/CAST(100 AS DOUBLE)) AS INTEGER)]*(1-((1+(n-1)*j/CAST(100 AS DOUBLE))-floor(1+(n-1)*j/CAST(100 AS DOUBLE))))
   + l[CAST(ceil(1+(n-1)*j/CAST(100 AS DOUBLE)) AS INTEGER)]*((1+(n-1)*j/CAST(100 AS DOUBLE))-floor(1+(n-1)*j/CAST(100 AS DOUBLE))) AS q FROM {name}_l, range(101) r(j))"""


def path_sql(name: str, source: str, keys: str) -> str:
    return f"""{name}_p AS (SELECT {keys}, path, avg(power) AS p, sum(delay_s*power)/sum(power) AS d FROM {source} WHERE path_valid GROUP BY ALL HAVING sum(power)>0)"""


def score_sql(target_keys: str) -> str:
    """Scores of every candidate (c_p, c_q) for every target (t_p, t_q) of one dataset."""
    k = target_keys
    on = " AND ".join(f"a.{x.strip()}=b.{x.strip()}" for x in k.split(","))
    return f"""tw AS (SELECT {k}, max(d)*CAST(1.05 AS DOUBLE) AS w FROM t_p GROUP BY ALL),
th0 AS (SELECT a.*, least(floor(a.d/(b.w/128)),127) AS bin FROM t_p a JOIN tw b ON {on}),
th AS (SELECT {k}, bin, sum(p) AS p FROM th0 GROUP BY ALL), ths AS (SELECT *, p/sum(p) OVER (PARTITION BY {k}) AS sh FROM th),
ch0 AS (SELECT {k}, candidate_id, least(floor(least(d,w)/(w/128)),127) AS bin, p FROM c_p, tw),
ch AS (SELECT {k}, candidate_id, bin, sum(p) AS p FROM ch0 GROUP BY ALL), chs AS (SELECT *, p/sum(p) OVER (PARTITION BY {k}, candidate_id) AS sh FROM ch),
al AS (SELECT {k}, candidate_id, bin, 0 AS p, sh AS q FROM chs UNION ALL SELECT {k}, candidate_id, bin, sh, 0 FROM ths, (SELECT DISTINCT candidate_id FROM c_p)),
mg AS (SELECT {k}, candidate_id, bin, (sum(p)+1e-12)/(1+128e-12) AS a, (sum(q)+1e-12)/(1+128e-12) AS b FROM al GROUP BY ALL),
js AS (SELECT {k}, candidate_id, sqrt(greatest(0, least(1, sum(a*log2(a/((a+b)/2))+b*log2(b/((a+b)/2)))/2))) AS pdp_score FROM mg GROUP BY ALL),
qd AS (SELECT {', '.join('t.' + x.strip() for x in k.split(','))}, c.candidate_id, least(1, avg(abs(log10(greatest(t.q,1e-12))-log10(greatest(c.q,1e-12))))) AS ds_score FROM t_q t JOIN c_q c USING (j) GROUP BY ALL),
sc AS (SELECT *, (pdp_score+ds_score)/2 AS total FROM js JOIN qd USING ({k}, candidate_id))"""


FIT_SQL = f"""kn AS (SELECT 1 AS d1, * FROM cand WHERE sample%10=0), ca AS (SELECT * FROM cand WHERE sample%10<>0),
{path_sql('t', 'kn', 'd1')}, {spread_sql('t', 'kn', 'd1')}, {path_sql('c', 'ca', 'candidate_id')}, {spread_sql('c', 'ca', 'candidate_id')}, {score_sql('d1')}"""


def known_and_candidates(spark, sf):
    """Every tenth sample is the known region; all other samples are candidate output."""
    moments = fit.path_moments(views.cand(spark, sf), [D, "candidate_id", "sample"]).persist()
    return moments.filter(F.col("sample") % 10 == 0), moments.filter(F.col("sample") % 10 != 0)


def fit_scores(spark, sf):
    known, cand = known_and_candidates(spark, sf)
    return fit.score_candidates(fit.known_targets(known), [D], fit.candidate_features(cand))


@query("h02_target_histogram", "cand", f"""WITH {FIT_SQL} SELECT CAST(bin AS INTEGER) AS bin, {s6('sh','share')}, {s6('(SELECT max(w) FROM tw)*1e9','window_ns')} FROM ths""")
def _(spark, sf):
    window, hist, _ = fit.known_targets(known_and_candidates(spark, sf)[0])
    return hist.join(window, D).select("bin", r6("share", "share"), r6(F.col("window_s") * 1e9, "window_ns"))


@query("h02_target_quantiles", "cand", f"""WITH {FIT_SQL} SELECT CAST(j AS INTEGER) AS p_index, {s6('q*1e9','spread_ns')} FROM t_q""")
def _(spark, sf):
    q = fit.known_targets(known_and_candidates(spark, sf)[0])[2]
    return q.select("p_index", r6(F.col("tq") * 1e9, "spread_ns"))


@query("h03_candidate_scores", "cand", f"""WITH {FIT_SQL} SELECT candidate_id, {s6('pdp_score','pdp_score')}, {s6('ds_score','delay_spread_score')}, {s6('total','total_score')} FROM sc""")
def _(spark, sf):
    s = fit_scores(spark, sf)
    return s.select("candidate_id", r6("pdp_score", "pdp_score"), r6("delay_spread_score", "delay_spread_score"),
                    r6("total_score", "total_score"))


EVAL_SQL = f"""{FIT_SQL}, ev AS (SELECT n_nationkey AS candidate_id, coalesce(total, 'inf'::DOUBLE) AS total_score, total IS NOT NULL AS success FROM nation LEFT JOIN sc ON candidate_id=n_nationkey)"""


def evaluated(spark, sf):
    nations = views.table(spark, sf, "nation").select(views.source_id("lineitem", "n_nationkey"), F.col("n_nationkey").alias("candidate_id"))
    return fit.evaluate_candidates(nations, fit_scores(spark, sf))


@query("h04_evaluated_candidates", "cand", f"""WITH {EVAL_SQL} SELECT candidate_id, success, CASE WHEN success THEN 'SUCCEEDED' ELSE 'FAILED' END AS outcome, {s6('CASE WHEN success THEN total_score ELSE 999 END','score')} FROM ev""")
def _(spark, sf):
    e = evaluated(spark, sf)
    return e.select("candidate_id", "success", "outcome", r6(F.when(F.col("success"), F.col("total_score")).otherwise(999.0), "score"))


@query("h05_ranking", "cand", f"""WITH {EVAL_SQL} SELECT candidate_id, row_number() OVER (ORDER BY NOT success, total_score, candidate_id) AS place,
 CASE WHEN success THEN row_number() OVER (ORDER BY NOT success, total_score, candidate_id) END AS rank FROM ev""")
def _(spark, sf):
    return fit.rank_candidates(evaluated(spark, sf)).select("candidate_id", "place", "rank")


@query("h06_top_k", "cand", f"""WITH {EVAL_SQL} SELECT candidate_id, {s6('total_score','total_score')} FROM ev WHERE success ORDER BY total_score, candidate_id LIMIT 5""")
def _(spark, sf):
    return fit.top_k(evaluated(spark, sf)).select("candidate_id", r6("total_score", "total_score"))


@query("h06_best_candidate", "cand", f"""WITH {EVAL_SQL} SELECT arg_min(candidate_id, total_score) AS candidate_id, {s6('min(total_score)','total_score')} FROM ev WHERE success""")
def _(spark, sf):
    return fit.best_candidate(evaluated(spark, sf), [D]).select("candidate_id", r6("total_score", "total_score"))


HIST_SQL = f"""{FC_SQL},
hs AS (SELECT group_id, start_idx, row_number() OVER (PARTITION BY group_id ORDER BY start_idx) AS i, sqrt(avg(pow(predicted-truth,2))) AS score FROM fc WHERE model='persistence' GROUP BY 1,2),
hb AS (SELECT *, min(score) OVER (PARTITION BY group_id ORDER BY i) AS best, min(score) OVER (PARTITION BY group_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM hs),
hi AS (SELECT *, prior IS NULL OR score<prior AS improved FROM hb)"""


def history(spark, sf):
    """Example scores in order as the proposals of one search per group."""
    fc = pseq_forecast(spark, sf, models=("persistence",))
    rows = fc.groupBy(D, "group_id", "start_idx").agg(F.sqrt(F.avg((F.col("predicted") - F.col("truth")) ** 2)).alias("score")).persist()  # one row per example, counted and ranked
    ranked = positions(rows, [D, "group_id"], ["start_idx"], "start_idx", "i")
    return fit.search_history(ranked, [D, "group_id"], "i", "score")


@query("h07_search_history", "pseq", f"""WITH {HIST_SQL}
SELECT group_id, i, {s6('score','score')}, {s6('best','best')}, improved, i - max(CASE WHEN improved THEN i END) OVER (PARTITION BY group_id ORDER BY i) AS streak FROM hi""")
def _(spark, sf):
    return history(spark, sf).select("group_id", "i", r6("score", "score"), r6("best", "best"), "improved", "streak")


@query("h08_acceptance_by_level", "pseq", f"""WITH {HIST_SQL}
SELECT group_id, (i-1)//10 AS level, count(*) AS successful, CAST(count_if(score<=best*CAST(1.5 AS DOUBLE)) AS BIGINT) AS accepted_n, {s6('count_if(score<=best*CAST(1.5 AS DOUBLE))/CAST(count(*) AS DOUBLE)','acceptance_rate')}, {s6('min(best)','best_score')} FROM hi GROUP BY 1,2""")
def _(spark, sf):
    h = history(spark, sf).withColumn("level", F.floor((F.col("i") - 1) / 10)).withColumn(
        "success", F.col("score").isNotNull()).withColumn("accepted", F.col("score") <= F.col("best") * 1.5)
    a = fit.acceptance_by_level(h, ["group_id", "level"])
    return a.select("group_id", "level", "successful", "accepted_n", r6("acceptance_rate", "acceptance_rate"),
                    r6("best_score", "best_score"))


@query("h09_proposal_cache", "pseq", """WITH k AS (SELECT group_id, round(KF_mu, 0) AS key, row_number() OVER (PARTITION BY group_id, round(KF_mu, 0) ORDER BY idx) AS rn FROM pseq)
SELECT group_id, count(*) AS proposals, CAST(count_if(rn=1) AS BIGINT) AS objective_evaluations, CAST(count_if(rn>1) AS BIGINT) AS cached FROM k GROUP BY 1""")
def _(spark, sf):
    p = views.pseq(spark, sf).select("group_id", F.round("KF_mu", 0).alias("key"))
    return fit.proposal_cache(p, ["group_id"], "key")


@query("h10_outcome_counts", "cand", f"""WITH {EVAL_SQL} SELECT count(*) AS planned, count(*) AS completed, CAST(count_if(success) AS BIGINT) AS succeeded, CAST(count_if(NOT success) AS BIGINT) AS failed,
 count(*) AS proposals, count(*) AS objective_evaluations FROM ev""")
def _(spark, sf):
    return fit.outcome_counts(evaluated(spark, sf)).drop(D)


@query("f16_fitted_windows", "cand", f"""WITH {LOCAL_SQL},
kn AS (SELECT window_no, cand.* FROM cand JOIN mem USING (sample)), ca AS (SELECT * FROM cand),
{path_sql('t', 'kn', 'window_no')}, {spread_sql('t', 'kn', 'window_no')}, {path_sql('c', 'ca', 'candidate_id')}, {spread_sql('c', 'ca', 'candidate_id')}, {score_sql('window_no')},
bs AS (SELECT window_no, arg_min(candidate_id, total) AS candidate_id, min(total) AS fit_score FROM sc GROUP BY 1)
SELECT window_no, s AS first_pos, e AS last_pos, bs.candidate_id, {s6('fit_score','fit_score')}, {s6('avg(s_acctbal)','parameter')}, 'grid_fitted' AS label_source, 'PASS' AS quality_status
FROM lw JOIN bs USING (window_no) JOIN supplier ON s_nationkey=bs.candidate_id GROUP BY ALL""")
def _(spark, sf):
    samples = ranked_samples(spark, sf)
    windows = seqs.local_windows(samples, "pos")
    member_keys = seqs.window_members(samples, "pos").select(D, "sample", "window")
    cand = views.cand(spark, sf)
    parameters = views.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("candidate_id")).agg(
        F.avg("s_acctbal").alias("parameter")).select("*", views.source_id("lineitem", "candidate_id"))
    f = fit.fit_windows(cand, member_keys, cand, windows, parameters, ["parameter"])
    return f.select(F.col("window").alias("window_no"), F.col("start").alias("first_pos"), F.col("end").alias("last_pos"),
                    "candidate_id", r6("fit_score", "fit_score"), r6("parameter", "parameter"), "label_source", "quality_status")
