"""Sequence preparation on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import corpora
from ..operators import sequences as seqs
from ..operators.ordering import keyed_positions, positions
from ..operators.sequences import D
from ..sources import bundles
from . import views
from .registry import query, s6
from .views import PARAMS

N_SQL = "n AS (SELECT count(*) AS n FROM embeddings)"
SEQ_SQL = "sq AS (SELECT dense_rank() OVER (ORDER BY snapshot) AS pos, bin, dbm FROM dpsd)"
LIST_FNS = "list_filter(src, lambda x, i: list_position(src, x) = i)"

SPAN_SQL = """spans AS (SELECT group_id, idx AS start_idx, count(*) OVER w AS n,
  sum(CASE WHEN quality_status='FAIL' THEN 1 ELSE 0 END) OVER w AS fails,
  list(DS_mu) OVER w AS a, list(KF_mu) OVER w AS b, list(label_source) OVER w AS src
  FROM pseq WINDOW w AS (PARTITION BY group_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
ex AS (SELECT * FROM spans WHERE n=20 AND fails=0)"""

SPLIT_SQL = """grp AS (SELECT group_id, row_number() OVER (ORDER BY group_id) AS g, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM ex)),
cnt AS (SELECT *, greatest(1, floor(n*CAST(0.70 AS DOUBLE))) AS t, greatest(1, floor(n*CAST(0.15 AS DOUBLE))) AS v FROM grp),
split AS (SELECT group_id, g, CASE WHEN g<=t THEN 1 WHEN g<=t+v THEN 2 ELSE 3 END AS partition_code FROM cnt)"""

NORM_SQL = """tr AS (SELECT p.* FROM pseq p JOIN split s USING (group_id) WHERE partition_code=1 AND quality_status<>'FAIL'),
norm AS (SELECT 'DS_mu' AS param, avg(DS_mu) AS mean, stddev_samp(DS_mu) AS std, count(*) AS n_rows FROM tr
  UNION ALL SELECT 'KF_mu', avg(KF_mu), stddev_samp(KF_mu), count(*) FROM tr)"""


def pseq_examples(spark, sf, task="extrapolation"):
    return seqs.examples(views.pseq(spark, sf), PARAMS, task)


def example_split(spark, sf, ex=None):
    ex = ex if ex is not None else pseq_examples(spark, sf)
    groups = ex.select(D, "group_id").distinct()
    return seqs.group_split(groups, "group_id")


def train_groups(split):
    return split.filter("partition_code = 1").select(D, "group_id")


def fitted_norm(spark, sf):
    seq = views.pseq(spark, sf)
    split = example_split(spark, sf, seqs.examples(seq, PARAMS, "extrapolation"))
    return seqs.fit_normalization(seq, PARAMS, train_groups(split))


@query("f01_sliding_windows", "dpsd", f"""WITH {SEQ_SQL},
w AS (SELECT bin, pos AS start_pos, list(dbm) OVER f AS l, lead(dbm, 10) OVER o AS target, lead(pos, 10) OVER o AS target_pos
  FROM sq WINDOW o AS (PARTITION BY bin ORDER BY pos), f AS (PARTITION BY bin ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT bin, start_pos, target_pos, {s6('l[1]','first_in')}, {s6('l[10]','last_in')}, {s6('list_sum(l)','sum_in')}, {s6('target','target')} FROM w WHERE target_pos IS NOT NULL""")
def _(spark, sf):
    w = seqs.sliding_windows(views.dpsd_sequence(spark, sf), [D, "bin"], "pos", "dbm", 10)
    total = F.aggregate("inputs", F.lit(0.0), lambda a, x: a + x)
    return w.select("bin", "start_pos", "target_pos", r6(F.col("inputs")[0], "first_in"),
                    r6(F.col("inputs")[9], "last_in"), r6(total, "sum_in"), r6("target", "target"))


@query("f02_examples_extrapolation", "pseq", f"""WITH {SPAN_SQL}
SELECT group_id, start_idx, array_to_string({LIST_FNS}, '+') AS label_sources, {s6('list_sum(a[1:16])','ds_inputs')},
 {s6('list_sum(b[1:16])','kf_inputs')}, {s6('list_sum(a[17:20])','ds_targets')}, {s6('list_sum(b[17:20])','kf_targets')},
 start_idx+16 AS first_target_idx FROM ex""")
def _(spark, sf):
    return example_sums(pseq_examples(spark, sf))


def example_sums(ex):
    total = lambda c, p: F.aggregate(F.col(f"{c}.{p}"), F.lit(0.0), lambda a, x: a + x)
    return ex.select(
        "group_id", "start_idx", "label_sources", r6(total("inputs", "DS_mu"), "ds_inputs"),
        r6(total("inputs", "KF_mu"), "kf_inputs"), r6(total("targets", "DS_mu"), "ds_targets"),
        r6(total("targets", "KF_mu"), "kf_targets"), F.col("targets")[0]["idx"].alias("first_target_idx"))


@query("f02_examples_interpolation", "pseq", f"""WITH {SPAN_SQL}
SELECT group_id, start_idx, array_to_string({LIST_FNS}, '+') AS label_sources, {s6('list_sum(a[1:8])+list_sum(a[13:20])','ds_inputs')},
 {s6('list_sum(b[1:8])+list_sum(b[13:20])','kf_inputs')}, {s6('list_sum(a[9:12])','ds_targets')}, {s6('list_sum(b[9:12])','kf_targets')},
 start_idx+8 AS first_target_idx FROM ex""")
def _(spark, sf):
    return example_sums(pseq_examples(spark, sf, "interpolation"))


@query("f02_span_counts", "pseq", f"""WITH {SPAN_SQL}, i AS (SELECT count(*) AS inside, count_if(fails=0) AS good, count_if(fails>0) AS bad FROM spans WHERE n=20),
t AS (SELECT greatest(count(*)-19, 0) AS c FROM pseq)
SELECT CAST(good AS BIGINT) AS n_example, CAST(bad AS BIGINT) AS skipped_invalid, CAST(c-inside AS BIGINT) AS skipped_boundary FROM i, t""")
def _(spark, sf):
    return seqs.span_counts(views.pseq(spark, sf), PARAMS, 20).select("n_example", "skipped_invalid", "skipped_boundary")


@query("f03_chronological_split", "dpsd", f"""WITH {SEQ_SQL}, {N_SQL},
b AS (SELECT sq.*, CASE WHEN pos<=floor(n*CAST(0.70 AS DOUBLE)) THEN 'train' WHEN pos<=floor(n*CAST(0.70 AS DOUBLE))+floor(n*CAST(0.15 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS part FROM sq, n),
w AS (SELECT bin, part, pos AS start, lead(dbm, 10) OVER o AS target, lead(pos, 10) OVER o AS target_index FROM b WINDOW o AS (PARTITION BY bin, part ORDER BY pos))
SELECT part AS split_part, bin, count(*) AS windows, CAST(min(target_index) AS BIGINT) AS first_target, CAST(max(target_index) AS BIGINT) AS last_target, {s6('avg(target)','mean_target')}
FROM w WHERE target_index IS NOT NULL GROUP BY 1,2""")
def _(spark, sf):
    w = seqs.chronological_windows(views.dpsd_sequence(spark, sf), [D], [D, "bin"], "pos", "dbm")
    return w.groupBy(F.col("partition").alias("split_part"), "bin").agg(
        F.count(F.lit(1)).alias("windows"), F.min("target_index").alias("first_target"),
        F.max("target_index").alias("last_target"), r6(F.avg("target"), "mean_target"))


@query("f04_two_way_split", "dpsd", f"""WITH {SEQ_SQL}, {N_SQL}
SELECT CASE WHEN pos <= n - greatest(1, round(n*CAST(0.2 AS DOUBLE))) THEN 'train' ELSE 'test' END AS split_part, bin, count(*) AS n_rows, {s6('avg(dbm)','mean_dbm')}
FROM sq, n GROUP BY 1,2""")
def _(spark, sf):
    s = seqs.two_way_split(views.dpsd_sequence(spark, sf), [D], "pos")
    return s.groupBy(F.col("partition").alias("split_part"), "bin").agg(
        F.count(F.lit(1)).alias("n_rows"), r6(F.avg("dbm"), "mean_dbm"))


@query("f05_group_split", "pseq", f"""WITH {SPAN_SQL}, {SPLIT_SQL},
k AS (SELECT group_id, count(*) AS examples FROM ex GROUP BY 1)
SELECT group_id, g AS group_order, CAST(partition_code AS INTEGER) AS partition_code, examples, CAST(0 AS BIGINT) AS leaked FROM split JOIN k USING (group_id)""")
def _(spark, sf):
    ex = pseq_examples(spark, sf)
    groups = ex.groupBy(D, "group_id").agg(F.count(F.lit(1)).alias("examples"))
    split = seqs.group_split(groups.select(D, "group_id"), "group_id")
    leaks = seqs.leaked_groups(split).select(D, "group_id", F.lit(1).alias("hit"))
    return split.join(groups, [D, "group_id"]).join(leaks, [D, "group_id"], "left").select(
        "group_id", F.col("g").alias("group_order"), "partition_code", "examples",
        F.coalesce("hit", F.lit(0)).cast("long").alias("leaked"))


@query("f06_train_normalization", "pseq", f"""WITH {SPAN_SQL}, {SPLIT_SQL}, {NORM_SQL}
SELECT param, {s6('mean','mean')}, {s6('std','std')}, {s6('std','raw_std')}, std<1e-12 AS zero_variance, false AS is_int, n_rows FROM norm""")
def _(spark, sf):
    n = fitted_norm(spark, sf)
    return n.select("param", r6("mean", "mean"), r6("std", "std"), r6("raw_std", "raw_std"), "zero_variance",
                    "is_int", F.col("rows").alias("n_rows"))


@query("f07_normalize_and_back", "pseq", f"""WITH {SPAN_SQL}, {SPLIT_SQL}, {NORM_SQL},
l AS (SELECT group_id, idx, 'DS_mu' AS param, DS_mu AS x FROM pseq UNION ALL SELECT group_id, idx, 'KF_mu', KF_mu FROM pseq)
SELECT group_id, idx, param, {s6('(x-mean)/std','z')}, {s6("CASE param WHEN 'DS_mu' THEN least(greatest(x,-9),-7) ELSE least(greatest(x,-10),10) END",'restored')}
FROM l JOIN norm USING (param)""")
def _(spark, sf):
    seq = views.pseq(spark, sf)
    norm = seqs.fit_normalization(seq, PARAMS, train_groups(example_split(spark, sf)),
                                  {"DS_mu": (-9.0, -7.0), "KF_mu": (-10.0, 10.0)})
    z = seqs.normalize(seqs.to_long(seq, PARAMS, [D, "group_id", "idx"]), norm)
    back = seqs.denormalize(z.drop("value"), norm)
    return back.select("group_id", "idx", "param", r6("z", "z"), r6("value", "restored"))


@query("f08_temporal_experiment", "dpsd", f"""WITH {SEQ_SQL}, {N_SQL},
b AS (SELECT sq.*, CASE WHEN pos<=floor(n*CAST(0.70 AS DOUBLE)) THEN 'train' WHEN pos<=floor(n*CAST(0.70 AS DOUBLE))+floor(n*CAST(0.15 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS part FROM sq, n),
st AS (SELECT bin, avg(dbm) AS mu, stddev_samp(dbm) AS sd FROM b WHERE part='train' GROUP BY 1),
w AS (SELECT bin, part, pos AS start, list(dbm) OVER f AS l, lead(dbm, 10) OVER o AS target FROM b
  WINDOW o AS (PARTITION BY bin, part ORDER BY pos), f AS (PARTITION BY bin, part ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT part AS split_part, bin, count(*) AS windows, {s6('avg((list_sum(l)-10*mu)/sd)','mean_input_sum')}, {s6('avg((target-mu)/sd)','mean_target')}
FROM w JOIN st USING (bin) WHERE target IS NOT NULL GROUP BY 1,2""")
def _(spark, sf):
    w, _, _ = seqs.temporal_experiment(views.dpsd_sequence(spark, sf), "bin", "pos", "dbm")
    total = F.aggregate("inputs", F.lit(0.0), lambda a, x: a + x)
    return w.groupBy(F.col("partition").alias("split_part"), "bin").agg(
        F.count(F.lit(1)).alias("windows"), r6(F.avg(total), "mean_input_sum"), r6(F.avg("target"), "mean_target"))


@query("f09_leakage_guard", "pseq", f"""WITH {SPAN_SQL}, {SPLIT_SQL},
tg AS (SELECT DISTINCT group_id, start_idx+16+j AS idx FROM ex, range(4) r(j)),
tr AS (SELECT t.* FROM tg t JOIN split USING (group_id) WHERE partition_code=1),
te AS (SELECT t.* FROM tg t JOIN split USING (group_id) WHERE partition_code=3)
SELECT 'held_out' AS region, count(*) AS overlap FROM (SELECT * FROM tr INTERSECT SELECT * FROM te)
UNION ALL SELECT 'tail_of_train', count(*) FROM tr WHERE idx>=40""")
def _(spark, sf):
    ex = pseq_examples(spark, sf)
    coded = ex.join(example_split(spark, sf, ex), [D, "group_id"])
    train, test = coded.filter("partition_code = 1"), coded.filter("partition_code = 3")
    held_out = test.select(D, "group_id", F.explode("targets.idx").alias("idx"))
    tail = views.pseq(spark, sf).filter("idx >= 40")
    count = lambda region, bad: seqs.leaked_targets(train, bad).agg(F.count(F.lit(1)).alias("overlap")).select(
        F.lit(region).alias("region"), "overlap")
    return count("held_out", held_out).unionByName(count("tail_of_train", tail))


@query("f10_min_max_scaling", "dpsd", f"""WITH m AS (SELECT *, min(dbm) OVER (PARTITION BY snapshot) AS lo, max(dbm) OVER (PARTITION BY snapshot) AS hi FROM dpsd)
SELECT snapshot, bin, {s6('(dbm-lo)/(hi-lo)','scaled')}, {s6('dbm','restored')} FROM m""")
def _(spark, sf):
    m = seqs.undo_min_max(seqs.min_max(views.dpsd(spark, sf), [D, "snapshot"], "dbm"))
    return m.select("snapshot", "bin", r6("scaled", "scaled"), r6("restored", "restored"))


def halves(spark, sf):
    """Even snapshots as the real sequence, odd ones as the generated one."""
    rows = views.table(spark, sf, "embeddings").select(
        views.source_id("embeddings", "vec_id"), F.col("vec_id").alias("snapshot"), (F.col("vec_id") % 2).alias("side"), "embedding")
    ranked = keyed_positions(rows, [D, "side"], "snapshot")
    flat = ranked.select(D, "side", "pos", F.posexplode("embedding").alias("bin", "e")).select(
        D, "side", "pos", "bin", (F.lit(-65.0) + 10.0 * F.col("e").cast("double")).alias("dbm"))
    return flat.filter("side = 0").drop("side"), flat.filter("side = 1").drop("side")


HALF_SQL = """hs AS (SELECT snapshot%2 AS side, dense_rank() OVER (PARTITION BY snapshot%2 ORDER BY snapshot) AS pos, bin, dbm FROM dpsd),
hn AS (SELECT side, max(pos) AS n FROM hs GROUP BY 1),
st AS (SELECT bin, avg(dbm) AS mu, stddev_samp(dbm) AS sd FROM hs JOIN hn USING (side) WHERE side=0 AND pos<=floor(n*CAST(0.70 AS DOUBLE)) GROUP BY 1),
part AS (SELECT side, pos, bin, (dbm-mu)/sd AS z FROM hs JOIN hn USING (side) JOIN st USING (bin) WHERE side=1 OR pos<=floor(n*CAST(0.70 AS DOUBLE))),
hw AS (SELECT side, bin, list(z) OVER f AS l, lead(z, 10) OVER o AS target FROM part
  WINDOW o AS (PARTITION BY side, bin ORDER BY pos), f AS (PARTITION BY side, bin ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))"""


def augmented_training(spark, sf):
    real, generated = halves(spark, sf)
    w, stats, length = seqs.temporal_experiment(real, "bin", "pos", "dbm")
    gw = seqs.scaled_windows(seqs.sliding_windows(generated, [D, "bin"], "pos", "dbm", length), stats, "bin")
    columns = [D, "bin", "inputs", "target"]
    return seqs.merge_training(w.filter("partition = 'train'").select(*columns), gw.select(*columns),
                               source_id="generated_in_app")


@query("f11_append_generated_windows", "dpsd", f"""WITH {HALF_SQL}
SELECT CASE side WHEN 0 THEN 'real_train' ELSE 'synthetic_generated' END AS source_type, bin, count(*) AS windows, {s6('avg(list_sum(l))','mean_input_sum')}, {s6('avg(target)','mean_target')}
FROM hw WHERE target IS NOT NULL GROUP BY 1,2""")
def _(spark, sf):
    total = F.aggregate("inputs", F.lit(0.0), lambda a, x: a + x)
    return augmented_training(spark, sf).groupBy("source_type", "bin").agg(
        F.count(F.lit(1)).alias("windows"), r6(F.avg(total), "mean_input_sum"), r6(F.avg("target"), "mean_target"))


@query("f12_training_provenance", "dpsd", f"""WITH {HALF_SQL}
SELECT CASE side WHEN 0 THEN 'real_train' ELSE 'synthetic_generated' END AS source_type, CASE side WHEN 0 THEN 'real' ELSE 'generated_in_app' END AS source_id, count(*) AS sample_count
FROM hw WHERE target IS NOT NULL GROUP BY 1,2""")
def _(spark, sf):
    return seqs.provenance(augmented_training(spark, sf)).select("source_type", "source_id", "sample_count")


@query("f13_canonical_sequence", "pseq", f"""WITH l AS (SELECT group_id, idx, 'DS_mu' AS param, DS_mu AS x, 'log10_s' AS unit FROM pseq UNION ALL SELECT group_id, idx, 'KF_mu', KF_mu, 'dB' FROM pseq)
SELECT group_id, idx, param, {s6('x','value')}, unit, 'generator_truth' AS label_source, 'PASS' AS quality_status, CAST(idx AS DOUBLE) AS raw_window_center,
 CAST(CASE param WHEN 'DS_mu' THEN -9 ELSE -10 END AS DOUBLE) AS lo, CAST(CASE param WHEN 'DS_mu' THEN -5 ELSE 20 END AS DOUBLE) AS hi FROM l""")
def _(spark, sf):
    bare = views.pseq(spark, sf).drop("label_source", "quality_status")
    s = seqs.canonical_sequence(bare, PARAMS, {"DS_mu": (-9, -5), "KF_mu": (-10, 20)})
    return s.select("group_id", "idx", "param", r6("value", "value"), "unit", "label_source", "quality_status",
                    "raw_window_center", "lo", "hi")


@query("f14_fine_tuning_flags", "pseq", """SELECT bool_or(label_source='generator_truth') AS contains_generator_truth,
 bool_or(label_source IN ('grid_fitted','sa_fitted')) AS contains_fitted_labels, bool_or(label_source='generator_truth') AS pretraining_eligible,
 bool_or(label_source IN ('grid_fitted','sa_fitted')) AS fine_tuning_candidate FROM pseq WHERE quality_status<>'FAIL'""")
def _(spark, sf):
    return seqs.fine_tuning_flags(views.pseq(spark, sf)).drop(D)


LOCAL_SQL = """smp AS (SELECT sample, row_number() OVER (ORDER BY sample) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT sample FROM cir)),
lw AS (SELECT (pos-1)//4+1 AS window_no, pos AS s, pos+15 AS e FROM smp WHERE (pos-1)%4=0 AND pos+15<=n),
mem AS (SELECT window_no, sample FROM smp JOIN lw ON pos BETWEEN s AND e)"""


def ranked_samples(spark, sf):
    samples = views.cir(spark, sf).select(D, "sample").distinct()
    return positions(samples, [D], ["sample"], "sample")


@query("f15_local_windows", "cir", f"""WITH {LOCAL_SQL}
SELECT window_no, s AS first_pos, e AS last_pos, CAST(s+7.5 AS DOUBLE) AS center, count(*) AS members, CAST(sum(sample) AS BIGINT) AS sample_sum
FROM lw JOIN mem USING (window_no) GROUP BY ALL""")
def _(spark, sf):
    samples = ranked_samples(spark, sf)
    w = seqs.local_windows(samples, "pos")
    m = seqs.window_members(samples, "pos").groupBy(D, "window").agg(
        F.count(F.lit(1)).alias("members"), F.sum("sample").alias("sample_sum"))
    return w.join(m, [D, "window"]).select(
        F.col("window").alias("window_no"), F.col("start").alias("first_pos"), F.col("end").alias("last_pos"),
        "center", "members", "sample_sum")


@query("f17_bundle_corpus", "pseq", f"""WITH {SPAN_SQL}, {SPLIT_SQL},
c AS (SELECT b.bundle, t.task, partition_code, count(*) AS examples FROM ex JOIN split USING (group_id), (VALUES ('P1'),('P2')) b(bundle), (VALUES ('extrapolation'),('interpolation')) t(task) GROUP BY 1,2,3)
SELECT bundle, task, CAST(partition_code AS INTEGER) AS partition_code, examples, {s6('CASE bundle WHEN \'P1\' THEN 4 ELSE 8 END','values_per_example')} FROM c""")
def _(spark, sf):
    # The table has two parameters, so the prefix bundles here are P1 and P2.
    out = None
    for task in ("extrapolation", "interpolation"):
        for bundle, names in (("P1", PARAMS[:1]), ("P2", PARAMS[:2])):
            ex = seqs.examples(views.pseq(spark, sf), names, task)
            split = seqs.group_split(ex.select(D, "group_id").distinct(), "group_id")
            part = ex.join(split, [D, "group_id"]).groupBy("partition_code").agg(
                F.count(F.lit(1)).alias("examples"), F.avg(F.size("targets") * len(names)).alias("v"))
            part = part.select(F.lit(bundle).alias("bundle"), F.lit(task).alias("task"), "partition_code", "examples",
                               r6("v", "values_per_example"))
            out = part if out is None else out.unionByName(part)
    return out


NESTED_SQL = """bd AS (SELECT * FROM (VALUES ('P2',2),('P4',4),('P6',6),('P8',8)) v(bundle, size)),
tk AS (SELECT * FROM (VALUES ('extrapolation',16),('interpolation',8)) v(task, lft)),
sp AS (SELECT group_id, idx AS start_idx, count(*) OVER w AS n, min(level) OVER w AS lowest FROM pseq8 WINDOW w AS (PARTITION BY group_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
ne AS (SELECT task, lft, bundle, size, group_id, start_idx FROM sp JOIN bd ON size<=lowest, tk WHERE n=20),
ng AS (SELECT task, bundle, size, group_id, row_number() OVER w AS g, count(*) OVER (PARTITION BY task, bundle) AS n FROM (SELECT DISTINCT task, bundle, size, group_id FROM ne) WINDOW w AS (PARTITION BY task, bundle ORDER BY group_id)),
nc AS (SELECT *, greatest(1, floor(n*CAST(0.70 AS DOUBLE))) AS t, greatest(1, floor(n*CAST(0.15 AS DOUBLE))) AS v FROM ng),
ns AS (SELECT task, bundle, size, group_id, CASE WHEN g<=t THEN 1 WHEN g<=t+v THEN 2 ELSE 3 END AS partition_code FROM nc),
nm AS (SELECT task, bundle, i, avg(vals[i+1]) AS mean, stddev_samp(vals[i+1]) AS std, count(*) AS n_rows FROM pseq8 JOIN ns USING (group_id), range(8) r(i)
  WHERE partition_code=1 AND level>=size AND i<size GROUP BY 1,2,3)"""


def nested_corpus(spark, sf):
    """Leveled rows, examples, split and normalization of the four bundles and both tasks."""
    leveled = corpora.with_level(views.pseq8(spark, sf), seqs.PARAMETERS).select(D, "group_id", "pos", "idx", "label_source", "level", "values")
    leveled = bundles.shared_copy(leveled, "leveled")  # ranked once for the examples, the split and the moments
    ex = corpora.nested_examples(leveled)
    split = corpora.bundle_split(ex)
    return ex, split, corpora.bundle_normalization(leveled, seqs.PARAMETERS, split)


@query("f17_nested_bundles", "pseq8", f"""WITH {NESTED_SQL},
tg AS (SELECT ne.task, ne.bundle, partition_code, start_idx, ne.group_id, p.idx, i, (vals[i+1]-mean)/std AS z FROM ne JOIN ns USING (task, bundle, group_id)
  JOIN pseq8 p ON p.group_id=ne.group_id AND p.idx BETWEEN start_idx+lft AND start_idx+lft+3 JOIN nm ON nm.task=ne.task AND nm.bundle=ne.bundle)
SELECT task, bundle, CAST(partition_code AS INTEGER) AS partition_code, count(DISTINCT (group_id, start_idx)) AS examples, {s6('avg(z)','mean_z')}, {s6('avg(z*z)','mean_zz')} FROM tg GROUP BY 1,2,3""")
def _(spark, sf):
    ex, split, norm = nested_corpus(spark, sf)
    z = corpora.normalized_examples(ex, norm)
    total = lambda f: F.aggregate("targets", F.lit(0.0), lambda s, c: s + F.aggregate(c["values"], F.lit(0.0), f))
    # the split is by group, so examples are summed by group before they meet it
    groups = z.groupBy(*corpora.KEYS, "group_id").agg(
        F.count(F.lit(1)).alias("c"), F.sum(total(lambda a, v: a + v)).alias("s"), F.sum(total(lambda a, v: a + v * v)).alias("ss"),
        F.sum(F.col("size") * F.size("targets")).alias("cells"))
    coded = groups.join(split.drop("size", "g", "n"), [*corpora.KEYS, "group_id"])
    cells = F.sum("cells")
    out = coded.groupBy("task", "bundle", "partition_code").agg(
        F.sum("c").alias("examples"), (F.sum("s") / cells).alias("m"), (F.sum("ss") / cells).alias("q"))
    return out.select("task", "bundle", "partition_code", "examples", r6("m", "mean_z"), r6("q", "mean_zz"))


@query("f17_bundle_normalization", "pseq8", f"""WITH {NESTED_SQL}
SELECT task, bundle, ['DS_mu','KF_mu','DS_sigma','KF_sigma','r_DS','LNS_ksi','num_clusters','num_rays'][i+1] AS param, n_rows, {s6('mean','mean')}, {s6('std','std')} FROM nm""")
def _(spark, sf):
    norm = nested_corpus(spark, sf)[2]
    return norm.select("task", "bundle", "param", F.col("rows").alias("n_rows"), r6("mean", "mean"), r6("std", "std"))


@query("f18_group_catalogue", "pseq", """WITH g AS (SELECT group_id, row_number() OVER (ORDER BY group_id) AS group_index FROM (SELECT DISTINCT group_id FROM pseq)),
c AS (SELECT * FROM (VALUES (0,'sub-6 GHz_UMa_LoS',3.5),(1,'sub-6 GHz_UMa_NLoS',3.5),(2,'sub-6 GHz_UMi_LoS',3.5),(3,'sub-6 GHz_UMi_NLoS',3.5),
 (4,'sub-6 GHz_RMa_LoS',3.5),(5,'sub-6 GHz_RMa_NLoS',3.5),(6,'sub-6 GHz_Indoor_LoS',3.5),(7,'sub-6 GHz_Indoor_NLoS',3.5),
 (8,'cmWave_UMa_LoS',16),(9,'cmWave_UMa_NLoS',16),(10,'mmWave_UMi_LoS',28),(11,'mmWave_UMi_NLoS',28)) v(i,scenario_name,ghz))
SELECT group_id, group_index, scenario_name, CAST(ghz*1e9 AS DOUBLE) AS carrier_hz FROM g JOIN c ON i=(group_index-1)%12""")
def _(spark, sf):
    groups = views.pseq(spark, sf).select(D, "group_id").distinct()
    return seqs.group_catalogue(groups, "group_id").select("group_id", "group_index", "scenario_name", "carrier_hz")


def _edge_sql(near: str, far: str) -> str:
    s = f"((3*{near}-{far})/2)"
    return f"CASE WHEN {s}*{near}<=0 THEN 0 WHEN {near}*{far}<=0 AND abs({s})>3*abs({near}) THEN 3*{near} ELSE {s} END"


def _hermite_sql(source: str) -> str:
    """Cubic pieces of `source` (bin, k, y, m; n knots) at every output point."""
    return f"""SELECT bin, j, (1+2*t)*pow(1-t,2)*y + t*pow(1-t,2)*m + t*t*(3-2*t)*y1 + t*t*(t-1)*m1 AS v FROM (
 SELECT p.bin, p.j, p.at-p.i AS t, a.y, a.m, b.y AS y1, b.m AS m1 FROM (
  SELECT bin, j, j*((n-1)/CAST(total-1 AS DOUBLE)) AS at, least(floor(j*((n-1)/CAST(total-1 AS DOUBLE))), n-2) AS i
  FROM (SELECT bin, max(n) AS n FROM {source} GROUP BY 1), sz, range((SELECT total FROM sz)) g(j)) p
 JOIN {source} a ON a.bin=p.bin AND a.k=p.i JOIN {source} b ON b.bin=p.bin AND b.k=p.i+1)"""


# The spline's slopes by forward elimination and back substitution, one knot a step.
BLEND_SQL = f"""hs AS (SELECT snapshot%2 AS side, dense_rank() OVER (PARTITION BY snapshot%2 ORDER BY snapshot)-1 AS k, bin, dbm FROM dpsd),
sz AS (SELECT count(DISTINCT CASE WHEN side=0 THEN k END) AS nr, count(DISTINCT CASE WHEN side=1 THEN k END) AS ns, nr+ns AS total FROM hs),
r AS (SELECT bin, k, dbm AS y, lead(dbm) OVER w - dbm AS d, dbm - lag(dbm) OVER w AS p, lead(dbm, 2) OVER w - lead(dbm) OVER w AS d2, lag(dbm) OVER w - lag(dbm, 2) OVER w AS p2
 FROM hs WHERE side=0 WINDOW w AS (PARTITION BY bin ORDER BY k)),
rm AS (SELECT bin, k, y, (SELECT nr FROM sz) AS n, CASE WHEN p IS NULL THEN {_edge_sql('d', 'd2')} WHEN d IS NULL THEN {_edge_sql('p', 'p2')}
 WHEN p*d>0 THEN 2*p*d/(p+d) ELSE 0 END AS m FROM r),
s0 AS (SELECT bin, k, dbm - avg(dbm) OVER (PARTITION BY bin) AS y, (SELECT ns FROM sz) AS n FROM hs WHERE side=1),
s1 AS (SELECT *, (-5*lag(y) OVER w + 4*y + lead(y) OVER w)/2 AS head, (5*lead(y) OVER w - 4*y - lag(y) OVER w)/2 AS tail, 3*(lead(y) OVER w - lag(y) OVER w) AS rhs
 FROM s0 WINDOW w AS (PARTITION BY bin ORDER BY k)),
s AS (SELECT bin, k, y, n, head, tail, rhs - CASE WHEN k=1 THEN head ELSE 0 END - CASE WHEN k=n-2 THEN tail ELSE 0 END AS rhs,
 4 - CASE WHEN k=1 THEN 2 ELSE 0 END - CASE WHEN k=n-2 THEN 2 ELSE 0 END AS diag FROM s1),
fw AS (SELECT bin, k, CAST(1/CAST(diag AS DOUBLE) AS DOUBLE) AS c, rhs/diag AS d FROM s WHERE k=1
 UNION ALL SELECT s.bin, s.k, 1/(s.diag-fw.c), (s.rhs-fw.d)/(s.diag-fw.c) FROM fw JOIN s ON s.bin=fw.bin AND s.k=fw.k+1 AND s.k<=s.n-2),
bw AS (SELECT fw.bin, fw.k, fw.d AS m FROM fw, sz WHERE fw.k=ns-2
 UNION ALL SELECT fw.bin, fw.k, fw.d-fw.c*bw.m FROM bw JOIN fw ON fw.bin=bw.bin AND fw.k=bw.k-1),
sm AS (SELECT s.bin, s.k, s.y, s.n, bw.m FROM s JOIN bw USING (bin, k)
 UNION ALL SELECT s.bin, 0, z.y, s.n, s.head-2*bw.m FROM s JOIN bw USING (bin, k) JOIN s z ON z.bin=s.bin AND z.k=0 WHERE s.k=1
 UNION ALL SELECT s.bin, s.n-1, z.y, s.n, s.tail-2*bw.m FROM s JOIN bw USING (bin, k) JOIN s z ON z.bin=s.bin AND z.k=s.n-1 WHERE s.k=s.n-2),
rv AS ({_hermite_sql('rm')}), sv AS ({_hermite_sql('sm')})"""


@query("f19_blend_series", "dpsd", f"""WITH RECURSIVE {BLEND_SQL}
SELECT rv.bin, rv.j+1 AS pos, {s6('rv.v + CAST(0.15 AS DOUBLE)*sv.v', 'dbm')} FROM rv JOIN sv USING (bin, j)""")
def _(spark, sf):
    real, generated = halves(spark, sf)
    b = seqs.blend_on_common_grid(real, generated, "bin", "pos", "dbm")
    return b.select("bin", "pos", r6("dbm", "dbm"))


@query("f20_pad_bins", "dpsd", f"""WITH g AS (SELECT vec_id AS snapshot, CAST(b AS INTEGER) AS bin FROM embeddings, range(200) r(b))
SELECT snapshot, bin, {s6('coalesce(dbm, -130)','dbm')} FROM g LEFT JOIN dpsd USING (snapshot, bin)""")
def _(spark, sf):
    from ..operators.metrics import pad_bins
    return pad_bins(views.dpsd(spark, sf), [D, "snapshot"], 200).select("snapshot", "bin", r6("dbm", "dbm"))
