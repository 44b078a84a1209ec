"""Validation, capability and task rules on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import rules, sequences as seqs
from ..operators.ordering import positions
from ..operators.sequences import D
from ..sources.bundles import shared_copy
from . import views
from .queries_metrics import SNAPSHOT_S, SUBCARRIER_HZ
from .queries_sequences import SPAN_SQL, pseq_examples
from .registry import query, s6
from .views import PARAMS


def literal_map(d):
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def cir_metadata(summary):
    """Declared metadata of the path table; the sample count is declared one too high."""
    return summary.select(
        D, F.lit(2).alias("n_tx"), F.lit(3).alias("n_rx"), F.lit(7).alias("n_path"), F.lit(12).alias("n_t"),
        (F.col("n_sample") + 1).alias("n_sample"), literal_map({**rules.UNITS, "time": "ms"}).alias("units"),
        F.lit("unspecified").alias("source"), F.lit("ordered_route").alias("sample_semantics"),
        F.lit(True).alias("has_time_axis"), F.lit(True).alias("has_sample_index"), F.lit(False).alias("has_position"))


CIR_RULE_SQL = """f AS (SELECT count_if(path_valid)=0 AS nv, count_if(path_valid AND NOT (isfinite(re) AND isfinite(im))) AS nf, count_if(path_valid AND NOT (isfinite(delay_s) AND delay_s>=0)) AS bd,
 bool_or(im<>0) AS cx, count(DISTINCT t) AS nt FROM cir),
ru AS (SELECT * FROM (SELECT unnest(['no_valid_path','non_finite_coefficient','bad_delay','tx_mismatch','rx_mismatch','path_mismatch','time_mismatch','sample_mismatch','wrong_unit','unknown_semantics','real_valued','source_unspecified','time_axis_missing','sample_index_missing','position_missing']) AS rule,
  unnest([CAST(nv AS BIGINT), nf, bd, 0, 0, 0, 0, 1, 1, 0, CAST(NOT cx AS BIGINT), 1, 0, 0, 1]) AS violations,
  unnest(['error','error','error','error','error','error','error','error','error','error','warning','warning','warning','warning','warning']) AS severity FROM f))"""


def cir_report(spark, sf):
    cir = views.cir(spark, sf)
    return rules.cir_rules(cir, cir_metadata(rules.dataset_summary(cir)))


@query("b01_dataset_rules", "cir", f"WITH {CIR_RULE_SQL} SELECT rule, CAST(violations AS BIGINT) AS violations, severity FROM ru")
def _(spark, sf):
    return cir_report(spark, sf).select("rule", "violations", "severity")


@query("b01_dataset_status", "cir", f"WITH {CIR_RULE_SQL} SELECT 'lineitem' AS dataset_id, CASE WHEN count_if(violations>0 AND severity='error')>0 THEN 'FAIL' WHEN count_if(violations>0)>0 THEN 'WARNING' ELSE 'PASS' END AS status FROM ru")
def _(spark, sf):
    return rules.overall_status(cir_report(spark, sf), [D])


@query("b02_axis_rules", "pseq", """WITH d AS (SELECT group_id, event_id, ts_us, lag(ts_us) OVER (PARTITION BY group_id ORDER BY event_id) AS p FROM pseq)
SELECT group_id, count(*) AS n, CAST(0 AS BIGINT) AS non_finite, CAST(count_if(ts_us<=p) AS BIGINT) AS not_increasing FROM d GROUP BY 1""")
def _(spark, sf):
    return rules.axis_rules(views.pseq(spark, sf), ["group_id"], "ts_us", "event_id")


@query("b03_uniform_spacing", "pseq", f"""WITH s AS (SELECT 'index' AS axis, group_id, idx, CAST(idx AS DOUBLE) AS x FROM pseq UNION ALL SELECT 'time', group_id, idx, ts_us/CAST(1e6 AS DOUBLE) FROM pseq),
d AS (SELECT axis, group_id, x, x-lag(x) OVER (PARTITION BY axis, group_id ORDER BY idx) AS d FROM s),
m AS (SELECT axis, group_id, median(d) AS m FROM d GROUP BY 1,2)
SELECT axis, group_id, count(*) AS n, {s6('any_value(m)','spacing')}, min(d)>0 AND bool_and(d IS NULL OR abs(d-m)<=greatest(abs(m)*1e-6, 1e-12)) AS uniform FROM d JOIN m USING (axis, group_id) GROUP BY 1,2""")
def _(spark, sf):
    seq = views.pseq(spark, sf)
    side = lambda name, x: seq.select(F.lit(name).alias("axis"), "group_id", "idx", x.alias("x"))
    both = side("index", F.col("idx").cast("double")).unionByName(side("time", F.col("ts_us") / F.lit(1e6)))
    u = rules.uniform_spacing(both, ["axis", "group_id"], "x", "idx")
    return u.select("axis", "group_id", "n", r6("spacing", "spacing"), "uniform")


DIMS_SQL = """dm AS (SELECT candidate_id, count(DISTINCT tx) AS n_tx, count(DISTINCT rx) AS n_rx, count(DISTINCT path) AS n_path, count(DISTINCT t) AS n_t, count(DISTINCT sample) AS n_sample FROM cand GROUP BY 1),
cp AS (SELECT *, n_t>1 AND candidate_id%2=0 AS has_time, n_path>1 AS wide, n_tx>1 OR n_rx>1 AS arr FROM dm),
cl AS (SELECT *, CASE WHEN NOT wide AND NOT has_time AND NOT arr THEN 'narrowband_static_siso' WHEN wide AND NOT has_time AND NOT arr THEN 'wideband_static_siso'
  WHEN wide AND NOT has_time AND arr THEN 'wideband_static_mimo' WHEN wide AND has_time AND arr THEN 'wideband_dynamic_mimo' WHEN has_time THEN 'dynamic_channel' ELSE 'other_channel' END AS classification,
  candidate_id%3<>0 AS ordered FROM cp),
st AS (SELECT candidate_id, classification, unnest(['power','pdp','frequency_autocorrelation','delay_spread_cdf','angular_power_spectrum','spatial_correlation','angular_spread_cdf','doppler_power_spectrum','time_autocorrelation','doppler_spread_cdf','delay_sample_heatmap']) AS metric,
  unnest([true, wide, false, wide AND n_sample>1, arr, arr AND n_t*n_sample>1, arr AND n_sample>1, has_time, has_time, has_time AND n_sample>1, wide AND ordered AND n_sample>1]) AS available,
  unnest([1,2,3,4,5,6,7,8,9,10,11]) AS k FROM cl),
rg AS (SELECT candidate_id AS dataset_id, classification, metric, available, CASE classification WHEN 'narrowband_static_siso' THEN k=1 WHEN 'wideband_static_siso' THEN k BETWEEN 2 AND 4 WHEN 'wideband_static_mimo' THEN k BETWEEN 2 AND 7 WHEN 'wideband_dynamic_mimo' THEN k BETWEEN 2 AND 10 ELSE false END AS is_standard,
  k=11 AS is_additional, classification IN ('narrowband_static_siso','wideband_static_siso','wideband_static_mimo','wideband_dynamic_mimo') AS standard_class FROM st)"""


def candidate_datasets(spark, sf):
    """Each candidate as one dataset; even ones have a time axis, every third is unordered."""
    cand = views.cand(spark, sf).withColumn(D, F.col("candidate_id"))
    dims = rules.dataset_summary(cand)
    return dims.select(
        D, F.lit("cir").alias("domain"), "n_tx", "n_rx", F.lit(1).alias("n_f"), "n_path", "n_t", "n_sample",
        F.lit(False).alias("has_frequency_axis"), (F.col(D) % 2 == 0).alias("has_time_axis"), "has_angles",
        F.lit(False).alias("tx_ula"), F.lit(False).alias("rx_ula"),
        F.when(F.col(D) % 3 == 0, "independent").otherwise("ordered_route").alias("sample_semantics"))


@query("b04_capabilities", "cand", f"""WITH {DIMS_SQL} SELECT candidate_id AS dataset_id, metric, available FROM st""")
def _(spark, sf):
    return rules.metric_status(rules.capabilities(candidate_datasets(spark, sf))).select(D, "metric", "available")


@query("b04_capability_reasons", "cand", f"""WITH {DIMS_SQL} SELECT candidate_id AS dataset_id, n_sample>=2 AS cdf_minimum_met, n_sample>=20 AS cdf_recommended_met,
 CASE WHEN has_time THEN 'Continuous time information is available.' ELSE 'Need Nt > 1 plus time_s or snapshot_interval_s.' END AS time_reason,
 CASE WHEN n_sample>1 AND ordered THEN 'Samples have declared physical order.' ELSE 'Heatmaps need ordered sample semantics, not independent samples.' END AS order_reason FROM cl""")
def _(spark, sf):
    c = rules.capabilities(candidate_datasets(spark, sf))
    return c.select(D, "cdf_minimum_met", "cdf_recommended_met", "time_reason", "order_reason")


@query("b05_classification", "cand", f"WITH {DIMS_SQL} SELECT candidate_id AS dataset_id, classification FROM cl")
def _(spark, sf):
    return rules.capabilities(candidate_datasets(spark, sf)).select(D, "classification")


@query("b06_pair_capabilities", "cand", f"""WITH {DIMS_SQL}, g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
j AS (SELECT cl.*, n FROM cl JOIN g ON label=candidate_id)
SELECT candidate_id AS dataset_id, CASE WHEN has_time AND arr THEN 'wideband_dynamic_mimo' WHEN arr THEN 'wideband_static_mimo' ELSE 'other_channel' END AS classification,
 array_to_string(list_filter(['pdp', 'frequency_autocorrelation', CASE WHEN n_sample>1 THEN 'delay_spread_cdf' END, CASE WHEN arr THEN 'angular_power_spectrum' END, CASE WHEN arr AND n_t*n_sample>1 THEN 'spatial_correlation' END,
  CASE WHEN arr AND n_sample>1 THEN 'angular_spread_cdf' END, CASE WHEN has_time THEN 'doppler_power_spectrum' END, CASE WHEN has_time THEN 'time_autocorrelation' END, CASE WHEN has_time AND n_sample>1 THEN 'doppler_spread_cdf' END], lambda x: x IS NOT NULL), '|') AS standard_metrics FROM j""")
def _(spark, sf):
    cir = candidate_datasets(spark, sf)
    # The frequency view of a pair comes from the vectors with the same label.
    seen = views.ctf_vectors(spark, sf).groupBy(F.col("sample").alias(D)).agg(F.max(F.size("re")).alias("n_f"))
    ctf = cir.drop("n_f", "has_frequency_axis").join(seen, D).withColumn("domain", F.lit("ctf")).withColumn(
        "has_frequency_axis", F.lit(True)).withColumn("n_t", F.when(F.col("has_time_axis"), F.col("n_t")).otherwise(1))
    p = rules.pair_capabilities(rules.capabilities(cir), rules.capabilities(ctf))
    return p.select(D, "classification", F.array_join("standard_metrics", "|").alias("standard_metrics"))


def candidate_registry(spark, sf):
    return rules.metric_registry(rules.metric_status(rules.capabilities(candidate_datasets(spark, sf))))


@query("b07_metric_registry", "cand", f"""WITH {DIMS_SQL} SELECT dataset_id, metric, available, is_standard, is_additional,
 CAST(count_if(available) OVER w AS BIGINT) AS available_count, CAST(count_if(available AND is_standard) OVER w AS BIGINT) AS available_standard, CAST(count_if(available AND is_additional) OVER w AS BIGINT) AS available_additional
FROM rg WINDOW w AS (PARTITION BY dataset_id)""")
def _(spark, sf):
    r = candidate_registry(spark, sf)
    return r.select(D, "metric", "available", "is_standard", "is_additional", "available_count", "available_standard",
                    "available_additional")


@query("b07_metric_reasons", "cand", f"""WITH {DIMS_SQL},
m AS (SELECT cl.*, unnest(['power','pdp','frequency_autocorrelation','delay_spread_cdf','angular_power_spectrum','spatial_correlation','angular_spread_cdf','doppler_power_spectrum','time_autocorrelation','doppler_spread_cdf','delay_sample_heatmap']) AS metric,
 unnest([1,2,3,4,5,6,7,8,9,10,11]) AS k, CASE WHEN NOT wide THEN '{rules.NO_DELAY}' END AS dl, CASE WHEN NOT has_time THEN 'Need Nt > 1 plus time_s or snapshot_interval_s.' END AS tm FROM cl)
SELECT candidate_id AS dataset_id, metric, coalesce(CASE k WHEN 2 THEN dl WHEN 3 THEN 'Need Nf > 1 plus frequency_hz or center/subcarrier spacing.'
 WHEN 4 THEN coalesce(dl, CASE WHEN n_sample<2 THEN '{rules.NO_CDF}' END) WHEN 5 THEN CASE WHEN NOT arr THEN '{rules.NO_ARRAY}' END
 WHEN 6 THEN CASE WHEN NOT arr THEN '{rules.NO_CORRELATION_ARRAY}' WHEN n_t*n_sample<2 THEN '{rules.NO_CORRELATION}' END
 WHEN 7 THEN CASE WHEN NOT arr THEN '{rules.NO_SPREAD}' WHEN n_sample<2 THEN '{rules.NO_SPREAD_CDF}' END WHEN 8 THEN tm WHEN 9 THEN tm
 WHEN 10 THEN coalesce(tm, CASE WHEN n_sample<2 THEN '{rules.NO_CDF}' END)
 WHEN 11 THEN coalesce(dl, CASE WHEN n_sample<2 THEN '{rules.NO_HEATMAP_SAMPLES}' WHEN NOT ordered THEN '{rules.NO_HEATMAP_ORDER}' END) END, '') AS reason FROM m""")
def _(spark, sf):
    return candidate_registry(spark, sf).select(D, "metric", "reason")


@query("b08_visible_metrics", "cand", f"WITH {DIMS_SQL} SELECT dataset_id, metric FROM rg WHERE available AND (is_standard OR is_additional OR NOT standard_class)")
def _(spark, sf):
    return rules.visible_metrics(candidate_registry(spark, sf)).select(D, "metric")


@query("b09_continuity_policy", "cand", f"""WITH {DIMS_SQL}, h AS (SELECT candidate_id AS dataset_id, count(DISTINCT (path, sample)) AS pts FROM cand GROUP BY 1)
SELECT dataset_id, metric, available AND metric<>'delay_sample_heatmap' AS available, CASE WHEN metric='delay_sample_heatmap' THEN 0 ELSE pts END AS points, 'WARNING' AS status FROM rg JOIN h USING (dataset_id)""")
def _(spark, sf):
    status = rules.metric_status(rules.capabilities(candidate_datasets(spark, sf)))
    cells = views.cand(spark, sf).select(F.col("candidate_id").alias(D), "path", "sample").distinct()
    points = cells.withColumn("metric", F.explode(F.array(*[F.lit(m) for m in rules.METRICS])))
    analysis = status.groupBy(D).agg(F.lit("PASS").alias("status"))
    s, p, a = rules.apply_continuity(status, points, analysis, "independent_targets")
    counts = p.groupBy(D, "metric").agg(F.count(F.lit(1)).alias("points"))
    return s.join(counts, [D, "metric"], "left").join(a, D).select(
        D, "metric", "available", F.coalesce("points", F.lit(0)).alias("points"), "status")


PRESET_SQL = """nn AS (SELECT group_id, count(*) AS n FROM pseq GROUP BY 1),
cn AS (SELECT *, least(greatest(1, round(n*CAST(0.2 AS DOUBLE))), n-2) AS ci, least(greatest(1, round(n*CAST(0.2 AS DOUBLE))), n-1) AS ce FROM nn),
tk AS (SELECT 'interpolation' AS mode, p.group_id, idx, CASE WHEN idx BETWEEN floor((n-ci)/2)+1 AND floor((n-ci)/2)+ci THEN 'target' ELSE 'known' END AS region FROM pseq p JOIN cn USING (group_id) WHERE n>=3
 UNION ALL SELECT 'extrapolation', p.group_id, idx, CASE WHEN idx>n-ce THEN 'target' ELSE 'known' END FROM pseq p JOIN cn USING (group_id) WHERE n>=2)"""


def preset_tasks(spark, sf):
    axis = shared_copy(views.pseq(spark, sf).select(D, "group_id", "idx"), "axis")  # ranked once for both presets
    return rules.preset_task(axis, [D, "group_id"], "idx", "interpolation").unionByName(
        rules.preset_task(axis, [D, "group_id"], "idx", "extrapolation"))


@query("b10_task_rules", "pseq", f"""WITH {PRESET_SQL},
br AS (SELECT mode||'/'||group_id AS task_id, mode, region, idx FROM tk UNION ALL SELECT mode||'/'||group_id, mode, 'known', idx FROM tk WHERE region='target' AND group_id%4=0 UNION ALL SELECT mode||'/'||group_id, mode, region, idx FROM tk WHERE region='known' AND group_id%4=1),
e AS (SELECT task_id, idx, count_if(region='known') AS k, count_if(region='target') AS t FROM br GROUP BY 1,2),
f AS (SELECT task_id, count_if(k>1) AS duplicate_known, count_if(k>0 AND t>0) AS overlap FROM e GROUP BY 1)
SELECT task_id, CAST(duplicate_known AS BIGINT) AS duplicate_known, CAST(overlap AS BIGINT) AS overlap, CAST(0 AS BIGINT) AS wrong_side, CASE WHEN duplicate_known+overlap>0 THEN 'FAIL' ELSE 'PASS' END AS status FROM f""")
def _(spark, sf):
    tasks = preset_tasks(spark, sf).select(F.concat_ws("/", "mode", "group_id").alias("task_id"), "group_id", "mode", "region", "idx")
    # Some tasks are broken on purpose: targets repeated as known, and doubled known indices.
    overlap = tasks.filter("region = 'target' AND group_id % 4 = 0").withColumn("region", F.lit("known"))
    doubled = tasks.filter("region = 'known' AND group_id % 4 = 1")
    broken = tasks.unionByName(overlap).unionByName(doubled).withColumn("axis", F.lit("sample"))
    length = tasks.groupBy("task_id").agg(F.max("idx").alias("n")).withColumns(
        {"n_f": F.lit(1), "n_t": F.lit(1), "has_position": F.lit(False)})
    r = shared_copy(rules.task_rules(broken, length), "rules")  # nine rows a task, for the counts and the status
    pick = lambda rule: F.max(F.when(F.col("rule") == rule, F.col("violations"))).alias(rule)
    wide = r.groupBy("task_id").agg(pick("duplicate_known"), pick("overlap"), pick("wrong_side"))
    return wide.join(rules.overall_status(r, ["task_id"]), "task_id")


@query("b11_task_preset", "pseq", f"WITH {PRESET_SQL} SELECT mode, group_id, region, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx, 'index' AS axis_unit FROM tk GROUP BY 1,2,3")
def _(spark, sf):
    return preset_tasks(spark, sf).groupBy("mode", "group_id", "region", "axis_unit").agg(
        F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@query("b12_manual_task", "pseq", """WITH f AS (SELECT group_id, CAST(round(KF_mu) AS BIGINT) AS item, min(idx) AS first_seen FROM pseq GROUP BY 1,2)
SELECT group_id, item, first_seen, row_number() OVER (PARTITION BY group_id ORDER BY first_seen) AS place FROM f""")
def _(spark, sf):
    lists = views.pseq(spark, sf).select("group_id", F.round("KF_mu").cast("long").alias("item"), "idx")
    return rules.manual_task(lists, ["group_id"], "item", "idx").select("group_id", "item", "first_seen", "place")


@query("b13_range_text", "pseq", """WITH g AS (SELECT group_id, max(idx) AS n FROM pseq GROUP BY 1),
v AS (SELECT group_id, unnest(range(1, 6)) AS v FROM g UNION SELECT group_id, n FROM g UNION SELECT group_id, n+5 FROM g)
SELECT v.group_id, CAST(v AS DOUBLE) AS value, idx FROM v LEFT JOIN pseq p ON p.group_id=v.group_id AND p.idx=v.v""")
def _(spark, sf):
    seq = views.pseq(spark, sf)
    texts = seq.groupBy("group_id").agg(F.max("idx").alias("n")).select(
        "group_id", F.concat(F.lit("1:5, 3 ,"), F.col("n").cast("string"), F.lit("，"), (F.col("n") + 5).cast("string")).alias("text"))
    axis = seq.select("group_id", F.col("idx").cast("double").alias("value"), "idx")
    return rules.parse_ranges(texts, ["group_id"], "text", axis).select("group_id", "value", "idx")


@query("b14_region_selection", "cir", f"""WITH s AS (SELECT sample, row_number() OVER (ORDER BY sample) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT sample FROM cir)),
k AS (SELECT sample FROM s WHERE pos <= n - least(greatest(1, round(n*CAST(0.2 AS DOUBLE))), n-1))
SELECT sample, path, count(*) AS n_rows, {s6('ln(avg(power))','log_power')} FROM cir SEMI JOIN k USING (sample) GROUP BY 1,2""")
def _(spark, sf):
    cir = views.cir(spark, sf)
    samples = positions(cir.select(D, "sample").distinct(), [D], ["sample"], "sample")
    task = rules.preset_task(samples, [D], "pos", "extrapolation").select(D, F.col("sample").alias("idx"), "region")
    kept = rules.select_region(cir, task, "sample", "known")
    return kept.groupBy("sample", "path").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.log(F.avg("power")), "log_power"))


SEQ_RULE_SQL = """sr AS (SELECT unnest(['unsupported_source','unsupported_quality','empty_group','window_order','non_finite','out_of_bounds','failed_rows']) AS rule,
 unnest([0, 0, 0, 0, 0, count_if(quality_status<>'FAIL' AND NOT (DS_mu BETWEEN -9 AND -7 AND KF_mu BETWEEN -10 AND 20)), count_if(quality_status='FAIL')]) AS violations,
 unnest(['error','error','error','error','error','error','warning']) AS severity FROM pseq)"""


def sequence_report(spark, sf):
    seq = views.pseq(spark, sf).withColumns({"raw_window_start": F.col("idx"), "raw_window_end": F.col("idx")})
    return rules.sequence_rules(seq, PARAMS, {"DS_mu": (-9.0, -7.0), "KF_mu": (-10.0, 20.0)})


@query("b15_combined_report", "cir pseq", f"""WITH {CIR_RULE_SQL}, {SEQ_RULE_SQL}, a AS (SELECT 'dataset: '||rule AS rule, violations, severity FROM ru UNION ALL SELECT 'task: '||rule, violations, severity FROM sr)
SELECT rule, CAST(violations AS BIGINT) AS violations, severity, CASE WHEN max(CASE WHEN violations>0 AND severity='error' THEN 2 WHEN violations>0 THEN 1 ELSE 0 END) OVER ()=2 THEN 'FAIL' ELSE 'WARNING' END AS overall FROM a""")
def _(spark, sf):
    a = cir_report(spark, sf).withColumn("job", F.lit("import"))
    b = sequence_report(spark, sf).withColumn("job", F.lit("import"))
    r = rules.combine_reports({"dataset": a, "task": b}, ["job"])
    status = rules.overall_status(r, ["job"]).withColumnRenamed("status", "overall")
    return r.join(status, "job").select("rule", "violations", "severity", "overall")


@query("b16_sequence_rules", "pseq", f"WITH {SEQ_RULE_SQL} SELECT rule, CAST(violations AS BIGINT) AS violations, severity FROM sr")
def _(spark, sf):
    return sequence_report(spark, sf).select("rule", "violations", "severity")


@query("b17_example_rules", "pseq", f"""WITH {SPAN_SQL} SELECT unnest(['input_shape','target_shape','non_finite','index_overlap','no_examples']) AS rule,
 unnest([count_if(len(a)<>20), count_if(len(b)<>20), count_if(NOT isfinite(list_sum(a)+list_sum(b))), 0, CAST(count(*)=0 AS BIGINT)]) AS violations, unnest(['error','error','error','error','warning']) AS severity FROM ex""")
def _(spark, sf):
    r = rules.example_rules(pseq_examples(spark, sf), PARAMS, seqs.LAYOUT["extrapolation"])
    return r.select("rule", "violations", "severity")


CARD_CORE = ["dataset_name", "data_type", "source"]
CARD_RECOMMENDED = ["bandwidth", "license", "trajectory"]
CARD_TYPES = ["SAGE", "CIR", "CTF", "PDP", "Doppler", "Angular Spectrum", "Feature Tensor", "Prediction Target"]
CARD_SQL = """cd AS (SELECT doc_id AS card_id, CASE WHEN doc_id%5=0 THEN ' Unknown ' ELSE lang END AS dataset_name, CASE doc_id%4 WHEN 0 THEN 'cir' WHEN 1 THEN 'PDP' WHEN 2 THEN 'video' ELSE '' END AS data_type, source,
 CASE WHEN n_chars>1000 THEN 'wide' END AS bandwidth, CASE WHEN doc_id%2=0 THEN 'restricted' ELSE 'public' END AS visibility FROM documents),
cr AS (SELECT card_id, unnest(['missing_dataset_name','missing_data_type','missing_source','missing_bandwidth','missing_license','missing_trajectory','unsupported_type','private_visibility']) AS rule,
 unnest([CAST(trim(lower(dataset_name))='unknown' AS BIGINT), CAST(data_type='' AS BIGINT), CAST(source='' AS BIGINT), CAST(bandwidth IS NULL AS BIGINT), 1, 1, CAST(data_type='video' AS BIGINT), CAST(visibility='restricted' AS BIGINT)]) AS violations,
 unnest(['error','error','error','warning','warning','warning','error','warning']) AS severity FROM cd)"""


def dataset_cards(spark, sf):
    d = views.table(spark, sf, "documents")
    n = F.col("doc_id") % 4
    card = F.create_map(
        F.lit("dataset_name"), F.when(F.col("doc_id") % 5 == 0, " Unknown ").otherwise(F.col("lang")),
        F.lit("data_type"), F.when(n == 0, "cir").when(n == 1, "PDP").when(n == 2, "video").otherwise(""),
        F.lit("source"), F.col("source"), F.lit("bandwidth"), F.when(F.col("n_chars") > 1000, "wide"),
        F.lit("visibility"), F.when(F.col("doc_id") % 2 == 0, "restricted").otherwise("public"))
    return d.select(F.col("doc_id").alias("card_id"), card.alias("card"))


@query("b18_dataset_card_rules", "", f"WITH {CARD_SQL} SELECT card_id, rule, CAST(violations AS BIGINT) AS violations, severity FROM cr")
def _(spark, sf):
    return rules.card_rules(dataset_cards(spark, sf), CARD_CORE, CARD_RECOMMENDED, CARD_TYPES)


@query("b18_dataset_card_status", "", f"WITH {CARD_SQL} SELECT card_id, CASE WHEN count_if(violations>0 AND severity='error')>0 THEN 'FAIL' ELSE 'WARNING' END AS status FROM cr GROUP BY 1")
def _(spark, sf):
    return rules.overall_status(rules.card_rules(dataset_cards(spark, sf), CARD_CORE, CARD_RECOMMENDED, CARD_TYPES), ["card_id"])


def file_inventory(spark, sf):
    """Inventory rows whose extension, attributes and variables depend on the page."""
    f = views.files(spark, sf)
    k = F.col("file_id") % 10
    texts = lambda *names: F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>")
    full = rules.REQUIRED_ATTRIBUTES
    return f.select(
        "file_id",
        F.when(k < 5, ".h5").when(k < 9, ".mat").otherwise(F.col("extension")).alias("extension"),
        (F.col("file_id") % 7 != 0).alias("readable"),
        F.when(k.isin(0, 1, 2), texts(*full)).otherwise(texts("schema_version")).alias("attributes"),
        F.when(k == 0, texts(*rules.REQUIRED_DATASETS["cir"])).when(k == 1, texts(*rules.REQUIRED_DATASETS["ctf"]))
        .when(k == 3, texts("/csi/real", "/csi/imag")).otherwise(texts()).alias("datasets"),
        F.when(k == 5, texts("sage")).when(k == 6, texts("my_dpsd")).when(k == 7, texts("input", "x")).otherwise(texts("x")).alias("variables"),
        F.when(k == 1, "ctf").otherwise("cir").alias("domain"))


@query("b19_file_classification", "files", """SELECT file_id, CASE WHEN k<9 AND file_id%7=0 THEN CASE WHEN k<5 THEN 'invalid_hdf5' ELSE 'invalid_mat' END WHEN k IN (0,1) THEN 'v3_channel_hdf5' WHEN k=2 THEN 'incomplete_v3_hdf5' WHEN k=3 THEN 'legacy_wifo_hdf5' WHEN k=4 THEN 'non_v3_hdf5'
 WHEN k=5 THEN 'legacy_sage_mat' WHEN k=6 THEN 'power_feature_mat' WHEN k=7 THEN 'model_feature_mat' WHEN k=8 THEN 'unsupported_mat' ELSE 'unsupported_file_format' END AS category FROM (SELECT *, file_id%10 AS k FROM files)""")
def _(spark, sf):
    return rules.classify_files(file_inventory(spark, sf)).select("file_id", "category")


@query("b20_manifest_guard", "files", """WITH u AS (SELECT path, min(sha256(path)) AS h, min(file_id) AS id FROM files GROUP BY 1)
SELECT path, CASE id%5 WHEN 0 THEN 'missing' WHEN 1 THEN 'changed' WHEN 2 THEN 'unexpected' ELSE 'ok' END AS state FROM u""")
def _(spark, sf):
    u = views.files(spark, sf).groupBy("path").agg(F.sha2(F.col("path"), 256).alias("sha256"), F.min("file_id").alias("id"))
    k = F.col("id") % 5
    expected = u.filter(k != 2)
    found = u.filter(k != 0).withColumn("sha256", F.when(k == 1, F.lit("0")).otherwise(F.upper("sha256")))
    return rules.manifest_check(expected, found).select("path", "state")


@query("c27_full_analysis", "cir", """SELECT * FROM (SELECT unnest(['power','pdp','frequency_autocorrelation','delay_spread_cdf','angular_power_spectrum','spatial_correlation','angular_spread_cdf','doppler_power_spectrum','time_autocorrelation','doppler_spread_cdf','delay_sample_heatmap']) AS metric,
 unnest([true,true,true,true,true,true,true,true,true,true,true]) AS available,
 unnest([n, 7, 8, n, 360, 13, 2*n, 16, 12, n, 64*n]) AS points FROM (SELECT count(DISTINCT sample) AS n FROM cir))""")
def _(spark, sf):
    from ..operators.metrics import centred_offsets
    from .analysis import analyze
    cir = views.cir(spark, sf)
    meta = cir.groupBy(D).agg(F.lit(8).alias("n_f")).withColumns({
        "has_frequency_axis": F.lit(True), "has_time_axis": F.lit(True), "tx_ula": F.lit(False), "rx_ula": F.lit(False),
        "sample_semantics": F.lit("ordered_route")})
    points, registry = analyze(cir, meta, spacing_s=SNAPSHOT_S, offsets_hz=centred_offsets(8, SUBCARRIER_HZ))
    counts = points.groupBy(D, "metric").agg(F.count(F.lit(1)).alias("points"))
    return registry.join(counts, [D, "metric"], "left").select(
        "metric", "available", F.coalesce("points", F.lit(0)).cast("long").alias("points"))
