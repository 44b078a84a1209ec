"""Reshaping, folder loads and result bundles on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import power, r6
from ..operators import forecast as fcst
from ..operators import rules, sequences as seqs, tensors
from ..operators.sequences import D
from ..sources import bundles, files
from . import views
from .queries_evaluate import FC_SQL, pseq_forecast
from .queries_metrics import BANDWIDTH_HZ, SNAPSHOT_S
from .queries_rules import DIMS_SQL, candidate_datasets
from .queries_sequences import NORM_SQL, SPAN_SQL, SPLIT_SQL, example_split, fitted_norm, pseq_examples
from .registry import query, s6
from .views import PARAMS


def flat_vectors(spark, sf):
    return views.table(spark, sf, "embeddings").select(
        views.source_id("embeddings", "vec_id"), F.col("vec_id").alias("obs"),
        F.transform("embedding", lambda x: x.cast("double")).alias("values"))


FLAT_SQL = "fl AS (SELECT vec_id AS obs, CAST(b AS INTEGER) AS pos, CAST(embedding[b+1] AS DOUBLE) AS v FROM embeddings, range(64) r(b))"


@query("a01_unflatten", "", f"WITH {FLAT_SQL} SELECT obs, pos%2 AS tx, (pos//2)%4 AS rx, (pos//8)%8 AS f, {s6('v','value')} FROM fl")
def _(spark, sf):
    u = tensors.unflatten(flat_vectors(spark, sf), ["obs"], "values", [2, 4, 8], ["tx", "rx", "f"])
    return u.select("obs", "tx", "rx", "f", r6("value", "value"))


@query("a02_complex_assembly", "", """SELECT vec_id AS obs, CAST(b AS INTEGER) AS k, round(CAST(embedding[b+1] AS DOUBLE), 6) AS re, round(CAST(embedding[b+33] AS DOUBLE), 6) AS im, 'ok' AS status FROM embeddings, range(32) r(b) WHERE vec_id%7<>0
UNION ALL SELECT vec_id, NULL, NULL, NULL, 'shape_mismatch' FROM embeddings WHERE vec_id%7=0""")
def _(spark, sf):
    # Every seventh vector lost its last imaginary value.
    short = F.when(F.col("obs") % 7 == 0, 31).otherwise(32)
    parts = flat_vectors(spark, sf).select("obs", F.slice("values", 1, 32).alias("re"), F.slice("values", F.lit(33), short).alias("im"))
    c = tensors.assemble_complex(parts, ["obs"])
    return c.select("obs", "k", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"), "status")


@query("a03_singleton_broadcast", "cir", f"""WITH d AS (SELECT path, avg(delay_s) AS d FROM cir GROUP BY 1)
SELECT sample, path, count(*) AS n_rows, {s6('any_value(d)*1e9','field_ns')} FROM cir JOIN d USING (path) GROUP BY 1,2""")
def _(spark, sf):
    cir = views.cir(spark, sf)
    field = cir.groupBy("path").agg(F.avg("delay_s").alias("field_delay_s"))
    e = tensors.expand_field(cir.select("sample", "path"), field, ["path"])
    return e.groupBy("sample", "path").agg(F.count(F.lit(1)).alias("n_rows"), F.max("field_delay_s").alias("d")).select(
        "sample", "path", "n_rows", r6(F.col("d") * 1e9, "field_ns"))


@query("a04_flatten", "", f"WITH {FLAT_SQL} SELECT obs, CAST(count(*) AS INTEGER) AS n, '2x4x8' AS shape, {s6('sum(v*(pos+1))','position_sum')}, {s6('max(v) FILTER (pos=5)','sixth')} FROM fl GROUP BY 1")
def _(spark, sf):
    u = tensors.unflatten(flat_vectors(spark, sf), ["obs"], "values", [2, 4, 8], ["tx", "rx", "f"])
    f = tensors.flatten(u, ["obs"], ["tx", "rx", "f"], [2, 4, 8], "value")
    weighted = F.aggregate(F.zip_with("values", F.sequence(F.lit(1), F.size("values")), lambda v, i: v * i), F.lit(0.0), lambda a, x: a + x)
    return f.select("obs", F.size("values").alias("n"), F.array_join(F.transform("shape", lambda x: x.cast("string")), "x").alias("shape"),
                    r6(weighted, "position_sum"), r6(F.col("values")[5], "sixth"))


@query("a05_table_write", "cir", f"SELECT 'lineitem' AS dataset_id, sample, count(*) AS n_rows, {s6('ln(sum(power))','log_power')} FROM cir GROUP BY 2")
def _(spark, sf):
    folder = bundles.scratch_folder(spark, "cir")
    bundles.write_table(views.cir(spark, sf), folder, [D])
    return spark.read.parquet(folder).groupBy(D, "sample").agg(
        F.count(F.lit(1)).alias("n_rows"), r6(F.log(F.sum(power())), "log_power"))


def named_profiles(spark, sf):
    """One named vector per embedding; names need natural order."""
    return flat_vectors(spark, sf).select(
        D, F.concat(F.lit("Snap"), F.col("obs").cast("string"), F.lit(".mat")).alias("name"),
        F.transform("values", lambda x: F.lit(-65.0) + 10.0 * x).alias("dbm"))


@query("a06_folder_pack", "", f"""WITH {FLAT_SQL} SELECT obs+1 AS sample, pos AS tap, {s6('pos/CAST(1e8 AS DOUBLE)*1e9','delay_ns')}, {s6('-65+10*v','value')}, CAST(1 AS BIGINT) AS sizes FROM fl""")
def _(spark, sf):
    p = tensors.pack_folder(named_profiles(spark, sf), "name", "dbm", bandwidth_hz=BANDWIDTH_HZ)
    return p.select("sample", "tap", r6(F.col("delay_s") * 1e9, "delay_ns"), r6("value", "value"), "sizes")


@query("a07_legacy_remap", "ctf", f"""SELECT 'sample' AS axis, obs+1 AS sample, CAST(0 AS BIGINT) AS t, CAST(-1 AS DOUBLE) AS time_ms, count(*) AS cells, {s6('sum(re)','sum_re')} FROM ctf GROUP BY obs
UNION ALL SELECT 'time', 1, obs, {s6('obs*CAST(0.001 AS DOUBLE)*1e3','x')}, count(*), {s6('sum(re)','sum_re')} FROM ctf GROUP BY obs""")
def _(spark, sf):
    legacy = views.ctf(spark, sf).select(D, F.col("obs").alias("seq"), (F.col("k") % 2).alias("tx"),
                                         (F.floor(F.col("k") / 2) % 2).alias("rx"), F.floor(F.col("k") / 4).alias("path"), "re", "im")
    def side(axis, df):
        g = df.groupBy("sample", "t").agg(F.max("time_s").alias("s"), F.count(F.lit(1)).alias("cells"), F.sum("re").alias("r"))
        return g.select(F.lit(axis).alias("axis"), "sample", "t", r6(F.coalesce(F.col("s") * 1e3, F.lit(-1.0)), "time_ms"), "cells", r6("r", "sum_re"))
    return side("sample", tensors.remap_legacy(legacy, "sample")).unionByName(
        side("time", tensors.remap_legacy(legacy, "time", SNAPSHOT_S)))


@query("a08_axis_reorder", "cir", "SELECT rx AS tx, tx AS rx, path, count(*) AS n_rows, CAST(count_if(path<>3) AS BIGINT) AS valid_rows FROM cir GROUP BY 1,2,3")
def _(spark, sf):
    # Path 3 carries no amplitude here, so the mask drops it.
    zero = lambda c: F.when(F.col("path") == 3, 0.0).otherwise(F.col(c)).alias(c)
    rows = views.cir(spark, sf).select("tx", "rx", "path", "delay_s", zero("re"), zero("im"))
    return tensors.reorder_axes(rows).groupBy("tx", "rx", "path").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("path_valid").alias("valid_rows"))


CELL_SQL = """ce AS (SELECT sample, tx, rx, t, path, sum(re) AS re, sum(im) AS im, min(delay_s) AS delay_s FROM cir GROUP BY ALL)"""


def path_cells(spark, sf):
    """One row per index cell; each link holds its own set of paths."""
    return views.cir(spark, sf).groupBy(D, "sample", "tx", "rx", "t", "path").agg(
        F.sum("re").alias("re"), F.sum("im").alias("im"), F.min("delay_s").alias("delay_s"), F.lit(True).alias("path_valid"))


@query("a09_path_padding", "cir", f"""WITH {CELL_SQL}, n AS (SELECT sample, tx, rx, t, count(*) AS n, sum(re) AS re FROM ce GROUP BY ALL), m AS (SELECT max(n) AS m FROM n)
SELECT sample, tx, rx, t, CAST(m AS BIGINT) AS paths, n AS valid_paths, {s6('re','sum_re')} FROM n, m""")
def _(spark, sf):
    p = tensors.pad_paths(path_cells(spark, sf), ["sample", "tx", "rx", "t"], ["re", "im", "delay_s"])
    return p.groupBy("sample", "tx", "rx", "t").agg(
        F.count(F.lit(1)).alias("paths"), F.count_if("path_valid").alias("valid_paths"), r6(F.sum("re"), "sum_re"))


@query("a10_combine_targets", "cir", f"""WITH {CELL_SQL}, n AS (SELECT sample, tx, rx, t, count(*) AS n, sum(re) AS re FROM ce GROUP BY ALL), m AS (SELECT max(n) AS m FROM n)
SELECT CAST(CASE tx WHEN 1 THEN 1 ELSE 2 END AS INTEGER) AS target, CASE tx WHEN 1 THEN 'tx1' ELSE 'tx0' END AS target_name, count(*)*any_value(m) AS cells, CAST(sum(n) AS BIGINT) AS valid_cells, false AS has_angles FROM n, m GROUP BY tx""")
def _(spark, sf):
    cells = path_cells(spark, sf)
    tx1 = cells.filter("tx = 1").withColumn("aoa_rad", F.lit(0.0))
    tx0 = cells.filter("tx = 0")  # has no angles, so the combined table has none
    c = tensors.combine_targets([tx1, tx0], ["tx1", "tx0"], ["aoa_rad"], ["sample", "rx", "t"])
    return c.groupBy("target", "target_name").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if("path_valid").alias("valid_cells")).withColumn(
        "has_angles", F.lit("aoa_rad" in c.columns))


@query("a11_profile_folder_order", "", "SELECT 'Snap'||vec_id||'.mat' AS name, row_number() OVER (ORDER BY vec_id) AS snapshot, CAST(1 AS BIGINT) AS lengths, 64 AS n_bins FROM embeddings")
def _(spark, sf):
    o = files.ordered_profiles(named_profiles(spark, sf), "name", "dbm")
    return o.select("name", "snapshot", "lengths", F.size("dbm").alias("n_bins"))


@query("a12_canonical_axes", "ctf", f"SELECT k%4+1 AS antenna, CAST(k//4+1 AS BIGINT) AS delay, obs+1 AS snapshot, {s6('re','re')}, {s6('im','im')} FROM ctf")
def _(spark, sf):
    v = views.ctf(spark, sf).select(D, F.lit(0).alias("tx"), (F.col("k") % 4).alias("rx"), F.floor(F.col("k") / 4).alias("path"),
                                    F.lit(0).alias("t"), F.col("obs").alias("sample"), "re", "im")
    c = tensors.canonical_axes(v, ["tx", "rx", "path", "t", "sample"], ["re", "im"])
    return c.select("antenna", "delay", "snapshot", r6("re", "re"), r6("im", "im"))


@query("a12_mixed_layouts", "ctf", f"""SELECT 'array' AS dataset_id, k%4+1 AS antenna, CAST(k//4+1 AS BIGINT) AS delay, obs+1 AS snapshot, {s6('re','re')}, {s6('im','im')} FROM ctf
UNION ALL SELECT 'sweep', obs+1, k+1, 1, {s6('re','re')}, {s6('im','im')} FROM ctf WHERE obs<40
UNION ALL SELECT 'line', 1, k+1, 1, {s6('re','re')}, {s6('im','im')} FROM ctf WHERE obs=7""")
def _(spark, sf):
    """Three, two and one axis in one table; each dataset keeps its own layout."""
    v = views.ctf(spark, sf)
    zero = F.lit(0)
    side = lambda name, rows, tx, rx, path: rows.select(
        F.lit(name).alias(D), tx.alias("tx"), rx.alias("rx"), path.alias("path"), zero.alias("t"), "obs", "re", "im")
    k, obs = F.col("k"), F.col("obs")
    mixed = side("array", v, zero, k % 4, F.floor(k / 4).cast("int")).withColumn("sample", obs).unionByName(
        side("sweep", v.filter("obs < 40"), obs.cast("int"), zero, k).withColumn("sample", F.lit(0).cast("long"))).unionByName(
        side("line", v.filter("obs = 7"), zero, zero, k).withColumn("sample", F.lit(0).cast("long")))
    c = tensors.canonical_axes(mixed, ["tx", "rx", "path", "t", "sample"], ["re", "im"])
    return c.select(D, "antenna", "delay", "snapshot", r6("re", "re"), r6("im", "im"))


@query("a13_record_flattening", "", """WITH r AS (SELECT doc_id, doc_id%6 AS k FROM documents)
SELECT doc_id, CASE WHEN k IN (4) THEN 'FAIL' WHEN k=0 THEN 'PASS' ELSE 'WARNING' END AS validation_status,
 CASE k WHEN 4 THEN 'No usable CIR, estimated CIR, or path amplitude is present.' WHEN 0 THEN '' WHEN 1 THEN 'Missing recommended SAGE fields: alpha' WHEN 2 THEN 'Missing recommended SAGE fields: doa' WHEN 3 THEN 'Missing recommended SAGE fields: delay, likelihood' ELSE 'Missing recommended SAGE fields: cir_e' END AS warning FROM r""")
def _(spark, sf):
    return record_rows(spark, sf, ["doc_id"]).select("doc_id", "validation_status", "warning")


def record_rows(spark, sf, keys):
    """One nested record per document; which fields are missing depends on its id."""
    k = F.col("doc_id") % 6
    size = F.col("n_chars").cast("double")
    record = F.struct(
        F.when(~k.isin(1, 4), size).alias("alpha"), F.when(k != 2, size).alias("doa"), F.when(k != 3, size).alias("delay"),
        F.when(~k.isin(4), size).alias("cir"), F.when(~k.isin(4, 5), size).alias("cir_e"), F.when(k != 3, size).alias("likelihood"))
    docs = views.table(spark, sf, "documents").withColumns({
        "file_no": F.floor(F.col("doc_id") / 3) + 1, "record_no": F.col("doc_id") % 3 + 1, "sage": record})
    return tensors.flatten_records(docs, keys, "sage")


RECORD_SQL = """r AS (SELECT doc_id, doc_id%6 AS k, doc_id//3+1 AS file_no, doc_id%3+1 AS record_no FROM documents),
f AS (SELECT *, CASE WHEN k=4 THEN 'FAIL' WHEN k=0 THEN 'PASS' ELSE 'WARNING' END AS status,
 CASE k WHEN 4 THEN 'No usable CIR, estimated CIR, or path amplitude is present.' WHEN 0 THEN '' WHEN 1 THEN 'Missing recommended SAGE fields: alpha' WHEN 2 THEN 'Missing recommended SAGE fields: doa' WHEN 3 THEN 'Missing recommended SAGE fields: delay, likelihood' ELSE 'Missing recommended SAGE fields: cir_e' END AS warning FROM r)"""


@query("a13_record_warnings", "", f"""WITH {RECORD_SQL}
SELECT printf('sage_%04d_%04d', file_no, record_no) AS record_id, CASE WHEN warning='' THEN '' ELSE printf('sage_%04d_%04d', file_no, record_no)||': '||warning END AS record_warning FROM f""")
def _(spark, sf):
    rows = record_rows(spark, sf, ["file_no", "record_no"])
    return tensors.with_record_ids(rows, "file_no", "record_no").select("record_id", "record_warning")


@query("a13_conversion_status", "", f"""WITH {RECORD_SQL}, fl AS (SELECT DISTINCT file_no FROM r UNION SELECT -1)
SELECT fl.file_no, count(f.doc_id) AS records, CAST(coalesce(count_if(f.warning<>''), 0) AS BIGINT) AS warnings,
 CASE WHEN count(f.doc_id)=0 OR bool_or(f.status='FAIL') THEN 'FAIL' WHEN bool_or(f.status='WARNING') THEN 'WARNING' ELSE 'PASS' END AS status FROM fl LEFT JOIN f USING (file_no) GROUP BY 1""")
def _(spark, sf):
    rows = record_rows(spark, sf, ["file_no"])
    # one listed file has no record
    listed = rows.select("file_no").distinct()
    listed = listed.union(listed.agg(F.lit(-1).cast("long").alias("file_no")))
    return tensors.conversion_status(listed, rows, ["file_no"]).select("file_no", "records", "warnings", "status")


def archive_files(spark, sf):
    return views.files(spark, sf).withColumn("archive", F.regexp_extract("path", "//([^/]+)/", 1))


ARCHIVE_SQL = "ar AS (SELECT *, regexp_extract(path, '//([^/]+)/', 1) AS archive FROM files)"


@query("a14_inventory_counts", "files", f"WITH {ARCHIVE_SQL} SELECT archive, extension, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM ar GROUP BY 1,2")
def _(spark, sf):
    return files.inventory_counts(archive_files(spark, sf))


@query("a14_inventory_samples", "files", f"WITH {ARCHIVE_SQL} SELECT archive, file_id, path FROM ar QUALIFY row_number() OVER (PARTITION BY archive ORDER BY path, file_id) <= 40")
def _(spark, sf):
    return files.inventory_samples(archive_files(spark, sf)).select("archive", "file_id", "path")


@query("a15_file_manifest", "files", """WITH e AS (SELECT path, min(size_bytes) AS size_bytes, sha256(path) AS h FROM files GROUP BY path),
r AS (SELECT *, (row_number() OVER (ORDER BY path)-1)//64 AS block FROM e),
b AS (SELECT block, count(*) AS c, sum(size_bytes) AS s, sha256(string_agg(h||'  '||size_bytes||'  '||path, chr(10) ORDER BY path)) AS d FROM r GROUP BY 1)
SELECT CAST(sum(c) AS BIGINT) AS file_count, CAST(sum(s) AS BIGINT) AS total_bytes, sha256(string_agg(d, chr(10) ORDER BY block)) AS aggregate_sha256 FROM b""")
def _(spark, sf):
    e = views.files(spark, sf).groupBy("path").agg(F.min("size_bytes").alias("size_bytes"), F.sha2(F.col("path"), 256).alias("sha256"))
    return files.manifest_digest(e.select("*", views.source_id("pages", "path")), files_per_digest=64).select("file_count", "total_bytes", "aggregate_sha256")


@query("a16_analysis_export", "cand", f"""WITH {DIMS_SQL}, p AS (SELECT candidate_id, count(DISTINCT path) AS n FROM cand GROUP BY 1)
SELECT candidate_id AS dataset_id, CAST(11 AS BIGINT) AS metrics, n AS points, CAST((SELECT count_if(available) FROM rg WHERE dataset_id=candidate_id) AS BIGINT) AS available FROM p""")
def _(spark, sf):
    from ..operators.metrics import power_delay_profile
    status = rules.metric_status(rules.capabilities(candidate_datasets(spark, sf))).withColumn("status", F.lit("PASS"))
    pdp = power_delay_profile(views.cand(spark, sf).withColumn(D, F.col("candidate_id")))
    points = pdp.select(D, F.lit("pdp").alias("metric"), F.lit("").alias("series"), F.col("delay_s").alias("x"), F.col("normalized_db").alias("y"))
    tasks = status.select(D).distinct().withColumn("task", F.lit("interpolation"))
    folder = bundles.write_json(bundles.analysis_export(status, points, tasks), bundles.scratch_folder(spark, "analysis"))
    back = spark.read.schema("dataset_id int, metric string, kind string, document string").json(folder)
    flag = F.get_json_object("document", "$.available") == "true"
    return back.groupBy(D).agg(F.count_if(F.col("kind") == "metric").alias("metrics"), F.count_if(F.col("kind") == "point").alias("points"),
                               F.count_if(flag).alias("available"))


@query("a17_prediction_export", "cir", "SELECT 'cir' AS part, count(*) AS n_rows FROM cir UNION ALL SELECT 'ctf', count(*) FROM (SELECT DISTINCT sample, tx, rx, t FROM cir WHERE path_valid) CROSS JOIN range(4) UNION ALL SELECT 'manifest', count(DISTINCT sample) FROM cir")
def _(spark, sf):
    from ..operators.metrics import centred_offsets, cir_to_ctf
    cir = views.cir(spark, sf)
    folder = bundles.scratch_folder(spark, "prediction")
    bundles.write_bundle(folder, {"cir": cir, "ctf": cir_to_ctf(cir, centred_offsets(4, 120e3))}, {"cir": [D]})
    manifest = cir.groupBy("sample").agg(F.count(F.lit(1)).alias("rows"), F.max("delay_s").alias("max_delay_s"))
    bundles.write_json(manifest, f"{folder}/manifest")
    t = bundles.read_bundle(spark, folder, ["cir", "ctf"])
    t["manifest"] = spark.read.schema("sample long, rows long, max_delay_s double").json(f"{folder}/manifest")
    out = None
    for name, df in t.items():
        n = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("part"), "n_rows")
        out = n if out is None else out.unionByName(n)
    return out


@query("a18_predictor_bundle", "pseq", f"""WITH {SPAN_SQL}, {SPLIT_SQL}, {NORM_SQL}
SELECT 'examples' AS part, count(*) AS n_rows, {s6('sum(list_sum(a[17:20]))','checksum')} FROM ex UNION ALL SELECT 'split', count(*), {s6('sum(partition_code)','c')} FROM split
UNION ALL SELECT 'norm', count(*), {s6('sum(mean)+sum(std)','c')} FROM norm""")
def _(spark, sf):
    folder = bundles.scratch_folder(spark, "predictor")
    bundles.write_bundle(folder, {"examples": pseq_examples(spark, sf), "split": example_split(spark, sf), "norm": fitted_norm(spark, sf)})
    t = bundles.read_bundle(spark, folder, ["examples", "split", "norm"])
    total = F.aggregate(F.col("targets.DS_mu"), F.lit(0.0), lambda a, x: a + x)
    checks = {"examples": F.sum(total), "split": F.sum("partition_code"), "norm": F.sum("mean") + F.sum("std")}
    out = None
    for name, check in checks.items():
        part = t[name].agg(F.count(F.lit(1)).alias("n_rows"), check.alias("c")).select(
            F.lit(name).alias("part"), "n_rows", r6(F.col("c").cast("double"), "checksum"))
        out = part if out is None else out.unionByName(part)
    return out


@query("a19_corpus_write", "pseq", f"""WITH {SPAN_SQL} SELECT t.task, b.bundle, count(*) AS examples FROM ex, (VALUES ('P1'),('P2')) b(bundle), (VALUES ('extrapolation'),('interpolation')) t(task) GROUP BY 1,2""")
def _(spark, sf):
    folder = bundles.scratch_folder(spark, "corpus")
    rows = None
    for task in ("extrapolation", "interpolation"):
        for bundle, names in (("P1", PARAMS[:1]), ("P2", PARAMS[:2])):
            cells = seqs.long_targets(seqs.examples(views.pseq(spark, sf), names, task), names)
            part = cells.withColumns({"task": F.lit(task), "bundle": F.lit(bundle)})
            rows = part if rows is None else rows.unionByName(part)
    bundles.write_table(rows, folder, ["task", "bundle"])
    back = spark.read.parquet(folder).filter("step = 0 AND param = 'DS_mu'")
    return back.groupBy("task", "bundle").agg(F.count(F.lit(1)).alias("examples"))


@query("a20_pair_csv", "pseq", f"""WITH {FC_SQL}, {SPLIT_SQL} SELECT group_id, start_idx, step, 'validation' AS split_part, {s6("max(truth) FILTER (param='DS_mu')",'truth_DS_mu')}, {s6("max(predicted) FILTER (param='KF_mu')",'predicted_KF_mu')}
FROM fc JOIN split USING (group_id) WHERE model='persistence' AND partition_code=2 GROUP BY 1,2,3""")
def _(spark, sf):
    from ..operators.evaluate import pair_table
    ex = pseq_examples(spark, sf).join(example_split(spark, sf).filter("partition_code = 2").select(D, "group_id"), [D, "group_id"], "left_semi")
    fc = fcst.forecast(ex, PARAMS, "extrapolation", ("persistence",))
    pairs = pair_table(fc.withColumnRenamed("truth", "value"), fc.withColumnRenamed("predicted", "value"), PARAMS, [])
    wide = pairs.select(F.lit("validation").alias("split_part"), "group_id", "start_idx", "step",
                        *[f"truth_{p}" for p in PARAMS], *[f"predicted_{p}" for p in PARAMS])
    folder = bundles.write_pairs_csv(wide, bundles.scratch_folder(spark, "pairs"))
    schema = "split_part string, group_id long, start_idx long, step int, " + ", ".join(
        f"{s}_{p} double" for s in ("truth", "predicted") for p in PARAMS)
    back = bundles.read_pairs_csv(spark, folder, schema, "validation")
    return back.select("group_id", "start_idx", "step", "split_part", r6("truth_DS_mu", "truth_DS_mu"),
                       r6("predicted_KF_mu", "predicted_KF_mu"))


@query("a21_dataset_summary", "cand", """SELECT candidate_id AS dataset_id, count(DISTINCT tx) AS n_tx, count(DISTINCT rx) AS n_rx, count(DISTINCT path) AS n_path, count(DISTINCT t) AS n_t, count(DISTINCT sample) AS n_sample,
 count(*) AS n_rows, CAST(count_if(path_valid) AS BIGINT) AS valid_rows, true AS has_angles FROM cand GROUP BY 1""")
def _(spark, sf):
    s = rules.dataset_summary(views.cand(spark, sf).withColumn(D, F.col("candidate_id")))
    return s.select(D, "n_tx", "n_rx", "n_path", "n_t", "n_sample", F.col("rows").alias("n_rows"), "valid_rows", "has_angles")


@query("a22_prediction_request", "pseq", f"""WITH {SPAN_SQL}, {SPLIT_SQL}
SELECT group_id, start_idx AS first_input_idx, start_idx+15 AS last_input_idx, start_idx+16 AS first_target_idx, {s6('list_sum(a[1:16])','ds_inputs')}, false AS contains_truth FROM ex JOIN split USING (group_id) WHERE partition_code=3""")
def _(spark, sf):
    ex = pseq_examples(spark, sf)
    test = ex.join(example_split(spark, sf, ex).filter("partition_code = 3").select(D, "group_id"), [D, "group_id"], "left_semi")
    req = tensors.prediction_request(test, PARAMS, "extrapolation", seqs.LAYOUT["extrapolation"])
    folder = bundles.write_json(req, bundles.scratch_folder(spark, "request"))
    back = spark.read.schema(
        "group_id long, input_index array<long>, target_index array<long>, contains_target_ground_truth boolean, "
        "input_parameters array<struct<DS_mu: double, KF_mu: double>>").json(folder)
    total = F.aggregate("input_parameters.DS_mu", F.lit(0.0), lambda a, x: a + x)
    return back.select("group_id", F.col("input_index")[0].alias("first_input_idx"), F.col("input_index")[15].alias("last_input_idx"),
                       F.col("target_index")[0].alias("first_target_idx"), r6(total, "ds_inputs"),
                       F.col("contains_target_ground_truth").alias("contains_truth"))


@query("a23_selected_example", "pseq", f"""WITH {FC_SQL}, f AS (SELECT group_id, max(start_idx) AS s FROM fc GROUP BY 1)
SELECT fc.group_id, step, param, fc.idx, {s6('predicted','predicted')}, {s6('(ts_us-epoch_us(TIMESTAMP \'2024-01-01\'))/CAST(3.6e9 AS DOUBLE)','axis_hours')} FROM fc JOIN f ON f.group_id=fc.group_id AND f.s=start_idx JOIN pseq p ON p.group_id=fc.group_id AND p.idx=fc.idx WHERE model='linear'""")
def _(spark, sf):
    batch = pseq_forecast(spark, sf, models=("linear",))
    last = batch.groupBy(D, "group_id").agg(F.max("start_idx").alias("last_start"))
    start_us = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    axis = views.pseq(spark, sf).select(D, "group_id", "idx", ((F.col("ts_us") - start_us) / F.lit(3.6e9)).alias("axis_value"))
    s = tensors.select_example(batch.join(last, [D, "group_id"]), F.col("start_idx") == F.col("last_start"), axis)
    return s.select("group_id", "step", "param", "idx", r6("predicted", "predicted"), r6("axis_value", "axis_hours"))


@query("a24_batch_export", "pseq", f"WITH {FC_SQL} SELECT group_id%8 AS batch, count(*) AS n_rows, {s6('avg(predicted)','mean_predicted')} FROM fc GROUP BY 1")
def _(spark, sf):
    folder = bundles.scratch_folder(spark, "batches")
    bundles.write_table(pseq_forecast(spark, sf).withColumn("batch", F.col("group_id") % 8), folder, ["batch"])
    return spark.read.parquet(folder).groupBy(F.col("batch").cast("long").alias("batch")).agg(
        F.count(F.lit(1)).alias("n_rows"), r6(F.avg("predicted"), "mean_predicted"))
