"""Canonical tables read from the parquet tables, with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import keyed_positions, positions

AXIS = 32  # complex values per embedding


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def source_id(name: str, key: str):
    """Dataset key of a bound table; a column, so joins on it stay key joins."""
    return F.when(F.col(key).isNotNull(), name).alias("dataset_id")


def cir(spark: SparkSession, sf: str) -> DataFrame:
    """Path observations (V1)."""
    phase = 20 * F.pi() * F.col("l_discount")
    to_rad = F.pi() / F.lit(180.0)
    return table(spark, sf, "lineitem").select(
        source_id("lineitem", "l_suppkey"),
        F.col("l_suppkey").alias("sample"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("tx"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("rx"),
        F.col("l_linenumber").alias("path"),
        (F.month("l_shipdate") - 1).alias("t"),
        (F.sqrt("l_extendedprice") * F.cos(phase)).alias("re"),
        (F.sqrt("l_extendedprice") * F.sin(phase)).alias("im"),
        F.col("l_extendedprice").alias("power"),
        (F.col("l_quantity") * F.lit(1e-9)).alias("delay_s"),
        (F.col("l_tax") <= 0.06).alias("path_valid"),
        ((F.col("l_discount") * 1000 - 50) * to_rad).alias("aoa_rad"),
        ((F.col("l_tax") * 1000 - 40) * to_rad).alias("aod_rad"),
    )


def ctf_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """One complex vector of 32 values per embedding (V2)."""
    e = F.col("embedding")
    def part(offset: int):
        return F.transform(F.sequence(F.lit(0), F.lit(AXIS - 1)),
                           lambda k: e[2 * k + offset].cast("double"))
    return table(spark, sf, "embeddings").select(
        source_id("embeddings", "vec_id"), F.col("vec_id").alias("obs"),
        F.col("label").alias("sample"), part(0).alias("re"), part(1).alias("im"))


def ctf(spark: SparkSession, sf: str) -> DataFrame:
    """Long form of V2."""
    cells = F.posexplode(F.arrays_zip("re", "im")).alias("k", "v")
    return ctf_vectors(spark, sf).select("dataset_id", "obs", "sample", cells).select(
        "dataset_id", "obs", "sample", "k", F.col("v.re").alias("re"), F.col("v.im").alias("im"))


def antenna_vectors(spark: SparkSession, sf: str, elements: int = 4) -> DataFrame:
    """V2 with k = f*elements + rx: one vector over rx per (obs, f)."""
    grid = ctf_vectors(spark, sf).withColumn(
        "f", F.explode(F.sequence(F.lit(0), F.lit(AXIS // elements - 1))))
    cut = lambda c: F.slice(F.col(c), F.col("f") * elements + 1, elements)
    return grid.select("dataset_id", "obs", "sample", "f", cut("re").alias("re"), cut("im").alias("im"))


def pseq(spark: SparkSession, sf: str) -> DataFrame:
    """Parameter sequence (V3); idx is the dense position in the group."""
    events = table(spark, sf, "events").select(
        source_id("events", "user_id"),
        F.col("user_id").alias("group_id"), "ts", "event_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    ranked = positions(events, ["dataset_id", "group_id"], ["ts", "event_id"], "ts_us", "idx",
                       tie_key="event_id")
    return ranked.select(
        "dataset_id", "group_id", "idx", F.col("idx").alias("pos"), "ts_us", "event_id", "event_type",
        (F.lit(-9.0) + F.col("value") / 125).alias("DS_mu"),
        (F.col("k") / 5.0 - 5.0).alias("KF_mu"),
        F.when(F.col("value") < 2, "FAIL").when(F.col("event_type") == "error", "WARNING")
        .otherwise("PASS").alias("quality_status"),
        F.when(F.col("event_type").isin("click", "view"), "generator_truth")
        .when(F.col("event_type") == "purchase", "grid_fitted")
        .otherwise("sa_fitted").alias("label_source"))


def pseq8(spark: SparkSession, sf: str) -> DataFrame:
    """V3 with all eight parameters; two of them are missing now and then."""
    e = F.col("event_id")
    return pseq(spark, sf).withColumns({
        "DS_sigma": F.lit(0.1) + F.pmod(e, F.lit(17)) / 50, "KF_sigma": F.lit(1.0) + F.pmod(e, F.lit(13)) / 4,
        "r_DS": F.lit(1.5) + (F.col("DS_mu") + 9) / 8, "LNS_ksi": F.when(F.pmod(e, F.lit(89)) != 0, F.lit(2.0) + (F.col("KF_mu") + 5) / 10),
        "num_clusters": (F.lit(5) + F.pmod(e, F.lit(11))).cast("double"),
        "num_rays": F.when(F.pmod(e, F.lit(97)) != 0, (F.lit(10) + F.pmod(e, F.lit(7))).cast("double"))})


def dpsd(spark: SparkSession, sf: str) -> DataFrame:
    """Power profile in dBm (V4)."""
    return table(spark, sf, "embeddings").select(
        source_id("embeddings", "vec_id"), F.col("vec_id").alias("snapshot"),
        F.posexplode("embedding").alias("bin", "e")).select(
        "dataset_id", "snapshot", "bin", (F.lit(-65.0) + 10.0 * F.col("e").cast("double")).alias("dbm"))


def dpsd_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """V4 with the dense 1-based snapshot position; the bins unfold after the ranking."""
    rows = table(spark, sf, "embeddings").select(
        source_id("embeddings", "vec_id"), F.col("vec_id").alias("snapshot"), "embedding")
    ranked = keyed_positions(rows, ["dataset_id"], "snapshot")
    return ranked.select("dataset_id", "snapshot", "pos", F.posexplode("embedding").alias("bin", "e")).select(
        "dataset_id", "snapshot", "pos", "bin", (F.lit(-65.0) + 10.0 * F.col("e").cast("double")).alias("dbm"))


def cand(spark: SparkSession, sf: str) -> DataFrame:
    """V1 with the candidate that made each sample (V5)."""
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("sample"), F.col("s_nationkey").alias("candidate_id"))
    return cir(spark, sf).join(suppliers, "sample")


def files(spark: SparkSession, sf: str) -> DataFrame:
    """File paths with extension and name tokens (V7)."""
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    base = table(spark, sf, "pages").select(
        F.col("page_id").alias("file_id"),
        F.regexp_replace("url", r"[?#].*$", "").alias("path"), F.length("html").cast("long").alias("size_bytes"))
    ext = F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))
    return base.select("file_id", "path", "size_bytes",
                       F.when(ext == "", "(none)").otherwise(ext).alias("extension"),
                       F.split(F.lower(F.col("path")), "[/._-]").alias("tokens"))


PARAMS = ["DS_mu", "KF_mu"]

SQL = {
    "cir": """cir AS (SELECT 'lineitem' AS dataset_id, l_suppkey AS sample,
  CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS tx,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS rx,
  l_linenumber AS path, CAST(month(l_shipdate) - 1 AS INTEGER) AS t,
  sqrt(l_extendedprice) * cos(20 * pi() * l_discount) AS re,
  sqrt(l_extendedprice) * sin(20 * pi() * l_discount) AS im,
  l_extendedprice AS power, l_quantity * CAST(1e-9 AS DOUBLE) AS delay_s, l_tax <= CAST(0.06 AS DOUBLE) AS path_valid,
  (l_discount * 1000 - 50) * (pi() / 180) AS aoa_rad,
  (l_tax * 1000 - 40) * (pi() / 180) AS aod_rad FROM lineitem)""",
    "ctf": """ctf AS (SELECT vec_id AS obs, label AS sample, CAST(k AS INTEGER) AS k,
  CAST(embedding[2*k+1] AS DOUBLE) AS re, CAST(embedding[2*k+2] AS DOUBLE) AS im
  FROM embeddings, range(32) r(k))""",
    "pseq": """pseq AS (SELECT user_id AS group_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, epoch_us(ts) AS ts_us, event_id, event_type,
  CAST(-9 AS DOUBLE) + value / 125 AS DS_mu,
  CAST(json_extract_string(props, '$.k') AS INTEGER) / CAST(5 AS DOUBLE) - 5 AS KF_mu,
  CASE WHEN value < 2 THEN 'FAIL' WHEN event_type = 'error' THEN 'WARNING' ELSE 'PASS' END AS quality_status,
  CASE WHEN event_type IN ('click','view') THEN 'generator_truth' WHEN event_type = 'purchase' THEN 'grid_fitted'
       ELSE 'sa_fitted' END AS label_source FROM events)""",
    "pseq8": """pseq8 AS (SELECT *, CASE WHEN quality_status='FAIL' THEN 0 WHEN LNS_ksi IS NULL THEN 5 WHEN num_rays IS NULL THEN 7 ELSE 8 END AS level,
  [DS_mu, KF_mu, DS_sigma, KF_sigma, r_DS, LNS_ksi, num_clusters, num_rays] AS vals FROM (SELECT *, CAST(0.1 AS DOUBLE) + (event_id%17)/CAST(50 AS DOUBLE) AS DS_sigma,
  CAST(1 AS DOUBLE) + (event_id%13)/CAST(4 AS DOUBLE) AS KF_sigma, CAST(1.5 AS DOUBLE) + (DS_mu+9)/8 AS r_DS,
  CASE WHEN event_id%89<>0 THEN CAST(2 AS DOUBLE) + (KF_mu+5)/10 END AS LNS_ksi, CAST(5+event_id%11 AS DOUBLE) AS num_clusters,
  CASE WHEN event_id%97<>0 THEN CAST(10+event_id%7 AS DOUBLE) END AS num_rays FROM pseq))""",
    "dpsd": """dpsd AS (SELECT vec_id AS snapshot, CAST(b AS INTEGER) AS bin,
  CAST(-65 AS DOUBLE) + 10 * CAST(embedding[b+1] AS DOUBLE) AS dbm FROM embeddings, range(64) r(b))""",
    "cand": """cand AS (SELECT cir.*, s_nationkey AS candidate_id FROM cir JOIN supplier ON s_suppkey = sample)""",
    "files": """files0 AS (SELECT page_id AS file_id, regexp_replace(url, '[?#].*$', '') AS path,
  CAST(length(html) AS BIGINT) AS size_bytes FROM pages),
files AS (SELECT file_id, path, size_bytes,
  coalesce(nullif(lower(regexp_extract(string_split(path, '/')[-1], '(\\.[A-Za-z0-9]+)$', 1)), ''), '(none)') AS extension,
  regexp_split_to_array(lower(path), '[/._-]') AS tokens FROM files0)""",
}
NEEDS = {"cand": ["cir"], "pseq8": ["pseq"]}


def with_views(views: str, body: str) -> str:
    """A query body (starting at its own CTEs or SELECT) over named views."""
    names: list[str] = []
    for v in views.split():
        for n in [*NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    body = body.strip()
    head = ",\n".join(SQL[n] for n in names)
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
