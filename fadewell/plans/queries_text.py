"""Text, JSON and name rules on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from . import views
from .registry import query


@query("e01_natural_key", "files", r"""WITH p AS (SELECT file_id, path, regexp_split_to_array(lower(path), '\d+') AS parts, regexp_extract_all(lower(path), '(\d+)', 1) AS nums FROM files)
SELECT file_id, array_to_string(list_transform(parts, lambda x, i: x || coalesce(CASE WHEN length(nums[i])>=12 THEN nums[i] ELSE lpad(regexp_replace(nums[i], '^0+([0-9])', '\1'), 12, '0') END, '')), '') AS natural_key FROM p""")
def _(spark, sf):
    return views.files(spark, sf).select("file_id", text.natural_key("path").alias("natural_key"))


def rule_sql(rules, column: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains({column}, '{w}')" for w in words) + f" THEN '{label}'"
                     for label, words in reversed(rules))
    return f"CASE {whens} END"


SCENE_SQL = f"""SELECT doc_id, {rule_sql(text.BAND_RULES, 'lower(text)')} AS band, {rule_sql(text.SCENARIO_RULES, 'lower(text)')} AS scenario, source FROM documents"""


@query("e02_scenario_detection", "", f"WITH s AS ({SCENE_SQL}) SELECT doc_id, band, scenario FROM s")
def _(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", text.band("text").alias("band"), text.scenario("text").alias("scenario"))


@query("e03_scenario_fallback", "", f"""WITH s AS ({SCENE_SQL}), b AS (SELECT doc_id, scenario, coalesce(band, CASE WHEN source LIKE '%1%' THEN 'Sub-6' WHEN source LIKE '%2%' THEN 'mmWave' WHEN source LIKE '%3%' THEN 'THz' ELSE 'Optical Wireless' END) AS band FROM s)
SELECT doc_id, band, coalesce(scenario, CASE band WHEN 'Sub-6' THEN 'Scenario 1' WHEN 'mmWave' THEN 'Scenario 2' WHEN 'THz' THEN 'Scenario 3' ELSE 'Scenario 4' END) AS scenario FROM b""")
def _(spark, sf):
    current = F.when(F.col("source").contains("1"), "Sub-6 GHz").when(F.col("source").contains("2"), "mmWave 28").when(
        F.col("source").contains("3"), "THz 140").otherwise("light")
    docs = views.table(spark, sf, "documents").withColumn(
        "band", F.coalesce(text.band("text"), text.default_band(current)))
    return docs.select("doc_id", "band", F.coalesce(text.scenario("text"), text.default_scenario(F.col("band"))).alias("scenario"))


@query("e04_name_tokens", "", """WITH n AS (SELECT doc_id, CASE doc_id%3 WHEN 0 THEN 'Pol_'||lang||'_SAGE_'||source||'_t'||(doc_id%7)||'_w'||n_chars WHEN 1 THEN 'pol_'||lang||'_sage_'||source ELSE lang||'_'||source END AS stem FROM documents),
t AS (SELECT *, string_split(stem, '_') AS k, coalesce(list_position(list_transform(string_split(stem, '_'), lambda x: lower(x)), 'sage'), 0) AS p FROM n)
SELECT doc_id, CASE WHEN len(k)>=2 AND lower(k[1]) LIKE 'pol%' THEN k[1]||'_'||k[2] ELSE 'unspecified' END AS polarization,
 coalesce(CASE WHEN p>0 THEN k[p+1] END, 'unspecified') AS frequency_id, coalesce(CASE WHEN p>0 THEN k[p+2] END, 'unspecified') AS trajectory, coalesce(CASE WHEN p>0 THEN k[p+3] END, 'unspecified') AS time_window FROM t""")
def _(spark, sf):
    d = views.table(spark, sf, "documents")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.col(p[1:]).cast("string")
                                  if isinstance(p, str) else p.cast("string") for p in parts])
    stem = F.when(F.col("doc_id") % 3 == 0, c("Pol_", "$lang", "_SAGE_", "$source", "_t", F.col("doc_id") % 7, "_w", "$n_chars")).when(
        F.col("doc_id") % 3 == 1, c("pol_", "$lang", "_sage_", "$source")).otherwise(c("$lang", "_", "$source"))
    named = d.select("doc_id", stem.alias("stem"))
    return named.select("doc_id", *[v.alias(k) for k, v in text.name_tokens("stem").items()])


@query("e05_channel_hints", "", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN contains(lower(text), '{p}') THEN '{h}' END" for h, p in text.CHANNEL_HINTS.items()) + "], lambda x: x IS NOT NULL), '|') AS hints FROM documents")
def _(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", F.array_join(text.channel_hints("text"), "|").alias("hints"))


@query("e05_variable_tags", "files", "SELECT file_id, array_to_string(list_filter([" + ", ".join(
    "CASE WHEN " + " OR ".join([f"contains(lower(path), '{w}')" for w in words] + (["lower(path)='h'"] if t.startswith("CTF") else [])) + f" THEN '{t}' END"
    for t, words in text.VARIABLE_TAGS.items()) + "], lambda x: x IS NOT NULL), '|') AS tags FROM files")
def _(spark, sf):
    return views.files(spark, sf).select("file_id", F.array_join(text.variable_tags("path"), "|").alias("tags"))


@query("e06_metadata_parse", "", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') AS missing FROM events""")
def _(spark, sf):
    parsed = F.from_json("props", "k int, missing string")
    return views.table(spark, sf, "events").select("event_id", parsed.alias("m")).select("event_id", "m.k", "m.missing")


@query("e07_row_fingerprint", "pseq", """SELECT event_id, sha256('{"group_id":'||group_id||',"idx":'||idx||',"event_type":"'||event_type||'"}') AS fingerprint FROM pseq""")
def _(spark, sf):
    return views.pseq(spark, sf).select("event_id", text.fingerprint(["group_id", "idx", "event_type"]).alias("fingerprint"))


@query("e08_candidate_key", "cand", """SELECT 'nation='||candidate_id||'|path='||path AS candidate_key, count(*) AS n_rows FROM cand GROUP BY 1""")
def _(spark, sf):
    keyed = views.cand(spark, sf).withColumnRenamed("candidate_id", "nation")
    return keyed.select(text.candidate_key(["nation", "path"]).alias("candidate_key")).groupBy("candidate_key").agg(
        F.count(F.lit(1)).alias("n_rows"))


@query("e09_stable_messages", "files", """WITH l AS (SELECT file_id, list_filter(tokens, lambda x: trim(x)<>'') AS m FROM files)
SELECT file_id, array_to_string(list_filter(m, lambda x, i: list_position(m, x)=i), '|') AS messages FROM l""")
def _(spark, sf):
    return views.files(spark, sf).select("file_id", F.array_join(text.stable_messages("tokens"), "|").alias("messages"))
