"""The pN_ queries of this subpackage, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.llm.encoding import with_ids, with_token_count
from skyfold.llm.linkage import link
from skyfold.llm.packing import pack
from skyfold.llm.resolution import HOST_FIELDS, claims, facts, host_key, judged_survivors, survivors, truths
from skyfold.llm.truncation import truncated, truncation_report
from skyfold.plans.problems import table
from skyfold.session import spread

CAPACITY = 2048


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports, trust = table(spark, sf_dir, "exoplanets"), table(spark, sf_dir, "catalogue_trust")
    best = survivors(reports, host_key(), HOST_FIELDS, source="source", trust=trust, updated="updated_at", row_id="row_id")
    return best.select(F.col("record_key").alias("host_id"), "field_name", "row_id")


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = truths(table(spark, sf_dir, "exoplanets"), host_key(), HOST_FIELDS, "source")
    return judged.select(F.col("record_key").alias("host_id"), "field_name", "value", F.size("sources").alias("sources"), "probability", (F.col("probability") >= 0.5).alias("retained"))


def p4_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports, trust = table(spark, sf_dir, "exoplanets"), table(spark, sf_dir, "catalogue_trust")
    return judged_survivors(reports, host_key(), HOST_FIELDS, source="source", trust=trust, updated="updated_at", row_id="row_id").withColumnRenamed("record_key", "host_id")


def p4_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who claims and who denies each value: the table the model learns from."""
    found = facts(claims(table(spark, sf_dir, "exoplanets"), host_key(), HOST_FIELDS, "source"))
    return found.select(F.col("record_key").alias("host_id"), "field_name", "value", F.array_join("claimed", ",").alias("claimed"), F.array_join("denied", ",").alias("denied"))


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "pscomppars"), table(spark, sf_dir, "wgsn_faints"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pairs(spark, sf_dir).select("host_key", "wgsn_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ids(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text").select("doc_id", "ids")


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(with_token_count(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text"), "doc_id", "n_tokens", CAPACITY)


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_packed(spark, sf_dir).groupBy("container_id").agg(F.count("*").alias("pieces"), F.sum("n_units").alias("used"), (CAPACITY - F.sum("n_units")).alias("unused"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(table(spark, sf_dir, "documents")).where("is_truncated").select("doc_id").distinct()


def p10_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_report(truncated(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (p4_found, p4_values, p4_judged, p4_claims, p5_pairs, p5_found, p8_ids, p9_packed, p9_containers, p10_found, p10_report)}
_HOST = r"nullif(nullif(lower(regexp_replace(host_id, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')), ''), '-')"
_P4 = f"""
with r as (select {_HOST} h, row_id, updated_at, coalesce(trust_rank, 2147483647) k, stellar_temperature_k t, stellar_mass_solar m, stellar_radius_solar r, stellar_luminosity_log_solar l
  from exoplanets e left join catalogue_trust c on c.source_code = lower(trim(e.source))),
d as (select h from r where h is not null group by h having count(*) >= 2),
v as (
  select h, row_id, updated_at, k, 'stellar_temperature_k' f from r where t between 2000 and 60000 and not isnan(t)
  union all select h, row_id, updated_at, k, 'stellar_mass_solar' from r where m between 0.01 and 150 and not isnan(m)
  union all select h, row_id, updated_at, k, 'stellar_radius_solar' from r where r.r between 0.01 and 2000 and not isnan(r.r)
  union all select h, row_id, updated_at, k, 'stellar_luminosity_log_solar' from r where l between -6 and 7 and not isnan(l)),
o as (select *, row_number() over (partition by h, f order by k, updated_at desc nulls last, row_id) n from v semi join d using (h))
select h host_id, f field_name, row_id from o where n = 1
"""
_P4_CLAIMS = f"""
with r as (select {_HOST} host_id, coalesce(nullif(lower(trim(source)), ''), '?') s, stellar_temperature_k t, stellar_mass_solar m, stellar_radius_solar r, stellar_luminosity_log_solar l from exoplanets),
v as (
  select host_id, s, 'stellar_temperature_k' field_name, t as value from r where t between 2000 and 60000 and not isnan(t)
  union all select host_id, s, 'stellar_mass_solar', m from r where m between 0.01 and 150 and not isnan(m)
  union all select host_id, s, 'stellar_radius_solar', r.r from r where r.r between 0.01 and 2000 and not isnan(r.r)
  union all select host_id, s, 'stellar_luminosity_log_solar', l + 0.0 from r where l between -6 and 7 and not isnan(l)),
c as (select host_id, field_name, value, list_sort(list(distinct s)) claimed from v where host_id is not null group by all),
k as (select host_id, field_name, list(distinct s) speakers from v where host_id is not null group by all)
select host_id, field_name, value, array_to_string(claimed, ',') claimed, array_to_string(list_sort(list_filter(speakers, lambda x: not list_contains(claimed, x))), ',') denied from c join k using (host_id, field_name)
"""
SQL = {"p4_found": _P4, "p4_claims": _P4_CLAIMS}
