"""The pN_ queries of the core operators over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.functions.names import search_key
from skyfold.functions.text import plain_decimal, strip
from skyfold.operators.nearby import pairs_within
from skyfold.operators.orphans import Reference, Target, orphan_references
from skyfold.operators.profile import Usable, chunk_statistics, column_profile, load_findings, pattern_profile, profile_loads
from skyfold.operators.rejects import CheckedId, CheckedNumber, loaded_lines, rejected_lines
from skyfold.operators.snapshot_diff import snapshot_changes
from skyfold.sources.schemas import PSCOMPPARS

USABLE = [Usable("parallax", -50, 800), Usable("ruwe", 0, 100, above=True), Usable("distance_gspphot", 0, 50000, above=True)]
LINE_CHECKS = [CheckedNumber("ra", 0, 360, "bad_ra"), CheckedId("gaia_dr3_id", "Gaia DR3 ", "bad_gaia_dr3_id")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def planet_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    designation = strip("gaia_dr3_id")
    plain = ["sy_pnum", "sy_snum", "st_teff", "st_mass", "st_rad", "st_lum", "pl_rade", "pl_bmasse", "pl_orbper", "disc_year"]
    # + 0.0 turns -0.0 into 0.0
    compared = {"gaia_dr3_id": F.when(designation != "", designation)} | {c: F.col(c) + (0.0 if c[:2] in ("st", "pl") else 0) for c in plain}
    return snapshot_changes(table(spark, sf_dir, "pscomppars"), search_key("pl_name"), "snapshot_no", "delivered_at", compared)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planet_changes(spark, sf_dir).select(F.col("record_key").alias("planet_key"), F.col("snapshot_no").cast("int"), "change_kind")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = table(spark, sf_dir, "wgsn_faints").select("wgsn_id", plain_decimal("ra2000").alias("ra_deg"), plain_decimal("de2000").alias("dec_deg"))
    return pairs_within(stars, table(spark, sf_dir, "gaia"), 5 / 3600, left_id="wgsn_id", right_id="gaia_source_id").select("wgsn_id", "gaia_source_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    planets, hosts, gaia = (table(spark, sf_dir, t) for t in ("exoplanets", "exoplanet_hosts", "gaia"))
    targets = [Target("hosts", hosts, "host_id", "loaded_at", "deleted_at", as_text=True), Target("gaia", gaia, "gaia_source_id", "loaded_at")]
    references = [
        Reference("exoplanets.host_id", planets, "host_id", "row_id", "loaded_at", "hosts"),
        Reference("exoplanets.gaia_source_id", planets, "gaia_source_id", "row_id", "loaded_at", "gaia"),
        Reference("exoplanet_hosts.gaia_source_id", hosts, "gaia_source_id", "host_row_id", "loaded_at", "gaia"),
    ]
    return orphan_references(references, targets)


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_found(spark, sf_dir).groupBy("ref_column", "load_month", "reason").agg(F.count("*").alias("orphans"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_lines(table(spark, sf_dir, "pscomppars_raw"), PSCOMPPARS.names, LINE_CHECKS).select("raw_id", "reason")


def p6_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded_lines(table(spark, sf_dir, "pscomppars_raw"), PSCOMPPARS, LINE_CHECKS)


def p7_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_loads(table(spark, sf_dir, "gaia"), USABLE, different=True).withColumn("median", F.round("median", 9))


def p7_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_profile(table(spark, sf_dir, "gaia"), [u.column for u in USABLE]).drop("chunks", "read_chunks")


def p7_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_profile(table(spark, sf_dir, "gaia"), {"designation": "Gaia DR3 [0-9]+", "phot_variable_flag": "VARIABLE|CONSTANT|NOT_AVAILABLE"})


def p7_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_statistics(table(spark, sf_dir, "gaia"), [u.column for u in USABLE])
    return chunks.select(F.regexp_extract("path", r"([^/]+)\z", 1).alias("file"), "row_group", "column_name", "rows", "nulls", "low", "high", "candidates", F.size("loads").alias("loads"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_findings(profile_loads(table(spark, sf_dir, "gaia"), USABLE))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_report, p6_found, p6_loaded, p7_profile, p7_columns, p7_patterns, p7_found, p7_chunks)}
