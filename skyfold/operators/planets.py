"""Planets, hosts and systems from staged planet rows, with the tables for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.functions.names import search_key
from skyfold.operators.rank import non_null_count

STELLAR = ["stellar_temperature_k", "stellar_mass_solar", "stellar_radius_solar", "stellar_luminosity_log_solar"]


# The sentences given to rows for review.
CONFLICT_REASON = "stellar properties differ between planet rows"
COUNT_REASON = "archive system planet count differs from rows grouped by exact host name"

_HOST_VALUES = ["hd_name", "hip_name", "tic_id", "gaia_dr3_designation", "gaia_source_id", "ra_deg", "dec_deg", "system_distance_pc", "star_count", "planet_count", "is_circumbinary", *STELLAR]


def entity_id(kind: str, name: str) -> Column:
    return F.concat(F.lit(f"nea:{kind}:"), search_key(name))


def invalid_rows(staged: DataFrame, reason: str) -> DataFrame:
    """Rows flagged invalid, kept with a reason."""
    return staged.where(~F.col("is_valid")).withColumn("review_reason", F.lit(reason))


def build_planets(staged: DataFrame) -> DataFrame:
    """One record per valid row."""
    keyed = staged.where("is_valid").withColumns({"planet_id": entity_id("planet", "planet_name"), "_host": search_key("host_name")})
    return keyed.select(
        "planet_id", F.concat(F.lit("nea:system:"), "_host").alias("system_id"), F.concat(F.lit("nea:host:"), "_host").alias("host_id"), "planet_name", "planet_letter", "radius_earth", "mass_earth", "mass_provenance",
        "density_g_cm3", "equilibrium_temperature_k", "insolation_earth", "orbital_period_days",
        "semi_major_axis_au", "eccentricity", "inclination_deg", "discovery_method", "discovery_year", "discovery_facility", "is_controversial", "source",
    ).orderBy("planet_name")


def _candidates(staged: DataFrame) -> DataFrame:
    """Valid rows with their host, its chosen row's name, and how many stellar values of the host's spelling differ.

    The chosen row is the most complete one, the first by planet name among equals; the other values of the host
    settle what is left, so that repeated rows give the same record every time. Hosts whose keys collide are one
    host, whose spellings are counted apart.
    """
    rows = staged.where("is_valid").withColumns({"host_id": entity_id("host", "host_name"), "stellar_fields_available": non_null_count(STELLAR)})
    ranked = Window.partitionBy("host_id").orderBy(F.col("host_name"), F.col("stellar_fields_available").desc(), F.col("planet_name"), *[F.col(c) for c in _HOST_VALUES])
    rows = rows.withColumns({"_n": F.row_number().over(ranked), "selected_source_planet_name": F.first("planet_name").over(ranked)})
    counts = rows.groupBy("host_id", "host_name").agg(*[F.count_distinct(c).alias(f"{c}_value_count") for c in STELLAR])
    counts = counts.withColumn("stellar_values_conflict", F.greatest(*[F.col(f"{c}_value_count") for c in STELLAR]) > 1)
    return rows.join(counts, ["host_id", "host_name"])


def build_hosts(staged: DataFrame) -> DataFrame:
    """One record per host: its most complete row, flagged if its rows disagree."""
    chosen = _candidates(staged).where("_n = 1")
    return chosen.select(
        "host_id", "host_name", *_HOST_VALUES, "stellar_fields_available", F.col("planet_name").alias("stellar_source_planet_name"), F.lit("most_complete_then_planet_name").alias("stellar_selection_method"), "stellar_values_conflict", "source",
    ).orderBy("host_name")


def host_conflicts(staged: DataFrame) -> DataFrame:
    """Every candidate row of each host whose stellar values disagree."""
    rows = _candidates(staged).where("stellar_values_conflict")
    return rows.select(
        "host_id", "host_name", F.col("planet_name").alias("source_planet_name"), "selected_source_planet_name", (F.col("planet_name") == F.col("selected_source_planet_name")).alias("is_selected"),
        "stellar_fields_available", *STELLAR, *[f"{c}_value_count" for c in STELLAR], F.lit(CONFLICT_REASON).alias("review_reason"), "source",
    ).orderBy("host_name", "source_planet_name")


def build_systems(hosts: DataFrame, planets: DataFrame) -> DataFrame:
    """One system per host, with the planets counted anew beside the archive's count."""
    counted = planets.groupBy("host_id").agg(F.count("*").cast("short").alias("planet_count"))
    base = hosts.select("host_id", "host_name", "system_distance_pc", "star_count", F.col("planet_count").alias("archive_planet_count"), "is_circumbinary", "source")
    joined = base.join(counted, "host_id", "left").withColumns({"system_id": entity_id("system", "host_name"), "planet_count": F.coalesce("planet_count", F.lit(0)).cast("short")})
    return joined.select(
        "system_id", "host_id", "host_name", "star_count", "planet_count", "archive_planet_count", (F.col("planet_count") == F.col("archive_planet_count")).alias("planet_count_matches_archive"),
        "system_distance_pc", "is_circumbinary", F.lit("exact_host_name").alias("system_grouping_method"), "source",
    ).orderBy("host_name")


def count_mismatches(systems: DataFrame) -> DataFrame:
    """Systems whose counts differ, with the difference."""
    return systems.where(~F.col("planet_count_matches_archive")).select(
        "system_id", "host_id", "host_name", "star_count", "planet_count", "archive_planet_count", (F.col("planet_count") - F.col("archive_planet_count")).cast("short").alias("planet_count_difference"),
        "is_circumbinary", "system_grouping_method", F.lit(COUNT_REASON).alias("review_reason"), "source",
    ).orderBy("host_name")
