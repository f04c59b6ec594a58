"""Canonical stars, their aliases, and the links of planet hosts to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.functions.names import designation_aliases, parse_designation, search_key
from skyfold.operators.rank import first_per_key, numbered_batches

# Which kind of name is shown first.
PRIORITY = {"iau_proper_name": 1, "nasa_host_name": 2, "simbad_main": 3, "hd": 4, "hip": 5, "other_catalogue": 6, "gaia_dr3": 7}


def build_stars(names: DataFrame, faint: DataFrame) -> DataFrame:
    """One row per valid named star, enriched by the faint stars of the same name key."""
    stars = names.where("is_valid").withColumn("name_key", search_key("proper_name"))
    stars = stars.select(F.concat(F.lit("iau:"), F.col("name_key")).alias("star_id"), "name_key", F.col("proper_name").alias("canonical_display_name"), F.lit("star").alias("object_type"), "designation", "hip", "bayer_raw", "simbad_spelling", "constellation")
    more = faint.select(search_key("name").alias("name_key"), "ra_deg", "dec_deg", "vmag", "spectral_type", "hd", "hr", "other_id", "distance_ly", "bv_color", F.col("hip").alias("_hip"))
    both = stars.join(more, "name_key", "left").withColumn("hip", F.coalesce("hip", "_hip")).drop("_hip")
    return both.withColumns({"gaia_dr3_source_id": F.lit(None).cast("bigint"), "distance_value": F.lit(None).cast("double"), "distance_method": F.lit("unavailable")})


def build_aliases(stars: DataFrame) -> DataFrame:
    """Every searchable name of every star: one scan, exploded; of equal keys the first by priority, rank and text.

    Designations count in their Greek, abbreviated and spelled-out form and as written. Empty keys are left out.
    """

    def named(alias, catalogue, kind: str, source: str, official: bool = False):
        return F.struct(alias.alias("alias"), catalogue.alias("catalogue"), F.lit(kind).alias("alias_type"), F.lit(PRIORITY[kind]).alias("priority"), F.lit(official).alias("is_official"), F.lit(source).alias("source"))

    star = stars.withColumns({"_forms": designation_aliases("bayer_raw"), "_kind": parse_designation("bayer_raw")["kind"]})
    single = F.array(
        named(F.col("canonical_display_name"), F.lit("IAU"), "iau_proper_name", "iau_csn", True),
        named(F.col("simbad_spelling"), F.lit("SIMBAD"), "simbad_main", "iau_csn"),
        named(F.col("designation"), F.lit("HR"), "other_catalogue", "iau_csn"),
        named(F.concat(F.lit("HIP "), F.col("hip")), F.lit("HIP"), "hip", "iau_csn"),
        named(F.concat(F.lit("HD "), F.col("hd")), F.lit("HD"), "hd", "wgsn_faints"),
        named(F.col("other_id"), F.lit("other"), "other_catalogue", "wgsn_faints"),
        named(F.col("bayer_raw"), F.when(F.col("_kind") == "bayer", "Bayer").otherwise(F.col("_kind")), "other_catalogue", "iau_csn"),
    )
    forms = F.transform("_forms", lambda f: named(f, F.lit("Bayer"), "other_catalogue", "iau_csn"))
    rows = star.select("star_id", F.explode(F.concat(single, forms)).alias("x")).select("star_id", "x.*").where("alias is not null and alias != ''")
    keyed = rows.withColumn("alias_search_key", search_key("alias")).where("alias_search_key != ''")
    order = [F.col("priority"), F.col("is_official").desc(), F.col("catalogue"), F.col("alias")]
    return first_per_key(keyed, ["star_id", "alias_search_key"], order).orderBy("star_id", "priority")


def link_hosts(stars: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs whose host is a canonical star, pairs whose host is not)."""
    keyed = pairs.withColumn("host_key", search_key("host_name"))
    keys = stars.select("star_id", F.col("name_key").alias("host_key"))
    unmatched = keyed.join(keys, "host_key", "left_anti").withColumn("review_reason", F.lit("host name not found in canonical stars"))
    return keyed.join(keys, "host_key"), unmatched


def build_name_table(stars: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name_index, entity_type, entity_id, display_name, name_source, aliases, label_priority), an entity a row, numbered from 0 by its id.

    The name source and priority are those of the entity's first alias; the other names come in their order of priority.
    """
    best = F.struct(F.col("priority"), F.col("catalogue"), F.col("alias"))
    grouped = aliases.groupBy("star_id").agg(F.array_sort(F.collect_set(best)).alias("names"))
    joined = stars.select("star_id", "object_type", "canonical_display_name").join(grouped, "star_id", "left")
    numbered = numbered_batches(joined, "star_id", 1).select("star_id", (F.col("batch_number") - 1).alias("name_index"))
    return joined.join(numbered, "star_id").select(
        "name_index", F.col("object_type").alias("entity_type"), F.col("star_id").alias("entity_id"), F.col("canonical_display_name").alias("display_name"), F.get("names", F.lit(0))["catalogue"].alias("name_source"),
        F.coalesce(F.transform("names", lambda n: n["alias"]), F.array().cast("array<string>")).alias("aliases"), F.get("names", F.lit(0))["priority"].alias("label_priority"),
    )
