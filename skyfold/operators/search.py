"""Ranked search by exact name or prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.functions.names import fold
from skyfold.operators.rank import first_per_key


def search(stars: DataFrame, aliases: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(star_id, display_name, matched_alias, catalogue, is_exact, ra_deg, dec_deg): the best alias of each star, best stars first.

    An exact key goes before a prefix, then the priority, the shorter key and the display name decide. A query
    that folds to nothing finds nothing. The limit is that of the search, 1 to 50.
    """
    if not 1 <= limit <= 50:
        raise ValueError("limit must lie in 1..50")
    if not 1 <= len(query) <= 100:
        raise ValueError("query must have 1 to 100 characters")
    key = fold(query)
    met = aliases.where(F.col("alias_search_key").startswith(key) if key else F.lit(False)).withColumn("is_exact", F.col("alias_search_key") == key)
    length = F.char_length("alias_search_key")
    best = first_per_key(met.withColumn("_length", length), ["star_id"], [F.col("is_exact").desc(), F.col("priority"), F.col("_length"), F.col("alias")])
    hits = best.select("star_id", F.col("alias").alias("matched_alias"), "catalogue", "priority", "is_exact", "_length").join(stars.select("star_id", F.col("canonical_display_name").alias("display_name"), "ra_deg", "dec_deg"), "star_id")
    ranked = hits.orderBy(F.col("is_exact").desc(), "priority", "_length", "display_name", "star_id").limit(limit)
    return ranked.select("star_id", "display_name", "matched_alias", "catalogue", "is_exact", "ra_deg", "dec_deg")


def lookup(table: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one source, host or system by its id; the filter reaches the scan."""
    return table.where(F.col(key) == F.lit(value).cast(table.schema[key].dataType))
