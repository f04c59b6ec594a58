"""Host sources with positions, retrieval batches, published host records and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.operators.quality import validated_join
from skyfold.operators.spatial import with_distance, with_galactocentric, with_heliocentric

# The published columns and the words they may hold.
SPATIAL = ["distance_pc", "distance_method", "distance_quality", *[f"heliocentric_{c}_pc" for c in "xyz"], *[f"galactocentric_{c}_kpc" for c in "xyz"]]
SOURCE_COLUMNS = [
    "gaia_source_id", "gaia_dr3_designation", "reference_epoch", "ra_deg", "dec_deg", "galactic_longitude_deg", "galactic_latitude_deg", "parallax_mas", "parallax_error_mas", "parallax_over_error",
    "proper_motion_mas_per_year", "proper_motion_ra_mas_per_year", "proper_motion_ra_error_mas_per_year", "proper_motion_dec_mas_per_year", "proper_motion_dec_error_mas_per_year",
    "radial_velocity_km_per_s", "radial_velocity_error_km_per_s", "phot_g_mean_magnitude", "phot_bp_mean_magnitude", "phot_rp_mean_magnitude", "bp_rp_color", "ruwe", "duplicated_source",
    "astrometric_params_solved", "visibility_periods_used", "phot_variable_flag", "non_single_star", "temperature_gspphot_k", "distance_gspphot_pc", "distance_gspphot_lower_pc",
    "distance_gspphot_upper_pc", "distance_pc", "distance_lower_pc", "distance_upper_pc", *SPATIAL[1:], "source",
]


WORDS = {
    "position_status": ["available", "no_accepted_distance", "no_exact_gaia_source"],
    "distance_method": ["gaia_gspphot", "inverse_parallax", "unavailable"],
    "distance_quality": ["positive_gspphot_estimate", "snr_ge_5_ruwe_acceptable", "unavailable"],
}
RECORD_KINDS = {
    "host_id": "text", "host_name": "text", "gaia_source_id": "id?", "planet_count": "number", "archive_planet_count": "number", "planet_count_matches_archive": "flag", "is_circumbinary": "flag",
    "position_status": "text", "distance_pc": "number?", "distance_method": "text?", "distance_quality": "text?", **{f"heliocentric_{c}_pc": "number?" for c in "xyz"}, **{f"galactocentric_{c}_kpc": "number?" for c in "xyz"},
    "phot_g_mean_magnitude": "number?", "bp_rp_color": "number?",
}


class RecordError(ValueError):
    """A host record is not what clients read."""


def _kind(of: T.DataType) -> str:
    return "text" if isinstance(of, T.StringType) else "flag" if isinstance(of, T.BooleanType) else "number" if isinstance(of, T.NumericType) else of.simpleString()


def record_faults(records: DataFrame) -> DataFrame:
    """The records with ``fault``, the first that applies: a missing value, an unknown word, or a position in part; null for none."""
    rules = [(F.col(c).isNull(), f"{c} is missing") for c, kind in RECORD_KINDS.items() if not kind.endswith("?")]
    rules += [(~F.col(c).isin(words), f"unknown {c}") for c, words in WORDS.items()]
    for frame, unit in (("heliocentric", "pc"), ("galactocentric", "kpc")):
        known = [F.col(f"{frame}_{c}_{unit}").isNotNull() for c in "xyz"]
        rules.append(((known[0] != known[1]) | (known[1] != known[2]), f"{frame} position in part"))
    return records.withColumn("fault", F.coalesce(*[F.when(rule, reason) for rule, reason in rules]))


def decode_records(records: DataFrame) -> DataFrame:
    """The records as clients take them: checked strictly, source ids as text, positions as structs that may be null.

    Raises ``RecordError`` for a column that is missing or of another kind, and for the first record with a fault; one row reaches the driver.
    """
    for column, kind in RECORD_KINDS.items():
        found = _kind(records.schema[column].dataType) if column in records.columns else "missing"
        if found not in ({"id?": ("number", "text")}.get(kind) or (kind.rstrip("?"),)):
            raise RecordError(f"{column} must be a {kind.rstrip('?')}, is {found}")
    wrong = record_faults(records).where("fault is not null").select("host_id", "fault").head(1)
    if wrong:
        raise RecordError(f"{wrong[0]['host_id']}: {wrong[0]['fault']}")
    place = lambda frame, unit: F.when(F.col(f"{frame}_x_{unit}").isNotNull(), F.struct(*[F.col(f"{frame}_{c}_{unit}").alias(c) for c in "xyz"])).alias(frame)
    return records.select(*[F.col(c).cast("string").alias(c) if c == "gaia_source_id" else c for c in RECORD_KINDS if "centric" not in c], place("heliocentric", "pc"), place("galactocentric", "kpc"))


def marker_radius(count: Column | str, most: Column | str) -> Column:
    """Radius 3 to 9 of a host's marker, by the square root of its planets between 1 and the largest count; 6 if that is 1."""
    count, most = (F.col(c) if isinstance(c, str) else c for c in (count, most))
    share = (F.sqrt(count) - 1) / (F.sqrt(most) - 1)
    return F.when(most == 1, F.lit(6.0)).otherwise(3 + 6 * F.when(share < 0, 0.0).when(share > 1, 1.0).otherwise(share))


def colour_class(method: Column | str) -> Column:
    """The colour of a host's marker by where its distance comes from."""
    method = F.col(method) if isinstance(method, str) else method
    return F.when(method == "inverse_parallax", "amber").otherwise("blue")


def scatter_points(records: DataFrame, x: str, y: str) -> DataFrame:
    """(host_id, x, y, radius, colour) of the positioned records; the largest count is theirs, 1 at least."""
    placed = records.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    most = placed.agg(F.greatest(F.lit(1), F.max("planet_count")).alias("_most"))  # one row
    return placed.crossJoin(F.broadcast(most)).select("host_id", F.col(x).alias("x"), F.col(y).alias("y"), marker_radius("planet_count", "_most").alias("radius"), colour_class("distance_method").alias("colour"))


def display_name(*columns: str) -> Column:
    """The first name there is, blanks being none."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in columns])


def host_source_ids(hosts: DataFrame) -> DataFrame:
    """The distinct source ids of hosts, in order."""
    return hosts.select(F.col("gaia_source_id").cast("bigint")).dropna().distinct().orderBy("gaia_source_id")


def build_host_sources(staged: DataFrame) -> DataFrame:
    """Valid sources with distance and positions."""
    placed = staged.where("is_valid").transform(with_distance).transform(with_heliocentric).transform(with_galactocentric)
    return placed.select(*SOURCE_COLUMNS).orderBy("gaia_source_id")


def position_status() -> F.Column:
    return F.when(F.col("gaia_source_id").isNull(), "no_exact_gaia_source").when(F.col("distance_pc").isNull(), "no_accepted_distance").otherwise("available")


def host_records(hosts: DataFrame, systems: DataFrame, sources: DataFrame) -> DataFrame:
    """The published record of each host: identity, counts, position and its status."""
    both = validated_join(hosts.select("host_id", "host_name", "gaia_source_id", "is_circumbinary"), systems.select("host_id", "planet_count", "archive_planet_count", "planet_count_matches_archive"), ["host_id"], validate="1:1")
    full = validated_join(both, sources.select("gaia_source_id", *SPATIAL, "phot_g_mean_magnitude", "bp_rp_color"), ["gaia_source_id"], validate="m:1")
    return full.withColumn("position_status", position_status()).select(
        "host_id", "host_name", "gaia_source_id", "planet_count", "archive_planet_count", "planet_count_matches_archive", "is_circumbinary", "position_status", *SPATIAL, "phot_g_mean_magnitude", "bp_rp_color",
    ).orderBy("host_id")


def scatter_extent(records: DataFrame, x: str, y: str, *, padding: float = 1.08) -> DataFrame:
    """One row: the extent of positioned records and the origin, padded to equal aspect, with counts and the largest planet count."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    at = records.where(both).agg(*[f(F.least(F.lit(0.0), F.min(c)) if n == "min" else F.greatest(F.lit(0.0), F.max(c))).alias(f"{n}_{c}") for c in (x, y) for n, f in (("min", lambda v: v), ("max", lambda v: v))], F.count("*").alias("positioned"), F.greatest(F.lit(1), F.max("planet_count")).alias("most_planets"))
    half = F.greatest(F.col(f"max_{x}") - F.col(f"min_{x}"), F.col(f"max_{y}") - F.col(f"min_{y}")) / 2 * padding
    return at.withColumn("half_width", half)


def density_cells(df: DataFrame, x: str, y: str, levels: tuple[int, ...], bounds: tuple[float, float, float, float], *, magnitude: str | None = None, colour: str | None = None, quality: str | None = None) -> DataFrame:
    """(grid_level, cell_x, cell_y, points) of the non-empty cells of square grids over bounds (x0, y0, x1, y1).

    Where columns are named, also ``weighted_brightness``, the sum of 10^(-0.4 magnitude), ``mean_colour`` and
    ``mean_quality``. Null, NaN and infinite values are left out of these; a cell without any has null.
    """
    x0, y0, x1, y1 = bounds
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c).cast("double"))
    extra = [finite(c).alias(n) for n, c in (("_m", magnitude), ("_c", colour), ("_q", quality)) if c]
    inside = df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1)).select(F.col(x).alias("x"), F.col(y).alias("y"), *extra, F.explode(F.array(*[F.lit(n) for n in levels])).alias("grid_level"))
    cell = lambda c, low, high: F.least(F.col("grid_level") - 1, F.floor((F.col(c) - low) / (high - low) * F.col("grid_level"))).cast("int")
    more = [a for a, c in ((F.sum(F.pow(F.lit(10.0), -0.4 * F.col("_m"))).alias("weighted_brightness"), magnitude), (F.avg("_c").alias("mean_colour"), colour), (F.avg("_q").alias("mean_quality"), quality)) if c] if extra else []
    return inside.groupBy("grid_level", cell("x", x0, x1).alias("cell_x"), cell("y", y0, y1).alias("cell_y")).agg(F.count("*").alias("points"), *more)
