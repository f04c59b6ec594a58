"""Distances with their provenance, and heliocentric and Galactocentric positions, as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.operators.clean import known

# The v4.0 Galactocentric frame as one affine map of heliocentric kiloparsecs (rotation rows, offset).
GALACTOCENTRIC_V4 = (
    ((0.99999672443758247, 9.3396296357779800e-07, 2.5595142573179744e-03), -8.1219733661223),
    ((-9.3020648297014539e-07, 0.99999999999848865, -1.4688441515474427e-06), 0.0),
    ((-2.5595142586859292e-03, 1.4664584634852765e-06, 0.99999672443693988), 0.0208),
)


def with_distance(df: DataFrame) -> DataFrame:
    """Adds distance_pc, its bounds, ``distance_method`` and ``distance_quality``.

    The photometric estimate counts if it is positive. Else the inverse parallax, if the parallax is positive, at
    least five times its error and the fit is not poor (RUWE unknown or under 1.4); its bounds need a positive
    error smaller than the parallax. Else there is no distance.
    """
    p, e = F.col("parallax_mas"), F.col("parallax_error_mas")
    photometric = known(F.col("distance_gspphot_pc") > 0)
    parallax = ~photometric & known((p > 0) & (F.col("parallax_over_error") >= 5) & (F.col("ruwe").isNull() | (F.col("ruwe") < 1.4)))
    bounded = parallax & known((e > 0) & (p - e > 0))
    inverse = lambda x: F.try_divide(F.lit(1000.0), x)
    return df.withColumns(
        {
            "distance_pc": F.when(photometric, F.col("distance_gspphot_pc")).when(parallax, inverse(p)),
            "distance_lower_pc": F.when(photometric, F.col("distance_gspphot_lower_pc")).when(bounded, inverse(p + e)),
            "distance_upper_pc": F.when(photometric, F.col("distance_gspphot_upper_pc")).when(bounded, inverse(p - e)),
            "distance_method": F.when(photometric, "gaia_gspphot").when(parallax, "inverse_parallax").otherwise("unavailable"),
            "distance_quality": F.when(photometric, "positive_gspphot_estimate").when(parallax, "snr_ge_5_ruwe_acceptable").otherwise("unavailable"),
        }
    )


def with_heliocentric(df: DataFrame) -> DataFrame:
    """Adds heliocentric_x/y/z_pc from Galactic longitude, latitude and distance; null if any is."""
    d, l, b = F.col("distance_pc"), F.radians("galactic_longitude_deg"), F.radians("galactic_latitude_deg")
    return df.withColumns({"heliocentric_x_pc": d * F.cos(b) * F.cos(l), "heliocentric_y_pc": d * F.cos(b) * F.sin(l), "heliocentric_z_pc": d * F.sin(b)})


def with_galactocentric(df: DataFrame) -> DataFrame:
    """Adds galactocentric_x/y/z_kpc from the heliocentric position."""
    x, y, z = (F.col(f"heliocentric_{c}_pc") / 1000 for c in "xyz")
    return df.withColumns({f"galactocentric_{c}_kpc": a * x + b * y + k * z + F.lit(offset) for c, ((a, b, k), offset) in zip("xyz", GALACTOCENTRIC_V4)})
