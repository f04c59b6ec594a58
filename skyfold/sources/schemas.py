"""Column names and types of the catalogues."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "short": T.ShortType(), "byte": T.ByteType(), "boolean": T.BooleanType()}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in map(str.split, text.split(","))])


PSCOMPPARS = _schema(
    "pl_name string, hostname string, pl_letter string, hd_name string, hip_name string, tic_id string, gaia_dr3_id string, "
    "ra double, dec double, sy_dist double, sy_snum short, sy_pnum short, cb_flag byte, st_teff double, st_mass double, st_rad double, st_lum double, "
    "pl_rade double, pl_bmasse double, pl_bmassprov string, pl_dens double, pl_eqt double, pl_insol double, pl_orbper double, pl_orbsmax double, "
    "pl_orbeccen double, pl_orbincl double, discoverymethod string, disc_year short, disc_facility string, pl_controv_flag byte"
)
GAIA = _schema(
    "source_id long, designation string, ref_epoch double, ra double, dec double, l double, b double, parallax double, parallax_error double, parallax_over_error double, "
    "pm double, pmra double, pmra_error double, pmdec double, pmdec_error double, radial_velocity double, radial_velocity_error double, phot_g_mean_mag double, "
    "phot_bp_mean_mag double, phot_rp_mean_mag double, bp_rp double, ruwe double, duplicated_source boolean, astrometric_params_solved byte, "
    "visibility_periods_used short, non_single_star short, phot_variable_flag string, teff_gspphot double, distance_gspphot double, distance_gspphot_lower double, distance_gspphot_upper double"
)
