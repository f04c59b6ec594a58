"""Points near other points on the sphere, and the polygon region that contains a point."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.operators.skew import find_hot

_SLACK = 1e-9  # degrees by which a star's cells reach further than the radius, against rounding


def separation_deg(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance in degrees (haversine, exact for small angles); null if a coordinate is."""
    half_dec, half_ra = F.sin(F.radians(dec2 - dec1) / 2), F.sin(F.radians(ra2 - ra1) / 2)
    chord = half_dec * half_dec + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * half_ra * half_ra
    # not F.least, which would pass over an unknown position
    return F.degrees(2 * F.asin(F.sqrt(F.when(chord > 1, F.lit(1.0)).otherwise(chord))))


def on_sky(ra: Column, dec: Column) -> Column:
    """Both coordinates present, finite and in range."""
    return F.coalesce(ra.between(0, 360) & dec.between(-90, 90) & ~F.isnan(ra) & ~F.isnan(dec), F.lit(False))


def _cells_of(band: Column, size: float) -> Column:
    """Cells in a declination band: as many of ``size`` degrees as its middle is long."""
    return F.greatest(F.lit(1), F.floor(F.cos(F.radians((band + 0.5) * size - 90)) * (360 / size))).cast("long")


def _cell(band: Column, column: Column) -> Column:
    return band * F.lit(1 << 32) + column


def pairs_within(left: DataFrame, right: DataFrame, radius_deg: float, *, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, separation_deg) of every pair within ``radius_deg``, both ends included; one row per pair.

    Both inputs have ``ra_deg`` and ``dec_deg`` as doubles beside their id; other columns are not read. Rows whose
    id or position is null, NaN or out of range take no part. A pair met by several rows comes once, with the least
    separation. ``left`` should be the smaller side: its points are copied to the cells their circle touches
    (about nine), each point of ``right`` has one. RA 0 and 360 meet, and at a pole a circle takes its whole ring.
    Cells holding a large share of ``right`` are split by a salt.
    """
    size = radius_deg
    a = left.select(F.col(left_id).alias("_left"), F.col("ra_deg").cast("double").alias("_ra"), F.col("dec_deg").cast("double").alias("_dec"))
    a = a.where(F.col("_left").isNotNull() & on_sky(F.col("_ra"), F.col("_dec"))).distinct()
    b = right.select(F.col(right_id).alias("_right"), F.col("ra_deg").cast("double").alias("_ra2"), F.col("dec_deg").cast("double").alias("_dec2"))
    b = b.where(F.col("_right").isNotNull() & on_sky(F.col("_ra2"), F.col("_dec2")))
    last_band = math.ceil(180 / size) - 1

    band_of = lambda dec: F.greatest(F.lit(0), F.least(F.lit(last_band), F.floor((dec + 90) / size))).cast("long")
    band = band_of(F.col("_dec2"))
    column = F.least(F.floor(F.pmod(F.col("_ra2"), F.lit(360.0)) / 360 * _cells_of(band, size)), _cells_of(band, size) - 1).cast("long")
    points = b.withColumn("_cell", _cell(band, column))
    hot = find_hot(points, [F.col("_cell")])
    points = points.withColumn("_salt", hot.one([F.col("_cell")], [F.col("_right"), F.col("_ra2"), F.col("_dec2")]))

    reach = radius_deg + _SLACK
    near_pole = F.abs("_dec") + reach >= 90
    spread = F.when(near_pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(reach))) / F.cos(F.radians("_dec"))))) + _SLACK)
    banded = a.withColumn("_spread", spread).withColumn("_band", F.explode(F.sequence(band_of(F.col("_dec") - reach), band_of(F.col("_dec") + reach))))
    n = _cells_of(F.col("_band"), size)
    low, high = (F.floor((F.col("_ra") + s * F.col("_spread")) / 360 * n).cast("long") for s in (-1, 1))
    ring = F.when(high - low + 1 >= n, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.sequence(low, high))
    circles = banded.withColumn("_at", F.explode(F.array_distinct(F.transform(ring, lambda x: F.pmod(x, n))))).withColumn("_cell", _cell(F.col("_band"), F.col("_at")))
    circles = circles.select("_left", "_ra", "_dec", "_cell", F.explode(hot.every([F.col("_cell")])).alias("_salt"))

    # The planner does not see how many cells a circle has; it must not take the exploded side for a small one.
    met = circles.join(points.hint("merge"), ["_cell", "_salt"]).withColumn("_sep", separation_deg(F.col("_ra"), F.col("_dec"), F.col("_ra2"), F.col("_dec2")))
    return met.where(F.col("_sep") <= radius_deg).groupBy(F.col("_left").alias(left_id), F.col("_right").alias(right_id)).agg(F.min("_sep").alias("separation_deg"))


def regions_containing(points: DataFrame, regions: DataFrame, *, point_id: str, region_id: str, cell_deg: float = 1.0) -> DataFrame:
    """(point_id, region_id) of every point in a polygon, edges between vertices being straight in RA and Dec.

    ``regions`` has ``ra_list`` and ``dec_list``, the vertices of a simple polygon that does not cross RA 0; fewer
    than three vertices or a null among them make no region. A point on a left or lower edge is inside, as usual
    for half-open crossing counts. Polygons are copied to the grid cells of their bounding box, points have one
    cell, and each meeting is verified by the crossing number, all in the JVM.
    """
    x, y = F.col("ra_list"), F.col("dec_list")
    sound = regions.where((F.size(x) >= 3) & (F.size(x) == F.size(y)) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v)) & ~F.exists(y, lambda v: v.isNull() | F.isnan(v)))
    columns, rows = (F.sequence(F.floor(F.array_min(v) / cell_deg), F.floor(F.array_max(v) / cell_deg)) for v in (x, y))
    boxed = sound.select(F.col(region_id), x.alias("_x"), y.alias("_y"), F.explode(columns).alias("_cx"), rows.alias("_rows")).withColumn("_cy", F.explode("_rows")).drop("_rows")
    sky = points.select(F.col(point_id), F.col("ra_deg").cast("double").alias("_ra"), F.col("dec_deg").cast("double").alias("_dec"))
    sky = sky.where(on_sky(F.col("_ra"), F.col("_dec"))).withColumn("_cx", F.floor(F.col("_ra") / cell_deg)).withColumn("_cy", F.floor(F.col("_dec") / cell_deg))
    hot = find_hot(sky, [F.col("_cx"), F.col("_cy")])
    sky = sky.withColumn("_salt", hot.one([F.col("_cx"), F.col("_cy")], [F.col(point_id), F.col("_ra"), F.col("_dec")]))
    boxed = boxed.withColumn("_salt", F.explode(hot.every([F.col("_cx"), F.col("_cy")])))
    edges = F.sequence(F.lit(0), F.size("_x") - 1)

    def crosses(i: Column) -> Column:
        j = F.pmod(i + 1, F.size("_x"))
        xi, yi, xj, yj = (F.get(c, k) for k in (i, j) for c in (F.col("_x"), F.col("_y")))
        above = (yi > F.col("_dec")) != (yj > F.col("_dec"))
        return above & (F.col("_ra") < xi + F.try_divide((F.col("_dec") - yi) * (xj - xi), yj - yi))

    # as above, the exploded side is not to be taken for a small one
    met = sky.join(boxed.hint("merge"), ["_cx", "_cy", "_salt"])
    return met.where(F.size(F.filter(edges, crosses)) % 2 == 1).select(point_id, region_id).distinct()
