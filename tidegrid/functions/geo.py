"""Geometry as Column expressions: boxes, cells, distances, coast, map pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import (
    AUDIT_COAST_LON,
    AUDIT_KM_PER_DEGREE,
    COAST_KNOTS,
    DISTANCE_BAND_EDGES,
    DISTANCE_BAND_NAMES,
    KM_PER_DEGREE,
    PREDICT_BOX,
    Box,
)
from .numbers import bin_index, clamp, col, pick

EARTH_RADIUS_KM = 6371.0
SEGMENTS = 8


def in_box(lat, lon, box: Box) -> Column:
    return col(lat).between(box.south, box.north) & col(lon).between(box.west, box.east)


def box_wkt(box: Box) -> str:
    corners = [
        (box.west, box.south), (box.east, box.south), (box.east, box.north),
        (box.west, box.north), (box.west, box.south),
    ]
    return "POLYGON((" + ", ".join(f"{x} {y}" for x, y in corners) + "))"


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (col(c) for c in (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # least() skips NULL: a missing end gives no distance
    return F.when(h.isNotNull(), 2 * EARTH_RADIUS_KM * F.asin(F.least(F.sqrt(h), F.lit(1.0))))


def cell_index(value, step: float) -> Column:
    """Integer cell key: half-even, so joins compare longs and never doubles."""
    return F.rint(col(value) / F.lit(step)).cast("long")


def snap(value, step: float) -> Column:
    return F.round(F.rint(col(value) / F.lit(step)) * F.lit(step), 4)


def cell_name(lat, lon) -> Column:
    return F.format_string("%.4f_%.4f", col(lat), col(lon))


def lattice_size(box: Box, step: float) -> tuple[int, int]:
    return tuple(
        math.floor(round(span / step, 6)) + 1
        for span in (box.north - box.south, box.east - box.west)
    )


def lattice(spark: SparkSession, box: Box, step: float) -> DataFrame:
    """Every cell of a box from integer indices (no float drift), generated in parallel."""
    n_lat, n_lon = lattice_size(box, step)
    iy, ix = F.floor(F.col("id") / n_lon), F.col("id") % n_lon
    return spark.range(n_lat * n_lon).select(
        iy.alias("iy"),
        ix.alias("ix"),
        F.round(F.lit(box.south) + iy * F.lit(step), 4).alias("lat"),
        F.round(F.lit(box.west) + ix * F.lit(step), 4).alias("lon"),
    )


def current_speed(u, v) -> Column:
    return F.sqrt(col(u) * col(u) + col(v) * col(v))


def current_direction(u, v) -> Column:
    """Degrees clockwise from north the water moves toward."""
    return F.pmod(F.degrees(F.atan2(col(u), col(v))) + 360.0, F.lit(360.0))


def coast_lon(lat) -> Column:
    lat = col(lat)
    (first_lat, first_lon), (last_lat, last_lon) = COAST_KNOTS[0], COAST_KNOTS[-1]
    line = F.when(lat <= first_lat, F.lit(first_lon))
    for (a_lat, a_lon), (b_lat, b_lon) in zip(COAST_KNOTS, COAST_KNOTS[1:]):
        share = (lat - a_lat) / (b_lat - a_lat)
        line = line.when(lat <= b_lat, a_lon + (b_lon - a_lon) * share)
    return line.when(lat > last_lat, F.lit(last_lon))


def coast_distance_km(lat, lon) -> Column:
    km_per_lon = KM_PER_DEGREE * F.cos(F.radians(col(lat)))
    distance = (col(lon) - coast_lon(lat)) * km_per_lon
    return F.when(distance.isNotNull(), F.greatest(distance, F.lit(0.0)))


def audit_coast_distance_km(lon) -> Column:
    offset = col(lon) - AUDIT_COAST_LON
    return F.when(offset.isNotNull(), F.greatest(offset, F.lit(0.0)) * AUDIT_KM_PER_DEGREE)


def distance_band(km) -> Column:
    return pick(bin_index(km, DISTANCE_BAND_EDGES), DISTANCE_BAND_NAMES, None)


def coast_segment(lat) -> Column:
    """0..7 from south to north; the ratio is cut toward zero and then clamped."""
    share = (col(lat) - PREDICT_BOX.south) / (PREDICT_BOX.north - PREDICT_BOX.south)
    index = clamp(share * SEGMENTS, 0, SEGMENTS - 1).cast("long")
    return F.coalesce(index, F.lit(0).cast("long"))


def coast_priority_band(km) -> Column:
    km = col(km)
    return F.when(km <= 20, "nearshore").when(km <= 50, "midshore").otherwise("offshore")


def world_pixel(lat, lon, zoom: Column | int, tile: int = 256) -> tuple[Column, Column]:
    """Web-Mercator pixel of a point at a zoom level."""
    zoom = zoom if isinstance(zoom, Column) else F.lit(zoom)
    scale = tile * F.pow(F.lit(2.0), zoom)
    s = F.sin(F.radians(clamp(lat, -85.0511, 85.0511)))
    x = (col(lon) + 180.0) / 360.0 * scale
    y = (0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * scale
    return x, y
