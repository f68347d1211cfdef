"""Distances and boxes on the sphere, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = EARTH_RADIUS_KM * math.pi / 180.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lon), F.lit(2)
    )
    return 2 * F.lit(EARTH_RADIUS_KM) * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def in_box(lat: Column, lon: Column, min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> Column:
    """Closed latitude/longitude box; plain comparisons, so Parquet can skip row groups."""
    return lat.between(min_lat, max_lat) & lon.between(min_lon, max_lon)


def radius_box(lat: float, lon: float, radius_km: float) -> tuple[float, float, float, float]:
    """A box that contains the whole circle (min_lat, min_lon, max_lat, max_lon).

    The longitude half-width is that of the circle's tangent meridian; near a
    pole or across the date line the box opens to all longitudes.
    """
    reach = radius_km / KM_PER_DEGREE * (1 + 1e-9)
    min_lat, max_lat = lat - reach, lat + reach
    ratio = math.sin(math.radians(reach)) / max(math.cos(math.radians(lat)), 1e-12)
    if min_lat <= -90 or max_lat >= 90 or ratio >= 1:
        return max(min_lat, -90.0), -180.0, min(max_lat, 90.0), 180.0
    half = math.degrees(math.asin(ratio)) * (1 + 1e-9)
    if lon - half < -180 or lon + half > 180:
        return min_lat, -180.0, max_lat, 180.0
    return min_lat, lon - half, max_lat, lon + half


def proximity_score(distance_m: Column, radius_km: Column) -> Column:
    """1 at the centre, falling with the squared distance over 300 m per km of radius."""
    ratio = distance_m / (300.0 * radius_km)
    return F.when(distance_m <= 0, F.lit(1.0)).otherwise(1.0 / (1.0 + ratio * ratio))
