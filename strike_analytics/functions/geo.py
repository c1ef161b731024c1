"""Distance and search-box math (all native column expressions)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius in km, km per degree of latitude used for the
# search box, and the miles-per-degree / degrees-per-radian constants of the
# documented equirectangular query.
EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.0
MILES_PER_DEGREE = 69.1
DEGREES_PER_RADIAN = 57.3


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km: 2 R asin(sqrt(a))."""
    lat1, lon1, lat2, lon2 = (_col(v) for v in (lat1, lon1, lat2, lon2))
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(EARTH_RADIUS_KM) * (F.asin(F.sqrt(a)) * 2)


def search_box(lat: float, lon: float, radius_km: float) -> tuple[float, float, float, float]:
    """Coarse (min_lat, max_lat, min_lon, max_lon) around a point.

    Computed on the driver from scalars so the bounds reach the Parquet scan
    as literal predicates. No antimeridian wrap, as in the source service.
    """
    lat_delta = radius_km / KM_PER_DEGREE
    lon_delta = radius_km / (KM_PER_DEGREE * math.cos(math.radians(lat)))
    return lat - lat_delta, lat + lat_delta, lon - lon_delta, lon + lon_delta


def covering_boxes(lat: float, lon: float, radius_km: float) -> list[tuple[float, float, float, float]]:
    """(min_lat, max_lat, min_lon, max_lon) of boxes that hold every point
    within ``radius_km`` by great circle: two where they pass the antimeridian,
    all longitudes where a pole is within."""
    angle = radius_km / EARTH_RADIUS_KM * (1 + 1e-9) + 1e-9  # of rounded distances
    low, high = lat - math.degrees(angle), lat + math.degrees(angle)
    if low <= -90 or high >= 90:
        return [(max(low, -90.0), min(high, 90.0), -180.0, 180.0)]
    wide = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat)))))
    left, right = lon - wide, lon + wide
    if left < -180:
        return [(low, high, -180.0, right), (low, high, left + 360, 180.0)]
    if right > 180:
        return [(low, high, left, 180.0), (low, high, -180.0, right - 360)]
    return [(low, high, left, right)]


def equirect_miles(lat, lon, lat0: float, lon0: float) -> Column:
    """sqrt((69.1 (lat - lat0))^2 + (69.1 (lon0 - lon) cos(lat / 57.3))^2)."""
    lat, lon = _col(lat), _col(lon)
    dy = F.lit(MILES_PER_DEGREE) * (lat - F.lit(lat0))
    dx = F.lit(MILES_PER_DEGREE) * (F.lit(lon0) - lon) * F.cos(lat / F.lit(DEGREES_PER_RADIAN))
    return F.sqrt(F.pow(dy, 2) + F.pow(dx, 2))
