"""Distances and bearings on a local flat ruler, walking time, opposite stops."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84: equatorial radius in km and flattening.
RADIUS, FLATTENING = 6378.137, 1 / 298.257223563
#: Latitude of the ruler unless given.
REF_LAT = 1.3


def scales(ref_lat: float = REF_LAT) -> tuple[float, float]:
    """Kilometres of a degree of longitude and of latitude at a latitude."""
    e2 = FLATTENING * (2 - FLATTENING)
    cos = math.cos(math.radians(ref_lat))
    w2 = 1 / (1 - e2 * (1 - cos * cos))
    w = math.sqrt(w2)
    m = math.radians(1) * RADIUS
    return m * w * cos, m * w * w2 * (1 - e2)


def _diff(a: Column, b: Column) -> Column:
    """Degrees of longitude from a to b the short way round."""
    d = b - a
    return F.when(d < -180, d + 360).when(d > 180, d - 360).otherwise(d)


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x1 - x2, F.lit(2.0)) + F.pow(y1 - y2, F.lit(2.0)))


def ruler_distance_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, ref_lat: float = REF_LAT) -> Column:
    kx, ky = scales(ref_lat)
    dx, dy = _diff(lon1, lon2) * kx, (lat2 - lat1) * ky
    return F.sqrt(dx * dx + dy * dy)


def ruler_bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column, ref_lat: float = REF_LAT) -> Column:
    """Degrees from north, -180 to 180."""
    kx, ky = scales(ref_lat)
    return F.degrees(F.atan2(_diff(lon1, lon2) * kx, (lat2 - lat1) * ky))


def walking_minutes(metres: Column) -> Column:
    """Whole minutes at 1.4 m/s, rounded up."""
    return F.ceil(metres / 1.4 / 60).cast("long")


def opposite_stop_id(stop: Column) -> Column:
    """Trailing 1 and 9 swapped, other ids null."""
    head = F.substr(stop, F.lit(1), F.length(stop) - 1)
    return F.when(stop.endswith("1"), F.concat(head, F.lit("9"))).when(stop.endswith("9"), F.concat(head, F.lit("1")))
