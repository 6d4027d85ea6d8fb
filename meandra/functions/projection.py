"""Longitude and latitude to UTM as column expressions (Snyder's series, WGS 84)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the ellipsoid and the projection
A = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EAST = 500000.0
FALSE_NORTH = 10000000.0

E2 = FLATTENING * (2 - FLATTENING)
EP2 = E2 / (1 - E2)


def utm_zone(lon: Column) -> Column:
    return F.floor((lon + 180) / 6).cast("int") % 60 + 1


def utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """(east, north) in metres; southern latitudes get the false northing. Null where an input is null."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    n = A / F.sqrt(1 - E2 * sin * sin)
    t, c, a = tan * tan, EP2 * cos * cos, lam * cos
    m = A * (
        (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256) * phi
        - (3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024) * F.sin(2 * phi)
        + (15 * E2**2 / 256 + 45 * E2**3 / 1024) * F.sin(4 * phi)
        - (35 * E2**3 / 3072) * F.sin(6 * phi)
    )
    power = lambda k: F.pow(a, F.lit(k))
    east = FALSE_EAST + SCALE * n * (a + (1 - t + c) * power(3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * EP2) * power(5) / 120)
    north = SCALE * (m + n * tan * (power(2) / 2 + (5 - t + 9 * c + 4 * c * c) * power(4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * EP2) * power(6) / 720))
    return east, north + F.when(lat < 0, FALSE_NORTH).otherwise(0.0)
