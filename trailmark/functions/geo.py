"""Distances and map projections as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500_000.0, 10_000_000.0


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the sphere between points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def metres_to_degrees(metres: Column) -> Column:
    return metres * 360 / (2 * math.pi * RADIUS)


def degrees_to_metres(degrees: Column) -> Column:
    return degrees * (2 * math.pi * RADIUS) / 360


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) % 60 + 1).cast("int")


def epsg_code(lat: Column, lon: Column) -> Column:
    """Code of the point's UTM zone."""
    return F.concat(F.when(lat < 0, "327").otherwise("326"), F.lpad(utm_zone(lon).cast("string"), 2, "0"))


def kruger() -> tuple[float, float, list[float]]:
    """Third flattening, rectifying radius and the first four series terms of the transverse Mercator."""
    n = FLATTENING / (2 - FLATTENING)
    radius = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    return n, radius, alpha


def utm(lat: Column, lon: Column, zone: int | Column | None = None) -> tuple[Column, Column]:
    """(easting, northing) in metres in the given zone, or in the point's own."""
    _, radius, alpha = kruger()
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    zone = utm_zone(lon) if zone is None else F.lit(zone) if isinstance(zone, int) else zone
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(alpha, 1)), F.lit(0.0))
    north = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(alpha, 1)), F.lit(0.0))
    return FALSE_EAST + SCALE * radius * east, SCALE * radius * north + F.when(lat < 0, FALSE_NORTH).otherwise(0.0)


def conic_constants(lat1: float, lat2: float, lat0: float) -> tuple[float, float, float]:
    """n, F and the origin's radius of a Lambert conformal conic with two standard parallels."""
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p1, p2, p0 = map(math.radians, (lat1, lat2, lat0))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2))) if lat1 != lat2 else math.sin(p1)
    f = m(p1) / (n * t(p1) ** n)
    return n, f, RADIUS * f * t(p0) ** n


# Fixed values, the defaults below: parameters of the national Lambert conformal conic projection.
def conic_inverse(x: Column, y: Column, lat1: float = 49.0, lat2: float = 77.0, lat0: float = 63.390675, lon0: float = -91.86666666666666, x0: float = 6_200_000.0, y0: float = 3_000_000.0) -> tuple[Column, Column]:
    """(lat, lon) in degrees of Lambert conformal conic metres; five fixed-point steps for the latitude."""
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    n, f, rho0 = conic_constants(lat1, lat2, lat0)
    dx, dy = x - x0, rho0 - (y - y0)
    rho = F.sqrt(dx * dx + dy * dy) * (1 if n > 0 else -1)
    t = F.pow(rho / (RADIUS * f), 1 / n)
    phi = math.pi / 2 - 2 * F.atan(t)
    for _ in range(5):
        s = e * F.sin(phi)
        phi = math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), e / 2))
    return F.degrees(phi), F.degrees(F.atan2(dx, dy) / n) + lon0
