"""Geodesy as Column arithmetic (C28-C33): haversine, projections, walking time."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values used by the reference pipeline.
EARTH_RADIUS_KM = 6371.0
CENTER_LAT, CENTER_LON = 55.7522, 37.6156
WALK_MIN_PER_KM = 12
METERS_PER_DEGREE = 111_000
WEB_MERCATOR_R = 6378137.0
# WGS84 ellipsoid and UTM zone 37N
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
UTM37_LON0 = 39.0
UTM_FALSE_EASTING = 500000.0


def _c(c) -> Column:
    if isinstance(c, (int, float)):
        return F.lit(float(c))
    return F.col(c) if isinstance(c, str) else c


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km, atan2 form, R = 6371."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dphi = F.radians(_c(lat2) - _c(lat1))
    dl = F.radians(_c(lon2) - _c(lon1))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Same formula as SQL text (for oracles)."""
    return (f"(2*{EARTH_RADIUS_KM}e0*atan2(sqrt(pow(sin(radians({lat2}-{lat1})/2),2)"
            f"+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-{lon1})/2),2)),"
            f"sqrt(1-(pow(sin(radians({lat2}-{lat1})/2),2)"
            f"+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-{lon1})/2),2)))))")


def center_distance_km(lat, lon) -> Column:
    """Unrounded distance to the city centre (round with ``rint_dp`` at the end)."""
    return haversine_km(lat, lon, CENTER_LAT, CENTER_LON)


def walk_minutes(km) -> Column:
    """Round-half-even of km * 12 from the unrounded distance."""
    return F.rint(_c(km) * WALK_MIN_PER_KM).cast("int")


def meters_to_degrees(m) -> Column:
    """C31."""
    return _c(m) / METERS_PER_DEGREE


def project_webmercator(lat, lon) -> tuple[Column, Column]:
    """EPSG:3857 x, y in metres."""
    x = F.lit(WEB_MERCATOR_R) * F.radians(_c(lon))
    y = F.lit(WEB_MERCATOR_R) * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(_c(lat)) / 2))
    return x, y


def project_utm37(lat, lon) -> tuple[Column, Column]:
    """WGS84 -> UTM 37N (easting, northing) in metres, Krüger series (3 terms)."""
    f = WGS84_F
    n = f / (2 - f)
    big_a = WGS84_A / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    alpha = [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16,
             13 * n ** 2 / 48 - 3 * n ** 3 / 5,
             61 * n ** 3 / 240]
    e = math.sqrt(f * (2 - f))
    phi = F.radians(_c(lat))
    lam = F.radians(_c(lon)) - F.lit(math.radians(UTM37_LON0))
    sin_phi = F.sin(phi)
    # conformal latitude via t = sinh(atanh(sin phi) - e atanh(e sin phi))
    atanh = lambda x: F.lit(0.5) * F.ln((1 + x) / (1 - x))
    t = F.sinh(atanh(sin_phi) - F.lit(e) * atanh(F.lit(e) * sin_phi))
    xi_p = F.atan2(t, F.cos(lam))
    eta_p = atanh(F.sin(lam) / F.sqrt(1 + t * t))
    xi = xi_p
    eta = eta_p
    for j, a in enumerate(alpha, start=1):
        xi = xi + F.lit(a) * F.sin(2 * j * xi_p) * F.cosh(2 * j * eta_p)
        eta = eta + F.lit(a) * F.cos(2 * j * xi_p) * F.sinh(2 * j * eta_p)
    easting = F.lit(UTM_FALSE_EASTING) + F.lit(UTM_K0 * big_a) * eta
    northing = F.lit(UTM_K0 * big_a) * xi
    return easting, northing


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Planar distance from P to segment AB (clamped projection)."""
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 == 0, F.lit(0.0)).otherwise(((px - ax) * dx + (py - ay) * dy) / len2)
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    qx, qy = ax + t * dx, ay + t * dy
    return F.sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy))
