"""Coordinates, tiles and distances as column mathematics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
E1 = math.sqrt(E2)
EARTH_KM = 6371.0088


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - E2 * math.sin(phi) ** 2)


def _q(phi: float) -> float:
    s = math.sin(phi)
    return (1 - E2) * (s / (1 - E2 * s * s) - math.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))


def albers_constants(lat1=25.0, lat2=47.0, lat0=36.0) -> tuple[float, float, float]:
    """n, C and rho0 of the equal-area cone (Snyder 1987, ellipsoidal form)."""
    p1, p2, p0 = (math.radians(x) for x in (lat1, lat2, lat0))
    n = (_m(p1) ** 2 - _m(p2) ** 2) / (_q(p2) - _q(p1))
    c = _m(p1) ** 2 + n * _q(p1)
    return n, c, A * math.sqrt(c - n * _q(p0)) / n


def albers(lon: Column, lat: Column, lat1=25.0, lat2=47.0, lat0=36.0, lon0=104.0) -> tuple[Column, Column]:
    """x and y in metres."""
    n, c, rho0 = albers_constants(lat1, lat2, lat0)
    s = F.sin(F.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))
    rho = A * F.sqrt(F.lit(c) - n * q) / n
    theta = n * F.radians(lon - lon0)
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def block_key(x: Column, y: Column, size: float = 25000.0) -> Column:
    return F.floor(x / size).cast("bigint") * 100000 + F.floor(y / size).cast("bigint")


def point_block(lon: Column, lat: Column, size: float = 25000.0) -> Column:
    return block_key(*albers(lon, lat), size)


def tile_xy(lon: Column, lat: Column, deg: float = 2.0, lon0: float = 73.0, lat0: float = 18.0) -> tuple[Column, Column]:
    return F.floor((lon - lon0) / deg).cast("bigint"), F.floor((lat - lat0) / deg).cast("bigint")


def tile_id(lon: Column, lat: Column) -> Column:
    tx, ty = tile_xy(lon, lat)
    return tx * 1000 + ty


def region_id(lon: Column, lat: Column) -> Column:
    """3 x 3 tiles."""
    tx, ty = tile_xy(lon, lat)
    return F.floor(tx / 3).cast("bigint") * 1000 + F.floor(ty / 3).cast("bigint")


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("bigint")


def cell_index(lon: Column, lat: Column, deg: float) -> tuple[Column, Column]:
    """Row and column of a pixel of a grid that begins at 90 N, 180 W."""
    return F.floor((90 - lat) / deg).cast("bigint"), F.floor((lon + 180) / deg).cast("bigint")


def pixel_km2(lat: Column, deg: float) -> Column:
    """Area of a pixel of `deg` x `deg` degrees that is centred at `lat`."""
    side = EARTH_KM * math.radians(deg)
    return side * side * F.cos(F.radians(lat))
