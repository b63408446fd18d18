"""Spherical geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
_BITS = 20


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres between points in degrees."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_dp, half_dl = (p2 - p1) / 2, (F.radians(lon2) - F.radians(lon1)) / 2
    a = F.pow(F.sin(half_dp), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_dl), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def unit_xyz(lat: Column, lon: Column) -> dict[str, Column]:
    """Degrees to a point on the unit sphere: no seam at 180 degrees or the poles."""
    p, q = F.radians(lat), F.radians(lon)
    return {"x": F.cos(p) * F.cos(q), "y": F.cos(p) * F.sin(q), "z": F.sin(p)}


def chord_of_km(km: float) -> float:
    """Straight-line length on the unit sphere of a great-circle distance."""
    return 2.0 * math.sin(min(km / EARTH_RADIUS_KM, math.pi) / 2.0)


def morton_code(x: Column, y: Column, z: Column) -> Column:
    """Interleaved 20-bit cell numbers: nearby points get nearby codes."""
    cells = [F.least(F.lit((1 << _BITS) - 1), F.floor((c + 1.0) * (1 << (_BITS - 1)))).cast("long") for c in (x, y, z)]

    def add_bits(code: Column, bit: Column) -> Column:
        for cell in cells:
            code = code * 2 + F.getbit(cell, bit)
        return code

    return F.aggregate(F.sequence(F.lit(_BITS - 1), F.lit(0), F.lit(-1)), F.lit(0).cast("long"), add_bits)
