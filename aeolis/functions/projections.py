"""Inverse map projections on a sphere: grid metres to degrees, as column functions.

The usual textbook forms; angles in degrees, x eastward and y northward from the projection's origin.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius in metres of the sphere that gridded messages assume.
RADIUS = 6367470.0


def _place(lat: Column, lon: Column) -> Column:
    return F.struct(F.degrees(lat).alias("lat"), (F.pmod(F.degrees(lon) + 180, F.lit(360.0)) - 180).alias("lon"))


def polar_stereographic(x: Column, y: Column, orientation: float, true_lat: float = 60.0, south: bool = False) -> Column:
    """struct(lat, lon); the pole is the origin and the meridian `orientation` points along -y (north) or y (south)."""
    scale = RADIUS * (1 + math.sin(math.radians(true_lat)))
    rho = F.hypot(x, y)
    lat = F.lit(math.pi / 2) - 2 * F.atan(rho / scale)
    turn = F.atan2(x, -y) if not south else F.atan2(x, y)
    return _place(-lat if south else lat, turn + math.radians(orientation))


def lambert_conformal(x: Column, y: Column, orientation: float, lat1: float, lat2: float, origin: float) -> Column:
    """struct(lat, lon) for a cone through two standard parallels; (0, 0) is (origin, orientation)."""
    a, b = math.radians(lat1), math.radians(lat2)
    t = lambda p: math.tan(math.pi / 4 + p / 2)
    n = math.sin(a) if lat1 == lat2 else math.log(math.cos(a) / math.cos(b)) / math.log(t(b) / t(a))
    f = math.cos(a) * t(a) ** n / n
    rho0 = RADIUS * f / t(math.radians(origin)) ** n
    sign = math.copysign(1, n)
    rho = sign * F.hypot(x, rho0 - y)
    lat = 2 * F.atan(F.pow(RADIUS * f / rho, F.lit(1 / n))) - math.pi / 2
    return _place(lat, F.atan2(sign * x, sign * (rho0 - y)) / n + math.radians(orientation))


def grid_points(nx: Column, ny: Column, dx: float, dy: float, x0: float, y0: float) -> Column:
    """Array of struct(i, j, x, y) for the points of a grid, by row."""
    rows = F.transform(F.sequence(F.lit(0), ny - 1), lambda j: F.transform(F.sequence(F.lit(0), nx - 1), lambda i: F.struct(i.alias("i"), j.alias("j"), (x0 + i * dx).alias("x"), (y0 + j * dy).alias("y"))))
    return F.flatten(rows)
