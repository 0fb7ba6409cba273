"""Geographic column functions. Latitudes and longitudes are in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres in a degree, the sphere's radius in kilometres.
KM_PER_DEGREE = 111.125
RADIUS = 6372.795477598
#: Bits behind the point of coordinates whose side of an edge is worked out exactly.
GRAIN = 50


def arc_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres on a plane that touches at the mean latitude."""
    north = (lat1 - lat2) * KM_PER_DEGREE
    east = (lon1 - lon2) * F.cos(F.radians((lat1 + lat2) / 2)) * KM_PER_DEGREE
    return F.hypot(north, east)


def gc_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres by the haversine formula."""
    half = lambda a, b: F.pow(F.sin(F.radians(a - b) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def box_index(lat: Column, lon: Column, size: int = 1) -> Column:
    """struct(lat_index, lon_index) of the box of `size` degrees; poles are boxes of their own; null outside."""
    cell = lambda x, half: F.ceil(x) + half
    south, north = F.abs(lat + 90) < 1e-5, F.abs(lat - 90) < 1e-5
    row = F.when(south, 0).when(north, (180 + size) // size).otherwise(F.floor((cell(lat, 89) + size) / size))
    east = F.when(F.abs(lon + 180) < 1e-5, F.lit(180.0)).otherwise(lon)
    column = F.when(south | north, 0).otherwise(F.floor(cell(east, 179) / size))
    inside = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(inside, F.struct(row.cast("int").alias("lat_index"), column.cast("int").alias("lon_index")))


def box_center(lat_index: Column, lon_index: Column, size: int = 1) -> Column:
    """struct(lat, lon) of a box's centre; null for no such box."""
    top = 180 // size + 1
    lat = F.when(lat_index == 0, -90.0).when(lat_index == top, 90.0).otherwise(lat_index * size - 90 - size / 2)
    known = lat_index.between(0, top) & lon_index.between(0, 360 // size - 1)
    return F.when(known, F.struct(lat.alias("lat"), (lon_index * size - 180 + size / 2).alias("lon")))


def within_polygon(polygon: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside a closed ring, an array of struct(x, y), by the parity of crossings; points on the ring are outside.

    On which side of an edge a point is, is worked out in whole numbers of 2^-GRAIN where rounding could tell it wrong. Coordinates
    are below 1024.
    """
    edges = F.zip_with(F.slice(polygon, F.lit(1), F.size(polygon) - 1), F.slice(polygon, F.lit(2), F.size(polygon) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    whole = lambda v: F.round(v * float(1 << GRAIN)).cast("long").cast("decimal(19,0)")

    def turn(e: Column) -> Column:
        """1 left of the edge, -1 right of it, 0 on its line."""
        a, b = e["a"], e["b"]
        cross = lambda f: (f(b["x"]) - f(a["x"])) * (f(y) - f(a["y"])) - (f(b["y"]) - f(a["y"])) * (f(x) - f(a["x"]))
        near = cross(lambda v: v)
        return F.when(F.abs(near) > 1e-6, F.signum(near)).otherwise(F.signum(cross(whole)))

    def part(e: Column) -> Column:
        """1 for an edge that a ray to the east crosses, 2 for one that the point is on."""
        a, b = e["a"], e["b"]
        over, up = (a["y"] > y) != (b["y"] > y), b["y"] > a["y"]
        beside = y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"])) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]))
        return F.when(beside & (turn(e) == 0), 2).when(over & (turn(e) == F.when(up, 1).otherwise(-1)), 1).otherwise(0)

    parts = F.transform(edges, part)
    return ~F.array_contains(parts, 2) & (F.size(F.filter(parts, lambda p: p == 1)) % 2 == 1)
