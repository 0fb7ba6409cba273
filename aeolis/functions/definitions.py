"""Grid definitions as text: a kind, and numbers between colons such as 72:19:90N:0E:90S:355E:5:5.

Numbers are nx, ny, first latitude and longitude, last latitude and longitude, and the increments (or, for
gaussian grids, the increment and the number of circles).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of grids with their abbreviations and names.
KINDS = {
    "gaussLatLon": ("GLL", "Longitude/Gaussian Latitude"), "lambertConformal": ("LC", "Lambert Conformal"), "latLon": ("LL", "Longitude/Latitude"), "latLonCell": ("LL", "Longitude/Latitude cells"),
    "mercator": ("MERC", "Mercator"), "polarStereographic": ("PS", "Polar Stereographic"), "sphericalHarmonics": ("SPHARM", "Spherical Harmonics"),
}


def kind_name(kind: Column, short: bool = False) -> Column:
    """Name or abbreviation of a kind; empty for others."""
    names = F.create_map(*(F.lit(x) for k, v in KINDS.items() for x in (k, v[not short])))
    return F.coalesce(F.try_element_at(names, kind), F.lit(""))


def signed(part: Column, negative: str) -> Column:
    """A number with a letter for its side behind it."""
    value = F.substring(part, F.lit(1), F.length(part) - 1).try_cast("double")
    return F.when(part.endswith(negative), -value).otherwise(value)


def parameters(numbers: Column) -> Column:
    """struct(nx, ny, slat, slon, elat, elon, dx, dy) of a definition's numbers, longitudes from -180 to 360 as given."""
    at = lambda n: F.split_part(numbers, F.lit(":"), F.lit(n))
    return F.struct(
        at(1).try_cast("int").alias("nx"), at(2).try_cast("int").alias("ny"), signed(at(3), "S").alias("slat"), signed(at(4), "W").alias("slon"), signed(at(5), "S").alias("elat"), signed(at(6), "W").alias("elon"),
        at(7).try_cast("double").alias("dx"), at(8).try_cast("double").alias("dy"),
    )


def description(kind: Column, numbers: Column) -> Column:
    """Text of a grid in degrees: increments, extent, and size with the kind's name."""
    at = lambda n: F.split_part(numbers, F.lit(":"), F.lit(n))
    p = parameters(numbers)
    apart = F.format_string("%.3f", F.abs(p["slat"] - p["elat"]) / (p["ny"] - 1))
    spacing = F.when(kind == "gaussLatLon", F.concat(F.lit("~"), apart)).when(kind == "mercator", F.concat(F.lit("~"), at(8))).otherwise(at(8))
    reduced = F.when(kind == "gaussLatLon", F.concat(F.lit("reduced n"), F.floor(p["ny"] / 2).cast("string"))).otherwise("reduced")
    size = F.when(at(1) == "-1", reduced).otherwise(F.concat_ws(" x ", at(1), at(2)))
    return F.concat(at(7), F.lit("&deg; x "), spacing, F.lit("&deg; from "), at(4), F.lit(" to "), at(6), F.lit(" and "), at(3), F.lit(" to "), at(5), F.lit(" <small>("), size, F.lit(" "), kind_name(kind), F.lit(")</small>"))


def domain(kind: Column, numbers: Column, center: str = "primeMeridian") -> Column:
    """struct(west, south, east, north) of a grid in degrees, its longitudes about the prime meridian or the date line.

    The increment says which way rows run; a grid that goes round the earth spans it, and one whose rows leave
    half an increment to either pole reaches both. Null where the numbers do not fit each other.
    """
    p = parameters(numbers)
    east_of = lambda lon: F.when(lon < 0, lon + 360).otherwise(lon)
    first, last, dx = east_of(p["slon"]), east_of(p["elon"]), p["dx"]
    steps = F.when(p["nx"] == 0, (last - first) / dx).when(kind.endswith("Cell"), p["nx"]).otherwise(p["nx"] - 1)
    fits = lambda span: F.abs(span / steps - dx) < 0.01
    way = F.when(fits(last - first), 0).when(fits(last + 360 - first), 1).when(fits(first - last), 2).when(fits(first + 360 - last), 3)
    start, end = first + F.when(way == 3, 360).otherwise(0), last + F.when(way == 1, 360).otherwise(0)
    whole = lambda span: F.abs(F.abs(span) - 360) < 0.001
    round_ = (F.abs(end - start) > 1e-9) & (whole(end - start) | F.when(end > start, whole(end + dx - start)).otherwise(whole(end - dx - start)))
    left, right = F.when(way < 2, start).otherwise(end), F.when(way < 2, end).otherwise(start)
    if center == "primeMeridian":
        left, right = F.when(left >= 180, left - 360).otherwise(left), F.when(right > 180, right - 360).otherwise(right)
        west, east = F.when(round_, -180.0).otherwise(left), F.when(round_, 180.0).otherwise(right)
    else:
        west, east = F.when(round_, 0.0).otherwise(left), F.when(round_, 360.0).otherwise(right)
    south, north = F.least(p["slat"], p["elat"]), F.greatest(p["slat"], p["elat"])
    poles = F.abs(F.abs(north - south + p["dy"]) - 180) < 0.001
    box = F.struct(west.alias("west"), F.when(poles, -90.0).otherwise(south).alias("south"), east.alias("east"), F.when(poles, 90.0).otherwise(north).alias("north"))
    return F.when(way.isNotNull(), box)


def fixed_increment(p: Column) -> Column:
    """The struct of parameters() with a rounded increment of a grid round the earth put right, and its last longitude."""
    step = F.lit(360.0) / p["nx"]
    loose = F.abs((p["elon"] - p["slon"]) / (p["nx"] - 1) - p["dx"]) >= 1e-6
    bad = loose & (F.abs(p["elon"] + p["dx"] - p["slon"] - 360) < 0.002)
    return p.withField("elon", F.when(bad, p["slon"] + step * (p["nx"] - 1)).otherwise(p["elon"])).withField("dx", F.when(bad, step).otherwise(p["dx"]))


def same_parameters(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Whether two grids have one size and places within the tolerance."""
    out = (a["nx"] == b["nx"]) & (a["ny"] == b["ny"])
    for k in ("slat", "slon", "elat", "elon", "dx", "dy"):
        out = out & (F.abs(a[k] - b[k]) < tolerance)
    return out


def gaussian_latitudes(circles: int, from_north: bool = True) -> list[float]:
    """The 2 * circles gaussian latitudes: arcsines of the roots of the Legendre polynomial of that degree."""
    found = np.degrees(np.arcsin(np.polynomial.legendre.leggauss(2 * circles)[0]))
    return (found[::-1] if from_north else found).tolist()


def latitude_index(latitude: Column, latitudes: list[float], tolerance: float = 0.01) -> Column:
    """Place from 0 of the first latitude within the tolerance, or -1."""
    lats = F.array(*map(F.lit, latitudes))
    near = F.filter(F.sequence(F.lit(0), F.lit(len(latitudes) - 1)), lambda i: F.abs(F.get(lats, i) - latitude) < tolerance)
    return F.coalesce(F.get(near, F.lit(0)), F.lit(-1))


def latitude_index_north(latitude: Column, latitudes: list[float]) -> Column:
    """Place, in latitudes from the north, of the one next north of (or at) a latitude, or -1 where none is or none lies south."""
    lats = F.array(*map(F.lit, latitudes))
    return F.coalesce(F.get(F.filter(F.sequence(F.lit(0), F.lit(len(latitudes) - 1)), lambda i: latitude > F.get(lats, i)), F.lit(0)) - 1, F.lit(-1))


def gridpoint_at(values: Column, p: Column, lat: Column, lon: Column) -> Column:
    """The cell of a field by row at a place on its grid; null off the grid."""
    j = F.round((lat - p["slat"]) / F.when(p["elat"] < p["slat"], -p["dy"]).otherwise(p["dy"])).cast("int")
    i = F.round(F.pmod(lon - p["slon"], F.lit(360.0)) / p["dx"]).cast("int")
    there = i.between(0, p["nx"] - 1) & j.between(0, p["ny"] - 1)
    return F.when(there, F.get(values, j * p["nx"] + i))


def precision(value: Column) -> Column:
    """Decimal places, 1 to 10, at which the fraction of a number first shows."""
    fraction = F.abs(value) - F.floor(F.abs(value))
    places = F.filter(F.sequence(F.lit(1), F.lit(9)), lambda n: fraction * F.pow(F.lit(10.0), n) >= 1)
    return F.coalesce(F.get(places, F.lit(0)), F.lit(10))


def nearly(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return (a == b) | (F.abs(a - b) < tolerance)


def rotated_wind(u: Column, v: Column, nx: int, step: float, offset: float) -> Column:
    """struct(u, v) of fields by row whose components lie along a grid turned by each column's longitude: column * step + offset degrees."""
    angle = lambda i: F.radians(F.pmod(i, F.lit(nx)) * step + offset)
    x = F.transform(F.sequence(F.lit(0), F.size(u) - 1), lambda i: F.get(v, i) * F.cos(angle(i)) - F.get(u, i) * F.sin(angle(i)))
    y = F.transform(F.sequence(F.lit(0), F.size(u) - 1), lambda i: -F.get(v, i) * F.sin(angle(i)) - F.get(u, i) * F.cos(angle(i)))
    return F.struct(x.alias("u"), y.alias("v"))
