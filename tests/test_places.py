"""Points beside, on and within rounding of the edges of a polygon, against fractions; coordinates from 4 on, which are told apart exactly."""

import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from aeolis.functions import geo

RHOMB = [(-100, 0), (0, 50), (100, 0), (0, -50), (-100, 0)]


def test_points_at_edges(spark):
    rng, points = random.Random(5), [(0.0, 50.0), (100.0, 0.0), (0.0, -50.0), (-100.0, 0.0), (0.0, 0.0), (99.0, 0.0), (101.0, 0.0), (20.0, 50.0), (20.0, -50.0)]
    for _ in range(400):
        lat = rng.randrange(400, 4800) / 100
        for side in (lat, -lat):
            lon = rng.choice((-1, 1)) * (100 - 2 * abs(side))
            points += [(lon, side), (math.nextafter(lon, 0), side), (math.nextafter(lon, 999), side), (lon, math.nextafter(side, 0)), (lon, math.nextafter(side, 99 * side))]
    inside = {p for p in points if abs(Fraction(p[0])) / 2 + abs(Fraction(p[1])) < 50}
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in RHOMB))
    for shape in (ring, F.reverse(ring)):
        found = spark.createDataFrame(points, "x double, y double").filter(geo.within_polygon(shape, F.col("x"), F.col("y")))
        assert {tuple(r) for r in found.collect()} == inside
