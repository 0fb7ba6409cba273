"""Inverse projections against the forward formulas."""

import math

from pyspark.sql import functions as F

from aeolis.functions import projections as p


def test_polar_stereographic(spark):
    for south in (False, True):
        rows = []
        for lat in (89.0, 60.0, 12.5):
            for lon in (-170.0, -105.0, 0.0, 75.5):
                rho = p.RADIUS * (1 + math.sin(math.radians(60))) * math.tan(math.radians(90 - lat) / 2)
                a = math.radians(lon + 105)
                rows.append((-lat if south else lat, lon, rho * math.sin(a), rho * math.cos(a) * (1 if south else -1)))
        for r in spark.createDataFrame(rows, "lat double, lon double, x double, y double").withColumn("g", p.polar_stereographic(F.col("x"), F.col("y"), -105.0, 60.0, south)).collect():
            assert abs(r["g"]["lat"] - r["lat"]) < 1e-9 and abs(r["g"]["lon"] - r["lon"]) < 1e-9


def test_lambert(spark):
    for lat1, lat2, origin in ((33.0, 45.0, 40.0), (25.0, 25.0, 25.0), (-30.0, -60.0, -40.0)):
        a, b, t = math.radians(lat1), math.radians(lat2), lambda q: math.tan(math.pi / 4 + q / 2)
        n = math.sin(a) if lat1 == lat2 else math.log(math.cos(a) / math.cos(b)) / math.log(t(b) / t(a))
        f = math.cos(a) * t(a) ** n / n
        rho = lambda q: p.RADIUS * f / t(math.radians(q)) ** n  # noqa: B023, E731
        rows = [(lat, lon, rho(lat) * math.sin(n * math.radians(lon + 95)), rho(origin) - rho(lat) * math.cos(n * math.radians(lon + 95))) for lat in (-50.0, 20.0, 41.0, 70.0) for lon in (-120.0, -95.0, -60.0)]
        for r in spark.createDataFrame(rows, "lat double, lon double, x double, y double").withColumn("g", p.lambert_conformal(F.col("x"), F.col("y"), -95.0, lat1, lat2, origin)).collect():
            assert abs(r["g"]["lat"] - r["lat"]) < 1e-8 and abs(r["g"]["lon"] - r["lon"]) < 1e-8


def test_points(spark):
    got = spark.range(1).select(p.grid_points(F.lit(2), F.lit(2), 10.0, 5.0, 1.0, 2.0).alias("g")).first()["g"]
    assert [tuple(x) for x in got] == [(0, 0, 1.0, 2.0), (1, 0, 11.0, 2.0), (0, 1, 1.0, 7.0), (1, 1, 11.0, 7.0)]
