"""Gaussian latitudes at the polynomial's roots, and definitions that do not fit."""

import numpy as np
from pyspark.sql import functions as F

from aeolis.functions import definitions
from aeolis.sources import sinks


def test_gaussian_latitudes():
    for circles in (1, 16, 47, 160):
        lats = definitions.gaussian_latitudes(circles)
        values = np.polynomial.legendre.legval(np.sin(np.radians(lats)), [0] * (2 * circles) + [1])
        assert len(lats) == 2 * circles and lats == sorted(lats, reverse=True) and np.abs(values).max() < 1e-9
        assert definitions.gaussian_latitudes(circles, from_north=False) == lats[::-1]


def test_domains(spark):
    rows = [("latLon", "72:19:90S:0E:90N:355E:5:10"), ("latLon", "144:73:90N:180W:90S:177.5E:2.5:2.5"), ("latLon", "11:11:10N:350E:20N:0E:1:1"), ("latLon", "11:11:10N:10E:20N:0E:1:1"), ("latLonCell", "360:180:89.5N:0E:89.5S:360E:1:1"), ("latLon", "10:10:1N:2E:3N:4E:5:6")]
    df = spark.createDataFrame(rows, "kind string, numbers string").withColumn("b", definitions.domain(F.col("kind"), F.col("numbers")))
    assert [tuple(r["b"]) if r["b"] else None for r in df.collect()] == [(-180, -90, 180, 90), (-180, -90, 180, 90), (-10, 10, 0, 20), (0, 10, 10, 20), (-180, -90, 180, 90), None]


def test_fields_of_records(spark):
    row = spark.range(1).select(sinks.fixed_width((2, 3, F.lit(7)), (8, 2, F.lit(None)), length=12).alias("line"), sinks.bits((3, 5, F.lit(9)), (8, 8, F.lit(-1)), length=24).alias("bits")).first()
    assert row["line"] == "    7       " and bytes(row["bits"]) == bytes([9, 255, 0])
