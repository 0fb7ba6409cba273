"""Nested processes by hand, those that are not defined, and points of time."""

import datetime as dt

from pyspark.sql import functions as F

from aeolis.functions import processes

REF = dt.datetime(2020, 2, 1, 12)
SCHEMA = "i int, template int, center int, ref timestamp, forecast timestamp, hour int, unit int, valid timestamp, ranges array<struct<type: int, length: int, unit: int, increment: int>>"


def hours(n):
    return REF + dt.timedelta(hours=n)


def test_products(spark):
    cases = [
        (0, 98, 0, 1, [], ("Analysis", 0, 0)), (2, 98, 30, 1, None, ("30-hour Forecast", 30, 30)), (1, 98, 5, 0, [], ("5-minute Forecast", 5, 5)),
        (8, 98, 6, 1, [(1, 6, 1, 0)], ("6-hour Accumulation (initial+6 to initial+12)", 6, 12)),
        (11, 98, 0, 1, [(0, 1, 2, 6), (2, 2, 10, 0)], ("1-day Average of 6-hour Maximum (initial+0 to initial+6)", 0, 24)),
        (12, 98, 0, 1, [(6, 12, 1, 1), (3, 1, 11, 0), (255, 30, 0, 5)], ("12-hour Standard Deviation of 6-hour Minimum (initial+0 to initial+6) of 30-minute Period", 0, 12)),
        (61, 98, 24, 1, [(1, -6, 1, 0)], ("6-hour Accumulation (initial+18 to initial+24)", 18, 24)), (8, 98, 0, 1, [(1, -6, 1, 0)], ("6-hour Accumulation (initial-6 to initial+0)", -6, 0)),
        (8, 98, 0, 1, [(0, 0, 1, 0)], ("0-hour Average", 0, 0)), (8, 98, 0, 1, [(4, 6, 1, 0)], None), (8, 98, 0, 1, [(0, -6, 1, 0)], None), (8, 98, 0, 1, [(0, 6, 99, 0)], None), (8, 98, 0, 1, [], None), (8, 98, 0, 1, None, None),
        (8, 98, 0, 1, [(0, 6, 1, 0), (9, 6, 1, 0)], None), (40, 98, 0, 1, [], None), (8, 98, 0, 1, [(193, 29, 1, 6), (0, 6, 1, 0)], None), (8, 7, 0, 1, [(200, 29, 1, 6), (0, 6, 1, 0)], None),
        (8, 7, 0, 1, [(194, 116, 1, 6), (0, 0, 1, 0)], ("Monthly Mean (4 per day) of Analyses", 0, 115 * 6)), (8, 60, 0, 1, [(195, 29, 1, 24), (1, 6, 1, 0)], ("Monthly Mean (1 per day) of 6-hour Accumulation (initial+18 to initial+24)", 0, 28 * 24 + 6)),
    ]
    rows = [(i, t, c, REF, hours(h), h, u, hours(h), r) for i, (t, c, h, u, r, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("m", processes.product(F.col("template"), F.col("center"), F.lit(0), *map(F.col, ("ref", "forecast", "hour", "unit", "valid", "ranges"))))
    for r in df.collect():
        want = cases[r["i"]][-1]
        assert (r["m"] and tuple(r["m"])) == (want and (want[0], hours(want[1]), hours(want[2]))), cases[r["i"]]
