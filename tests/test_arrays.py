"""Array files written in place by many tasks, against arrays made at once; parts of grids; cell methods."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeolis.operators import arrays
from aeolis.sources import binary

SHAPE = arrays.Shape(3, 2, 10.0, -5.0, 0.0, 120.0)
DAY = dt.datetime(2001, 2, 3)


def rows_of():
    """Variables with the same and with other times and levels, one without levels, gaps, nulls and a repeated field."""
    rng = np.random.default_rng(0)
    out = []
    for v, times, levels in (("a", range(6), (500.0, 850.0)), ("b", range(6), (500.0, 850.0)), ("c", (0, 3, 40), (None,)), ("d", (1, 2), (10.0, 20.0, 30.0))):
        for t in times:
            for level in levels:
                if (v, t, level) not in (("a", 2, 500.0), ("d", 1, 20.0)):
                    out.append(("one", v, DAY + dt.timedelta(hours=t), level, [None if rng.random() < 0.1 else float(x) for x in rng.normal(size=6)], "extra"))
    out.append(("one", "a", DAY + dt.timedelta(hours=1), 500.0, [9e9] * 6, "extra"))
    out += [("two", "a", DAY, None, [1.0, 2.0], None), (None, "a", DAY, None, [1.0] * 6, None), ("two", None, DAY, None, [1.0] * 6, None), ("two", "a", None, None, [1.0] * 6, None)]
    return out


SCHEMA = "file string, variable string, time timestamp_ntz, level double, values array<double>, offset string"


@pytest.mark.parametrize("tasks", [1, 4, 50])
def test_files(spark, tmp_path, tasks):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = arrays.write_arrays(df, f"file://{tmp_path}", SHAPE, "2001-01-01", tasks).collect()
    for name in ("one", "two"):
        runs = sorted((r["offset"], r["bytes"]) for r in made if r["file"] == name)
        assert runs[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(runs, runs[1:])) and sum(runs[-1]) == os.path.getsize(tmp_path / f"{name}.nc")
    if tasks == 50:
        assert sum(r["file"] == "one" for r in made) > 10
    found = {(r["path"].rsplit("/", 1)[1][:-3], r["name"]): r for r in binary.netcdf_variables(spark, str(tmp_path)).collect()}
    assert {k for f, k in found if f == "one"} == {"lat", "lon", "time", "time1", "time2", "level", "level1", "a", "b", "c", "d"}
    assert found["one", "lat"]["values"] == [10.0, 5.0] and found["one", "lon"]["values"] == [0.0, 120.0, 240.0]
    one = {}
    for f, v, t, level, values, _ in rows:
        if f == "one":
            one[v, t, level] = max(one.get((v, t, level), values), values, key=lambda x: [-9e99 if y is None else y for y in x])
    for v in "abcd":
        r = found["one", v]
        names = [d["name"] for d in r["dims"]]
        times = [DAY.replace(month=1, day=1) + dt.timedelta(hours=h) for h in found["one", names[0]]["values"]]
        levels = found["one", names[1]]["values"] if len(names) == 4 else [None]
        assert times == sorted({t for x, t, _ in one if x == v}) and levels == sorted({lv for x, _, lv in one if x == v}, key=lambda x: x or 0)
        want = [x for t in times for lv in levels for x in one.get((v, t, lv), [None] * 6)]
        assert r["values"] == want, v
    assert [d["name"] for d in found["one", "a"]["dims"]] == [d["name"] for d in found["one", "b"]["dims"]] != [d["name"] for d in found["one", "d"]["dims"]]
    assert found["two", "a"]["values"] == [1.0, 2.0, None, None, None, None] and len(found["two", "a"]["dims"]) == 3


def test_written_again(spark, tmp_path):
    """A repeated attempt leaves the same bytes; nothing is written for no fields; other stores are refused."""
    df = spark.createDataFrame(rows_of(), SCHEMA)
    arrays.write_arrays(df, f"file://{tmp_path}", SHAPE).collect()
    first = (tmp_path / "one.nc").read_bytes()
    arrays.write_arrays(df.repartition(7), f"file://{tmp_path}", SHAPE, tasks=9).collect()
    assert (tmp_path / "one.nc").read_bytes() == first
    assert not arrays.write_arrays(df.limit(0), f"file://{tmp_path}", SHAPE).collect()
    with pytest.raises(ValueError):
        arrays.write_arrays(df, "s3://bucket/x", SHAPE)


def test_parts_of_grids(spark):
    globe = arrays.Shape(72, 37, 90.0, -5.0, 0.0, 5.0)
    west = arrays.Shape(72, 37, -90.0, 5.0, -180.0, 5.0)

    def longitudes(shape, a, b):
        r = spark.range(1).select(arrays.longitude_range(shape, F.lit(float(a)), F.lit(float(b))).alias("r")).first()["r"]
        return r and (r["first"], r["last"], len(r["values"]), r["values"][0], r["values"][-1])

    assert longitudes(globe, 10, 30) == (2, 6, 5, 10.0, 30.0)
    assert longitudes(globe, -10, 0) == (70, 0, 3, -10.0, 0.0)
    assert longitudes(globe, -20, 12) == (68, 2, 7, -20.0, 10.0)
    assert longitudes(globe, -90, -80) == (54, 56, 3, 270.0, 280.0)
    assert longitudes(globe, 0, 360) == (0, 71, 72, 0.0, 355.0)
    assert longitudes(globe, -180, 180)[2:] == (72, -180.0, 175.0)
    assert longitudes(globe, 101, 104) is None and longitudes(globe, 102, 102) == (20, 20, 1, 100.0, 100.0)
    assert longitudes(west, -20, 12) == (32, 38, 7, -20.0, 10.0)
    assert longitudes(west, 170, 190)[:3] == (70, 2, 5)
    assert longitudes(west, -180, 180)[2:] == (72, -180.0, 175.0)

    def latitudes(shape, a, b):
        r = spark.range(1).select(arrays.latitude_range(shape, F.lit(float(a)), F.lit(float(b))).alias("r")).first()["r"]
        return r and (r["first"], r["last"], r["values"][0], r["values"][-1])

    assert latitudes(globe, 20, 31) == (12, 14, 30.0, 20.0) and latitudes(west, 20, 31) == (22, 24, 20.0, 30.0)
    assert latitudes(globe, -90, 90) == (0, 36, 90.0, -90.0) and latitudes(globe, 41, 44) is None and latitudes(globe, 41, 41) == (10, 10, 40.0, 40.0)


def test_cell_methods(spark):
    rows = [(113, 1, 0, 6, 112, "2001-02-10"), (113, 1, 0, 6, 99, "2001-02-10"), (113, 2, 0, 1, 26, "2001-02-10"), (123, 3, 0, 1, 5, "2001-02-10"), (137, 1, 3, 6, 124, "2001-03-10"), (137, 11, 3, 6, 124, "2001-03-10"), (138, 1, 3, 6, 9, "2001-03-10"), (10, 1, 0, 0, 0, "2001-03-10"), (113, 1, 0, 0, 5, "2001-03-10")]
    df = spark.createDataFrame(rows, "tr int, unit int, p1 int, p2 int, n int, valid string").withColumn("m", arrays.cell_methods(*map(F.col, ("tr", "unit", "p1", "p2", "n")), F.col("valid").cast("date")))
    assert [r["m"] for r in df.collect()] == [
        "time: mean over months", "time: mean over intervals of 6 hours", "time: mean over months", "time: mean over intervals of 1 months", "time: sum over 3 hours time: mean over months",
        "time: sum over 3 6hours time: sum over intervals of 6 6hours", "time: mean over 3 hours time: mean over intervals of 6 hours", None, "time: mean over intervals of 0 hours",
    ]


def test_ranges_are_worked_out(spark):
    """As a look at every place of an axis tells, at bounds on, within rounding of and far from places; no place is looked at for a row."""
    edges = [x * 2.5 + d for x in range(-3, 9) for d in (0.0, 1e-4, -1e-4, 1.00001e-4, 0.99999e-4, -1.00001e-4, 1.25, 0.7)] + [-1e300, 1e300, float("inf"), float("-inf")]
    pairs = [(a, b) for a in edges for b in edges if a <= b] + [(0.0, float("nan")), (float("nan"), 5.0)]
    rows = spark.createDataFrame(pairs, "a double, b double")
    for step in (2.5, -2.5):
        places = [(15 if step < 0 else 0) + j * step for j in range(7)]
        found = rows.select("a", "b", arrays.latitude_range(arrays.Shape(4, 7, places[0], step, 0.0, 90.0), F.col("a"), F.col("b")).alias("r"))
        assert "filter(" not in found._jdf.queryExecution().optimizedPlan().toString()
        for a, b, r in found.collect():
            inside = [j for j, v in enumerate(places) if a - 1e-4 <= v and (v <= b + 1e-4 or b != b)]
            if a == b and abs(a) < 1e9:
                inside = [min(range(7), key=lambda j: (round(abs(places[j] - a), 9), j))]
            if a == b and abs(a) >= 1e9:
                continue
            assert (r and (r["first"], r["last"], r["values"])) == ((inside[0], inside[-1], [places[j] for j in inside]) if inside else None), (a, b)
