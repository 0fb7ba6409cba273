"""Encoders through the readers."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from aeolis.functions import text
from aeolis.sources import binary, sinks

from .test_functions import one


def test_grib1_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    cells = rng.normal(280, 15, (4, 12)).round(3)
    cells[1] = -5.0
    rows = [(dt.datetime(1999 + k, 2, 3, 6), 11, 100, 500, 7, 4, 3, 10.0, -20.0, -10.0, 20.0, [None if k == 2 and i % 5 == 0 else float(v) for i, v in enumerate(c)]) for k, c in enumerate(cells)]
    schema = "ref_time timestamp, param int, level_type int, level int, center int, nx int, ny int, slat double, slon double, elat double, elon double, values array<double>"
    messages = sinks.grib1_messages(spark.createDataFrame(rows, schema)).orderBy("ref_time").collect()
    (tmp_path / "a.grb").write_bytes(b"".join(bytes(r["message"]) for r in messages))
    got = binary.grib1_grids(spark, str(tmp_path / "a.grb")).orderBy("offset").collect()
    assert [r["ref_time"] for r in got] == [f"{1999 + k}-02-03 06:00:00" for k in range(4)]
    assert {(r["nx"], r["ny"], r["slat"], r["slon"], r["elat"], r["elon"]) for r in got} == {(4, 3, 10.0, -20.0, -10.0, 20.0)}
    for r, want in zip(got, rows):
        assert [v is None for v in r["values"]] == [v is None for v in want[-1]]
        pairs = [(a, b) for a, b in zip(r["values"], want[-1]) if b is not None]
        assert max(abs(a - b) for a, b in pairs) < 0.02


def test_netcdf_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 2, [1.0, None, 3.0, 4.0, 5.0, 6.0]), ("a", 1, [0.0] * 6), ("b", 1, [9.0] * 6)], "file string, t int, values array<double>")
    for r in sinks.netcdf_files(df, "file", "t", "temp", 3, 2).collect():
        (tmp_path / f"{r['file']}.nc").write_bytes(bytes(r["content"]))
    rows = {r["name"]: r for r in binary.netcdf_variables(spark, str(tmp_path / "a.nc")).collect()}
    assert rows["time"]["values"] == [1.0, 2.0] and rows["temp"]["values"] == [0.0] * 6 + [1.0, None, 3.0, 4.0, 5.0, 6.0]
    assert [tuple(d)[:2] for d in rows["temp"]["dims"]] == [("time", 2), ("y", 2), ("x", 3)]


def test_f77_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(b"one")), (0, bytearray(b"zero" * 99))], "n int, record binary")
    (tmp_path / "a.bin").write_bytes(b"".join(bytes(r["framed"]) for r in sinks.f77_file(df, "record", "n").collect()))
    assert [bytes(r["record"]) for r in binary.f77_records(spark, str(tmp_path / "a.bin")).orderBy("rec_no").collect()] == [b"zero" * 99, b"one"]


def test_words(spark):
    words = {"tempratur": True, "9:3": False, "1900s": False, "21st": False, "11th": False, "4th": False, "WMO": False, "TS1.3B": False, "v2.0": False, "a@b.co": False, "(iv)": False, "XIV": False, "b)": False, "#": False, ".nc": False, "pre-1950": False, "Ocean": True}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.checked(F.col("w")).alias("c")).collect()
    assert {r["w"]: r["c"] for r in rows} == words
    assert one(spark, text.compound_parts(F.lit("sea-surface"))) == ["sea", "surface", "seasurface"] and one(spark, text.compound_parts(F.lit("sea"))) == []
    assert one(spark, text.html_text(F.lit("<p>A &amp; <b>b</b>c<script>x</script></p><p>d</p>"))) == "A & bc d"
    assert [one(spark, text.resolution_name(F.lit(x)))[:18] for x in (0.25, 2.5, 20.0)] == ["H : 10 km - < 50 k", "H : 250 km - < 500", "H : >= 1000 km or "]
    assert one(spark, text.resolution_name(F.lit(75.0), "km")).startswith("H : 50 km")
    named = lambda *x: one(spark, text.time_resolution_name(*map(F.lit, x)))
    assert [named("climatology", 5, "day"), named("climatology", 1, "day"), named("regular", 6, "hour"), named("irregular", 1, "day")] == ["T : Pentad Climatology", "T : Daily Climatology", "T : Hourly - < Daily", None]
