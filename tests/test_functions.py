"""Column functions against plain Python."""

import math
import random

from pyspark.sql import functions as F

from aeolis.functions import bitmaps, dates, geo, grids, met, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_phonetic(spark):
    def code(w):
        digit = dict(zip("BFPVCGJKQSXZDTLMNR", "111122222222334556"))
        out = [digit[c] for c in w[1:].upper() if c in digit]
        out = [d for i, d in enumerate(out) if not i or d != out[i - 1]]
        return w[0].upper() + "".join(out).ljust(3, "0")

    for w in ("Robert", "rupert", "a", "Tymczak", "pfister", "Honeyman", "lloyd", "mississippi"):
        assert one(spark, text.phonetic(F.lit(w))) == code(w)
    assert one(spark, text.phonetic(F.lit("a1"))) == one(spark, text.phonetic(F.lit(""))) == ""


def test_stem_and_clean(spark):
    assert [one(spark, text.stem(F.lit(w))) for w in ("winds", "running", "oceanic", "tides", "small", "a", "x1")] == ["wind", "run", "ocean", "tid", "smal", "a", ""]
    assert [one(spark, text.clean_word(F.lit(w))) for w in (' "Ocean," ', "(temp)", "<b>x</b>", "...", "a.b.", "it's")] == ["ocean", "temp", "x", None, "a.b", "it's"]


def test_dates(spark):
    d = lambda x: F.lit(x).cast("date")
    assert str(one(spark, dates.add_months_overflow(d("2024-01-31"), 1))) == "2024-03-02"
    assert str(one(spark, dates.add_months_clamped(d("2024-03-31"), -1))) == "2024-02-29"
    t = lambda x: F.lit(x).cast("timestamp")
    assert one(spark, dates.since("hour", t("2024-01-01 05:59:59"), t("2024-01-01 00:00:00"))) == 5
    assert one(spark, dates.since("day", t("2024-01-01"), t("2024-01-02"))) == -1
    assert [one(spark, dates.days_in_month(F.lit(y), F.lit(2), c)) for y, c in ((1900, "standard"), (2000, "standard"), (2000, "noleap"), (2001, "all_leap"), (2001, "360_day"))] == [28, 29, 28, 29, 30]
    assert tuple(one(spark, dates.add_days_360(F.lit(2000), F.lit(12), F.lit(30), 1))) == (2001, 1, 1)
    assert [str(one(spark, dates.synoptic(t(x)))) for x in ("2024-01-01 03:00:00", "2024-01-01 03:00:01", "2024-01-01 21:00:01")] == ["2024-01-01 00:00:00", "2024-01-01 06:00:00", "2024-01-02 00:00:00"]


def test_geo(spark):
    f = lambda *x: [F.lit(float(v)) for v in x]
    assert abs(one(spark, geo.gc_distance(*f(0, 0, 0, 180))) - math.pi * geo.RADIUS) < 1e-6
    assert abs(one(spark, geo.arc_distance(*f(0, 0, 1, 0))) - 111.125) < 1e-9
    box = lambda lat, lon, n: one(spark, geo.box_index(*f(lat, lon), n))
    assert [tuple(box(*x)) for x in ((-90, 5, 1), (90, 5, 1), (0.5, 0.5, 1), (-89.5, -179.5, 1))] == [(0, 0), (181, 0), (91, 180), (1, 0)]
    assert box(91, 0, 1) is None
    center = one(spark, geo.box_center(F.lit(91), F.lit(180)))
    assert (center["lat"], center["lon"]) == (0.5, 0.5)


def test_met(spark):
    assert one(spark, met.relative_humidity(F.lit(10.0), F.lit(10.0))) == 100
    assert one(spark, met.relative_humidity(F.lit(10.0), F.lit(11.0))) is None
    assert abs(one(spark, met.standard_height(F.lit(500.0))) - 5574.4) < 1
    assert abs(one(spark, met.standard_height(F.lit(10.0))) - 31055) < 10
    assert one(spark, met.standard_height(F.lit(1014.0))) is None and one(spark, met.standard_height(F.lit(0.001))) is None
    for u, v, want in ((0, 0, 0), (0, -5, 360), (5, 0, 270), (-5, 0, 90), (0, 5, 180), (3, 3, 225), (-3, 3, 135), (-3, -3, 45), (3, -3, 315)):
        assert one(spark, met.wind_direction(F.lit(float(u)), F.lit(float(v)))) == want
    dry, wet, p = 70.0, 60.0, 29.92
    c = lambda x: (x - 32) * 5 / 9
    hpa = p * 33.8637526
    e = 6.112 * math.exp(17.67 * c(wet) / (243.5 + c(wet)))
    s = 0.62197 * e / (hpa - e)
    m = 1.0
    for _ in range(50):
        m = s + (1006.3 + (m + s) / 2 * 1850) / 2462880 * (c(wet) - c(dry))
    x = math.log(m * hpa / (0.62197 + m) / 6.112)
    assert abs(one(spark, met.dew_point(F.lit(dry), F.lit(wet), F.lit(p))) - (243.5 * x / (17.67 - x) * 9 / 5 + 32)) < 1e-6


def test_bitmaps(spark):
    rng = random.Random(2)
    sets = [[5], [3, 4, 5], [1, 9], [0], list(range(10, 60)), *(rng.sample(range(500), rng.randint(1, 200)) for _ in range(30))]
    df = spark.createDataFrame([(s,) for s in sets], "v array<long>")
    for r in df.select("v", bitmaps.encode(F.col("v")).alias("t"), bitmaps.decode(bitmaps.encode(F.col("v"))).alias("d")).collect():
        assert r["d"] == sorted(set(r["v"]))
    assert one(spark, bitmaps.encode(F.array(*map(F.lit, [3, 4, 5, 6, 7, 10])))) == "3:-5/1001"
    assert one(spark, bitmaps.encode(F.array().cast("array<long>"))) is None


def test_grids(spark):
    v = F.array(*map(F.lit, [1.0, 5.0, 2.0, 9.0, 0.0, 4.0]))
    assert one(spark, grids.reverse_scan(v, 3)) == [9.0, 0.0, 4.0, 1.0, 5.0, 2.0]
    assert one(spark, grids.subset(v, 3, 0, 1, 2, 0)) == [2.0, 1.0, 4.0, 9.0]
    assert one(spark, grids.combine_hemispheres(v, v, 3)) == [1.0, 5.0, 2.0, 9.0, 0.0, 4.0, 9.0, 0.0, 4.0]
    s = one(spark, grids.stats(v, 3))
    assert (s["min"], s["max"], s["min_i"], s["min_j"], s["max_i"], s["max_j"]) == (0.0, 9.0, 2, 2, 1, 2)
