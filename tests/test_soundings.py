"""Soundings put together, checked and compared; inventories from bitmaps."""

from pyspark.sql import functions as F

from aeolis.functions import bitmaps, soundings
from aeolis.operators import inventories

SOUNDING = "struct<released: int, ended: int, indicators: array<int>, levels: array<struct<p: double, quality: array<string>>>>"
LEVELS = "array<struct<p: double, t: double, w: int>>"
CHECKED = "array<struct<type: int, pressure: double, height: long, temperature: double, moisture: double>>"


def test_appended(spark):
    first = (1, 2, [1, 0, 0], [(900.0, ["5", None, None]), (800.0, None)])
    second = (3, 4, [0, 1, 0], [(700.0, [None, "7", "8"])])
    rows = [(0, first, second), (1, first, None), (2, None, second), (3, None, None), (4, first, (3, 4, [0, 0, 0], []))]
    df = spark.createDataFrame(rows, f"i int, a {SOUNDING}, b {SOUNDING}")
    got = {r["i"]: r["s"] for r in df.select("i", soundings.appended(F.col("a"), F.col("b")).alias("s")).collect()}
    s = got[0]
    assert (s["released"], s["ended"], s["indicators"]) == (1, 4, [1, 1, 0])
    # A kind that one alone reports is "0" in the other, one that neither reports stays as it is.
    assert [(x["p"], x["quality"]) for x in s["levels"]] == [(900.0, ["5", "0", None]), (800.0, None), (700.0, ["0", "7", "8"])]
    assert got[1]["released"] == 1 and len(got[1]["levels"]) == 2 and got[2]["ended"] == 4 and got[3] is None
    assert [x["p"] for x in got[4]["levels"]] == [900.0, 800.0]


def test_combined(spark):
    first, second = [(850.0, 1.0, None), (1000.0, None, 5), (None, 9.0, 9)], [(1000.0, 2.0, 6), (700.0, None, None), (850.0, 3.0, 7)]
    df = spark.createDataFrame([(0, first, second), (1, None, second), (2, first, []), (3, None, None)], f"i int, a {LEVELS}, b {LEVELS}")
    got = {r["i"]: [tuple(x) for x in r["s"]] for r in df.select("i", soundings.combined(F.col("a"), F.col("b"), "p", "t", "w").alias("s")).collect()}
    assert got[0] == [(1000.0, 2.0, 2, 5, 1), (850.0, 1.0, 1, 7, 2), (700.0, None, None, None, None)]
    assert got[1] == [(1000.0, 2.0, 2, 6, 2), (850.0, 3.0, 2, 7, 2), (700.0, None, None, None, None)]
    assert got[2] == [(1000.0, None, None, 5, 1), (850.0, 1.0, 1, None, None)] and got[3] == []


def test_same(spark):
    a = [(1000.0, None, 3)]
    df = spark.createDataFrame([(0, a, [(1000.0 + 1e-11, None, 3)]), (1, a, [(1000.0, 0.0, 3)]), (2, a, a + a), (3, [], []), (4, None, a)], f"i int, a {LEVELS}, b {LEVELS}")
    got = {r["i"]: r["s"] for r in df.select("i", soundings.same(F.col("a"), F.col("b"), "p", "t", "w").alias("s")).collect()}
    assert got == {0: True, 1: False, 2: False, 3: True, 4: None}


def test_hydrostatic_check(spark):
    # Two layers of dry air at 0 degrees: (273.15 + 273.15) * ln(1000 / 900) * 14.63563358 = 842.4 and, to 800, 941.8 metres.
    good = [(0, 1000.0, 100, 0.0, None), (2, 900.0, 942, 0.0, None), (2, 800.0, 1890, 0.0, None)]
    bad = [(2, 1100.0, None, 0.0, None), *good[:2], (0, 850.0, 9000, None, None), (2, 800.0, 2000, 0.0, None)]
    df = spark.createDataFrame([(0, good), (1, bad), (2, []), (3, [(None, 900.0, None, 0.0, None)])], f"i int, levels {CHECKED}")
    got = {r["i"]: r["c"] for r in df.select("i", soundings.hydrostatic_check(F.col("levels"), "humidity", 20).alias("c")).collect()}
    checks = lambda i: [(x["computed"], x["difference"]) for x in got[i]["checks"]]
    assert checks(0) == [(100, 0), (942, 0), (1884, 6)] and (got[0]["status"], got[0]["surface"], got[0]["surfaces"]) == (3, 1, 1)
    # A level without a temperature has no computed height; the next is computed from the last that has both.
    assert checks(1) == [(None, None), (100, 0), (942, 0), (None, None), (1884, 116)] and (got[1]["status"], got[1]["surface"], got[1]["surfaces"]) == (1, 2, 2)
    assert (got[2]["status"], got[2]["surface"], checks(2)) == (3, 0, []) and checks(3) == [(None, None)]


def test_inventories(spark):
    packed = lambda *v: bitmaps.encode(F.array(*(F.lit(x).cast("long") for x in v)))
    fields = spark.createDataFrame([("f", "t"), ("f", "u"), ("g", "T"), ("h", None)], "file string, parameter string").withColumn("ranges", F.when(F.col("file") == "f", packed(3, 10, 4)).when(F.col("file") == "g", packed(10)))
    names = spark.createDataFrame([("U", "3", "b"), ("U", "10", "a"), ("P", "t", "Wind"), ("P", "u", "wind"), ("P", "u", "wind")], "kind string, code string, name string")
    numbered = inventories.numbered_codes(inventories.codes(fields, "file", {"U": "ranges"}, {"P": "parameter"}), names).cache()
    got = {(r["file"], r["kind"], r["code"]): (r["name"], r["number"]) for r in numbered.collect()}
    # Code 4 and parameter T have no names; names that differ by case alone are one parameter.
    assert got == {("f", "U", "3"): ("b", 2), ("f", "U", "10"): ("a", 1), ("f", "U", "4"): ("", 0), ("g", "U", "10"): ("a", 0), ("f", "P", "t"): ("Wind", 0), ("f", "P", "u"): ("wind", 0), ("g", "P", "T"): ("", 0)}
    texts = {r["text"] for r in inventories.legend(numbered, "7!").filter("file = 'f'").collect()}
    assert texts == {"U<!>0<!>4<!>", "U<!>1<!>10<!>a", "U<!>2<!>3<!>b", "P<!>0<!>7!t<!>Wind"}
    rows = spark.createDataFrame([("f", 8, 3, "u"), ("f", 9, 77, None), ("none", 1, 3, "t")], "file string, at int, r int, p string")
    found = inventories.renumbered(rows, numbered, "file", {"U": "r", "P": "p"})
    assert {r[0] for r in found.select(inventories.lines(found, "at", "n_U", "n_P")).collect()} == {"8|2|0", "9||"}


def test_fields_are_read_once_for_all_kinds(spark):
    from aeolis.functions import bitmaps
    from aeolis.operators import inventories

    fields = spark.range(30).selectExpr("id % 3 AS f", "array(id % 5, id % 7 + 90) AS a", "CASE WHEN id % 4 > 0 THEN concat('p', id % 4) END AS p").select("f", bitmaps.encode(F.col("a")).alias("a"), "p")
    found = inventories.codes(fields, "f", {"U": "a"}, {"P": "p"})
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    want = {(i % 3, "U", str(x)) for i in range(30) for x in (i % 5, i % 7 + 90)} | {(i % 3, "P", f"p{i % 4}") for i in range(30) if i % 4}
    assert sorted(map(tuple, found.collect())) == sorted(want)
