"""Templates, rules with fallback and ranges by rows."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from aeolis.functions import templates
from aeolis.operators import catalog, joins, ranges, rules


def one(spark, template, indent=0, **kw):
    row = "array(named_struct('a', 'x.1', 'b', cast(null as string), 'm', array('p', 'q')), named_struct('a', 'y', 'b', 'LIST.a', 'm', array())) AS pairs, array('LIST', 'u', null) AS strings, true AS yes, cast(null as boolean) AS no, 'NAME' AS name, cast(null as string) AS none"
    df = spark.sql(f"SELECT {row}")
    conditions = {"YES": F.col("yes"), "NO": F.col("no")}
    return templates.rendered(df, template, "d", conditions, {"LIST": F.col("pairs"), "S": F.col("strings"), "NONE": F.lit(None).cast("array<string>")}, {"NAME": F.col("name"), "NAMES": F.lit(5), "VOID": F.col("none")}, indent).first()["d"]


@pytest.mark.parametrize(
    "template, want",
    [
        ("", ""),
        ("@ comment\na NAME NAMES VOID\n", "a NAME 5 VOID"),
        ("a\\\nb\nc", "ab\nc"),
        ("#IF YES\n1\n#ENDIF YES\n#IF !YES\n2\n#ENDIF !YES\n#IF NO\n3\n#ENDIF NO\n#ELSE NO\n4\n#ENDELSE NO\n#IF !other\n5\n#ENDIF !other\n", "1\n4\n5"),
        ("#REPEAT S\n$LOOP_COUNT:S\n#ENDREPEAT S\n#REPEAT NONE\nn\n#ENDREPEAT NONE\n#REPEAT GONE\ng\n#ENDREPEAT GONE\n", "0:LIST\n1:u\n2:S"),
        ("#REPEAT LIST\nLIST.a LIST.b\n!REPIF LIST.b\nhas LIST.b\n!ENDREPIF LIST.b\n#REPEAT LIST.m\n-$LOOP_COUNT LIST.m LIST.a\n#ENDREPEAT LIST.m\n#IF ^a.!.x\nX\n#ENDIF ^a.!.x\n#ENDREPEAT LIST\n", "x.1 LIST.b\n-0 p x.1\n-1 q x.1\nX\ny LIST.a\nhas LIST.a"),
        ("#REPEAT S\n$($LOOP_COUNT + 1) $($LOOP_COUNT-2) $($LOOP_COUNT*2.5) $(7/2) $(-7/2) $(7/2.0) $(7%4) $(1/$LOOP_COUNT) $(S)\n#ENDREPEAT S\n$(1+1)\n", None),
    ],
)
def test_templates(spark, template, want):
    if want is None:
        lines = [f"{i + 1} {i - 2} {('0', '2.500000', '5')[i]} 3 -3 3.500000 3 {('$(1/$LOOP_COUNT)', '1', '0')[i]} $(S)" for i in range(3)]
        want = "\n".join([*lines, "$(1+1)"])
    assert one(spark, template) == want


def test_templates_indent_and_faults(spark):
    assert one(spark, "a\\\nb\n#REPEAT S\nS\n#ENDREPEAT S\n", 2) == "  a  b\n  LIST\n  u\n  S"
    for bad in ("#IF a\n", "#IF a\n#ENDIF b\n", "#ENDIF a\n", "#REPEAT S\n#IF a\n#ENDREPEAT S\n#ENDIF a\n"):
        with pytest.raises(ValueError):
            templates.parse(bad)
    with pytest.raises(ValueError):
        templates.rendered(spark.range(1), "#REPEAT a\n#ENDREPEAT a\n", "d", repeats={"a": F.col("id")})


@pytest.mark.parametrize("most", [0, 1000])
def test_most_specific(spark, most):
    rng = random.Random(5)
    some = lambda top: None if rng.random() < 0.3 else f"v{rng.randrange(top)}"
    levels = (("a", "b", "c"), ("a", "b"), ("a", "c"), ("a",), ())
    table = [(some(4), some(3), some(3), f"r{i % 37}" if i % 11 else None) for i in range(60)]
    rows = [(i, some(5), some(4), some(4)) for i in range(300)]
    asked = spark.createDataFrame(rows, "i int, a string, b string, c string")
    for given in (table, [r for r in table if any(r[:3])], []):
        want = []
        for i, *own in rows:
            found = None
            for level in levels:
                held = {k: v for k, v in zip("abc", own)}
                hits = [r[3] for r in given if r[3] is not None and all((x is not None and x == held[k]) if k in level else x is None for k, x in zip("abc", r))]
                found = min(hits) if hits and found is None else found
            want.append((i, *own, found))
        got = rules.most_specific(asked, spark.createDataFrame(given, "a string, b string, c string, v string"), levels, "v", most)
        assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
    with pytest.raises(ValueError):
        rules.most_specific(asked, asked, levels, "i")


def test_keyword_rules(spark):
    one = '<parameterMap><title>T</title><parameter code="11"><shortName>t</shortName><GCMD>any</GCMD><GCMD ifLevelType="100">type</GCMD><GCMD ifLevelType="100" ifLevelValue="500">both &amp; more</GCMD><CF>cf</CF></parameter><parameter code="12"/></parameterMap>'
    two = '<parameterMap><parameter code="11"><GCMD>special</GCMD></parameter></parameterMap>'
    maps = spark.createDataFrame([("grib", one), ("grib.7", two), ("none", "<parameterMap/>"), ("void", None)], "map string, xml string")
    table = rules.keyword_rules(maps, "map", "xml")
    assert table.count() == 5
    rows = [("grib", "11", "100", "500"), ("grib", "11@x", "100", "1"), ("grib", "9:11", "1", None), ("grib", "7:11@y", "100", "500"), ("grib", "7:12", None, None), ("other", "11", "100", "500"), (None, None, None, None)]
    asked = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, format string, parameter string, level_type string, level_value string")
    got = {r["i"]: r["keyword"] for r in rules.keywords(asked, table, "GCMD").collect()}
    assert got == {0: "both & more", 1: "type", 2: "any", 3: "special", 4: None, 5: None, 6: None}


def test_places_in_blocks(spark):
    rng = random.Random(2)
    for n in (0, 1, 127, 128, 129, 1000):
        values = sorted(rng.sample(range(5000), n))
        asked = [None, -1, 6000, *(rng.randrange(5000) for _ in range(50)), *values[:3], *values[-3:]]
        df = spark.createDataFrame([(x, values) for x in asked], "x int, v array<int>").withColumn("cut", ranges.blocks(F.col("v")))
        for r in df.select("x", ranges.place(F.col("cut"), F.col("x")).alias("n"), ranges.below(F.col("cut"), F.col("x")).alias("lo"), ranges.above(F.col("cut"), F.col("x")).alias("hi")).collect():
            x = r["x"]
            assert r["n"] == (0 if x is None else bisect.bisect_left(values, x))
            assert r["lo"] == (None if x is None else max((v for v in values if v <= x), default=None))
            assert r["hi"] == (None if x is None else min((v for v in values if v >= x), default=None))


def test_ranges_grow_with_rows(spark, monkeypatch):
    """One key holds all rows: ranges are many and none holds much more than its share; joins stay right."""
    monkeypatch.setattr(ranges, "RANGE_ROWS", 20)
    rows = spark.range(6000).select((F.col("id") * 7919 % 6000).alias("at"))
    n = ranges.range_count(6000)
    assert n == 301
    placed = rows.join(F.broadcast(ranges.bounds(rows, "at", n))).groupBy(ranges.place(F.col("cuts"), F.col("at")).alias("r")).count()
    assert placed.count() > 290 and placed.agg(F.max("count")).first()[0] <= 3 * 20
    events = spark.range(3000).select(F.lit(1).alias("who"), (F.col("id") * 31 % 3100).alias("at"))
    spans = spark.range(300).select(F.lit(1).alias("who"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 4).alias("e"))
    got = {(r["at"], r["entry"]["s"] if r["entry"] else None) for r in joins.interval_join(events, spans, "who", "at", "s", "e").collect()}
    assert got == {(x, x - x % 10 if x % 10 <= 4 and x < 3000 else None) for x in (i * 31 % 3100 for i in range(3000))}
    marks, points = spark.range(500).selectExpr("id * 3 AS m"), spark.range(800).selectExpr("id * 2 AS x")
    near = lambda most: sorted(map(tuple, joins.nearest_below_above(points, marks, "x", "m", most).collect()), key=repr)
    assert near(0) == near(1000)
    values = spark.range(4000).selectExpr("concat('v', id * 7919 % 4000) AS v")
    assert {r["v"]: r["c"] for r in catalog.numbered(values, "v", "c").collect()} == {v: i for i, v in enumerate(sorted(f"v{i}" for i in range(4000)))}
