"""Keyed tables, soundings, wrapped text and further readers."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeolis.functions import soundings, text
from aeolis.operators import joins, tables
from aeolis.sources import binary
from aeolis.sources import text as records


def test_tables(spark):
    table = spark.createDataFrame([(1, "a", None), (2, None, 2.0), (None, "n", 0.0)], "k int, s string, x double")
    rows = spark.createDataFrame([(2, "b", None), (3, "c", 1.0), (3, "d", 0.0), (None, "m", 1.0)], "k int, s string, x double")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(tables.upsert(table, rows, "k")) == sorted([(1, "a", None), (2, "b", None), (3, "d", 0.0), (None, "m", 1.0)], key=repr)
    assert {r["k"] for r in tables.insert_new(table, rows.filter("k IS NOT NULL"), "k").collect()} == {1, 2, 3, None}
    assert key(tables.delete(table, F.col("x") < 1)) == sorted([(1, "a", None), (2, None, 2.0)], key=repr)
    assert key(tables.update(table, F.col("k") == 1, {"s": F.lit("z")})) == sorted([(1, "z", None), (2, None, 2.0), (None, "n", 0.0)], key=repr)
    assert key(tables.upsert(table, rows.limit(0), "k")) == key(table)
    assert tables.replace_groups(table, rows.filter("k = 2"), "k").filter("k = 2").first()["s"] == "b"


def test_merge_levels(spark):
    levels = [(1000.0, 10, None), (1000.0, None, 5.0), (1000.0, 11, 5.0), (850.0, None, None), (850.0, None, 1.0), (None, 1, 1.0), (None, 1, 1.0)]
    df = spark.createDataFrame([(levels,), ([],), (None,)], "levels array<struct<p double, z int, t double>>")
    got = [r[0] if r[0] is None else [tuple(x) for x in r[0]] for r in df.select(soundings.merge_levels(F.col("levels"), "p", "z", "t")).collect()]
    assert got == [[(1000.0, 10, 5.0), (1000.0, 11, 5.0), (850.0, None, 1.0), (None, 1, 1.0), (None, 1, 1.0)], [], None]


def test_wrap(spark):
    cases = {"the quick brown fox": "  the quick\n  brown fox", "": "", "abcdefghijklmno pq": "  abcdefghijklmno\n  pq", "one\n\ntwo": "  one\n\n  two"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    for r in df.select("s", text.wrap(F.col("s"), 12, 2).alias("w")).collect():
        assert r["w"] == cases[r["s"]], r


def test_tdl(spark, tmp_path):
    short = "85010203" + "72AB" + "04512" + "-07525"
    long = "1999010203" + "CYYZ" + "07" + " 450001" + "-0750002"
    (tmp_path / "t").write_text("\n".join([short.ljust(107), long.ljust(150), "neither"]) + "\n")
    a, b = sorted(records.tdl_hourly(spark, str(tmp_path / "t")).collect(), key=lambda r: r["ts"])
    assert (str(a["ts"]), a["id"], a["stn_type"], a["lat"], a["lon"]) == ("1985-01-02 03:00:00", "72AB", None, 45.12, -75.25)
    assert (str(b["ts"]), b["id"], b["stn_type"], b["lat"], b["lon"]) == ("1999-01-02 03:00:00", "CYYZ", 7, 45.0001, -75.0002)


def test_cmorph(spark, tmp_path):
    cells = np.arange(1440 * 480, dtype="<f4")
    cells[1] = -9999
    name = tmp_path / "20100102_3hr-025deg_cpc+comb"
    name.write_bytes(cells.tobytes() * 3 + b"short")
    rows = sorted(binary.cmorph_quarter(spark, str(tmp_path)).collect(), key=lambda r: r["rec_no"])
    assert [(str(r["ts"]), r["code"], r["first_lat"]) for r in rows] == [("2010-01-02 00:00:00", "MMP", 59.875), ("2010-01-02 00:00:00", "CMORPH", 59.875), ("2010-01-02 03:00:00", "MMP", 59.875)]
    assert rows[0]["values"][:3] == [0.0, None, 2.0] and len(rows[0]["values"]) == 1440 * 480


def test_gpcp(spark, tmp_path):
    head = "size=(char*200) (real*4)x3x2x12 data file variable=precip units=mm/day year=1990 grid=2.5x2.5deg"
    data = np.array([1, 2, 3, 4, 5, -99999], ">f4").tobytes()
    (tmp_path / "g").write_bytes(head.ljust(200).encode() + data * 2)
    rows = binary.gpcp_grids(spark, str(tmp_path / "g")).collect()
    assert [r["rec_no"] for r in rows] == [0, 1] and rows[0]["values"] == [1.0, 2.0, 3.0, 4.0, 5.0, None]
    assert rows[0]["header"]["year"] == "1990" and rows[0]["header"]["units"] == "mm/day"
    (tmp_path / "bad").write_bytes(b"x" * 100)
    with pytest.raises(Exception):
        binary.gpcp_grids(spark, str(tmp_path / "bad")).collect()


def bufr(edition: int, optional: bytes = b"") -> bytes:
    three = b"\0" + struct.pack(">HB", 2, 0x40) + bytes([0b01000001, 1, 0b11000000 | 1, 11])
    three = (len(three) + 3).to_bytes(3, "big") + three
    flag = 0x80 if optional else 0
    if edition >= 4:
        one = bytes([0]) + struct.pack(">HH", 98, 0) + bytes([0, flag, 2, 0, 0, 19, 0]) + struct.pack(">H", 2011) + bytes([5, 6, 7, 8, 0])
    else:
        one = bytes([0, 0, 7, 0, flag, 2, 0, 19, 0, 99, 5, 6, 7, 8])
    one = (len(one) + 3).to_bytes(3, "big") + one
    two = (len(optional) + 4).to_bytes(3, "big") + b"\0" + optional if optional else b""
    four = (7).to_bytes(3, "big") + b"\0abc"
    body = one + two + three + four + b"7777"
    return b"BUFR" + (len(body) + 8).to_bytes(3, "big") + bytes([edition]) + body


def test_bufr(spark, tmp_path):
    (tmp_path / "b").write_bytes(b"junk BUFR" + bufr(3) + b"\r\n" + bufr(4, b"local") + b"BUFR\0")
    a, b = sorted(binary.bufr_messages(spark, str(tmp_path / "b")).collect(), key=lambda r: r["msg_no"])
    assert (a["edition"], a["centre"], a["category"], a["year"], a["hour"], a["minute"]) == (3, 7, 2, 1999, 7, 8)
    assert (b["edition"], b["centre"], b["category"], b["year"], b["month"], b["day"]) == (4, 98, 2, 2011, 5, 6)
    for r in (a, b):
        assert r["subsets"] == 2 and r["compressed"] and r["descriptors"] == ["101001", "301011"] and bytes(r["data"]) == b"abc"


@pytest.mark.parametrize("ranges", [64, 3])
def test_histories_of_hot_keys(spark, monkeypatch, ranges):
    """Most rows under one key, against all entries of a key in order; no key's history is collected."""
    monkeypatch.setattr(joins, "RANGES", ranges)
    rng = random.Random(3)
    some = lambda top: None if rng.random() < 0.02 else rng.randrange(top)
    draw = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    history = [(draw(), s, None if rng.random() < 0.02 else (s or 0) + rng.randrange(-3, 40), k % 7) for k in range(700) for s in (some(900),)]
    events = [(k, draw(), some(1000)) for k in range(1500)] + [(1500, 9, 5)]
    df = spark.createDataFrame(events, "k long, who long, at long").repartition(3)
    spans = spark.createDataFrame(history, "who long, s long, e long, site long").repartition(3)
    low = lambda x: (x is not None, x or 0)
    for join in (joins.history_join, joins.interval_join):
        want = []
        for k, who, at in events:
            own = sorted((h[1:] for h in history if who is not None and h[0] == who), key=lambda h: [low(x) for x in h])
            due = next((h for h in own if at is not None and h[1] is not None and h[1] >= at), None)
            if join is joins.history_join:
                due = due or (own[-1] if own else None)
            elif due:
                due = next((h for h in own if None not in h[:2] and h[0] <= at <= h[1]), None)
            want.append((k, who, at, due))
        got = join(df, spans, "who", "at", "s", "e")
        assert sorted(((r["k"], r["who"], r["at"], r["entry"] and tuple(r["entry"])) for r in got.collect()), key=lambda r: r[0]) == want
        assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert join(df, spans.limit(0), "who", "at", "s", "e").filter("entry IS NULL").count() == len(events) and join(df.limit(0), spans, "who", "at", "s", "e").count() == 0


def test_marks_beyond_the_broadcast(spark):
    """Marks sorted together with the points give what the broadcast gives."""
    from aeolis.operators import joins

    points = spark.createDataFrame([(i, None if i % 50 == 7 else float(i * 37 % 1000) / 4) for i in range(400)], "i long, x double")
    marks = spark.createDataFrame([(float(m * m % 700) / 2 + 3,) for m in range(90)] + [(None,)], "m double")
    rows = lambda most: sorted(map(tuple, joins.nearest_below_above(points, marks, "x", "m", most).select("i", "x", "below", "above").collect()))
    assert rows(0) == rows(1000)


def test_numbers_of_many_values(spark):
    """Values of many ranges, with repeats and nulls."""
    from aeolis.operators import catalog

    values = [None, *(f"v{i * 7919 % 5000:05}" for i in range(5000))]
    df = spark.createDataFrame([(v,) for v in values for _ in range(2)], "v string")
    order = {v: i for i, v in enumerate(sorted(values, key=lambda v: (v is not None, v or "")))}
    assert {(r["v"], r["c"]) for r in catalog.numbered(df, "v", "c").collect()} == set(order.items())


def test_small_keys_need_no_ranges(spark, monkeypatch):
    """Keys are searched whole where none is large, and in ranges where one is; both tell the same."""
    rows = spark.range(400).selectExpr("id % 7 AS k", "timestamp'2024-01-01' + make_dt_interval(id * 37 % 100) AS ts", "id AS n")
    history = spark.range(60).selectExpr("id % 8 AS k", "timestamp'2024-01-01' + make_dt_interval(id * 11 % 90) AS s", "timestamp'2024-01-01' + make_dt_interval(id * 11 % 90 + id % 9) AS e", "id AS w")
    asked = []
    monkeypatch.setattr(joins, "bounds", lambda *x, f=joins.bounds: asked.append(x) or f(*x))
    found = {}
    for most in (1 << 18, 10):
        monkeypatch.setattr(joins, "RANGE_ROWS", most)
        monkeypatch.setattr(joins, "range_count", lambda n, least=1, most=most: max(least, n // most + 1))
        found[most] = [sorted(map(str, f(rows, history, "k", "ts", "s", "e").collect())) for f in (joins.history_join, joins.interval_join)]
        assert len(asked) == (0 if most > 1000 else 2)
    assert found[10] == found[1 << 18]


def test_groups_give_way_with_and_without_rows(spark):
    table = spark.createDataFrame([(k % 9, k) for k in range(90)] + [(None, 1)], "k int, v int")
    rows = spark.createDataFrame([(2, 100), (11, 110)], "k int, v int")
    groups = spark.createDataFrame([(2,), (2,), (5,), (None,)], "k int")
    want = sorted([(k % 9, k) for k in range(90) if k % 9 not in (2, 5)] + [(None, 1), (2, 100), (11, 110)], key=repr)
    for parts in (1, 7):
        assert sorted(map(tuple, tables.replace_groups(table, rows, "k", groups=groups, parts=parts).collect()), key=repr) == want


def test_partitions_of_replaced_groups_grow_with_the_lines(spark, monkeypatch):
    """What a task sorts is bounded: the lines meet the keys once, in as many partitions as their number asks for."""
    from aeolis.operators import ranges
    from aeolis.plans.queries import QUERIES

    path = "/root/testdata/sf0.001"
    monkeypatch.setattr(ranges, "RANGE_ROWS", 300)
    n = spark.read.parquet(f"{path}/lineitem.parquet").count() // 300 + 1
    found = QUERIES["groups_replaced"](spark, path)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert n > 10 and plan.count("LeftAnti") == 1 and plan.count(f"RepartitionByExpression [l_orderkey") == 2 and f"], {n}" in plan
    lines = spark.read.parquet(f"{path}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity").collect()
    want = [(k, i, 0.0 if k % 5 == 0 else q) for k, i, q in lines if k % 5 or i <= 2]
    assert sorted(map(tuple, found.collect())) == sorted(want)
