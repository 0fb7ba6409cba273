"""Readers on files made here."""

import datetime as dt
import struct

import numpy as np

from aeolis.operators.joins import history_join
from aeolis.sources import binary, text

T = dt.datetime


def put(width, *fields):
    out = [" "] * width
    for at, s in fields:
        out[at : at + len(s)] = s
    return "".join(out)


def lines(tmp_path, *rows):
    (tmp_path / "x.txt").write_text("\n".join(rows) + "\n")
    return str(tmp_path / "x.txt")


def test_tcvitals(spark, tmp_path):
    r = text.tcvitals(spark, lines(tmp_path, put(80, (0, "NHC  05L"), (9, "ERIN"), (19, "20190827 1830"), (33, "321N 0745W"), (52, "1003"), (67, "18")))).first()
    assert tuple(r) == (5, "L", "ERIN", T(2019, 8, 27, 18, 30), 32.1, -74.5, 1003, 18)


def test_hurdat(spark, tmp_path):
    head = put(80, (0, "00005 12/30/1954 M= 2  4 SNBR= 704 ALICE"), (35, "ALICE      "), (47, "XING=0 SSS=0"), (64, "N"), (70, "W"))
    head = put(80, (0, "00005 12/30/1954 M= 2"), (22, " 4"), (35, "ALICE"), (47, "XING=0"), (54, "SSS=0"), (64, "N"), (70, "W"))
    day = lambda n, d, *fixes: put(80, (0, n), (6, d), *((11 + 17 * k, f) for k, f in fixes))
    a = day("00010", "12/31", (0, "*175 590  45 1000"), (3, "E180 610  50    0"))
    b = day("00015", "01/01", (1, "S185 620"))
    end = put(80, (0, "00020 HR"))
    got = [tuple(r) for r in text.hurdat(spark, lines(tmp_path, head, a, b, end, head.replace("ALICE    ", "NOT NAMED"), a, end)).orderBy("name", "ts").collect()]
    assert got[:3] == [
        ("ALICE", "HR", T(1954, 12, 31, 0), "tropical", 17.5, -59.0, 45.0, 1000.0), ("ALICE", "HR", T(1954, 12, 31, 18), "extratropical", 18.0, -61.0, 50.0, 0.0),
        ("ALICE", "HR", T(1955, 1, 1, 6), "subtropical", 18.5, -62.0, None, None),
    ]
    assert [g[0] for g in got[3:]] == ["NOT NAMED-04"] * 2


def test_isd(spark, tmp_path):
    row = put(110, (0, "0005"), (4, "722780"), (10, "23183"), (15, "202001021530"), (28, "+33428"), (34, "-112004"), (41, "FM-15"), (46, "+0337"), (51, "KPHX "), (56, "V020"), (60, "0901N0031199999 9016000"), (87, "+01501+99999102031"), (105, "ADDAA"))
    r = text.isd(spark, lines(tmp_path, row)).first()
    assert (r["id"], r["ts"], r["lat"], r["lon"], r["elev"]) == ("722780-23183-KPHX ", T(2020, 1, 2, 15, 30), 33.428, -112.004, 337)
    assert (r["dd"]["value"], r["dd"]["flag"], r["ff"]["value"], r["tdry"]["value"], r["tdew"]["value"], r["slp"]["value"], r["sections"]) == (90.0, "1", 3.1, 15.0, None, 1020.3, "ADDAA")


def test_td32(spark, tmp_path):
    daily = put(34, (4, "DLY"), (7, "00023183"), (15, "TMAX"), (19, "TF"), (21, "2020"), (25, "02"), (31, "002")) + "0118000750 0" + "0218-99999 1"
    got = [(r["id"], r["ts"], r["value"], r["flags"]) for r in text.td32(spark, lines(tmp_path, daily)).orderBy("ts").collect()]
    assert got == [("00023183", T(2020, 2, 1, 18), 75.0, " 0"), ("00023183", T(2020, 2, 2, 18), None, " 1")]
    monthly = put(34, (4, "MLY"), (7, "00023183"), (15, "TPCP"), (19, "HI"), (21, "2020"), (31, "001")) + "0300000125  "
    assert [(r["ts"], r["value"]) for r in text.td32(spark, lines(tmp_path, monthly)).collect()] == [(T(2020, 3, 1), 1.25)]
    hourly = put(34, (4, "HLY"), (7, "00023183"), (15, "TMPD"), (19, "F "), (21, "2020"), (25, "02"), (29, "03"), (31, "001")) + "1230000041 0"
    r = text.td32(spark, lines(tmp_path, hourly)).first()
    assert (r["type"], r["element"], r["ts"], r["value"]) == ("HLY", "TMPD", T(2020, 2, 3, 12, 30), 41.0)


def test_stations_and_marine(spark, tmp_path):
    row = put(60, (0, "012345"), (16, "1990010100"), (27, "1999123123"), (37, " 45.50"), (44, "350.25"), (50, "     120"))
    history = text.station_history(spark, lines(tmp_path, row))
    assert tuple(history.first()) == ("012345", T(1990, 1, 1), T(1999, 12, 31, 23), 45.5, -9.75, 120)
    events = spark.createDataFrame([("012345", T(1995, 1, 1)), ("012345", T(2005, 1, 1)), ("9", T(1995, 1, 1))], "id string, ts timestamp_ntz")
    assert sorted((r["entry"] is None, r["id"]) for r in history_join(events, history, "id", "ts", "start", "end").collect()) == [(False, "012345"), (False, "012345"), (True, "9")]
    bt = put(100, (0, "XB"), (3, "30450N"), (10, "120300W"), (18, "85"), (20, "0704"), (24, "1230"), (44, "AB"), (48, "CD"), (95, "0002")).rstrip("\n") + "00001850" + "00101725"
    r = text.bathythermographs(spark, lines(tmp_path, bt)).first()
    assert (r["type"], r["id"], r["ts"], r["lat"], r["lon"], [tuple(x) for x in r["levels"]]) == ("XB", "ABCD", T(1985, 7, 4, 12, 30), 30.75, -120.5, [(0, 18.5), (10, 17.25)])
    sl = put(40, (0, "STATION1"), (8, "1230S"), (13, "04515W"), (19, "6"), (20, "2000"), (24, "02"), (30, "0000"), (34, "01234"))
    r = text.sea_level(spark, lines(tmp_path, sl)).first()
    assert (r["format"], r["ts"], r["lat"], r["lon"], r["height"]) == ("F186", T(2000, 2, 29), -12.5, -45.25, 1234)
    imma = put(108, (0, "1900"), (4, " 1"), (6, " 2"), (8, "1250"), (12, " 4512"), (17, " 35025"), (23, " 1"), (32, " 5"), (34, "SHIPNAME"))
    r = text.marine(spark, lines(tmp_path, imma)).first()
    assert (r["id"], r["ts"], r["lat"], r["lon"]) == ("SHIPNAME", T(1900, 1, 2, 12, 30), 45.12, -9.75)


def test_little_r(spark, tmp_path):
    head = put(600, (0, "            45.00000"), (20, "           350.00000"), (40, "72278"), (123, " 35"), (279, "T"), (326, "20200102120000"))
    row = lambda *v: "".join(f"{x:13.5f}{0:7d}" for x in v)
    level = row(100000, 10, 280.15, -888888, 5, 90, -888888, -888888, 50, -888888)
    end = row(-777777, -777777, 1, -888888, -888888, -888888, -888888, -888888, -888888, -888888)
    got = text.little_r(spark, lines(tmp_path, head, level, level, end, f"{2:7d}{0:7d}{0:7d}", head, level, end, f"{1:7d}{0:7d}{0:7d}")).collect()
    assert [(r["id"], r["ts"], r["lon"], r["sounding"], len(r["levels"])) for r in got] == [("72278", T(2020, 1, 2, 12), -10.0, True, 2), ("72278", T(2020, 1, 2, 12), -10.0, True, 1)]
    assert got[0]["levels"][0]["dew_point"] is None and got[0]["levels"][0]["temperature"] == 280.15


def test_f77(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(binary.f77_bytes([b"one", b"", b"three" * 100]))
    got = [(r["rec_no"], r["offset"], bytes(r["record"])) for r in binary.f77_records(spark, str(tmp_path / "a.bin")).orderBy("rec_no").collect()]
    assert got == [(0, 0, b"one"), (1, 11, b""), (2, 19, b"three" * 100)]


def netcdf(version):
    """x(2), t unlimited with 3 records; a fixed double, a char, and two record variables of odd sizes."""
    n = lambda v: struct.pack(">q" if version == 5 else ">i", v)
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: n(len(s)) + pad(s.encode())
    tag = lambda k, c: struct.pack(">i", k) + n(c)
    text_attribute = name("units") + struct.pack(">i", 2) + n(1) + pad(b"m")
    variables = [("x", [0], 6, struct.pack(">2d", 1.5, -2)), ("c", [0], 2, b"hi"), ("s", [1, 0], 3, [struct.pack(">2h", k, -32767) for k in range(3)]), ("b", [1], 1, [struct.pack(">b", k) for k in range(3)])]

    def build(begins):
        out = b"CDF" + bytes([version]) + n(3) + tag(10, 2) + name("x") + n(2) + name("t") + n(0) + tag(12, 1) + text_attribute + tag(11, 4)
        for (v, dims, kind, _), begin in zip(variables, begins):
            out += name(v) + n(len(dims)) + b"".join(map(n, dims)) + tag(12, 1) + text_attribute + struct.pack(">i", kind) + n(4) + struct.pack(">i" if version == 1 else ">q", begin)
        return out

    at = len(build([0] * 4))
    data, begins = b"", []
    for _, _, _, body in variables[:2]:
        begins.append(at + len(data))
        data += pad(body)
    begins += [at + len(data), at + len(data) + 4]
    for k in range(3):
        data += variables[2][3][k] + pad(variables[3][3][k])
    return build(begins) + data


def test_netcdf(spark, tmp_path):
    for version in (1, 2, 5):
        (tmp_path / f"v{version}.nc").write_bytes(netcdf(version))
    for version in (1, 2, 5):
        rows = {r["name"]: r for r in binary.netcdf_variables(spark, str(tmp_path / f"v{version}.nc")).collect()}
        assert rows["x"]["values"] == [1.5, -2.0] and rows["x"]["is_coord"] and rows["x"]["attrs"] == {"units": "m"} and rows["x"]["global_attrs"] == {"units": "m"}
        assert rows["c"]["text"] == "hi" and rows["s"]["values"] == [0.0, None, 1.0, None, 2.0, None] and rows["b"]["values"] == [0.0, 1.0, 2.0]
        assert [tuple(d) for d in rows["s"]["dims"]] == [("t", 3, True), ("x", 2, False)]


def grib1(values, bitmap=None):
    pds = bytearray(28)
    pds[:3], pds[3], pds[4], pds[5], pds[7], pds[8], pds[9], pds[10:12] = (28).to_bytes(3, "big"), 2, 7, 80, 0x80 | (0x40 if bitmap else 0), 11, 100, (500).to_bytes(2, "big")
    pds[12:17], pds[17], pds[24], pds[26:28] = bytes([99, 12, 31, 18, 0]), 1, 20, (1).to_bytes(2, "big")
    gds = bytearray(32)
    gds[:3], gds[4], gds[6:8], gds[8:10] = (32).to_bytes(3, "big"), 255, (3).to_bytes(2, "big"), (2).to_bytes(2, "big")
    gds[10:13], gds[13:16], gds[17:20], gds[20:23] = (10000).to_bytes(3, "big"), (0x800000 | 5000).to_bytes(3, "big"), (7500).to_bytes(3, "big"), (0).to_bytes(3, "big")
    bms = (6 + 1).to_bytes(3, "big") + bytes([2, 0, 0, int(bitmap + "00", 2)]) if bitmap else b""
    packed = np.packbits(np.array([[int(x) for x in f"{v:012b}"] for v in values]).ravel()).tobytes()
    reference = (0x41100000).to_bytes(4, "big")  # 1.0
    bds = (11 + len(packed)).to_bytes(3, "big") + bytes([0]) + (0x8001).to_bytes(2, "big") + reference + bytes([12]) + packed
    body = bytes(pds) + bytes(gds) + bms + bds + b"7777"
    return b"GRIB" + (8 + len(body)).to_bytes(3, "big") + b"\1" + body


def test_grib1(spark, tmp_path):
    (tmp_path / "a.grb").write_bytes(b"junk" + grib1([0, 1, 2, 3, 4, 4095]) + grib1([8, 6], "100001"))
    a, b = binary.grib1_grids(spark, str(tmp_path / "a.grb")).orderBy("offset").collect()
    assert np.allclose(a["values"], [(1 + v / 2) / 10 for v in (0, 1, 2, 3, 4, 4095)])
    assert b["values"][1:5] == [None] * 4 and np.allclose([b["values"][0], b["values"][5]], [0.5, 0.4])
    assert (a["param"], a["level_type"], a["level"], a["ref_time"], a["nx"], a["ny"], a["slat"], a["slon"], a["elat"]) == (11, 100, 500, "1999-12-31 18:00:00", 3, 2, 10.0, -5.0, 7.5)


def test_ibm_floats():
    assert np.allclose(binary.ibm_floats(np.array([0x41100000, 0xC276A000, 0])), [1.0, -118.625, 0.0])


def test_levels_are_worked_out_once(spark):
    """No filter ahead of the explode holds the levels again."""
    from aeolis.plans import records

    for query in (records.compared_levels, records.little_r_levels):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert sum("try_cast" in x for x in plan.split("\n") if x.strip(" +-:").startswith("Filter")) == 0
