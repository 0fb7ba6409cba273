"""Further column functions, readers and catalogue operators."""

import datetime as dt
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeolis.functions import dates, text
from aeolis.operators import catalog
from aeolis.sources import binary
from aeolis.sources import text as readers

from .test_functions import one
from .test_sources import lines, put

L = F.lit
T = dt.datetime


def test_strings(spark):
    cases = [
        (lambda: text.fold_accents(L("Éàñ")), "Ean"), (lambda: text.ascii_lower(L("ÉA")), "Éa"), (lambda: text.is_class(L(""), "alpha"), True), (lambda: text.is_class(L("a1"), "alpha"), False),
        (lambda: text.holds(L("abc"), L("")), False), (lambda: text.holds(L("abc"), L("bc")), True), (lambda: text.occurs(L("aaaa"), L("aa")), 2), (lambda: text.token(L("a/b"), "/", 1), "b"), (lambda: text.token(L("a/b"), "/", 2), ""),
        (lambda: text.csv_split(L('a,"b,""c""",d')), ["a", '"b,""c"""', "d"]), (lambda: text.unquote(L("'x y'")), "x y"), (lambda: text.unquote(L("'x")), "'x"), (lambda: text.with_commas(L("1234567")), "1,234,567"),
        (lambda: text.with_commas(L("1x")), ""), (lambda: text.to_title(L("the wind of the SEA")), "The Wind of the Sea"), (lambda: text.summary(L("a b c"), 2), "a b ..."), (lambda: text.clean_id(L(" é<x> ")), "/&LT;X&GT;"),
        (lambda: text.size_text(L(999)), "999 bytes"), (lambda: text.size_text(L(1239999)), "1.23 MB"),
    ]
    for f, want in cases:
        assert one(spark, f()) == want


def test_times(spark):
    t = lambda s: L(s).cast("timestamp")
    assert one(spark, dates.from_digits(L(20240229123045))) == T(2024, 2, 29, 12, 30, 45)
    assert one(spark, dates.from_digits(L(20241350))) is None
    assert one(spark, dates.add("Hours", t("2024-02-28 23:00:00"), L(2))) == T(2024, 2, 29, 1)
    assert one(spark, dates.cf_time(L(1.5), L("days since 2000-01-01 00:00:00"))) == T(2000, 1, 2, 12)
    assert one(spark, dates.cf_time(L(1.5), L("fortnights since 2000-01-01"))) is None
    assert one(spark, dates.to_precision(t("2024-02-28 23:10:00"), L(2))) == "2024-02"
    product = lambda *x: tuple(one(spark, dates.grib_product(t("2024-01-01"), *map(L, x))))
    assert product(1, 0, 0, 0, 0) == ("Analysis", T(2024, 1, 1), T(2024, 1, 1))
    assert product(11, 0, 2, 0, 0) == ("12-hour Forecast", T(2024, 1, 1, 12), T(2024, 1, 1, 12))
    assert product(2, 3, 0, 31, 0) == ("Monthly Average", T(2024, 1, 1), T(2024, 2, 1))
    assert product(1, 4, 0, 6, 0)[2] == T(2024, 1, 1, 6)
    assert product(1, 123, 0, 6, 4) == ("Mean of 4 Analyses", T(2024, 1, 1), T(2024, 1, 1, 18))


def grib2():
    def section(kind, body):
        return (5 + len(body)).to_bytes(4, "big") + bytes([kind]) + body

    one_ = section(1, struct.pack(">HHBBBHBBBBBBB", 7, 2, 1, 1, 1, 2021, 3, 4, 6, 0, 0, 0, 1))
    grid = bytearray(67)
    grid[1:5], grid[7:9] = (6).to_bytes(4, "big"), (0).to_bytes(2, "big")
    for octet, v in ((31, 3), (35, 2), (47, 10_000_000), (51, 0x80000000 | 5_000_000), (56, 7_500_000), (60, 0)):
        grid[octet - 6 : octet - 2] = v.to_bytes(4, "big")
    product = bytearray(29)
    product[2:4], product[4], product[5], product[12], product[13:17], product[17], product[19:23] = (0).to_bytes(2, "big"), 2, 3, 1, (12).to_bytes(4, "big"), 100, (50000).to_bytes(4, "big")
    out = one_ + section(3, bytes(grid))
    for values, bitmap in (([0, 1, 2, 3, 4, 255], None), ([7, 9], 0b10000100)):
        packing = struct.pack(">IHf", len(values), 0, 1.5) + (0x8001).to_bytes(2, "big") + (1).to_bytes(2, "big") + bytes([8, 0])
        out += section(4, bytes(product)) + section(5, packing) + section(6, bytes([255]) if bitmap is None else bytes([0, bitmap])) + section(7, bytes(values))
    return b"GRIB\0\0" + bytes([0, 2]) + (20 + len(out)).to_bytes(8, "big") + out + b"7777"


def test_grib2(spark, tmp_path):
    (tmp_path / "a.grb2").write_bytes(b"x" + grib2())
    a, b = binary.grib2_grids(spark, str(tmp_path / "a.grb2")).orderBy("field_no").collect()
    assert np.allclose(a["values"], [(1.5 + v / 2) / 10 for v in (0, 1, 2, 3, 4, 255)])
    assert b["values"][1:5] == [None] * 4 and np.allclose([b["values"][0], b["values"][5]], [0.5, 0.6])
    assert (a["ref_time"], a["nx"], a["ny"], a["slat"], a["slon"], a["category"], a["param"], a["fcst_time"], a["level_type"], a["level"]) == ("2021-03-04 06:00:00", 3, 2, 10.0, -5.0, 2, 3, 12, 100, 50000.0)


def test_blocked(spark, tmp_path):
    segment = lambda code, body: (4 + len(body)).to_bytes(2, "big") + bytes([code, 0]) + body
    block = lambda *s: (4 + sum(map(len, s))).to_bytes(2, "big") + b"\0\0" + b"".join(s)
    data = block(segment(0, b"whole"), segment(1, b"be")) + block(segment(3, b"twe")) + block(segment(2, b"en"))
    (tmp_path / "a.vbs").write_bytes(data)
    assert [bytes(r["record"]) for r in binary.vbs_records(spark, str(tmp_path / "a.vbs")).orderBy("rec_no").collect()] == [b"whole", b"between"]
    word = lambda kind, ahead, unused=0: (kind << 60 | unused << 54 | ahead).to_bytes(8, "big")
    cos = word(0, 2) + b"record 1 of 12..." [:16] + word(8, 1, 24) + b"abcde\0\0\0" + word(8, 0, 24) + word(14, 0) + word(15, 0)
    (tmp_path / "a.cos").write_bytes(cos)
    assert [(r["file_no"], bytes(r["record"])) for r in binary.cos_records(spark, str(tmp_path / "a.cos")).orderBy("rec_no").collect()] == [(0, b"record 1 of 1"), (0, b"abcde")]
    (tmp_path / "a.fix").write_bytes(b"aabbc")
    assert [bytes(r["record"]) for r in binary.fixed_records(spark, str(tmp_path / "a.fix"), 2).orderBy("rec_no").collect()] == [b"aa", b"bb", b"c"]
    assert [binary.framing(x) for x in (cos, data, binary.f77_bytes([b"x" * 9]), b"GRIB....")] == ["cos", "vbs", "f77", "plain"]


def test_legacy_numbers():
    assert np.allclose(binary.cray_floats(np.array([(16384 + 1) << 48 | 1 << 47, 1 << 63 | (16384 + 2) << 48 | 3 << 46, 0], np.uint64)), [1.0, -3.0, 0.0])
    assert [binary.overpunched(x) for x in ("12{", "12C", "12L", "12}", "123")] == [120, 123, -123, -120, 123]
    assert binary.ebcdic(bytes([0xC1, 0x40, 0xF1])) == "A 1"


def test_more_readers(spark, tmp_path):
    head = put(102, (0, "H"), (15, "72278 "), (22, " 3"), (38, "1999"), (43, "12"), (46, "31"), (49, "12"), (51, "50"), (57, "   33"), (63, "4281"), (68, " -112"), (74, " 040"), (79, "   337"), (86, "15"), (89, "   2"))
    r = readers.uadb(spark, lines(tmp_path, head, "l1".ljust(50, "."), "l2".ljust(50, "."), head)).collect()
    assert [(x["id"], x["ts"], x["lat"], x["lon"], len(x["levels"])) for x in r] == [("72278", T(1999, 12, 31, 12, 30), 33.4281, -112.0040, 2), ("72278", T(1999, 12, 31, 12, 30), 33.4281, -112.004, 0)]
    r = readers.station_pairs(spark, lines(tmp_path, put(30, (1, "72278"), (7, "23183"), (15, "480101"), (24, "0")))).first()
    assert tuple(r) == (72278, 23183, T(1948, 1, 1), T(2999, 12, 31))
    row = put(43, (1, " 1"), (4, " 72278"), (12, "85070412"), (25, " 33.43"), (31, "-112.00"), (38, "  337")) + f"{1000:5d}{100:6d}{155:5d}{270:5d}{52:5d}" + f"{850:5d}{1500:6d}{-25:5d}{280:5d}{100:5d}"
    r = readers.compare_records(spark, lines(tmp_path, row)).first()
    assert (r["stn"], r["ts"], [tuple(x) for x in r["levels"]]) == (72278, T(1985, 7, 4, 12), [(1000.0, 100.0, 15.5, 270.0, 5.2), (850.0, 1500.0, -2.5, 280.0, 10.0)])


def test_catalog(spark):
    df = spark.createDataFrame([("pressure", 500.0), ("pressure", 850.0), ("depth", 5.0), ("depth", 1.0)], "t string, v double")
    assert [r["v"] for r in df.orderBy(*catalog.level_order(F.col("t"), F.col("v"))).collect()] == [1.0, 5.0, 850.0, 500.0]
    names = spark.createDataFrame([("T62",), ("2.5° x 2.5°",), ("1° x 1°",), ("10° x 10°",), ("octagon",)], "d string")
    assert [r["d"] for r in names.orderBy(*catalog.resolution_order(F.col("d"))).collect()] == ["1° x 1°", "2.5° x 2.5°", "10° x 10°", "octagon", "T62"]
    assert sorted((r["t"], r["c"]) for r in catalog.numbered(df, "t", "c").collect()) == [("depth", 0), ("depth", 0), ("pressure", 1), ("pressure", 1)]
    people = F.array(*(F.struct(L(a).alias("last"), L(b).alias("first")) for a, b in (("Noether", "Emmy"), ("Kovalevskaya", "Sofya"), ("Germain", "Sophie"))))
    assert one(spark, catalog.authors_text(people)) == "Noether, E., S. Kovalevskaya, and S. Germain"
    assert one(spark, catalog.authors_text(people, 2)) == "Noether, E. et al."
    assert one(spark, catalog.citation(F.slice(people, 1, 1), L(1918), L("Invariants"), L("Archive"), L("10.5/x"))) == "Noether, E. (1918). Invariants. Archive. https://doi.org/10.5/x"
    assert one(spark, catalog.bibtex(L("k"), F.slice(people, 1, 1), L(1918), L("Invariants"), L("Archive"), L("10.5/x"))).startswith("@misc{k,\n  author = {Noether, Emmy}")
    doc = one(spark, catalog.dublin_core({"title": L("A & B"), "subject[]": F.array(L("x"), L("y")), "date": L(None).cast("string")}))
    assert doc.endswith("<dc:title>A &amp; B</dc:title><dc:subject>x</dc:subject><dc:subject>y</dc:subject></oai_dc:dc>")
    assert one(spark, catalog.json_ld({"name": L("A")})) == '{"@context":"https://schema.org/","@type":"Dataset","name":"A"}'


@pytest.fixture(autouse=True)
def _spark_started(spark):
    """Column functions need a session."""


def test_largest_unit(spark):
    """A size that has a unit of its own stays in the largest unit that is asked for."""
    assert one(spark, text.size_text(L(1239999999999), "GB")) == "1239.99 GB"
    assert one(spark, text.size_text(L(1239999999999))) == "1.23 TB"
