"""Packed grids built bit by bit, and the readers of climate summaries and aircraft reports."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeolis.sources import binary, packed
from aeolis.sources import text as readers


def record(length, fields):
    """fields: (first bit, width, number)."""
    bits = np.zeros(8 * length, np.uint8)
    for first, width, n in fields:
        bits[first : first + width] = [int(x) for x in f"{n:0{width}b}"]
    return np.packbits(bits).tobytes()


def cells(first, width, numbers):
    return [(first + k * width, width, n) for k, n in enumerate(numbers)]


BASE = [(121, 11, 1024), (132, 48, 500)]


@pytest.mark.parametrize("kind", ["octagonal", "latlon_5", "latlon_2.5", "navy"])
def test_scaled(spark, tmp_path, kind):
    layout = packed.LAYOUTS[kind]
    n = 1977 if kind == "octagonal" else layout.nx * layout.ny
    raw = [k % 60 for k in range(n)]
    head = [(6, 7, 63), (13, 4, 2), (17, 5, 28), (22, 5, 12), (27, 10, 523), (37, 9, 7), (46, 9, 24)] + BASE + [(*layout.head["bias"], 10), (*layout.head["scale"], 9)]
    mean = [(6, 7, 63), (13, 4, 2), (*layout.head["n_mean"], 31)] + BASE
    (tmp_path / "x").write_bytes(record(layout.length, head + cells(layout.first, layout.width, raw)) + record(layout.length, mean) + b"rest")
    one, two = packed.packed_file(spark, str(tmp_path / "x"), kind).orderBy("rec_no").collect()
    assert (one["ref_time"], one["valid_time"], one["level1"], one["param"]) == (dt.datetime(1963, 2, 28, 12), dt.datetime(1963, 3, 1, 12), 500, 7)
    assert (two["ref_time"], two["n_mean"], one["n_mean"]) == (None, 31, 0) and set(two["values"]) == {None}
    inside = [v for row, r in enumerate(np.array(one["values"], object).reshape(layout.ny, layout.nx)) for v in (r[slice(*np.add(layout.columns[row], (0, 1)))] if layout.columns else r)]
    assert inside == [500 + (r - 10) / 2 if r else None for r in raw]
    assert len(one["values"]) == layout.nx * layout.ny and sum(v is not None for v in one["values"]) == sum(r > 0 for r in raw)


def test_octagon_has_its_points():
    assert sum(hi - lo + 1 for lo, hi in packed.LAYOUTS["octagonal"].columns) == 1977


def test_negative_base():
    bits = np.unpackbits(np.frombuffer(record(8, [(0, 1, 1), (1, 11, 1020), (12, 48, 80)]), np.uint8))[None]
    assert packed.cdc_floats(bits, 0)[0] == -80 / 8


def test_sea_level_pressure(spark, tmp_path):
    slp = record(2048, [(6, 11, 1963), (17, 4, 5), (21, 5, 0), (41, 9, 2), *cells(120, 15, [10132, 16384 + 9999, 0, 16384])])
    (tmp_path / "a").write_bytes(slp)
    r = packed.packed_file(spark, str(tmp_path / "a"), "slp").first()
    assert np.allclose(r["values"][:2], [1013.2, 999.9]) and r["values"][2:5] == [None] * 3 and (r["year"], r["n_mean"], r["ref_time"]) == (1963, 999, None)
    (tmp_path / "b").write_bytes(record(1158, [(0, 16, 1972), (16, 16, 3), (32, 16, 4), *cells(48, 16, [132, 0x10000 - 50, 0x7FFF])]))
    r = packed.packed_file(spark, str(tmp_path / "b"), "slp_ussr").first()
    assert np.allclose(r["values"][:2], [1013.2, 995.0]) and r["values"][2] is None and r["ref_time"] == dt.datetime(1972, 3, 4, 12)
    rows = [x for k in range(36) for x in ((0x10000 - 10 * k) & 0xFFFF, *[10 * k + i for i in range(14)], 0x8000)]
    (tmp_path / "c").write_bytes(record(1184, [(32, 16, 40), (48, 16, 30), (64, 16, 720), *cells(256, 16, rows)]))
    r = packed.packed_file(spark, str(tmp_path / "c"), "slp_uk").first()
    grid = np.array(r["values"], float).reshape(15, 36)
    assert np.allclose(grid[2], 1000 + (10 * np.arange(36) + 2) / 10) and np.isnan(grid[14]).all() and r["ref_time"] == dt.datetime(1972, 3, 4)


def test_weeks(spark, tmp_path):
    head = f"{1990:5}{1:5}{3:5}{1990:5}{1:5}{9:5}{7:5}{'v2':>10}"
    body = "\n".join("".join(f"{(i + k) % 300 - 18:4}" for k in range(20)) for i in range(180 * 18))
    (tmp_path / "w").write_text("\n".join([head, body, head, body]) + "\n")
    rows = packed.sea_surface_weeks(spark, str(tmp_path / "w")).collect()
    assert len(rows) == 2 and (rows[1]["rec_no"], rows[0]["n_mean"], rows[0]["version"]) == (1, 7, "v2")
    assert rows[0]["values"][:2] == [-1.8, -1.7] and len(rows[0]["values"]) == 360 * 180


def placed(fields, width):
    out = [" "] * width
    for at, s in fields:
        out[at : at + len(s)] = s
    return "".join(out)


def test_summaries(spark, tmp_path):
    daily = placed([(1, "19990301"), (9, " 21.5"), (14, " -3.0"), (109, " 45")], 112)
    monthly = placed([(1, "199903"), (7, "99123"), (12, " 11.0"), (62, "   88.1")], 144)
    old = placed([(0, "790402"), (7, "7 503"), (17, "  4050"), (23, " 28000"), (29, "  120"), (34, "  215"), (40, "1"), (41, "  -30"), (47, "9"), (48, "   15"), (54, "8")], 55)
    (tmp_path / "s").write_text("\n".join([daily, monthly, old, "0123 x"]) + "\n")
    rows = {r["layout"]: r for r in readers.climate_summaries(spark, str(tmp_path / "s")).collect()}
    assert set(rows) == {"daily", "monthly", "old_daily"}
    assert rows["daily"]["data"] == {"tmax": 21.5, "tmin": -3.0, "mnrh": 45.0} and rows["daily"]["day"] == 1
    assert (rows["monthly"]["id"], rows["monthly"]["library_id"], rows["monthly"]["day"], rows["monthly"]["data"]) == ("123", "K123  ", None, {"tmean": 11.0, "rpcp": 88.1})
    r = rows["old_daily"]
    assert (r["id"], r["year"], r["lat"], r["lon"], r["elev"], r["data"]) == ("70503", 1979, 40.5, 80.0, 120, {"tmax": 21.5})


def test_aircraft(spark, tmp_path):
    line = placed([(4, "AB12"), (12, "7001021830"), (22, "6"), (23, "105"), (26, "250"), (29, "350"), (41, "27"), (43, " 85"), (98, "4K"), (104, "12")], 110)
    blank = placed([(4, "AB13"), (12, "7001021830"), (22, "*"), (98, " *")], 110)
    (tmp_path / "t").write_text(line + "\n" + blank + "\n")
    a, b = readers.aircraft_reports(spark, str(tmp_path / "t")).orderBy("id").collect()
    assert tuple(a) == ("AB12", dt.datetime(1970, 1, 2, 18, 30), -10.5, -125.0, 35000, 270, 85, -42, "dew_point_depression")
    assert tuple(b)[2:] == (None,) * 7


def test_only_what_is_needed(spark, tmp_path):
    (tmp_path / "x").write_bytes(record(2048, [(6, 11, 1963)]))
    assert packed.packed_file(spark, str(tmp_path / "x"), "slp").filter(F.col("year") == 1900).count() == 0


def test_reports(spark, tmp_path):
    hourly = record(16, [(16, 24, 6158350), (40, 12, 1977), (52, 4, 12), (56, 5, 31), (61, 5, 20), (66, 4, 3), (70, 14, 4367), (84, 16, 18000 - 7938), (100, 14, 112)])
    month = lambda m, *cells: [(332 + 75 * m + at, width, n) for (at, width), n in zip(((1, 15), (18, 15), (33, 13), (46, 11), (57, 18)), cells)]
    climate = record(156, [(16, 6, 63), (22, 2, 1), (27, 21, 72469), (48, 12, 1961), (64, 11, 1398), (75, 12, 2000 + 1049), (87, 14, 2625), *month(0, 10132, 20000, 5000, 1000 - 15, 431), *month(11, 20000, 8341, 1500, 1990, 150000)])
    (tmp_path / "r").write_bytes(binary.report_blocks([hourly] * 300 + [climate] * 60))
    records = binary.report_records(spark, str(tmp_path / "r"))
    assert records.count() == 360 and records.select("block_no").distinct().count() > 1
    r = packed.hourly_reports(records.filter("rec_no = 7")).first()
    assert tuple(r) == ("6158350", dt.datetime(1978, 1, 1, 1), 43.67, -79.38, 112)
    rows = packed.station_climate(records.filter("rec_no = 359")).orderBy("month").collect()
    assert len(rows) == 12 and tuple(rows[0])[:6] == ("072469", 1961, 39.8, -104.9, 1625, 1)
    assert tuple(rows[0])[7:] == (1013.2, None, None, -1.5, 43.1, False) and tuple(rows[11])[7:] == (None, 834.1, 1500.0, None, None, True)


def complex_section(values, order, missing, width=9):
    """Section 5 and the data of section 7 for groups of three values; None is missing."""
    bits = lambda numbers, w: np.packbits([int(c) for n in numbers for c in (f"{n:0{w}b}" if w else "")]).tobytes()
    known = [v for v in values if v is not None]
    diff, extra = np.array(known), []
    if order:
        extra = known[:order]
        diff = np.concatenate([np.zeros(order, int), np.diff(known, order)])
        least = int(diff[order:].min())
        diff = np.concatenate([np.zeros(order, int), diff[order:] - least])
        extra = [*extra, least]
    numbers = iter(diff.tolist())
    whole = [None if v is None else next(numbers) for v in values]
    groups = [whole[i : i + 3] for i in range(0, len(whole), 3)]
    refs, widths, body = [], [], ""
    for g in groups:
        some = [v for v in g if v is not None]
        if not some:
            refs.append(2**width - 1)
            widths.append(0)
            continue
        low = min(some)
        w = max(1, (max(some) - low + 1 + missing).bit_length()) if None in g or max(some) > low else 0
        refs.append(low)
        widths.append(w)
        body += "".join(f"{2**w - 1 if v is None else v - low:0{w}b}" for v in g) if w else ""
    p = bytearray(49)
    for first, size, n in ((6, 4, len(values)), (10, 2, 3 if order else 2), (20, 1, width), (23, 1, missing), (32, 4, len(groups)), (36, 1, 0), (37, 1, 5), (38, 4, 3), (42, 1, 1), (43, 4, len(groups[-1])), (47, 1, 0), (48, 1, order), (49, 1, 2)):
        p[first - 1 : first - 1 + size] = n.to_bytes(size, "big")
    head = b"".join((abs(x) | (0x8000 if x < 0 else 0)).to_bytes(2, "big") for x in extra)
    return bytes(p), head + bits(refs, width) + bits(widths, 5) + np.packbits([int(c) for c in body]).tobytes()


@pytest.mark.parametrize("order", [0, 1, 2])
@pytest.mark.parametrize("missing", [0, 1])
def test_groups(order, missing):
    rng = np.random.default_rng(3)
    values = [5, 5, 5, *(int(v) for v in rng.integers(0, 60, 40))]
    if missing:
        values[6:9] = [None] * 3
        values[11] = values[20] = None
    p, data = complex_section(values, order, missing)
    found = binary._grouped(data, p, len(values))
    assert [None if np.isnan(v) else int(v) for v in found] == values
