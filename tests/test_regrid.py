"""Sparse weights between grids: formulas worked out one cell at a time, missing cells, and both forms of fields."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeolis.operators import regrid

LATLON = regrid.Regular(72, 19, 0.0, 5.0, 0.0, 5.0)


def row(v, d):
    """Four values by the textbook's 16-point form."""
    return v[1] + d * (v[2] - v[1] + (d - 1) / 4 * (v[3] - v[2] + v[0] - v[1]))


def at_place(field, lat, lon):
    """A value of 19 rows of 72 from the equator, cell by cell; rows beyond the pole are those of the opposite meridian."""
    x, y = lon % 360 / 5, lat / 5
    i, j = math.floor(x + 1e-9), math.floor(y + 1e-9)

    def cell(a, b):
        return field[36 - b][(a + 36) % 72] if b > 18 else field[b][a % 72]

    return row([row([cell(i + a, j + b) for a in range(-1, 3)], x - i) for b in range(-1, 3)], y - j)


def octagon():
    for j in range(51):
        cut = max(0, 14 - j, j - 36)
        for i in range(cut, 47 - cut):
            x, y = i - 23, j - 25
            lat = math.degrees(math.asin((973.712023868 - x * x - y * y) / (973.712023868 + x * x + y * y)))
            lon = 270 if x == 0 and y <= 0 else math.degrees(math.atan2(y, x)) % 360
            yield j * 47 + i, lat, lon + 10


def made(spark, fields):
    return spark.createDataFrame([(k, 6, [None if math.isnan(x) else float(x) for x in np.ravel(f)]) for k, f in enumerate(fields)], "id int, param int, values array<double>").repartition(2)


def test_latlon_to_octagonal(spark):
    rng = np.random.default_rng(1)
    fields = [rng.normal(size=(19, 72)) for _ in range(3)]
    got = {r["id"]: r for r in regrid.latlon_to_octagonal(made(spark, fields), LATLON).collect()}
    for k, f in enumerate(fields):
        want = {c: at_place(f, lat, lon) for c, lat, lon in octagon()}
        values = got[k]["values"]
        assert {c for c, v in enumerate(values) if v is not None} == set(want)
        assert max(abs(values[c] - v) for c, v in want.items()) < 1e-3
        assert np.median([abs(values[c] - v) for c, v in want.items()]) < 1e-9
        assert got[k]["param"] == 28 and got[k]["pole"] == pytest.approx(f[18][56])


def test_smooth_fields_come_back(spark):
    """There and back again, a smooth field is what it was north of 20 N."""
    lat, lon = np.radians(np.arange(0, 91, 5))[:, None], np.radians(np.arange(0, 360, 5))[None, :]
    smooth = 1000 + 20 * np.sin(lat) + 15 * np.cos(lat) * np.cos(lon + 0.3)
    there = regrid.latlon_to_octagonal(made(spark, [smooth, np.full((19, 72), 7.5)]), LATLON)
    back = {r["id"]: r for r in regrid.octagonal_to_latlon(there.drop("pole"), LATLON).collect()}
    assert back[0]["param"] == 6
    for k, f, off in ((0, smooth, 0.1), (1, np.full((19, 72), 7.5), 1e-9)):
        values = np.array([np.nan if v is None else v for v in back[k]["values"]]).reshape(19, 72)
        assert np.isnan(values[:4]).all() and np.nanmax(np.abs(values[4:] - f[4:])) < off
        # Near the cut corners less than half of the weight may be known.
        assert np.isnan(values[4:]).mean() < 0.05


def test_percentages_are_held(spark):
    rough = np.random.default_rng(4).choice([0.0, 100.0], size=(51, 47))
    df = made(spark, [rough]).withColumn("param", F.lit(44))
    values = [v for v in regrid.octagonal_to_latlon(df, LATLON).first()["values"] if v is not None]
    assert min(values) == 0 and max(values) == 100
    free = [v for v in regrid.octagonal_to_latlon(df.withColumn("param", F.lit(1)), LATLON).first()["values"] if v is not None]
    assert min(free) < 0 and max(free) > 100


@pytest.mark.parametrize("kernel, least", [("bessel", 0.5), ("linear", 0.5), ("bessel", 1.0), ("linear", 0.0)])
def test_missing_cells(spark, kernel, least):
    """Known cells share the weight of the missing ones, and too little of it gives none; rows and arrays agree."""
    rng = np.random.default_rng(2)
    source, target = regrid.Regular(8, 5, -90.0, 45.0, 0.0, 45.0), regrid.Regular(12, 7, -90.0, 30.0, 5.0, 30.0)
    fields = [np.where(rng.random((5, 8)) < gone, np.nan, rng.normal(size=(5, 8))) for gone in (0.0, 0.3, 0.7, 1.0)]
    table = {}
    for r in regrid.weights(spark, source, target, kernel).collect():
        table.setdefault(r["target"], []).append((r["source"], r["weight"]))
    assert len(table) == target.size()
    assert all(abs(sum(w for _, w in t) - 1) < 1e-12 and len({c for c, _ in t}) == len(t) for t in table.values())
    df = made(spark, fields)
    arrays = {r["id"]: r["values"] for r in regrid.regrid_fields(df, source, target, kernel=kernel, least=least).collect()}
    cells = df.select("id", F.posexplode("values").alias("cell", "value"))
    rows = {(r["id"], r["cell"]): r["value"] for r in regrid.regrid_cells(cells, regrid.weights(spark, source, target, kernel), "id", least=least).collect()}
    for k, f in enumerate(fields):
        flat = f.ravel()
        for c in range(target.size()):
            known = [(flat[s], w) for s, w in table[c] if not np.isnan(flat[s])]
            total = sum(w for _, w in known)
            want = sum(v * w for v, w in known) / total if known and total >= least - 1e-9 else None
            if known and total > 1e-9:
                assert rows[k, c] == pytest.approx(want, abs=1e-9) if want is not None else rows[k, c] is None
                assert arrays[k][c] == pytest.approx(want, abs=1e-9) if want is not None else arrays[k][c] is None
            elif not known:
                assert (k, c) not in rows


def test_gaussian(spark):
    """Linear between rows; nothing beyond the outermost rows or beside a missing cell."""
    source = regrid.Gaussian(6, 3)
    lats = regrid.gaussian_latitudes(3)
    target = regrid.latitudes_within(source, 10.0)
    assert (target.ny, target.lat, target.dlat) == (13, 60.0, -10.0) and target.lat <= lats[0]
    flat = {k: 3 * lats[k // 6] + k % 6 for k in range(36) if k != 9}
    cells = spark.createDataFrame([(1, k, v) for k, v in flat.items()], "f int, cell int, value double")
    got = {r["cell"]: r["value"] for r in regrid.gaussian_to_latlon(cells, source, "f", step=10.0).collect()}
    for c in range(13 * 6):
        lat = 60.0 - c // 6 * 10
        beside = c % 6 == 3 and lats[2] < lat < lats[0]
        assert got[c] is None if beside else got[c] == pytest.approx(3 * lat + c % 6)


def test_edges(spark):
    """A part of the earth has no cells beyond it; short and null fields miss cells; other columns stay; too large a pair is refused."""
    part, fine = regrid.Regular(3, 3, 10.0, 1.0, 20.0, 1.0), regrid.Regular(5, 5, 9.5, 0.75, 19.5, 0.75)
    df = spark.createDataFrame([(1, "a", [1.0] * 9), (2, None, [1.0] * 4), (3, "c", None), (4, "d", [])], "id int, values_of string, values array<double>")
    got = {r["id"]: r for r in regrid.regrid_fields(df, part, fine, kernel="linear", least=1.0).collect()}
    inside = [c for c in range(25) if 10 <= 9.5 + c // 5 * 0.75 <= 12 and 20 <= 19.5 + c % 5 * 0.75 <= 22]
    assert [c for c, v in enumerate(got[1]["values"]) if v == 1.0] == inside and got[1]["values_of"] == "a"
    assert sum(v is not None for v in got[2]["values"]) < len(inside) and not any(got[3]["values"]) and not any(got[4]["values"]) and len(got[4]["values"]) == 25
    assert not regrid.regrid_fields(df.limit(0), part, fine).collect()
    with pytest.raises(ValueError):
        regrid.regrid_fields(df, part, fine, most=100)
    with pytest.raises(ValueError):
        regrid.weights(spark, part, fine, "cubic")


def test_gaussian_rows_are_not_rounded(spark):
    """Values as large as these tell positions that were rounded between rows."""
    source = regrid.Gaussian(4, 16)
    lats = regrid.gaussian_latitudes(16)
    cells = spark.createDataFrame([(0, r * 4 + i, (-1.0) ** r * 1e9) for r in range(32) for i in range(4)], "field int, cell int, value double")
    found = {r["cell"]: r["value"] for r in regrid.gaussian_to_latlon(cells, source, "field").collect()}
    for k in range(69):
        lat = 85 - 2.5 * k
        n = sum(x >= lat for x in lats)
        a, b = (-1.0) ** (n - 1) * 1e9, (-1.0) ** n * 1e9
        assert found[4 * k] == pytest.approx((a * (lat - lats[n]) + b * (lats[n - 1] - lat)) / (lats[n - 1] - lats[n]), abs=1e-4)


def test_fields_are_gathered_by_vectors(spark):
    """Whole vectors are put in their places, missing cells, vectors and ends included; no cell travels by itself."""
    from aeolis.plans import regridding

    path = "/root/testdata/sf0.001"
    made = regridding._grids(spark, path, 22, 1368)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and "Generate" not in plan
    want = {}
    for r in regridding._cells(spark, path, 22, 1368).collect():
        want.setdefault(r["field"], [None] * 1368)[r["cell"]] = r["value"]
    assert {r["field"]: r["values"] for r in made.collect()} == want
