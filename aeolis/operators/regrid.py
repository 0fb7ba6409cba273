"""Fields brought from one grid to another by sparse weights: a table of target cell, source cell and weight.

The weights of a pair of grids are worked out once and fit any number of fields. Cells are numbered by row from 0. A field
is an array by row (regrid_fields) or a row a cell (regrid_cells); both give the same values.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.definitions import gaussian_latitudes

#: A cell is given where at least so much of its weight lies on known cells.
LEAST = 0.5
#: Weights that are shipped to tasks as arrays (16 bytes each); larger pairs of grids go by rows.
MOST_WEIGHTS = 1 << 24
#: Positions are rounded to so many places, so that a cell that falls on another is that cell; but not between gaussian rows.
PLACES = 9
#: Fixed values of the octagonal grid: columns and rows, the pole's cell, the square of its radius in cells, degrees that it is turned by, and rows that widen and narrow.
OCTAGON_NX, OCTAGON_NY, POLE_I, POLE_J, RADIUS_SQUARED, TURN, SLANT = 47, 51, 23, 25, 973.712023868, 10.0, 14
#: Pressure and sea temperature have other codes on octagonal grids; percentages are held between bounds; the southern end of what octagonal grids reach.
TO_OCTAGONAL, PERCENT, SOUTH = {6: 28, 57: 47}, 44, 20.0


def _split(position: Column) -> Column:
    """struct(at, way): the cell before a rounded position and the way from it to the next; null for null."""
    rounded = F.round(position, PLACES)
    return F.when(rounded.isNotNull(), F.struct(F.floor(rounded).cast("int").alias("at"), (rounded - F.floor(rounded)).alias("way")))


class Regular(NamedTuple):
    """ny rows from latitude lat in steps of dlat, of nx columns from longitude lon in steps of dlon."""

    nx: int
    ny: int
    lat: float
    dlat: float
    lon: float
    dlon: float

    def size(self) -> int:
        return self.nx * self.ny

    def place(self, cell: Column) -> tuple[Column, Column]:
        return self.lat + F.floor(cell / self.nx) * self.dlat, self.lon + F.pmod(cell, F.lit(self.nx)) * self.dlon

    def position(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        return _split(F.pmod(lon - self.lon, F.lit(360.0)) / self.dlon), _split((lat - self.lat) / self.dlat)

    def cell(self, i: Column, j: Column) -> Column:
        """Number of the cell, columns round the earth and rows over a pole on the opposite meridian; null beyond the grid."""
        whole = math.isclose(abs(self.nx * self.dlon), 360)
        last = self.lat + (self.ny - 1) * self.dlat
        over = F.lit(False)
        row = j
        if whole and self.nx % 2 == 0:
            if math.isclose(abs(last), 90):
                over, row = over | (j >= self.ny), F.when(j >= self.ny, 2 * (self.ny - 1) - j).otherwise(row)
            if math.isclose(abs(self.lat), 90):
                over, row = over | (j < 0), F.when(j < 0, -j).otherwise(row)
        column = F.when(over, i + self.nx // 2).otherwise(i)
        column = F.pmod(column, F.lit(self.nx)) if whole else F.when(column.between(0, self.nx - 1), column)
        return F.when(row.between(0, self.ny - 1), row * self.nx + column)


class Gaussian(NamedTuple):
    """Rows at the gaussian latitudes of so many circles a hemisphere, from the north, of nx columns round the earth from longitude lon."""

    nx: int
    circles: int
    lon: float = 0.0

    def size(self) -> int:
        return self.nx * 2 * self.circles

    def place(self, cell: Column) -> tuple[Column, Column]:
        lats = F.array(*map(F.lit, gaussian_latitudes(self.circles)))
        return F.get(lats, F.floor(cell / self.nx).cast("int")), self.lon + F.pmod(cell, F.lit(self.nx)) * (360.0 / self.nx)

    def position(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """The row is linear in latitude between two rows and not rounded; null beyond the first and the last."""
        lats = F.array(*map(F.lit, gaussian_latitudes(self.circles)))
        north = F.size(F.filter(lats, lambda x: x >= lat)) - 1
        above, below = F.get(lats, north), F.get(lats, north + 1)
        way = F.when(above == lat, 0.0).otherwise((above - lat) / (above - below))
        row = F.when((north >= 0) & way.isNotNull(), F.struct(north.alias("at"), way.alias("way")))
        return _split(F.pmod(lon - self.lon, F.lit(360.0)) / (360.0 / self.nx)), row

    def cell(self, i: Column, j: Column) -> Column:
        return F.when(j.between(0, 2 * self.circles - 1), j * self.nx + F.pmod(i, F.lit(self.nx)))


class Octagonal(NamedTuple):
    """The polar stereographic grid of the northern hemisphere with cut corners."""

    def size(self) -> int:
        return OCTAGON_NX * OCTAGON_NY

    def place(self, cell: Column) -> tuple[Column, Column]:
        """Null in the corners; places near whole degrees are those."""
        i, j = F.pmod(cell, F.lit(OCTAGON_NX)), F.floor(cell / OCTAGON_NX).cast("int")
        x, y = (i - POLE_I).cast("double"), (j - POLE_J).cast("double")
        near = lambda a: F.when(F.abs(F.round(a) - a) < 1e-4, F.round(a)).otherwise(a)
        lat = near(F.degrees(F.asin((RADIUS_SQUARED - x * x - y * y) / (RADIUS_SQUARED + x * x + y * y))))
        lon = F.when((x == 0) & (y <= 0), 270.0).otherwise(near(F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))))
        inside = self.cell(i, j).isNotNull()
        return F.when(inside, lat), F.when(inside, lon + TURN)

    def position(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        r, turned = math.sqrt(RADIUS_SQUARED) * F.tan(F.radians(45 - lat / 2)), F.radians(lon - TURN)
        return _split(r * F.cos(turned) + POLE_I), _split(r * F.sin(turned) + POLE_J)

    def cell(self, i: Column, j: Column) -> Column:
        cut = F.greatest(F.lit(0), SLANT - j, j - (OCTAGON_NY - 1 - SLANT))
        return F.when(j.between(0, OCTAGON_NY - 1) & (i >= cut) & (i <= OCTAGON_NX - 1 - cut), j * OCTAGON_NX + i)


Grid = Regular | Gaussian | Octagonal


def _taps(kernel: str, d: Column) -> list[tuple[int, Column]]:
    """Offsets from the cell before a point and their weights, d the way from it to the next cell."""
    if kernel == "linear":
        return [(0, 1 - d), (1, d)]
    if kernel == "bessel":
        q = d * (d - 1) * 0.25
        return [(-1, q), (0, 1 - d - q), (1, d - q), (2, q)]
    raise ValueError(f"no kernel {kernel}")


def weights(spark: SparkSession, source: Grid, target: Grid, kernel: str = "bessel", south: float = -90.0) -> DataFrame:
    """target, source, weight: what each cell of the target at or north of `south` takes from cells of the source.

    kernel: `linear` takes 2 x 2 cells and `bessel` 4 x 4. Weights of a cell add up to 1 but for cells beyond the source's
    edge, which are left out; a target cell that lies beyond the source has none.
    """
    lat, lon = target.place(F.col("target"))
    at = spark.range(target.size()).select(F.col("id").cast("int").alias("target")).select("target", lat.alias("lat"), lon.alias("lon")).filter(F.col("lat") >= south)
    x, y = source.position(F.col("lat"), F.col("lon"))
    at = at.select("target", x.alias("x"), y.alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    pairs = [F.struct((F.col("x.at") + i).alias("i"), (F.col("y.at") + j).alias("j"), (u * v).alias("weight")) for j, v in _taps(kernel, F.col("y.way")) for i, u in _taps(kernel, F.col("x.way"))]
    taps = at.select("target", F.inline(F.array(*pairs))).filter("weight <> 0")
    found = taps.select("target", source.cell(F.col("i"), F.col("j")).cast("int").alias("source"), "weight").filter("source IS NOT NULL")
    # Over a pole two of the cells may be one.
    return found.groupBy("target", "source").agg(F.sum("weight").alias("weight"))


def regrid_cells(cells: DataFrame, table: DataFrame, *keys: str, cell: str = "cell", value: str = "value", least: float = LEAST) -> DataFrame:
    """keys, cell, value on the target grid of a table of weights, from a row a cell; for grids of any size.

    A value is the mean by weight of the known cells, null where they hold less than `least` of the weight; a cell that takes from no
    known one is left out, and a cell that comes twice counts twice. Sums are partial before the shuffle.
    """
    known = cells.filter(F.col(value).isNotNull()).select(*keys, F.col(cell).alias("_from"), F.col(value).cast("double").alias("_value"))
    met = known.join(table, F.col("_from") == F.col("source"))
    sums = met.groupBy(*keys, F.col("target").alias(cell)).agg(F.sum("weight").alias("_weight"), (F.sum(F.col("weight") * F.col("_value")) / F.sum("weight")).alias(value))
    return sums.select(*keys, cell, F.when(F.col("_weight") >= least - 1e-9, F.col(value)).alias(value))


def _applied(values: np.ndarray, order: tuple[np.ndarray, ...], size: int, least: float) -> np.ndarray:
    """Rows of fields, nan where missing, on the target grid; order: targets, first place of each, source cells and weights."""
    targets, first, source, weight = order
    out = np.full((len(values), size), np.nan)
    if not len(targets):
        return out
    known = ~np.isnan(values)
    total = np.add.reduceat(np.where(known, values, 0.0)[:, source] * weight, first, axis=1)
    share = np.add.reduceat(known[:, source] * weight, first, axis=1)
    some = share >= least - 1e-9
    out[:, targets] = np.where(some, total / np.where(some, share, 1.0), np.nan)
    return out


def regrid_fields(fields: DataFrame, source: Grid, target: Grid, values: str = "values", kernel: str = "bessel", least: float = LEAST, south: float = -90.0, most: int = MOST_WEIGHTS) -> DataFrame:
    """fields with the array `values` on the target grid; other columns stay.

    Missing cells as in regrid_cells; a field shorter than its grid misses the rest. The weights, at most 16 a target cell and `most` in
    all, are arrays in every task, where a batch of fields meets them by one sparse product.
    """
    if target.size() * 16 > most:
        raise ValueError(f"weights of {target.size()} cells go by rows: see regrid_cells")
    table = weights(fields.sparkSession, source, target, kernel, south).toPandas().sort_values(["target", "source"])
    targets, first = np.unique(table["target"].to_numpy(), return_index=True)
    order = (targets, first, table["source"].to_numpy(), table["weight"].to_numpy())
    n, size = source.size(), target.size()
    rows = max(1, (1 << 20) // max(1, len(table)))
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == values else f.dataType, True) for f in fields.schema])

    def run(batches):
        for whole in batches:
            for lo in range(0, len(whole), rows):
                b = whole.slice(lo, rows)
                column = b[values]
                given = np.diff(column.offsets.to_numpy())
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
                held = np.full((len(b), n), np.nan)
                width = np.minimum(given, n)
                at = np.repeat(np.cumsum(given) - given, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                held[np.repeat(np.arange(len(b)), width), at - np.repeat(np.cumsum(given) - given, width)] = flat[at]
                made = _applied(held, order, size, least).ravel()
                out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(made) + 1, size, dtype=np.int32)), pa.array(made, pa.float64(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([out if c == values else b[c] for c in b.schema.names], b.schema.names)

    return fields.withColumn(values, F.coalesce(F.col(values).cast("array<double>"), F.array().cast("array<double>"))).mapInArrow(run, schema)


def latlon_to_octagonal(grids: DataFrame, source: Regular) -> DataFrame:
    """Packed grids by row from the equator northward as octagonal ones, with two parameters renamed, and the pole's value in `pole`."""
    param = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in TO_OCTAGONAL.items() for x in pair)), F.col("param")), F.col("param"))
    made = regrid_fields(grids.withColumn("param", param), source, Octagonal())
    return made.withColumn("pole", F.get("values", F.lit(POLE_J * OCTAGON_NX + POLE_I)))


def octagonal_to_latlon(grids: DataFrame, target: Regular) -> DataFrame:
    """Octagonal grids as packed ones by row from the equator northward, missing south of SOUTH, percentages held between 0 and 100."""
    back = {v: k for k, v in TO_OCTAGONAL.items()}
    param = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in back.items() for x in pair)), F.col("param")), F.col("param"))
    made = regrid_fields(grids.withColumn("param", param), Octagonal(), target, south=SOUTH)
    held = F.transform("values", lambda v: F.when(v > 100, 100.0).when(v < 0, 0.0).otherwise(v))
    return made.withColumn("values", F.when(F.col("param") == PERCENT, held).otherwise(F.col("values")))


def latitudes_within(source: Gaussian, step: float = 2.5) -> Regular:
    """The regular rows, `step` degrees apart and from as far north as south, that lie within a gaussian grid, in its columns."""
    top = math.floor(round(gaussian_latitudes(source.circles)[0] / step, PLACES)) * step
    return Regular(source.nx, round(2 * top / step) + 1, top, -step, source.lon, 360.0 / source.nx)


def gaussian_to_latlon(cells: DataFrame, source: Gaussian, *keys: str, step: float = 2.5, cell: str = "cell", value: str = "value") -> DataFrame:
    """Cells of gaussian grids on regular latitudes, linear between the rows next to each; null if either is missing."""
    return regrid_cells(cells, weights(cells.sparkSession, source, latitudes_within(source, step), "linear"), *keys, cell=cell, value=value, least=1.0)
