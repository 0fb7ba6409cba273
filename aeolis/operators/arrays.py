"""Array files of fields: coordinates are found first, then many tasks write one file, each at the bytes that are its own.

Fields are rows of file, variable, time, level (null: none) and values by row of ny by nx cells. A variable is laid out by time, level, row and
column; variables with equal times, or levels, share a dimension. Cells of a time and level that no field has are missing.
"""

from __future__ import annotations

import math
import os
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import netcdf_cells, netcdf_head

#: Units of time in messages by code.
UNITS = {0: "minutes", 1: "hours", 2: "days", 3: "months", 4: "years", 5: "decades", 6: "normals", 7: "centuries", 10: "3hours", 11: "6hours", 12: "12hours"}
#: Degrees that a place may be beyond a bound; places behind the point to which distances are told apart.
SLACK, PLACES = 1e-4, 9


class Shape(NamedTuple):
    """ny rows from latitude lat in steps of dlat (negative: southward), of nx columns from lon eastward in steps of dlon."""

    nx: int
    ny: int
    lat: float
    dlat: float
    lon: float
    dlon: float


def axes(fields: DataFrame) -> DataFrame:
    """file, variable, times, levels (ascending, empty without levels) and their dimensions' numbers in the file, from 0.

    Equal lists of a file have one number. The lists are the file's coordinates, at most a value a field of one variable.
    """
    lists = fields.groupBy("file", "variable").agg(F.sort_array(F.collect_set("time")).alias("times"), F.sort_array(F.collect_set("level")).alias("levels"))
    number = lambda c: (F.dense_rank().over(Window.partitionBy("file").orderBy(F.size(c) == 0, c)) - 1).alias(f"{c[:-1]}_dim")
    return lists.select("*", number("times"), number("levels"))


def _heads(shape: Shape, origin: str):
    """Of a row a file, with its variables: rows of the head, of the coordinates, and of each variable's place."""
    lats, lons = shape.lat + shape.dlat * np.arange(shape.ny), shape.lon + shape.dlon * np.arange(shape.nx)

    def run(batches):
        for files in batches:
            for file, rows in zip(files["file"], files["variables"]):
                dims, coordinates = {"lat": shape.ny, "lon": shape.nx}, {"lat": (lats, {"units": "degrees_north"}), "lon": (lons, {"units": "degrees_east"})}
                named = {}
                for r in sorted(rows, key=lambda r: r["variable"]):
                    own = [f"time{r['time_dim'] or ''}"] + ([f"level{r['level_dim'] or ''}"] if len(r["levels"]) else [])
                    hours = (np.array([pd.Timestamp(t) for t in r["times"]], "datetime64[us]") - np.datetime64(origin)) / np.timedelta64(1, "h")
                    for name, values, text in zip(own, (hours, np.array(r["levels"], float)), ({"units": f"hours since {origin}"}, {"positive": "down"})):
                        dims[name], coordinates[name] = len(values), (values, text)
                    named[r["variable"]] = own + ["lat", "lon"]
                variables = [(k, [k], text) for k, (_, text) in coordinates.items()] + [(k, ds, {"coordinates": " ".join(ds)}) for k, ds in named.items()]
                head, begins = netcdf_head(dims, variables, {"Conventions": "CF-1.8"})
                place = dict(zip([v[0] for v in variables], begins))
                out = [(file, None, 0, head, 0)] + [(file, None, place[k], netcdf_cells(v), 0) for k, (v, _) in coordinates.items()]
                out += [(file, k, place[k], None, dims[ds[1]] if len(ds) == 4 else 1) for k, ds in named.items()]
                yield pd.DataFrame(out, columns=["file", "variable", "offset", "content", "n_levels"])

    return run


def parts(fields: DataFrame, shape: Shape, origin: str = "1900-01-01") -> DataFrame:
    """file, offset, content or values: the pieces of each file and the byte at which each belongs.

    A piece is the file's head, a coordinate, or the cells of one time and level. Of fields that have one variable, time and level
    the largest values are taken; null times and files are left out; names of variables must differ from those of the dimensions.
    """
    fields = fields.select("file", "variable", "time", F.col("level").cast("double").alias("level"), F.col("values").cast("array<double>").alias("values")).filter("file IS NOT NULL AND variable IS NOT NULL AND time IS NOT NULL")
    found = axes(fields)
    rows = found.groupBy("file").agg(F.collect_list(F.struct("variable", "times", "levels", "time_dim", "level_dim")).alias("variables"))
    placed = rows.mapInPandas(_heads(shape, origin), "file string, variable string, offset long, content binary, n_levels long")
    cells = 8 * shape.nx * shape.ny
    begins = placed.filter("variable IS NOT NULL").select(F.col("file").alias("f"), F.col("variable").alias("v"), F.col("offset").alias("begin"), "n_levels")
    none = F.array(F.lit(None).cast("double"))
    grid = found.select("file", "variable", F.posexplode("times").alias("t", "time"), "levels").select("file", "variable", "t", "time", F.posexplode(F.when(F.size("levels") == 0, none).otherwise(F.col("levels"))).alias("l", "level"))
    grid = grid.join(begins, (F.col("file") == F.col("f")) & (F.col("variable") == F.col("v")))
    grid = grid.select(F.col("file").alias("gf"), F.col("variable").alias("gv"), F.col("time").alias("gt"), F.col("level").alias("gl"), (F.col("begin") + (F.col("t") * F.col("n_levels") + F.col("l")) * cells).alias("offset"))
    one = fields.groupBy("file", "variable", "time", "level").agg(F.max("values").alias("values"))
    met = grid.join(one, (F.col("gf") == F.col("file")) & (F.col("gv") == F.col("variable")) & (F.col("gt") == F.col("time")) & F.col("gl").eqNullSafe(F.col("level")), "left")
    data = met.select(F.col("gf").alias("file"), "offset", F.lit(None).cast("binary").alias("content"), F.coalesce("values", F.array().cast("array<double>")).alias("values"))
    heads = placed.filter("content IS NOT NULL").select("file", "offset", "content", F.lit(None).cast("array<double>").alias("values"))
    return heads.union(data)


def write_arrays(fields: DataFrame, folder: str, shape: Shape, origin: str = "1900-01-01", tasks: int = 0) -> DataFrame:
    """file, offset, bytes of the runs of bytes written to <folder>/<file>.nc; run it once.

    Pieces are ranged by file and place, so that a task writes a stretch of a file, of any size, with many tasks a file. Writing again
    gives the same bytes, so attempts that are lost or repeated do no harm. folder: a URI of a file system that hosts share (file://), as
    object stores have no writing in place; there, `parts` says what belongs where.
    """
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError("files are written in place, which needs a file system that hosts share")
    root, size = folder.removeprefix("file://"), shape.nx * shape.ny

    def run(batches):
        os.makedirs(root, exist_ok=True)
        for b in batches:
            done = []
            for file, offset, content, values in zip(*(b[c].to_pylist() for c in ("file", "offset", "content", "values"))):
                if content is None:
                    cells = np.full(size, np.nan)
                    given = np.array(values[:size], float)
                    cells[: len(given)] = given
                    content = netcdf_cells(cells)
                at = os.open(f"{root}/{file}.nc", os.O_CREAT | os.O_WRONLY, 0o644)
                try:
                    n = 0
                    while n < len(content):
                        n += os.pwrite(at, content[n:], offset + n)
                finally:
                    os.close(at)
                if done and done[-1][0] == file and done[-1][1] + done[-1][2] == offset:
                    done[-1][2] += len(content)
                else:
                    done.append([file, offset, len(content)])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], ["file", "offset", "bytes"])

    pieces = parts(fields, shape, origin)
    n = tasks or int(fields.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, "file string, offset long, bytes long")


# --- parts of a grid


def latitude_range(shape: Shape, south: Column, north: Column) -> Column:
    """struct(first, last, values): rows of the grid from south to north, edges included; equal bounds give the row next to them (of two the first)."""
    return _within(_Axis(shape.ny, shape.lat, shape.dlat), south, north, SLACK)


def longitude_range(shape: Shape, west: Column, east: Column) -> Column:
    """struct(first, last, values): columns from west eastward to east, round the earth where that passes the grid's edge.

    A range that passes the edge has first after last, and its values rise from the first column on, from below 0 where they began
    beyond 180. Equal bounds give the next column. Bounds may be from -180 to 360; the grid goes round the earth.
    """
    turn = lambda x: F.pmod(x - shape.lon, F.lit(360.0)) + shape.lon
    axis = _Axis(shape.nx, shape.lon, shape.dlon)
    low, high, whole = turn(west), turn(east), east - west >= 360 - 1e-9
    all_ = F.struct(F.lit(0).alias("first"), F.lit(shape.nx - 1).alias("last"), axis.values(F.lit(0), F.lit(shape.nx - 1)).alias("values"))
    plain = _within(axis, low, high, SLACK)
    # A whole turn does not come back to where it began.
    left, right = (axis.ascending(low - SLACK), F.lit(shape.nx - 1)), (F.lit(0), axis.descending(F.when(whole, low - 2 * SLACK).otherwise(high) + SLACK))
    some, more = left[0] <= left[1], right[0] <= right[1]
    both = F.concat(F.transform(axis.values(*left), lambda v: v - 360), axis.values(*right))
    around = F.struct(F.when(some, left[0]).otherwise(right[0]).alias("first"), F.when(more, right[1]).otherwise(left[1]).alias("last"), both.alias("values"))
    return F.when(west == east, plain).when(whole & (F.abs(low - shape.lon) < 1e-9), all_).when((low > high) | whole, F.when(some | more, around)).otherwise(plain)


class _Axis(NamedTuple):
    """n places from `start` in steps; what lies within bounds is worked out, not looked for."""

    n: int
    start: float
    step: float

    def value(self, at: Column) -> Column:
        return self.start + at * self.step

    def values(self, first: Column, last: Column) -> Column:
        """The values from first to last; empty where last is before first."""
        return F.when(first <= last, F.transform(F.sequence(first, last), self.value)).otherwise(F.array().cast("array<double>"))

    def _near(self, value: Column) -> Column:
        """A place at most one beside that of the value, which is -1 before the axis and n behind it."""
        return F.least(F.greatest(F.floor((value - self.start) / self.step), F.lit(-1)), F.lit(self.n)).cast("int")

    def ascending(self, low: Column) -> Column:
        """The first place, in the direction of the values, that is not below low."""
        at = self._near(low)
        return F.greatest(F.lit(0), F.when(self.value(at) >= low, at).when(self.value(at + 1) >= low, at + 1).otherwise(at + 2))

    def descending(self, high: Column) -> Column:
        """The last place, in the direction of the values, that is not above high."""
        at = self._near(high)
        return F.least(F.lit(self.n - 1), F.when(self.value(at + 1) <= high, at + 1).when(self.value(at) <= high, at).otherwise(at - 1))

    def nearest(self, value: Column) -> Column:
        """The place next to a value, of two that are as near the first."""
        held = lambda at: F.greatest(F.lit(0), F.least(F.lit(self.n - 1), at))
        at = self._near(value)
        return F.least(*(F.struct(F.round(F.abs(self.value(held(at + k)) - value), PLACES).alias("off"), held(at + k).alias("at")) for k in (-1, 0, 1, 2)))["at"]


def _within(axis: _Axis, low: Column, high: Column, slack: float) -> Column:
    """struct(first, last, values) of the places between the bounds, or next to them if they are equal; null where there is none."""
    turned = _Axis(axis.n, -axis.start, -axis.step) if axis.step < 0 else axis
    top = F.nanvl(high, F.lit(math.inf))
    bounds = (-top - slack, -low + slack) if axis.step < 0 else (low - slack, top + slack)
    first, last, near = turned.ascending(bounds[0]), turned.descending(bounds[1]), axis.nearest(low)
    pick = lambda a, b: F.struct(a.alias("first"), b.alias("last"), axis.values(a, b).alias("values"))
    return F.when(low == high, pick(near, near)).when((first <= last) & ~F.isnan(low), pick(first, last))


def cell_methods(time_range: Column, unit: Column, p1: Column, p2: Column, n: Column, valid: Column) -> Column:
    """How a variable's cells stand for their times, of the time range codes of averages and sums; null for other codes.

    Averages of as many samples as a month has, or up to two fewer, are over months.
    """
    names = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    name, days = F.try_element_at(names, unit), F.dayofmonth(F.last_day(valid))
    daily = F.when(unit == 2, 1).when(p2 > 0, F.floor(F.lit(24) / p2)).cast("int")
    intervals = F.concat(F.lit(" over intervals of "), p2.cast("string"), F.lit(" "), name)
    known = unit.isin(1, 2)
    simple = F.when(known & (days - F.floor(n / daily) < 3), F.lit("time: mean over months")).otherwise(F.concat(F.lit("time: mean"), intervals))
    first = lambda what: F.concat(F.lit(f"time: {what} over "), (p2 - p1).cast("string"), F.lit(" "), name)
    month = F.lit(" time: mean over months")
    nested = lambda what: F.concat(first(what), F.when(known & (F.floor(n / 4) == days), month).when(known, F.concat(F.lit(" time: mean"), intervals)).otherwise(F.concat(F.lit(f" time: {what}"), intervals)))
    return F.when(time_range.isin(113, 123), simple).when(time_range == 137, nested("sum")).when(time_range == 138, nested("mean"))
