"""Algebra of fields: arrays of doubles by row, null where missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def scalar(values: Column, f: Callable[[Column], Column]) -> Column:
    """f of each cell, missing ones left."""
    return F.transform(values, f)


def combine(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of cells in the same place, missing if either is."""
    return F.zip_with(a, b, f)


def divide(a: Column, b: Column) -> Column:
    """Cell by cell, missing where the divisor is 0."""
    return F.zip_with(a, b, lambda x, y: x / F.nullif(y, F.lit(0.0)))


def stats(values: Column, nx: int) -> Column:
    """struct of min, max, avg of the cells that are not missing, and the first place (i, j, from 1) of either."""
    known = F.filter(values, lambda v: v.isNotNull())
    low, high = F.array_min(known), F.array_max(known)
    place = lambda v: F.array_position(values, v).cast("int") - 1
    mean = F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(known), F.lit(0))
    return F.struct(
        low.alias("min"), high.alias("max"), mean.alias("avg"), (place(low) % nx + 1).alias("min_i"), (F.floor(place(low) / nx) + 1).cast("int").alias("min_j"),
        (place(high) % nx + 1).alias("max_i"), (F.floor(place(high) / nx) + 1).cast("int").alias("max_j"), F.size(F.filter(values, lambda v: v.isNull())).alias("missing"),
    )


def rows(values: Column, nx: int) -> Column:
    """An array for each row of the field."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / nx).cast("int") - 1), lambda j: F.slice(values, j * nx + 1, nx))


def reverse_scan(values: Column, nx: int) -> Column:
    """Rows from the other pole."""
    return F.flatten(F.reverse(rows(values, nx)))


def combine_hemispheres(north: Column, south: Column, nx: int) -> Column:
    """The northern field and below it the southern one, whose first row, the equator, both have."""
    return F.concat(north, F.slice(south, F.lit(nx + 1), F.size(south) - nx))


def subset(values: Column, nx: int, first_row: int, last_row: int, first_column: int, last_column: int, stride: int = 1) -> Column:
    """Rows and columns from first to last, from 0; a first column after the last wraps round the field."""
    width = last_column - first_column if first_column <= last_column else nx - first_column + last_column
    picked = [(first_column + k) % nx for k in range(0, width + 1, stride)]
    cells = [j * nx + i for j in range(first_row, last_row + 1, stride) for i in picked]
    return F.transform(F.array(*map(F.lit, cells)), lambda k: F.element_at(values, k + 1))


def power(values: Column, exponent: float) -> Column:
    return scalar(values, lambda x: F.pow(x, F.lit(exponent)))


def to_latitudes(values: Column, nx: int, latitudes: list[float], wanted: list[float]) -> Column:
    """Rows at the wanted latitudes, linear between the rows next to each, missing beyond the first and last row."""
    between = lambda k: lambda a, b: a if k == 1 else a * k + b * (1 - k)
    out = []
    for lat in wanted:
        north = min((i for i, x in enumerate(latitudes) if x >= lat), key=lambda i: latitudes[i], default=None)
        south = max((i for i, x in enumerate(latitudes) if x <= lat), key=lambda i: latitudes[i], default=None)
        if north is None or south is None:
            out.append(F.array_repeat(F.lit(None).cast("double"), nx))
            continue
        row = lambda i: F.slice(values, i * nx + 1, nx)
        span = latitudes[north] - latitudes[south]
        share = (lat - latitudes[south]) / span if span else 1.0
        out.append(combine(row(north), row(south), between(share)))
    return F.flatten(F.array(*out))
