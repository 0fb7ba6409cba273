"""Rows dealt into ranges of a value, as many as their number asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a range, and ranges at most: the bound of what is broadcast. Beyond it ranges hold more rows.
RANGE_ROWS, MOST_RANGES = 1 << 18, 1 << 14
#: Values of a block of a sorted array.
BLOCK = 128


def range_count(rows: int, least: int = 1) -> int:
    return min(max(least, rows // RANGE_ROWS + 1), MOST_RANGES)


def blocks(values: Column) -> Column:
    """A sorted array cut into arrays of BLOCK values, so that a search reads the ends of blocks and then one block."""
    last = F.ceil(F.size(values) / BLOCK).cast("int") - 1
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * BLOCK + 1, BLOCK))).otherwise(F.array(values))


def below(cut: Column, at: Column) -> Column:
    """The largest of the values (in blocks) that is not above `at`, or null."""
    block = F.try_element_at(F.filter(cut, lambda b: F.get(b, 0) <= at), F.lit(-1))
    return F.try_element_at(F.filter(block, lambda m: m <= at), F.lit(-1))


def above(cut: Column, at: Column) -> Column:
    """The least of the values (in blocks) that is not below `at`, or null."""
    block = F.try_element_at(F.filter(cut, lambda b: F.try_element_at(b, F.lit(-1)) >= at), F.lit(1))
    return F.try_element_at(F.filter(block, lambda m: m >= at), F.lit(1))


def place(cut: Column, at: Column) -> Column:
    """How many of the bounds (in blocks) are below `at`, that is the number of its range; 0 for null."""
    full = F.size(F.filter(cut, lambda b: F.get(b, 0) < at))
    rest = F.size(F.filter(F.get(cut, full - 1), lambda m: m < at))
    return F.when(full > 0, (full - 1) * BLOCK + rest).otherwise(F.lit(0))


def bounds(rows: DataFrame, column: str, n: int) -> DataFrame:
    """One row, cuts: the bounds of n ranges of about as many rows each, in blocks."""
    at = F.array(*(F.lit(i / n) for i in range(1, n)))
    return rows.agg(F.percentile_approx(column, at, F.lit(max(10_000, 10 * n))).alias("cuts")).select(blocks(F.col("cuts")).alias("cuts"))
