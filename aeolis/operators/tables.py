"""Changes to keyed tables as new DataFrames; write them where the old ones stood."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def elements(df: DataFrame, values: Column | str, *keys: Column | str, element: str = "v", place: str = "_place") -> DataFrame:
    """keys, place and element: a row for each element of an array, places from 0; rows without an array or with an empty one go.

    They go behind the explode. Ahead of it, where Spark puts such a filter by itself, the array would be worked out again, with all that it is made from
    in place of each mention of it: for arrays made by functions of their places, in the square of their length.
    """
    return df.select(*keys, F.posexplode_outer(values).alias(place, element)).filter(F.col(place).isNotNull())


def upsert(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """table with rows put in, one row a key: rows win over the table, of several the greatest by their columns.

    Only rows are aggregated; the table is read past their keys, so with few rows nothing of it is exchanged.
    Null keys equal each other. Columns of rows must have an order, so none may be a map.
    """
    rest = [c for c in table.columns if c not in keys]
    last = rows.select(*table.columns).groupBy(*keys).agg(F.max(F.struct(*rest)).alias("last"))
    last = last.select(*(F.col(c) if c in keys else F.col(f"last.{c}").alias(c) for c in table.columns))
    same = functools.reduce(lambda a, b: a & b, (F.col(f"t.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys))
    return table.alias("t").join(last.select(*keys).alias("r"), same, "left_anti").select(*table.columns).unionByName(last)


def insert_new(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """table and those rows whose key it does not have, one a key."""
    fresh = rows.select(*table.columns).join(table.select(*keys), list(keys), "left_anti").select(*table.columns)
    return table.unionByName(fresh.dropDuplicates(list(keys)))


def update(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """table with values assigned where the condition holds, all of them from the old row."""
    return table.select(*(F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns))


def delete(table: DataFrame, where: Column) -> DataFrame:
    """table without the rows for which the condition holds; where it is null they stay."""
    return table.filter(~F.coalesce(where, F.lit(False)))


def replace_groups(table: DataFrame, rows: DataFrame, *keys: str, groups: DataFrame | None = None, parts: int = 1) -> DataFrame:
    """table with all rows of the keys in rows exchanged for these, so that stale ones go.

    groups: rows with the keys that go instead, of which some may get no rows. parts: partitions in which the table meets the keys. One that grows with
    the table bounds what a task sorts for the join, since Spark by itself puts as many rows in one as fit its bytes when compressed; with 1 it is left to Spark.
    """
    stale, old = (rows if groups is None else groups).select(*keys), table
    if parts > 1:
        stale, old = stale.repartition(parts, *keys), table.repartition(parts, *keys)
    return old.join(stale.distinct(), list(keys), "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))
