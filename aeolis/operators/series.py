"""Aggregates over series of fields and of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A mean needs so many values.
MIN_COUNT = 10
#: Fixed value: least rate that is given per unit, less its tolerance of 0.15.
LEAST_RATE = 0.85


def cells(df: DataFrame, *keys: str, values: str = "values") -> DataFrame:
    """One row for each cell of each field: keys, pos, value."""
    return df.select(*keys, F.posexplode(values).alias("pos", "value"))


def grid_mean(df: DataFrame, *keys: str, values: str = "values", min_count: int = MIN_COUNT) -> DataFrame:
    """keys, pos, n, total, mean: mean of each cell over the fields of a group, null with too few values.

    Sums are partial before the shuffle, so a group of any number of fields costs a row a cell and task.
    """
    out = cells(df, *keys, values=values).groupBy(*keys, "pos").agg(F.count("value").alias("n"), F.sum("value").alias("total"))
    return out.withColumn("mean", F.when(F.col("n") >= min_count, F.col("total") / F.col("n")))


def grid_sum_strict(df: DataFrame, *keys: str, values: str = "values") -> DataFrame:
    """keys, pos, total: null where any field of the group misses the cell."""
    out = cells(df, *keys, values=values).groupBy(*keys, "pos").agg(F.count("value").alias("n"), F.count(F.lit(1)).alias("fields"), F.sum("value").alias("total"))
    return out.select(*keys, "pos", F.when(F.col("n") == F.col("fields"), F.col("total")).alias("total"))


def rate(n: Column, start: Column, end: Column) -> Column:
    """struct(rate, unit): observations per the shortest unit that has about one or more."""
    seconds = F.nullif(F.timestamp_diff("SECOND", start, end), F.lit(0)).cast("double")
    month = F.dayofmonth(F.last_day(end)) * 86400
    out = F.struct((n / seconds * month * 12).alias("rate"), F.when(n / seconds * month * 12 > LEAST_RATE, "year").otherwise("").alias("unit"))
    units = [("month", month), ("week", F.lit(7 * 86400)), ("day", F.lit(86400)), ("hour", F.lit(3600)), ("minute", F.lit(60)), ("second", F.lit(1))]
    for unit, length in units:
        per = n / seconds * length
        out = F.when(per > LEAST_RATE, F.struct(per.alias("rate"), F.lit(unit).alias("unit"))).otherwise(out)
    return out


def running_height(levels: DataFrame, key: str, pressure: str, virtual_temperature: str, height: str) -> DataFrame:
    """Adds computed_height: from the lowest level upward, each layer's thickness on the one below.

    Levels of a sounding are few, so a window over `key` is a small group.
    """
    w = Window.partitionBy(key).orderBy(F.col(pressure).desc())
    tv, p = F.col(virtual_temperature), F.col(pressure)
    layer = F.coalesce(F.round((tv + F.lag(tv).over(w)) * F.ln(F.lag(p).over(w) / p) * 14.63563358), F.lit(0.0))
    layered = levels.withColumn("layer", layer)
    return layered.withColumn("computed_height", F.first(height).over(w) + F.sum("layer").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("layer")


def longitude_bounds(df: DataFrame, key: str, index: str, size: int = 360) -> DataFrame:
    """key, west, east: the arc of `size` boxes that leaves out the widest gap; the whole circle without a gap."""
    found = df.select(key, index).distinct()
    w = Window.partitionBy(key).orderBy(index)
    whole = Window.partitionBy(key)
    after = F.coalesce(F.lead(index).over(w), F.min(index).over(whole) + size)
    gaps = found.select(key, F.col(index).alias("east"), (after % size).alias("west"), (after - F.col(index) - 1).alias("gap"))
    best = gaps.groupBy(key).agg(F.max_by(F.struct("west", "east"), F.struct("gap", -F.col("east"))).alias("b"), F.max("gap").alias("gap"))
    return best.select(key, F.when(F.col("gap") == 0, 0).otherwise(F.col("b.west")).alias("west"), F.when(F.col("gap") == 0, size - 1).otherwise(F.col("b.east")).alias("east"))


def finest_resolution(df: DataFrame, key: str, resolution: Column, edges: tuple[float, ...]) -> DataFrame:
    """key, bucket, finest: the least resolution of each bucket, numbered by how many edges it passes."""
    bucket = sum((F.when(resolution >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return df.select(key, bucket.alias("bucket"), resolution.alias("r")).groupBy(key, "bucket").agg(F.min("r").alias("finest"))


def grid_mean_weighted(df: DataFrame, *keys: str, weight: str, values: str = "values") -> DataFrame:
    """keys, pos, mean: of fields that are means of `weight` others each; null where any of them misses the cell."""
    exploded = df.select(*keys, F.col(weight).alias("w"), F.posexplode(values).alias("pos", "x"))
    mean = F.when(F.count("x") == F.count("*"), F.sum(F.col("x") * F.col("w")) / F.sum("w"))
    return exploded.groupBy(*keys, "pos").agg(mean.alias("mean"))


def longitude_presence(df: DataFrame, key: str, index: str) -> DataFrame:
    """key, longitudes: which of 360 longitudes a key has. Pairs are made distinct first, so a key gathers 360 numbers at most."""
    from ..functions.bitmaps import longitudes

    return df.select(key, F.col(index).cast("int").alias("i")).distinct().groupBy(key).agg(longitudes(F.collect_list("i")).alias("longitudes"))
