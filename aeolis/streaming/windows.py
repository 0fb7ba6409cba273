"""Continuous counterparts of the series operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def synoptic_counts(events: DataFrame, ts: str, *keys: str, late: str = "6 hours") -> DataFrame:
    """slot, keys, n: reports by synoptic time, which stands for three hours on either side of it.

    Slots hold their right ends, so a report counts a microsecond earlier; one that comes later than
    `late` is not counted.
    """
    moved = events.withColumn("__at", F.expr(f"CAST({ts} AS TIMESTAMP) - INTERVAL 0.000001 SECOND")).withWatermark("__at", late)
    slots = moved.groupBy(F.window("__at", "6 hours", "6 hours", "3 hours").alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return slots.select(F.expr("w.start + INTERVAL 3 HOURS").alias("slot"), *keys, "n")


def running_grid_sums(fields: DataFrame, ts: str, key: str, values: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, key, pos, n, total: sums of each cell over the fields of a window, missing ones skipped."""
    cells = fields.withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", late).select("__at", key, F.posexplode(values).alias("pos", "value"))
    sums = cells.groupBy(F.window("__at", window).alias("w"), key, "pos").agg(F.count("value").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("start"), key, "pos", "n", "total")
