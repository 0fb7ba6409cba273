"""Queries of array files that many tasks write, of parts of grids, and of cell methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrays
from ..sources import binary, framed
from .queries import FIELD_SQL, fields, query, read

SHAPE = arrays.Shape(8, 8, 80.0, -20.0, 0.0, 45.0)
_ROWS = f"(SELECT label % 2 AS file, concat('v', vec_id % 3) AS variable, TIMESTAMP '2001-02-03' + INTERVAL (vec_id // 12) HOUR AS time, CASE WHEN vec_id % 3 < 2 THEN (vec_id // 3 % 4) * 100.0::DOUBLE WHEN vec_id // 3 % 4 > 0 THEN NULL ELSE -1 END AS level, v FROM {FIELD_SQL})"


@query(
    f"WITH r AS (SELECT file, variable, time, level, list_transform(range(64), lambda k: v[k + 1]) AS v FROM {_ROWS} WHERE level IS NULL OR level >= 0), "
    "m AS (SELECT file, variable, time, level, k AS pos, max(v[k + 1]) AS x FROM (SELECT * FROM r WHERE level IS NOT NULL), range(64) t(k) GROUP BY ALL), "
    "d AS (SELECT file, variable, time, dense_rank() OVER (PARTITION BY file, variable ORDER BY time) - 1 AS t, level, dense_rank() OVER (PARTITION BY file, variable ORDER BY level) - 1 AS l, pos, x FROM m) "
    "SELECT file::INT AS file, variable, t::INT AS t, epoch(time)::BIGINT // 3600 AS hour, l::INT AS l, level, pos::INT AS pos, round(x, 6) AS x FROM d WHERE x IS NOT NULL"
)
def array_archive(spark, sf_dir):
    """Fields of two files and two variables with levels, written by many tasks and read back with the coordinates that stand in the files."""
    v = fields(spark, sf_dir)
    n = F.col("vec_id")
    rows = v.filter(n % 3 < 2).select(
        (F.col("label") % 2).cast("string").alias("file"), F.concat(F.lit("v"), (n % 3).cast("string")).alias("variable"), F.timestamp_add("HOUR", F.expr("int(vec_id div 12)"), F.lit("2001-02-03 00:00:00").cast("timestamp_ntz")).alias("time"),
        (F.expr("vec_id div 3 % 4") * 100.0).alias("level"), "v",
    )
    folder = framed.shared_folder(spark)
    arrays.write_arrays(rows.withColumnRenamed("v", "values"), folder, SHAPE, "2001-01-01").agg(F.sum("bytes")).collect()
    found = binary.netcdf_variables(spark, folder).withColumn("file", F.regexp_extract("path", r"(\d+)\.nc$", 1).cast("int"))
    sizes = lambda k: F.col("dims")[k]["length"]
    cells = found.filter("size(dims) = 4").select("file", F.col("name").alias("variable"), F.col("dims")[0]["name"].alias("time_dim"), F.col("dims")[1]["name"].alias("level_dim"), sizes(1).alias("n"), F.posexplode("values").alias("i", "x"))
    cells = cells.filter("x IS NOT NULL").withColumns({"pos": F.expr("int(i % 64)"), "t": F.expr("int(i div 64 div n)"), "l": F.expr("int(i div 64 % n)")})
    axis = found.filter("is_coord").select(F.col("file").alias("f"), F.col("name").alias("dim"), F.posexplode("values").alias("at", "value"))
    at = lambda x: axis.select(*(F.col(c).alias(f"{x}_{c}") for c in axis.columns))
    same = lambda x, dim, k: (F.col("file") == F.col(f"{x}_f")) & (F.col(dim) == F.col(f"{x}_dim")) & (F.col(k) == F.col(f"{x}_at"))
    met = cells.join(at("a"), same("a", "time_dim", "t")).join(at("b"), same("b", "level_dim", "l"))
    start = 978307200 // 3600  # of 2001
    return met.select("file", "variable", "t", (F.col("a_value").cast("long") + start).alias("hour"), "l", F.col("b_value").alias("level"), "pos", F.round("x", 6).alias("x"))


_BOUNDS = "(SELECT c_custkey, (c_custkey * 37 % 181 - 90)::DOUBLE AS a, least(90, c_custkey * 37 % 181 - 90 + c_custkey % 50)::DOUBLE AS b FROM customer)"


@query(
    f"SELECT c_custkey, first, last, n FROM (SELECT c_custkey, list_min(js)::INT AS first, list_max(js)::INT AS last, len(js)::BIGINT AS n FROM (SELECT c_custkey, CASE WHEN a = b THEN [list_sort(list_transform(range(37), lambda j: [round(abs(90 - j * 5.0::DOUBLE - a), 9), j]))[1][2]] "
    f"ELSE list_filter(range(37), lambda j: 90 - j * 5 BETWEEN a - 0.0001 AND b + 0.0001) END AS js FROM {_BOUNDS})) WHERE n > 0"
)
def latitude_ranges(spark, sf_dir):
    """Rows of a grid of 5 degrees within bounds, or next to them where they are equal."""
    k = F.col("c_custkey")
    south = (k * 37 % 181 - 90).cast("double")
    rows = read(spark, sf_dir, "customer").select("c_custkey", arrays.latitude_range(arrays.Shape(72, 37, 90.0, -5.0, 0.0, 5.0), south, F.least(F.lit(90.0), south + k % 50)).alias("r"))
    return rows.filter("r IS NOT NULL").select("c_custkey", F.col("r.first").cast("int").alias("first"), F.col("r.last").cast("int").alias("last"), F.size("r.values").cast("long").alias("n"))


@query(
    "SELECT c_custkey, CASE WHEN a = b THEN near ELSE ((a + 360) % 360 + 4) // 5 END::INT % 72 AS first, CASE WHEN a = b THEN near % 72 ELSE ((b + 360) % 360) // 5 END::INT AS last, CASE WHEN a = b THEN 1 ELSE greatest(0, floor(b / 5.0) - ceil(a / 5.0) + 1) END::BIGINT AS n, "
    "CASE WHEN a = b THEN (near % 72) * 5 WHEN a < 0 AND b >= 0 THEN ceil(a / 5.0) * 5 ELSE ceil((a + 360) % 360 / 5.0) * 5 END::DOUBLE AS west FROM (SELECT *, least(71, round(((a + 360) % 360) / 5.0 - 0.01)) AS near FROM (SELECT c_custkey, c_custkey * 7 % 330 - 170 AS a, c_custkey * 7 % 330 - 170 + (c_custkey % 4) * 6 AS b FROM customer)) "
    "WHERE a = b OR (floor(b / 5.0) >= ceil(a / 5.0) AND (a + 360) % 360 // 5 < 71)"
)
def longitude_ranges(spark, sf_dir):
    """Columns of a grid of 5 degrees from one meridian eastward to another, some beyond the grid's edge."""
    k = F.col("c_custkey")
    west = k * 7 % 330 - 170
    east = west + k % 4 * 6
    rows = read(spark, sf_dir, "customer").select("c_custkey", west.alias("a"), east.alias("b"), arrays.longitude_range(arrays.Shape(72, 37, 90.0, -5.0, 0.0, 5.0), west.cast("double"), east.cast("double")).alias("r"))
    rows = rows.filter("r IS NOT NULL AND (a = b OR pmod(a, 360) div 5 < 71)")
    return rows.select("c_custkey", F.col("r.first").cast("int").alias("first"), F.col("r.last").cast("int").alias("last"), F.size("r.values").cast("long").alias("n"), F.get("r.values", F.lit(0)).alias("west"))


_METHOD = "concat(' over intervals of ', p2, ' ', u)"


@query(
    f"SELECT event_id, code::INT AS code, CASE WHEN code = 113 THEN CASE WHEN unit IN (1, 2) AND d - n // CASE WHEN unit = 2 THEN 1 ELSE 24 // p2 END < 3 THEN 'time: mean over months' ELSE concat('time: mean', {_METHOD}) END "
    f"WHEN unit IN (1, 2) THEN concat('time: ', w, ' over ', p2 - p1, ' ', u, CASE WHEN n // 4 = d THEN ' time: mean over months' ELSE concat(' time: mean', {_METHOD}) END) ELSE concat('time: ', w, ' over ', p2 - p1, ' ', u, ' time: ', w, {_METHOD}) END AS method FROM "
    "(SELECT event_id, [113, 137, 138][event_id % 3 + 1] AS code, CASE WHEN event_id % 3 = 1 THEN 'sum' ELSE 'mean' END AS w, [1, 2, 11][event_id % 7 % 3 + 1] AS unit, ['hours', 'days', '6hours'][event_id % 7 % 3 + 1] AS u, event_id % 3 AS p1, [6, 12, 24][event_id % 5 % 3 + 1] AS p2, "
    "CASE WHEN event_id % 2 = 0 THEN 4 ELSE 1 END * (28 + event_id % 4) AS n, day(last_day(ts)) AS d FROM events)"
)
def cell_methods(spark, sf_dir):
    """How averages and sums over a month or over intervals stand for their times."""
    k = F.col("event_id")
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    rows = read(spark, sf_dir, "events").select(
        "event_id", "ts", pick((113, 137, 138), k % 3).alias("code"), pick((1, 2, 11), k % 7 % 3).alias("unit"), (k % 3).alias("p1"), pick((6, 12, 24), k % 5 % 3).alias("p2"), (F.when(k % 2 == 0, 4).otherwise(1) * (28 + k % 4)).alias("n")
    )
    return rows.select("event_id", "code", arrays.cell_methods(*map(F.col, ("code", "unit", "p1", "p2", "n", "ts"))).alias("method"))
