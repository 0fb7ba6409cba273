"""Queries of fields brought from one grid to another; a field is a run of vectors of `embeddings`, with cells left out by the usual rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.definitions import gaussian_latitudes
from ..operators import regrid
from .queries import FIELD_SQL, fields, query


def _cells(spark, sf_dir, vectors: int, size: int):
    """field, cell, value: vectors after one another, 64 cells each."""
    rows = fields(spark, sf_dir).select("vec_id", F.posexplode("v").alias("pos", "value"))
    return rows.select(F.expr(f"vec_id div {vectors}").alias("field"), (F.col("vec_id") % vectors * 64 + F.col("pos")).cast("int").alias("cell"), "value").filter(F.col("cell") < size)


def _grids(spark, sf_dir, vectors: int, size: int):
    """field, param and the cells as an array, null where a vector lacks one or the table ends. Vectors are put in their places whole."""
    rows = fields(spark, sf_dir).select(F.expr(f"vec_id div {vectors}").alias("field"), (F.col("vec_id") % vectors).cast("int").alias("at"), "v")
    arrays = rows.groupBy("field").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    none = F.array_repeat(F.lit(None).cast("double"), 64)
    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(vectors - 1)), lambda i: F.coalesce(F.try_element_at("m", i), none)))
    code = F.get(F.array(*map(F.lit, (6, 57, 44, 28, 47, 1))), (F.col("field") % 6).cast("int"))
    return arrays.select("field", code.alias("param"), F.slice(whole, 1, size).alias("values"))


def _cells_sql(vectors: int, size: int) -> str:
    return f"(SELECT * FROM (SELECT vec_id // {vectors} AS field, (vec_id % {vectors} * 64 + k)::INT AS cell, v[k + 1] AS x FROM {FIELD_SQL}, range(64) r(k)) WHERE cell < {size} AND x IS NOT NULL)"


def _taps_sql(places: str, cell: str) -> str:
    """target, source, weight of 4 x 4 cells round x, y of `places`; cell: SQL for the source's cell i, j, null where there is none."""
    weight = lambda d, k: f"[{d} * ({d} - 1) / 4, 1 - {d} - {d} * ({d} - 1) / 4, {d} - {d} * ({d} - 1) / 4, {d} * ({d} - 1) / 4][{k} + 2]"
    return (
        f"(SELECT target, {cell} AS source, w FROM (SELECT target, (floor(x) + a)::INT AS i, (floor(y) + b)::INT AS j, {weight('(x - floor(x))', 'a')} * {weight('(y - floor(y))', 'b')} AS w "
        f"FROM (SELECT target, round(px, 9) AS x, round(py, 9) AS y FROM {places}), range(-1, 3) p(a), range(-1, 3) q(b)) WHERE w <> 0)"
    )


_OCTAGON = "(SELECT k AS target, (k % 47)::INT AS i, (k // 47)::INT AS j FROM range(2397) r(k) WHERE k % 47 BETWEEN greatest(0, 14 - k // 47, k // 47 - 36) AND 46 - greatest(0, 14 - k // 47, k // 47 - 36))"
_NEAR = "CASE WHEN abs(round({0}) - {0}) < 0.0001 THEN round({0}) ELSE {0} END"
_LAT = "degrees(asin((973.712023868::DOUBLE - s) / (973.712023868::DOUBLE + s)))"
_LON = "(CASE WHEN i = 23 THEN CASE WHEN j <= 25 THEN 270 ELSE 90 END ELSE degrees(atan((j - 25) / (i - 23)::DOUBLE)) + CASE WHEN i < 23 THEN 180 WHEN j < 25 THEN 360 ELSE 0 END END)"
_TO_OCTAGON = f"(SELECT target, ({_NEAR.format(_LON)} + 10) / 5 % 72 AS px, {_NEAR.format(_LAT)} / 5 AS py FROM (SELECT *, ((i - 23) * (i - 23) + (j - 25) * (j - 25))::DOUBLE AS s FROM {_OCTAGON}))"
_ROUND_EARTH = "CASE WHEN j BETWEEN 0 AND 18 THEN j * 72 + (i + 72) % 72 WHEN j > 18 THEN (36 - j) * 72 + (i + 108) % 72 END"
_FROM_OCTAGON = "(SELECT k AS target, r * cos(radians(k % 72 * 5 - 10.0::DOUBLE)) + 23 AS px, r * sin(radians(k % 72 * 5 - 10.0::DOUBLE)) + 25 AS py FROM (SELECT k, sqrt(973.712023868::DOUBLE) * tan(radians(45 - k // 72 * 5 / 2.0::DOUBLE)) AS r FROM range(4 * 72, 19 * 72) t(k)))"
_IN_OCTAGON = "CASE WHEN j BETWEEN 0 AND 50 AND i BETWEEN greatest(0, 14 - j, j - 36) AND 46 - greatest(0, 14 - j, j - 36) THEN j * 47 + i END"
_CODE = "[6, 57, 44, 28, 47, 1][field % 6 + 1]"


def _met_sql(cells: str, taps: str) -> str:
    return f"(SELECT field, target AS pos, sum(w * x) / sum(w) AS v, {_CODE} AS code FROM {cells} JOIN {taps} ON cell = source GROUP BY field, target HAVING sum(w) >= 0.5 - 1e-9)"


@query(
    f"SELECT field, CASE code WHEN 6 THEN 28 WHEN 57 THEN 47 ELSE code END AS param, pos::INT AS pos, round(v, 6) AS x, round(pole, 6) AS pole FROM "
    f"(SELECT *, max(CASE WHEN pos = 1198 THEN v END) OVER (PARTITION BY field) AS pole FROM {_met_sql(_cells_sql(22, 1368), _taps_sql(_TO_OCTAGON, _ROUND_EARTH))})"
)
def latlon_to_octagonal(spark, sf_dir):
    """Grids of 19 rows of 72 from the equator on the octagonal grid, by 16 cells each."""
    made = regrid.latlon_to_octagonal(_grids(spark, sf_dir, 22, 1368), regrid.Regular(72, 19, 0.0, 5.0, 0.0, 5.0))
    return made.select("field", "param", "pole", F.posexplode("values").alias("pos", "x")).filter("x IS NOT NULL").withColumns({"x": F.round("x", 6), "pole": F.round("pole", 6)})


@query(
    "SELECT field, CASE code WHEN 28 THEN 6 WHEN 47 THEN 57 ELSE code END AS param, pos::INT AS pos, round(CASE WHEN code = 44 THEN least(100, greatest(0, v)) ELSE v END, 6) AS x FROM "
    + _met_sql(_cells_sql(38, 2397), _taps_sql(_FROM_OCTAGON, _IN_OCTAGON))
)
def octagonal_to_latlon(spark, sf_dir):
    """Octagonal grids on 19 rows of 72, from 20 N on."""
    made = regrid.octagonal_to_latlon(_grids(spark, sf_dir, 38, 2397), regrid.Regular(72, 19, 0.0, 5.0, 0.0, 5.0))
    return made.select("field", "param", F.posexplode("values").alias("pos", "x")).filter("x IS NOT NULL").withColumn("x", F.round("x", 6))


_ROWS = "[" + ", ".join(f"{x!r}::DOUBLE" for x in gaussian_latitudes(16)) + "]"


@query(
    f"WITH c AS {_cells_sql(32, 2048)}, t AS (SELECT k AS pos, k % 64 AS i, 85.0::DOUBLE - k // 64 * 2.5 AS lat, len(list_filter(lats, lambda y: y >= 85.0::DOUBLE - k // 64 * 2.5)) AS n, lats FROM range(69 * 64) r(k), (SELECT {_ROWS} AS lats)) "
    "SELECT a.field, pos::INT AS cell, round((a.x * (lat - lats[n + 1]) + b.x * (lats[n] - lat)) / (lats[n] - lats[n + 1]), 6) AS x FROM t JOIN c a ON a.cell = (n - 1) * 64 + i JOIN c b ON b.cell = n * 64 + i AND b.field = a.field"
)
def gaussian_to_latlon(spark, sf_dir):
    """Grids of 32 gaussian rows of 64 on 69 rows 2.5 degrees apart."""
    made = regrid.gaussian_to_latlon(_cells(spark, sf_dir, 32, 2048), regrid.Gaussian(64, 16), "field")
    return made.filter("value IS NOT NULL").select("field", "cell", F.round("value", 6).alias("x"))
