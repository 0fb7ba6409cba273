"""Queries of conversions between grid schemas over fields made of embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conversions
from .queries import FIELD_SQL, fields, query, read


def _packed(spark, sf_dir):
    n = F.col("vec_id")
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    return fields(spark, sf_dir).select(
        "vec_id", pick((1, 2, 3, 9), n % 4).alias("source"), pick((1, 6, 10, 28, 44, 3), n % 6).alias("param"), F.when(n % 5 == 0, 1013).when(n % 5 == 1, 1001).otherwise(500).alias("level1"), F.when(n % 3 == 0, 700).otherwise(0).alias("level2"),
        (n % 24).cast("int").alias("forecast_hours"), F.when(n % 7 == 0, 30).otherwise(0).alias("n_mean"), F.lit(1990).alias("year"), (n % 12 + 1).cast("int").alias("month"), F.col("v").alias("values"),
    )


_SOURCE = (
    f"(SELECT *, [1, 2, 3, 9][vec_id % 4 + 1] AS source, [1, 6, 10, 28, 44, 3][vec_id % 6 + 1] AS p, CASE vec_id % 5 WHEN 0 THEN 1013 WHEN 1 THEN 1001 ELSE 500 END AS l1, CASE WHEN vec_id % 3 = 0 THEN 700 ELSE 0 END AS l2, vec_id % 24 AS ahead, vec_id % 7 = 0 AS mean FROM {FIELD_SQL})"
)
_MAPPED = (
    "(SELECT *, CASE WHEN p = 6 AND l1 = 1013 THEN 2 ELSE [7, 1, 11, 2, 52][list_position([1, 6, 10, 28, 44], p)] END AS param, CASE p WHEN 1 THEN 100 WHEN 6 THEN CASE WHEN l1 = 1013 THEN 2 ELSE 1 END WHEN 10 THEN CASE WHEN l1 = 1001 THEN 1 ELSE 100 END WHEN 28 THEN 2 ELSE 101 END AS kind, "
    f"CASE WHEN p = 6 THEN 100 ELSE 1 END AS factor, CASE WHEN p = 10 THEN 273.15::DOUBLE ELSE 0 END AS more FROM {_SOURCE} WHERE NOT mean AND p <> 3)"
)
_VALUES = "unnest(range(64))::INT AS pos, round(unnest(list_transform(v, lambda x: x * factor + more)), 4) AS x"


def _out(df, *columns):
    return df.select("vec_id", "center", "param", "level_type", "level1", "level2", "p1", F.posexplode("values").alias("pos", "x")).withColumn("x", F.round("x", 4))


@query(f"SELECT vec_id, CASE source WHEN 1 THEN 7 ELSE 58 END AS center, param, kind AS level_type, CASE WHEN l2 <> 0 THEN l2 ELSE l1 END AS level1, CASE WHEN l2 <> 0 THEN l1 ELSE 0 END AS level2, ahead::INT AS p1, {_VALUES} FROM {_MAPPED} WHERE source IN (1, 3)")
def octagonal_to_message(spark, sf_dir):
    return _out(conversions.packed_to_message(_packed(spark, sf_dir), "octagonal", "vec_id"))


@query(f"SELECT vec_id, CASE source WHEN 1 THEN 7 WHEN 2 THEN 57 ELSE 58 END AS center, param, kind AS level_type, CASE WHEN kind > 10 THEN l1 ELSE 0 END AS level1, CASE WHEN kind > 10 THEN l2 ELSE 0 END AS level2, ahead::INT AS p1, {_VALUES} FROM {_MAPPED} WHERE source <> 9")
def latlon_to_message(spark, sf_dir):
    return _out(conversions.packed_to_message(_packed(spark, sf_dir), "latlon", "vec_id"))


@query(
    "SELECT vec_id, CASE source WHEN 3 THEN 58 END AS center, CASE WHEN mean THEN 113 ELSE 10 END AS time_range, CASE WHEN mean AND 30 <= d THEN 2 ELSE 1 END AS time_unit, CASE WHEN mean AND 30 > d THEN 12 WHEN mean THEN 1 ELSE 0 END AS p2, CASE WHEN mean AND 30 > d THEN 2 * d WHEN mean THEN d ELSE 0 END::INT AS n_mean, "
    f"round(list_sum(v) * 100, 2) AS total FROM (SELECT *, day(last_day(make_date(1990, (vec_id % 12 + 1)::INT, 1))) AS d FROM {_SOURCE} WHERE source = 3)"
)
def pressure_to_message(spark, sf_dir):
    """Pressures with means of 30 samples, which are two a day in February."""
    made = conversions.pressure_to_message(_packed(spark, sf_dir).filter("source = 3"), "vec_id")
    total = F.aggregate(F.filter("values", lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v)
    return made.select("vec_id", "center", "time_range", "time_unit", "p2", "n_mean", F.round(total, 2).alias("total"))


@query(f"SELECT vec_id, 4 AS center, 2 AS param, 102 AS level_type, round(v[2] * 100, 4) AS second FROM {FIELD_SQL}")
def plain_pressure_to_message(spark, sf_dir):
    made = conversions.pressure_to_message(_packed(spark, sf_dir), "vec_id", center=4)
    return made.select("vec_id", "center", "param", "level_type", F.round(F.element_at("values", 2), 4).alias("second"))


@query(
    f"SELECT vec_id, CASE param WHEN 2 THEN 6 WHEN 7 THEN 1 WHEN 11 THEN CASE WHEN kind = 1 THEN 57 ELSE 10 END WHEN 33 THEN 30 WHEN 39 THEN 5 END AS param, CASE WHEN param = 2 THEN 1013 WHEN param = 7 AND kind = 1 THEN 1001 WHEN param = 11 AND (kind = 1 OR (kind = 105 AND level = 2)) THEN 1001 WHEN param = 33 AND kind = 105 THEN 1001 ELSE level END::INT AS level1 FROM "
    "(SELECT vec_id, [2, 7, 11, 33, 39, 61][vec_id % 6 + 1] AS param, [1, 100, 102, 105, 103][vec_id % 5 + 1] AS kind, CASE WHEN vec_id % 4 = 0 THEN 2 ELSE 850 END AS level FROM embeddings) WHERE kind <> 103 AND param <> 61 AND (param <> 2 OR kind = 102)"
)
def message_to_packed(spark, sf_dir):
    n = F.col("vec_id")
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    m = fields(spark, sf_dir).select("vec_id", pick((2, 7, 11, 33, 39, 61), n % 6).alias("param"), pick((1, 100, 102, 105, 103), n % 5).alias("level_type"), F.when(n % 4 == 0, 2).otherwise(850).alias("level1"))
    return conversions.message_to_packed(m, "vec_id").select("vec_id", "param", "level1")


@query("SELECT n_nationkey, unnest(range(1080))::INT AS pos, round(unnest(list_transform(range(1080), lambda k: ((n_nationkey + (21 + k // 72) * 72 + k % 72) % 500 + 100000) * 0.01)), 2)::DOUBLE AS x, round(((n_nationkey + 37 * 72 - 1) % 500 + 100000) * 0.01, 2)::DOUBLE AS pole FROM nation")
def message_to_pressure(spark, sf_dir):
    """Pressures of 37 rows of 72 from 90 S in steps of 5 degrees: those from 15 N on."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(37 * 72 - 1)), lambda k: ((F.col("n_nationkey") + k) % 500 + 100000).cast("double"))
    m = read(spark, sf_dir, "nation").select("n_nationkey", F.lit(7).alias("center"), F.lit(2).alias("param"), F.lit(102).alias("level_type"), F.lit(10).alias("time_range"), F.lit(0).alias("n_mean"), cells.alias("values"))
    made = conversions.message_to_pressure(m, "n_nationkey", nx=72, south=-90.0, step=5.0)
    return made.select("n_nationkey", F.posexplode("values").alias("pos", "x"), "pole").select("n_nationkey", "pos", F.round("x", 2).alias("x"), F.round("pole", 2).alias("pole"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 28 WHEN 1 THEN 47 ELSE 10 END AS param, unnest(range(2397))::INT AS pos, unnest(list_transform(range(2397), lambda k: n_nationkey * 10000 + (k // 47 + 6) * 63 + k % 47 + 8))::DOUBLE AS x FROM nation")
def navy_to_octagonal(spark, sf_dir):
    n = F.col("n_nationkey")
    cells = F.transform(F.sequence(F.lit(0), F.lit(63 * 63 - 1)), lambda k: (n * 10000 + k).cast("double"))
    g = read(spark, sf_dir, "nation").select("n_nationkey", F.when(n % 3 == 0, 6).when(n % 3 == 1, 57).otherwise(10).alias("param"), cells.alias("values"))
    return conversions.navy_to_octagonal(g).select("n_nationkey", "param", F.posexplode("values").alias("pos", "x"))


_FILLED = f"(SELECT vec_id, list_transform(range(64), lambda k: coalesce(v[k + 1], (v[(k // 8) * 8 + (k + 7) % 8 + 1] + v[(k // 8) * 8 + (k + 1) % 8 + 1]) * 0.5)) AS f FROM {FIELD_SQL})"


@query(
    f"SELECT vec_id, unnest(range(128))::INT AS pos, round(unnest(flatten(list_transform(range(64), lambda k: [f[k + 1], coalesce((f[k + 1] + f[(k // 8) * 8 + (k % 8 + 1) % 8 + 1]) * (9.0::DOUBLE / 16) - (f[(k // 8) * 8 + (k % 8 + 7) % 8 + 1] + f[(k // 8) * 8 + (k % 8 + 2) % 8 + 1]) / 16.0::DOUBLE, (f[k + 1] + f[(k // 8) * 8 + (k % 8 + 1) % 8 + 1]) * 0.5)]))), 6) AS x FROM {_FILLED}"
)
def doubled_columns(spark, sf_dir):
    """Fields of 8 columns with cells between them, round the earth."""
    made = fields(spark, sf_dir).select("vec_id", conversions.doubled_columns(F.col("v"), 8).alias("w"))
    return made.select("vec_id", F.posexplode("w").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(
    f"SELECT vec_id, CASE WHEN vec_id % 4 < 2 THEN 100 + vec_id % 4 ELSE vec_id % 4 END::INT AS param, CASE WHEN vec_id % 4 = 1 THEN 5 ELSE 100 END AS level_type, round(v[2] * CASE vec_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 0.5 ELSE 1 END, 6) AS second, vec_id % 3 = 0 AS averaged, vec_id % 3 = 1 AS accumulated FROM {FIELD_SQL}"
)
def remapped_parameters(spark, sf_dir):
    """Codes of one centre by a table, with factors; averages and accumulations by time range."""
    n = F.col("vec_id")
    m = fields(spark, sf_dir).select("vec_id", F.lit(7).alias("center"), (n % 4).cast("int").alias("param"), F.lit(100).alias("level_type"), F.when(n % 3 == 0, 113).when(n % 3 == 1, 114).otherwise(10).alias("time_range"), F.col("v").alias("values"))
    table = spark.createDataFrame([(7, 0, 100, None, 2.0), (7, 1, 101, 5, 0.5), (8, 2, 9, 9, 9.0)], "from_center int, from_param int, to_param int, to_level_type int, factor double")
    made = conversions.remapped(m, table)
    return made.select("vec_id", "param", "level_type", F.round(F.element_at("values", 2), 6).alias("second"), conversions.is_averaged(F.col("time_range")).alias("averaged"), conversions.is_accumulated(F.col("time_range")).alias("accumulated"))
