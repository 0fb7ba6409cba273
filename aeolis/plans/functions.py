"""Queries of column functions over the supplied tables: grid definitions, message times, report sections, numbers and strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bitmaps, dates, definitions, met, text
from ..sources import text as records
from .queries import FIELD_SQL, cells_of, cells_sql, fields, query, read

# --- grid definitions

#: A regular grid a part: nx, ny by its size, from the north, round the earth for even keys.
DEFINITION_SQL = "(SELECT p_partkey, 36 + p_partkey % 5 AS nx, 19 AS ny, CASE WHEN p_partkey % 2 = 0 THEN 360.0::DOUBLE / (36 + p_partkey % 5) ELSE 2.5::DOUBLE END AS dx, (p_partkey % 10)::DOUBLE AS slon FROM part)"


def definitions_of(spark, sf_dir):
    p = F.col("p_partkey")
    nx, slon = 36 + p % 5, (p % 10).cast("double")
    dx = F.when(p % 2 == 0, 360.0 / nx).otherwise(2.5)
    number = lambda c: c.cast("double").cast("string")
    numbers = F.concat_ws(":", nx.cast("string"), F.lit("19:90.0N"), F.concat(number(slon), F.lit("E")), F.lit("90.0S"), F.concat(number(slon + dx * (nx - 1)), F.lit("E")), number(dx), F.lit("10.0"))
    return read(spark, sf_dir, "part").select("p_partkey", F.when(p % 3 == 0, "latLon").when(p % 3 == 1, "mercator").otherwise("gaussLatLon").alias("kind"), numbers.alias("numbers"))


@query(f"SELECT p_partkey, nx, ny::BIGINT AS ny, 90.0::DOUBLE AS slat, slon, round(slon + dx * (nx - 1), 6) AS elon, round(dx, 6) AS dx FROM {DEFINITION_SQL}")
def definition_parameters(spark, sf_dir):
    d = definitions_of(spark, sf_dir).select("p_partkey", definitions.parameters(F.col("numbers")).alias("p"))
    return d.select("p_partkey", F.col("p.nx").cast("long").alias("nx"), F.col("p.ny").cast("long").alias("ny"), "p.slat", "p.slon", F.round("p.elon", 6).alias("elon"), F.round("p.dx", 6).alias("dx"))


@query(
    f"SELECT p_partkey, round(CASE WHEN p_partkey % 2 = 0 THEN -180 ELSE slon END, 4)::DOUBLE AS west, round(CASE WHEN p_partkey % 2 = 0 THEN 180 ELSE slon + dx * (nx - 1) END, 4)::DOUBLE AS east, "
    f"round(CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE slon END, 4)::DOUBLE AS west_about_date_line, -90.0::DOUBLE AS south, 90.0::DOUBLE AS north FROM {DEFINITION_SQL}"
)
def spatial_domains(spark, sf_dir):
    d = definitions_of(spark, sf_dir)
    box, other = (definitions.domain(F.col("kind"), F.col("numbers"), c) for c in ("primeMeridian", "dateLine"))
    made = d.select("p_partkey", box.alias("b"), other.alias("o"))
    return made.select("p_partkey", F.round("b.west", 4).alias("west"), F.round("b.east", 4).alias("east"), F.round("o.west", 4).alias("west_about_date_line"), "b.south", "b.north")


@query(
    "SELECT n_nationkey, abbreviation, concat(2.5 + n_nationkey, '&deg; x ', spacing, '&deg; from 0E to 355W and 90N to 90S <small>(', CASE WHEN n_nationkey % 2 = 0 THEN '72 x 19' ELSE CASE WHEN k = 2 THEN 'reduced n9' ELSE 'reduced' END END, ' ', name, ')</small>') AS description FROM "
    "(SELECT n_nationkey, n_nationkey % 3 AS k, ['LL', 'MERC', 'GLL'][n_nationkey % 3 + 1] AS abbreviation, ['Longitude/Latitude', 'Mercator', 'Longitude/Gaussian Latitude'][n_nationkey % 3 + 1] AS name, ['10', '~10', '~10.000'][n_nationkey % 3 + 1] AS spacing FROM nation)"
)
def definition_texts(spark, sf_dir):
    n = F.col("n_nationkey")
    kind = F.when(n % 3 == 0, "latLon").when(n % 3 == 1, "mercator").otherwise("gaussLatLon")
    numbers = F.concat(F.when(n % 2 == 0, "72").otherwise("-1"), F.lit(":19:90N:0E:90S:355W:"), (n + 2.5).cast("string"), F.lit(":10"))
    return read(spark, sf_dir, "nation").select("n_nationkey", definitions.kind_name(kind, short=True).alias("abbreviation"), definitions.description(kind, numbers).alias("description"))


@query(f"SELECT p_partkey, round(CASE WHEN p_partkey % 2 = 0 THEN dx ELSE 2.5 END, 6)::DOUBLE AS dx, round(slon + CASE WHEN p_partkey % 2 = 0 THEN dx ELSE 2.5 END * (nx - 1), 6)::DOUBLE AS elon, p_partkey % 2 = 0 AND round(dx, 3) <> dx AS changed FROM {DEFINITION_SQL}")
def repaired_increments(spark, sf_dir):
    """Increments rounded to three places, put right where the grid goes round the earth."""
    d = definitions_of(spark, sf_dir).select("p_partkey", definitions.parameters(F.col("numbers")).alias("p"))
    rough = d.withColumn("p", F.col("p").withField("dx", F.round("p.dx", 3))).withColumn("p", F.col("p").withField("elon", F.when(F.col("p_partkey") % 2 == 0, F.col("p.slon") + 360 - F.col("p.dx")).otherwise(F.col("p.elon"))))
    made = rough.select("p_partkey", "p", definitions.fixed_increment(F.col("p")).alias("q"))
    return made.select("p_partkey", F.round("q.dx", 6).alias("dx"), F.round("q.elon", 6).alias("elon"), (~definitions.same_parameters(F.col("p"), F.col("q"))).alias("changed"))


_LATITUDES = definitions.gaussian_latitudes(32)
_LIST = "[" + ", ".join(f"{x!r}::DOUBLE" for x in _LATITUDES) + "]"


@query(
    "SELECT p_size, (2 * p_size)::BIGINT AS rows, true AS falling, true AS symmetric, (2 * p_size)::BIGINT AS roots FROM (SELECT DISTINCT p_size FROM part)"
)
def gaussian_latitudes(spark, sf_dir):
    """Latitudes for the sizes of parts as circles: as many as the degree, falling, symmetric, and between any two a sign of the polynomial."""
    sizes = read(spark, sf_dir, "part").select("p_size").distinct()
    table = F.create_map(*(x for n in range(1, 51) for x in (F.lit(n), F.array(*map(F.lit, definitions.gaussian_latitudes(n))))))
    lats = sizes.select("p_size", F.element_at(table, F.col("p_size").cast("int")).alias("l"))
    degree = (2 * F.col("p_size")).cast("int")

    def value(x):
        """The Legendre polynomial by its recurrence, at a sine."""
        first = F.struct(F.lit(1.0).alias("a"), x.alias("b"))
        return F.aggregate(F.sequence(F.lit(2), degree), first, lambda s, k: F.struct(s["b"].alias("a"), (((2 * k - 1) * x * s["b"] - (k - 1) * s["a"]) / k).alias("b")))["b"]

    # A root lies where the sign changes a hair to either side.
    change = lambda y: value(F.sin(F.radians(y + 1e-7))) * value(F.sin(F.radians(y - 1e-7))) < 0
    pairs = F.arrays_zip(F.slice("l", 1, degree - 1).alias("a"), F.slice("l", 2, degree - 1).alias("b"))
    return lats.select(
        "p_size", F.size("l").cast("long").alias("rows"), F.forall(pairs, lambda p: p["a"] > p["b"]).alias("falling"),
        F.forall(F.arrays_zip(F.col("l").alias("a"), F.reverse("l").alias("b")), lambda p: F.abs(p["a"] + p["b"]) < 1e-9).alias("symmetric"), F.size(F.filter("l", change)).cast("long").alias("roots"),
    )


@query(
    f"SELECT c_custkey, lat, coalesce(list_position(list_transform({_LIST}, lambda x: abs(x - lat) < 1.4), true), 0)::INT - 1 AS at, coalesce(list_position(list_transform({_LIST}, lambda x: lat > x), true), 1)::INT - 2 AS north "
    "FROM (SELECT c_custkey, c_custkey % 1800 / 10.0::DOUBLE - 90 AS lat FROM customer)"
)
def latitude_indexes(spark, sf_dir):
    lat = (F.col("c_custkey") % 1800 / 10.0 - 90).alias("lat")
    rows = read(spark, sf_dir, "customer").select("c_custkey", lat)
    return rows.select("c_custkey", "lat", definitions.latitude_index(F.col("lat"), _LATITUDES, 1.4).cast("int").alias("at"), definitions.latitude_index_north(F.col("lat"), _LATITUDES).cast("int").alias("north"))


@query(f"SELECT vec_id, round(v[(vec_id % 8) * 8 + vec_id * 3 % 8 + 1], 6) AS x, vec_id % 8 = 7 AS outside FROM {FIELD_SQL}".replace("round(v[", "round(CASE WHEN vec_id % 8 < 7 THEN v[").replace(" + 1], 6)", " + 1] END, 6)"))
def gridpoints(spark, sf_dir):
    """Cells at places of a grid of 10 by 45 degrees from 70 N; a place off the grid has none."""
    p = F.struct(F.lit(8).alias("nx"), F.lit(8).alias("ny"), F.lit(70.0).alias("slat"), F.lit(0.0).alias("slon"), F.lit(0.0).alias("elat"), F.lit(315.0).alias("elon"), F.lit(45.0).alias("dx"), F.lit(10.0).alias("dy"))
    n = F.col("vec_id")
    outside = n % 8 == 7
    lat, lon = F.when(outside, -35.0).otherwise(70.0 - n % 8 * 10), (n * 3 % 8 * 45.0) - 360
    return fields(spark, sf_dir).select("vec_id", F.round(definitions.gridpoint_at(F.col("v"), p, lat, lon), 6).alias("x"), outside.alias("outside"))


@query(f"SELECT o_orderkey, list_position([floor(f * pow(10.0, i)) >= 1 FOR i IN range(1, 10)] || [true], true)::INT AS places, abs(f - 0.5) < 0.25 AS near_half FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0.0::DOUBLE ELSE (o_orderkey % 1000 + 0.5) / 100000.0::DOUBLE END AS f FROM orders)")
def decimal_places(spark, sf_dir):
    k = F.col("o_orderkey")
    value = F.when(k % 4 == 0, 0.0).otherwise((k % 1000 + 0.5) / 100000.0)
    return read(spark, sf_dir, "orders").select("o_orderkey", definitions.precision(value).cast("int").alias("places"), definitions.nearly(value, F.lit(0.5), 0.25).alias("near_half"))


@query(
    f"SELECT a.vec_id, unnest(range(64))::INT AS pos, round(unnest(list_transform(range(64), lambda i: b.v[i + 1] * cos(radians((i % 8) * 45.0::DOUBLE - 10)) - a.v[i + 1] * sin(radians((i % 8) * 45.0::DOUBLE - 10)))), 6) AS x, "
    f"round(unnest(list_transform(range(64), lambda i: -b.v[i + 1] * sin(radians((i % 8) * 45.0::DOUBLE - 10)) - a.v[i + 1] * cos(radians((i % 8) * 45.0::DOUBLE - 10)))), 6) AS y FROM {FIELD_SQL} a JOIN {FIELD_SQL} b ON b.vec_id = a.vec_id + 1"
)
def turned_winds(spark, sf_dir):
    """Fields and their successors as wind components along a turned grid."""
    a = fields(spark, sf_dir)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    made = a.join(b, "vec_id").select("vec_id", definitions.rotated_wind(F.col("v"), F.col("w"), 8, 45.0, -10.0).alias("r"))
    cells = made.select("vec_id", F.posexplode(F.arrays_zip("r.u", "r.v")).alias("pos", "c"))
    return cells.select("vec_id", "pos", F.round("c.u", 6).alias("x"), F.round("c.v", 6).alias("y"))


@query(cells_sql("list_transform(list_reverse(v), lambda x: x)"))
def reversed_cells(spark, sf_dir):
    return cells_of(fields(spark, sf_dir).withColumn("v", F.reverse("v")), "vec_id")


# --- times of messages

_CODES, _CENTERS, _COUNTS = (7, 51, 113, 118, 120, 123, 128, 129, 130, 131, 132, 133, 137, 138), (7, 34, 98, 60), (5, 29, 31, 60, 62, 120, 124, 744)
_MADE = (
    f"(SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS f, {list(_CODES)}[o_orderkey % 14 + 1] AS code, {list(_CENTERS)}[o_orderkey // 14 % 4 + 1] AS center, CASE WHEN o_orderkey % 5 = 4 THEN 0 ELSE 241 END AS sub, "
    f"[1, 2, 11, 3][o_orderkey // 3 % 4 + 1] AS unit, [0, 6][o_orderkey % 2 + 1] * CASE WHEN o_orderkey // 3 % 4 = 2 THEN 1 ELSE 1 END AS a, {list(_COUNTS)}[o_orderkey // 5 % 8 + 1] AS n, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE [6, 12, 24][o_orderkey // 2 % 3 + 1] END AS b FROM orders)"
)
#: Folds units of six hours; u, h: name and hours of the unit, d: days of the month, s: span.
_BASE = f"(SELECT *, p2 - p1 AS s, day(last_day(f)) AS d, CASE WHEN unit = 2 THEN 'day' ELSE 'hour' END AS u, CASE WHEN unit = 2 THEN 24 ELSE 1 END AS h, unit IN (1, 11) AS hourly, unit = 2 AS daily FROM (SELECT *, a * CASE WHEN unit = 11 THEN 6 ELSE 1 END AS p1, b * CASE WHEN unit = 11 THEN 6 ELSE 1 END AS p2 FROM {_MADE}))"


def _monthly(per: str) -> str:
    return f"({per} > 0 AND d - n // ({per}) BETWEEN 0 AND 2)"


_PER2, _PERS = "CASE WHEN daily THEN 1 WHEN p2 > 0 THEN 24 // p2 END", "CASE WHEN daily THEN 1 WHEN s > 0 THEN 24 // s END"
_EXTENT = "concat(s, '-', u, ' ', what, ' (initial+', p1, ' to initial+', p2, ')')"
_EVERY = "concat(m, ' of ', n, ' Forecasts at ', {}, '-', u, ' intervals of ')"
_TABLE = (
    "SELECT *, CASE WHEN code IN (118, 132) OR (code IN (129, 131) AND center = 34) THEN 'Variance/Covariance' ELSE 'Mean' END AS m, CASE WHEN code IN (120, 137) OR (code = 128 AND center IN (7, 60)) OR (code = 129 AND center = 7) THEN 'Accumulation' ELSE 'Average' END AS what, "
    "CASE WHEN code IN (113, 118) OR (code = 132 AND center = 34 AND sub = 241) THEN 'points' WHEN code = 123 THEN 'analyses' WHEN code = 120 AND hourly THEN 'next' "
    "WHEN (code = 129 AND center = 7) OR (code = 130 AND center = 34 AND sub = 241) OR (code = 131 AND center = 7) OR (code = 131 AND center = 34 AND sub = 241 AND hourly) THEN 'next by day' "
    "WHEN (code = 128 AND (center IN (7, 60) OR (center = 34 AND sub = 241))) OR (code = 130 AND center = 7) THEN 'days' WHEN code = 129 AND center = 34 AND sub = 241 AND hourly THEN 'variance' "
    "WHEN code IN (137, 138) AND center IN (7, 60) AND hourly THEN 'sixes' WHEN code = 51 AND (unit = 3 OR (hourly AND p2 = 24)) THEN 'climate' WHEN code = 7 AND center = 7 AND daily AND p2 = 0 THEN 'back' "
    f"WHEN code = 130 AND center = 98 AND unit = 1 THEN 'hours' WHEN code = 133 AND center = 98 AND unit = 1 AND p1 % 24 > 0 THEN 'steps' END AS kind FROM {_BASE}"
)
_STEPS = "(24 // (24 // greatest(p1 % 24, 1)))"


@query(
    "SELECT o_orderkey, CASE WHEN kind IN ('points', 'analyses') AND (hourly OR daily) THEN CASE "
    f"WHEN {_monthly(_PER2)} THEN concat('Monthly ', m, ' (', {_PER2}, ' per day) of ', CASE WHEN kind = 'analyses' OR p1 = 0 THEN 'Analyses' ELSE concat(p1, '-', u, ' Forecasts') END) "
    "WHEN kind = 'analyses' THEN concat(m, ' of ', n, ' Analyses at ', p2, '-', u, ' intervals') ELSE concat(m, ' of ', n, ' ', p1, '-', u, ' Forecasts at ', p2, '-', u, ' intervals') END "
    f"WHEN kind LIKE 'next%' AND (hourly OR daily) THEN CASE WHEN kind = 'next' AND {_monthly(_PERS)} THEN concat('Monthly ', m, ' (', {_PERS}, ' per day) of Forecasts of ', {_EXTENT}) "
    f"WHEN kind <> 'next' AND {_monthly(_PER2)} THEN concat('Monthly ', m, ' (', {_PER2}, ' per day) of Forecasts of ', {_EXTENT}) ELSE concat({_EVERY.format('s')}, {_EXTENT}) END "
    f"WHEN kind = 'days' AND (hourly OR daily) THEN concat(CASE WHEN n = d THEN 'Monthly Mean (1 per day) of ' ELSE {_EVERY.format('CASE WHEN what = ' + chr(39) + 'Average' + chr(39) + ' THEN s ELSE p2 END')} END, {_EXTENT}) "
    f"WHEN kind = 'variance' THEN concat(CASE WHEN d - n BETWEEN 0 AND 2 THEN 'Monthly Variance/Covariance (1 per day) of Forecasts of ' ELSE concat(m, ' of ', n, ' Forecasts at 24-hour intervals of ') END, {_EXTENT}) "
    f"WHEN kind = 'sixes' THEN concat(CASE WHEN n // 4 = d THEN 'Monthly Mean (4 per day) of ' WHEN n = d THEN 'Monthly Mean (1 per day) of ' ELSE {_EVERY.format('CASE WHEN code = 138 THEN s ELSE p2 END')} END, {_EXTENT}) "
    "WHEN kind = 'climate' THEN concat(n, '-year Climatology of ', CASE WHEN unit = 3 THEN 'Monthly Means' ELSE 'Daily Means' END) "
    "WHEN kind = 'back' THEN CASE WHEN day(last_day((f - INTERVAL (p1) DAY)::DATE)) = p1 + 1 THEN 'Monthly Mean' WHEN p1 = 4 THEN 'Pentad Mean' WHEN p1 = 6 THEN 'Weekly Mean' ELSE concat(p1 + 1, '-day Average') END "
    "WHEN kind = 'hours' AND n = 24 * day(last_day((f + INTERVAL (n) HOUR)::DATE)) THEN 'Monthly Mean (24 per day) of Forecasts of 1-hour Accumulation' "
    f"WHEN kind = 'steps' AND n = (24 // (p1 % 24)) * day(last_day((f + INTERVAL (n * {_STEPS}) HOUR)::DATE)) THEN concat('Monthly Mean (', 24 // (p1 % 24), ' per day) of ', {_STEPS}, '-hour Forecasts') END AS product, "
    "CASE WHEN kind IN ('points', 'analyses') AND (hourly OR daily) THEN f + INTERVAL ((n - 1) * p2 * h) HOUR WHEN kind LIKE 'next%' AND (hourly OR daily) THEN f + INTERVAL (n * s * h) HOUR WHEN kind = 'days' AND (hourly OR daily) THEN f + INTERVAL ((n - 1) * 24 + s * h) HOUR "
    "WHEN kind = 'variance' THEN f + INTERVAL ((n - 1) * 24 + p2) HOUR WHEN kind = 'sixes' THEN f + INTERVAL (CASE WHEN code = 137 OR n // 4 = d THEN (n - 1) * 6 WHEN n = d THEN (n - 1) * 24 ELSE 0 END + s) HOUR "
    "WHEN kind = 'climate' THEN f + INTERVAL (n - 1) YEAR + CASE WHEN unit = 3 THEN INTERVAL 1 MONTH ELSE INTERVAL 1 DAY END WHEN kind = 'back' THEN f "
    "WHEN kind = 'hours' AND n = 24 * day(last_day((f + INTERVAL (n) HOUR)::DATE)) THEN f + INTERVAL (n) HOUR "
    f"WHEN kind = 'steps' AND n = (24 // (p1 % 24)) * day(last_day((f + INTERVAL (n * {_STEPS}) HOUR)::DATE)) THEN f + INTERVAL (n * {_STEPS}) HOUR END AS last FROM ({_TABLE})"
)
def sampled_products(spark, sf_dir):
    """Means, variances and climatologies of all codes, centres and units."""
    k = F.col("o_orderkey")
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    div = lambda n: F.floor(k / n)
    p2 = F.when(k % 3 == 0, 0).otherwise(pick((6, 12, 24), div(2) % 3))
    made = dates.sampled_product(
        F.date_trunc("month", "o_orderdate").cast("timestamp"), pick(_CODES, k % 14), pick(_CENTERS, div(14) % 4), F.when(k % 5 == 4, 0).otherwise(241), pick((1, 2, 11, 3), div(3) % 4), pick((0, 6), k % 2), p2, pick(_COUNTS, div(5) % 8)
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", made.alias("m")).select("o_orderkey", "m.product", F.col("m.last").cast("timestamp_ntz").alias("last"))


@query(
    "SELECT o_orderkey, CASE WHEN c = 1 THEN concat(6 * (k % 4), '-hour Forecast') WHEN c = 10 THEN concat(6 * (k % 4), '-hour Forecast') WHEN c = 4 THEN concat('Accumulation from ', k % 4, ' to ', k % 4 + 2) WHEN c = 5 THEN concat('Difference from ', k % 4, ' to ', k % 4 + 2) ELSE concat('Product from ', k % 4, ' to ', k % 4 + 2) END AS product, "
    "t + INTERVAL (CASE WHEN c = 10 THEN ((k % 4) * 256 + k % 4 + 2) * 6 WHEN c = 1 THEN k % 4 * 6 ELSE (k % 4 + 2) * 6 END) HOUR AS valid FROM (SELECT o_orderkey, o_orderkey AS k, date_trunc('day', o_orderdate)::TIMESTAMP AS t, [1, 2, 4, 5, 10][o_orderkey % 5 + 1] AS c FROM orders) WHERE NOT (c = 10 AND k % 4 = 0)"
)
def single_products(spark, sf_dir):
    """Forecasts, spans, accumulations and differences in units of six hours."""
    k = F.col("o_orderkey")
    code, p1 = F.get(F.array(*map(F.lit, (1, 2, 4, 5, 10))), (k % 5).cast("int")), (k % 4).cast("int")
    made = dates.grib_product(F.date_trunc("day", "o_orderdate").cast("timestamp"), F.lit(11), code, p1, p1 + 2, F.lit(1))
    rows = read(spark, sf_dir, "orders").filter(~((k % 5 == 4) & (k % 4 == 0))).select("o_orderkey", made.alias("m"))
    return rows.select("o_orderkey", "m.product", F.col("m.valid").cast("timestamp_ntz").alias("valid"))


# --- sections of reports


@query(
    "SELECT event_id, section, key, value FROM (SELECT event_id, 'AA1' AS section, unnest(['hours', 'depth', 'condition', 'quality']) AS key, unnest([lpad((event_id % 24)::VARCHAR, 2, '0'), CASE WHEN event_id % 4 > 0 THEN lpad((event_id % 9000)::VARCHAR, 4, '0') END, '9', '1']) AS value FROM events "
    "UNION ALL SELECT event_id, 'AW1', unnest(['weather', 'quality']), unnest([lpad((event_id % 99)::VARCHAR, 2, '0'), '5']) FROM events WHERE event_id % 2 = 0)"
)
def sections_of_reports(spark, sf_dir):
    k = F.col("event_id")
    two = lambda c, n: F.lpad(c.cast("string"), n, "0")
    body = F.concat(F.lit("ADDAA1"), two(k % 24, 2), F.when(k % 4 > 0, two(k % 9000, 4)).otherwise("9999"), F.lit("91"), F.when(k % 2 == 0, F.concat(F.lit("AW1"), two(k % 99, 2), F.lit("5"))).otherwise(""), F.lit("REMSYN004AA1 no"))
    found = records.report_sections(read(spark, sf_dir, "events").select("event_id", body.alias("sections")), "event_id")
    return found.select("event_id", "section", F.explode("fields"))


# --- numbers, characters and strings


@query("SELECT o_orderkey, lower(hex(o_orderkey)) AS hexadecimal, o_orderkey AS back, printf('%o', o_orderkey) AS octal, CASE WHEN o_orderkey % 10 < 5 THEN o_orderkey % 100 ELSE -(o_orderkey % 100) END AS punched FROM orders".replace("printf('%o', o_orderkey)", "CASE WHEN o_orderkey = 0 THEN '0' ELSE concat_ws('', " + ", ".join(f"CASE WHEN o_orderkey >= {8**i} THEN (o_orderkey // {8**i} % 8)::VARCHAR END" for i in range(10, -1, -1)) + ") END"))
def number_bases(spark, sf_dir):
    """Numbers in base 16 and 8, and with a sign over the last digit."""
    k = F.col("o_orderkey")
    number = F.when(k % 10 < 5, k % 100).otherwise(-(k % 100))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", F.lower(F.hex(k)).alias("hexadecimal"), F.conv(F.hex(k), 16, 10).cast("long").alias("back"), F.conv(k, 10, 8).alias("octal"), records.overpunched_number(records.overpunch(number, 2)).cast("long").alias("punched")
    )


@query("SELECT o_orderkey, CASE WHEN s >= 4294967296 THEN s - 4294967295 ELSE s END AS checksum FROM (SELECT o_orderkey, o_orderkey % 4294967296 + (o_orderkey * 7919 + 3000000000) % 4294967296 AS s FROM orders)")
def end_around_sums(spark, sf_dir):
    """Sums of words of 32 bits whose carry is added again."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", text.end_around_sum(F.array(k % (1 << 32), (k * 7919 + 3000000000) % (1 << 32)), 32).alias("checksum"))


@query("SELECT p_partkey, substr(p_type, 1, 1) || lower(substr(p_type, 2)) AS capital, trim('  ' || p_name || ' ') AS trimmed, replace(p_name, 'e', 'E') AS replaced, p_name AS unquoted, length(p_name)::INT AS n FROM part")
def edited_strings(spark, sf_dir):
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.substring("p_type", 1, 1), F.lower(F.substring("p_type", 2, 1000))).alias("capital"), F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"), F.replace(name, F.lit("e"), F.lit("E")).alias("replaced"),
        text.unquote(F.concat(F.lit('"'), name, F.lit('"'))).alias("unquoted"), F.length(name).alias("n"),
    )


@query("SELECT p_partkey, printf('%.2f', p_retailprice) AS price, lpad(p_size::VARCHAR, 6, '0') AS size, p_size > 25 AS large, concat('(''', p_brand, ''', ''', p_type, ''')') AS tuple FROM part")
def numbers_as_text(spark, sf_dir):
    quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.format_string("%.2f", "p_retailprice").alias("price"), F.lpad(F.col("p_size").cast("string"), 6, "0").alias("size"), (F.col("p_size") > 25).alias("large"), F.concat(F.lit("("), F.concat_ws(", ", quoted(F.col("p_brand")), quoted(F.col("p_type"))), F.lit(")")).alias("tuple")
    )


@query("SELECT p_partkey, p_brand AS brand, p_size AS size, split_part(p_type, ' ', 1) AS first FROM part")
def split_lines(spark, sf_dir):
    """Fields of lines with commas and doubled quotes."""
    line = F.concat(F.lit('"'), F.col("p_brand"), F.lit('",'), F.col("p_size").cast("string"), F.lit(","), F.split_part("p_type", F.lit(" "), F.lit(1)))
    made = read(spark, sf_dir, "part").select("p_partkey", text.csv_split(line).alias("f"))
    return made.select("p_partkey", text.unquote(F.element_at("f", 1)).alias("brand"), F.element_at("f", 2).cast("int").alias("size"), F.element_at("f", 3).alias("first"))


@query("SELECT c_custkey, replace(replace(c_name, '#', '%23'), ' ', '%20') AS encoded, c_name AS decoded, parse FROM (SELECT *, c_mktsegment AS parse FROM customer)")
def encoded_urls(spark, sf_dir):
    name = F.replace(F.url_encode("c_name"), F.lit("+"), F.lit("%20"))
    return read(spark, sf_dir, "customer").select("c_custkey", name.alias("encoded"), F.url_decode(F.url_encode("c_name")).alias("decoded"), F.parse_url(F.concat(F.lit("https://x.org/a?s="), "c_mktsegment", F.lit("&b=1")), F.lit("QUERY"), F.lit("s")).alias("parse"))


@query("SELECT event_id, (props->>'$.k')::INT AS k, (props->>'$.k')::INT > 50 AS over, concat('{\"k\": ', props->>'$.k', '}') AS printed FROM events")
def json_comparisons(spark, sf_dir):
    """Typed comparison of values in JSON, and the object printed again."""
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select("event_id", k.alias("k"), (k > 50).alias("over"), F.concat(F.lit('{"k": '), k.cast("string"), F.lit("}")).alias("printed"))


@query("SELECT user_id, concat_ws('', list_transform(range(360), lambda i: CASE WHEN list_contains(m, i) THEN '1' ELSE '0' END)) AS bits FROM (SELECT user_id, list((event_id * 7 % 360)::INT) AS m FROM events GROUP BY 1)".replace("concat_ws('', list_transform(", "array_to_string(list_transform(").replace("ELSE '0' END)) AS bits", "ELSE '0' END), '') AS bits"))
def expanded_longitudes(spark, sf_dir):
    """Longitudes packed three to a digit and spread out again."""
    present = F.collect_set((F.col("event_id") * 7 % 360).cast("int"))
    packed = read(spark, sf_dir, "events").groupBy("user_id").agg(present.alias("m"))
    return packed.select("user_id", bitmaps.longitude_bits(bitmaps.longitudes(F.col("m"))).alias("bits"))


@query("SELECT o_orderkey, day(last_day(o_orderdate::DATE))::INT AS days, strftime(o_orderdate, '%Y%m%d%H%M%S')::BIGINT AS digits, date_trunc('second', o_orderdate) AS back, o_orderdate + INTERVAL (o_orderkey % 50 - 25) HOUR AS hours, o_orderdate - INTERVAL (o_orderkey % 90) MINUTE AS minutes, o_orderdate + INTERVAL (o_orderkey % 1000) SECOND AS seconds FROM orders")
def shifted_times(spark, sf_dir):
    k, ts = F.col("o_orderkey"), F.col("o_orderdate")
    digits = F.date_format(ts, "yyyyMMddHHmmss").cast("long")
    local = lambda c: c.cast("timestamp_ntz")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", dates.days_in_month(F.year(ts), F.month(ts)).cast("int").alias("days"), digits.alias("digits"), local(dates.from_digits(digits)).alias("back"), local(dates.add("hour", ts, k % 50 - 25)).alias("hours"),
        local(dates.add("minute", ts, -(k % 90))).alias("minutes"), local(dates.add("second", ts, k % 1000)).alias("seconds"),
    )


@query("SELECT event_id, round(ln(p / 1013.15) * 8.31432 * (t + 273.15) / -0.28404373326, 1) AS height FROM (SELECT event_id, event_id % 60 - 30.0::DOUBLE AS t, 500.0::DOUBLE + event_id % 500 AS p FROM events)")
def layer_heights(spark, sf_dir):
    k = F.col("event_id")
    return read(spark, sf_dir, "events").select("event_id", F.round(met.hypsometric_height(500.0 + k % 500, k % 60 - 30.0), 1).alias("height"))
