"""Named queries over the supplied tables, each with equivalent SQL.

Vectors of `embeddings` serve as fields of 8 by 8 cells, with cells left out by a rule; customers and
suppliers have places by a rule on their keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bitmaps, dates, geo, grids, met, soundings, text
from ..operators import catalog, joins, ranges, search, series, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NX = 8
FIELD_SQL = "(SELECT vec_id, label, list_transform(range(1, 65), lambda i: CASE WHEN (vec_id * 31 + i - 1) % 17 = 0 THEN NULL ELSE embedding[i]::DOUBLE END) AS v FROM embeddings)"
PLACE_SQL = "(SELECT c_custkey AS k, (c_custkey * 3571 % 18001) / 100.0::DOUBLE - 90 AS lat, (c_custkey * 7919 % 36001) / 100.0::DOUBLE - 180 AS lon FROM customer)"
RAD = "(pi() / 180)"


def query(sql: str | None = None):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries of the name {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") * 31 + i) % 17 != 0, x.cast("double")))
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", v.alias("v"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("k"), ((k * 3571 % 18001) / 100.0 - 90).alias("lat"), ((k * 7919 % 36001) / 100.0 - 180).alias("lon"))


def cells_of(df: DataFrame, *keys: str) -> DataFrame:
    """Rounded cells in rows, so that results compare as plain columns."""
    return df.select(*keys, F.posexplode("v").alias("pos", "x")).withColumn("x", F.round("x", 6))


def cells_sql(expression: str, source: str = FIELD_SQL) -> str:
    return f"SELECT vec_id, unnest(range(64))::INT AS pos, round(unnest({expression}), 6) AS x FROM {source}"


# --- inventory


@query(
    "SELECT event_type, year(ts)::INT AS year, month(ts)::INT AS month, hour(ts)::INT AS hour, " + ", ".join(f"nullif(count(*) FILTER (day(ts) = {d}), 0) AS d{d}" for d in range(1, 32))
    + " FROM events GROUP BY 1, 2, 3, 4"
)
def inventory_pivot(spark, sf_dir):
    """Counts by event type, month and hour with a column for each day of the month."""
    days = read(spark, sf_dir, "events").select("event_type", F.year("ts").alias("year"), F.month("ts").alias("month"), F.hour("ts").alias("hour"), F.concat(F.lit("d"), F.dayofmonth("ts")).alias("dom"))
    return days.groupBy("event_type", "year", "month", "hour").pivot("dom", [f"d{d}" for d in range(1, 32)]).agg(F.count(F.lit(1)))


# --- fields


@query(cells_sql("list_transform(v, lambda x: x + 2.5)"))
def grid_scalar_add(spark, sf_dir):
    return cells_of(fields(spark, sf_dir).withColumn("v", grids.scalar(F.col("v"), lambda x: x + 2.5)), "vec_id")


@query(cells_sql("list_transform(v, lambda x: x * 3)"))
def grid_scalar_multiply(spark, sf_dir):
    return cells_of(fields(spark, sf_dir).withColumn("v", grids.scalar(F.col("v"), lambda x: x * 3)), "vec_id")


@query(cells_sql("list_transform(v, lambda x: sqrt(abs(x)))"))
def grid_sqrt_abs(spark, sf_dir):
    return cells_of(fields(spark, sf_dir).withColumn("v", grids.scalar(F.col("v"), lambda x: F.sqrt(F.abs(x)))), "vec_id")


def _pairs(spark, sf_dir, f):
    a = fields(spark, sf_dir)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return cells_of(a.join(b, "vec_id").withColumn("v", f(F.col("v"), F.col("w"))), "vec_id")


def _pairs_sql(f: str) -> str:
    return f"SELECT a.vec_id, unnest(range(64))::INT AS pos, round(unnest(list_transform(range(1, 65), lambda i: {f})), 6) AS x FROM {FIELD_SQL} a JOIN {FIELD_SQL} b ON b.vec_id = a.vec_id + 1"


@query(_pairs_sql("a.v[i] + b.v[i]"))
def grid_add_grid(spark, sf_dir):
    return _pairs(spark, sf_dir, lambda a, b: grids.combine(a, b, lambda x, y: x + y))


@query(_pairs_sql("a.v[i] - b.v[i]"))
def grid_subtract_grid(spark, sf_dir):
    return _pairs(spark, sf_dir, lambda a, b: grids.combine(a, b, lambda x, y: x - y))


@query(_pairs_sql("a.v[i] * b.v[i]"))
def grid_multiply_grid(spark, sf_dir):
    return _pairs(spark, sf_dir, lambda a, b: grids.combine(a, b, lambda x, y: x * y))


@query(_pairs_sql("a.v[i] / nullif(b.v[i], 0)"))
def grid_divide_grid(spark, sf_dir):
    return _pairs(spark, sf_dir, grids.divide)


@query(f"SELECT label, pos, count(x) AS n, round(CASE WHEN count(x) >= 10 THEN avg(x) END, 6) AS mean FROM (SELECT label, unnest(range(64))::INT AS pos, unnest(v) AS x FROM {FIELD_SQL}) GROUP BY ALL")
def grid_mean_min10(spark, sf_dir):
    return series.grid_mean(fields(spark, sf_dir), "label", values="v").select("label", "pos", "n", F.round("mean", 6).alias("mean"))


@query(f"SELECT four, pos, round(CASE WHEN count(x) = count(*) THEN sum(x) END, 6) AS total FROM (SELECT vec_id // 4 AS four, unnest(range(64))::INT AS pos, unnest(v) AS x FROM {FIELD_SQL}) GROUP BY ALL")
def grid_sum_strict(spark, sf_dir):
    """Sums of four fields each."""
    return series.grid_sum_strict(fields(spark, sf_dir).withColumn("four", F.expr("vec_id div 4")), "four", values="v").withColumn("total", F.round("total", 6))


@query(
    "SELECT vec_id, round(lo, 6) AS min, round(hi, 6) AS max, round(list_avg(v), 6) AS avg, ((pl - 1) % 8 + 1)::INT AS min_i, ((pl - 1) // 8 + 1)::INT AS min_j, ((ph - 1) % 8 + 1)::INT AS max_i, ((ph - 1) // 8 + 1)::INT AS max_j, (64 - list_count(v))::INT AS missing "
    f"FROM (SELECT *, list_position(v, lo) AS pl, list_position(v, hi) AS ph FROM (SELECT vec_id, v, list_min(v) AS lo, list_max(v) AS hi FROM {FIELD_SQL}))"
)
def grid_stats(spark, sf_dir):
    out = fields(spark, sf_dir).select("vec_id", grids.stats(F.col("v"), NX).alias("s")).select("vec_id", "s.*")
    return out.withColumns({c: F.round(c, 6) for c in ("min", "max", "avg")})


@query(cells_sql("list_transform(range(64), lambda i: v[(7 - i // 8) * 8 + i % 8 + 1])"))
def grid_reverse_scan(spark, sf_dir):
    return cells_of(fields(spark, sf_dir).withColumn("v", grids.reverse_scan(F.col("v"), NX)), "vec_id")


@query(f"SELECT vec_id, unnest(range(12))::INT AS pos, round(unnest(list_transform([22, 23, 16, 17, 30, 31, 24, 25, 38, 39, 32, 33], lambda k: v[k + 1])), 6) AS x FROM {FIELD_SQL}")
def grid_subset_wrap(spark, sf_dir):
    """Rows 2 to 4 and columns 6 to 1 round the edge."""
    return cells_of(fields(spark, sf_dir).withColumn("v", grids.subset(F.col("v"), NX, 2, 4, 6, 1)), "vec_id")


@query(f"SELECT a.vec_id, unnest(range(120))::INT AS pos, round(unnest(list_concat(a.v, b.v[9:64])), 6) AS x FROM {FIELD_SQL} a JOIN {FIELD_SQL} b ON b.vec_id = a.vec_id + 1")
def grid_combine_hemispheres(spark, sf_dir):
    return _pairs(spark, sf_dir, lambda a, b: grids.combine_hemispheres(a, b, NX))


# --- places and weather


@query(
    f"SELECT a.k, round(sqrt(pow((a.lat - b.lat) * 111.125, 2) + pow((a.lon - b.lon) * cos((a.lat + b.lat) / 2 * {RAD}) * 111.125, 2)), 3) AS arc, "
    f"round(2 * 6372.795477598 * asin(sqrt(least(1.0, pow(sin((b.lat - a.lat) / 2 * {RAD}), 2) + cos(a.lat * {RAD}) * cos(b.lat * {RAD}) * pow(sin((b.lon - a.lon) / 2 * {RAD}), 2)))), 3) AS gc "
    f"FROM {PLACE_SQL} a JOIN {PLACE_SQL} b ON b.k = a.k + 1"
)
def distances(spark, sf_dir):
    a = places(spark, sf_dir)
    b = a.select((F.col("k") - 1).alias("k"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    four = [F.col(c) for c in ("lat", "lon", "lat2", "lon2")]
    return a.join(b, "k").select("k", F.round(geo.arc_distance(*four), 3).alias("arc"), F.round(geo.gc_distance(*four), 3).alias("gc"))


@query(
    f"SELECT lat_index, lon_index, count(*) AS n FROM (SELECT CASE WHEN abs(lat + 90) < 1e-5 THEN 0 WHEN abs(lat - 90) < 1e-5 THEN 37 ELSE floor((ceil(lat) + 94) / 5) END::INT AS lat_index, "
    f"CASE WHEN abs(abs(lat) - 90) < 1e-5 THEN 0 ELSE floor((ceil(CASE WHEN abs(lon + 180) < 1e-5 THEN 180 ELSE lon END) + 179) / 5) END::INT AS lon_index FROM {PLACE_SQL} WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) GROUP BY ALL"
)
def boxes(spark, sf_dir):
    """Places by boxes of 5 degrees."""
    box = geo.box_index(F.col("lat"), F.col("lon"), 5)
    return places(spark, sf_dir).select(box.alias("b")).filter("b IS NOT NULL").groupBy("b.lat_index", "b.lon_index").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT k FROM {PLACE_SQL} WHERE lon > -100 AND lon < 100 AND lat < 50 AND lat > -50 AND abs(lon) / 2 + abs(lat) < 50")
def polygon(spark, sf_dir):
    """Places in a rhomb."""
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((-100, 0), (0, 50), (100, 0), (0, -50), (-100, 0))))
    return places(spark, sf_dir).filter(geo.within_polygon(ring, F.col("lon"), F.col("lat"))).select("k")


@query(
    "SELECT event_id, round(6.11 * pow(10.0, 7.5 * d / (237.7 + d)) / (6.11 * pow(10.0, 7.5 * t / (237.7 + t))) * 100, 4) AS rh, round(sqrt(t * t + d * d), 6) AS speed, "
    "CASE WHEN t = 0 AND d = 0 THEN 0 WHEN t >= 0 AND d >= 0 THEN a + 180 WHEN t >= 0 THEN 360 - a WHEN d >= 0 THEN 180 - a ELSE a END::INT AS direction FROM (SELECT *, floor(degrees(acos(least(abs(d) / nullif(sqrt(t * t + d * d), 0), 1.0::DOUBLE))) + 0.5) AS a FROM (SELECT event_id, event_id % 50 - 10.0::DOUBLE AS t, event_id % 50 - 10.0::DOUBLE - event_id % 7 AS d FROM events))"
)
def humidity_wind(spark, sf_dir):
    t = F.col("event_id") % 50 - 10.0
    d = t - F.col("event_id") % 7
    return read(spark, sf_dir, "events").select("event_id", F.round(met.relative_humidity(t, d), 4).alias("rh"), F.round(met.wind_speed(t, d), 6).alias("speed"), met.wind_direction(t, d).alias("direction"))


@query(
    "SELECT p_partkey, round(CASE WHEN p > 1013.25 THEN NULL WHEN p > 226.32064 THEN 288.15 / 0.0065 * (1 - pow(p / 1013.25, 0.0065 * (8314.32 / 28.9644) / 9.80665)) "
    "WHEN p > 54.748887 THEN 11000 + (8314.32 / 28.9644) * 216.65 / 9.80665 * ln(226.32064 / p) END, 2) AS height FROM (SELECT p_partkey, 60.0::DOUBLE + p_partkey * 13 % 1000 AS p FROM part)"
)
def standard_height(spark, sf_dir):
    p = F.lit(60.0) + F.col("p_partkey") * 13 % 1000
    return read(spark, sf_dir, "part").select("p_partkey", F.round(met.standard_height(p), 2).alias("height"))


_MIXING = "1.0::DOUBLE"
for _ in range(12):
    _MIXING = f"(r + (1006.3::DOUBLE + ({_MIXING} + r) / 2 * 1850) / 2462880 * (wet - dry))"


@query(
    "SELECT p_partkey, round(243.5::DOUBLE * x / (17.67::DOUBLE - x) * 9 / 5 + 32, 4) AS dew_point FROM (SELECT p_partkey, ln(m * hpa / (0.62197::DOUBLE + m) / 6.112::DOUBLE) AS x FROM "
    f"(SELECT *, {_MIXING} AS m FROM (SELECT *, 0.62197::DOUBLE * s / (hpa - s) AS r FROM (SELECT *, 6.112::DOUBLE * exp(17.67::DOUBLE * wet / (243.5::DOUBLE + wet)) AS s FROM (SELECT p_partkey, (60.0::DOUBLE + p_partkey % 30 - 32) * 5 / 9 AS dry, (60.0::DOUBLE + p_partkey % 30 - p_partkey % 9 - 32) * 5 / 9 AS wet, 29.92::DOUBLE * 33.8637526::DOUBLE AS hpa FROM part)))))"
)
def dew_point(spark, sf_dir):
    """Iterated mixing ratio, twelve rounds."""
    dry = F.lit(60.0) + F.col("p_partkey") % 30
    return read(spark, sf_dir, "part").select("p_partkey", F.round(met.dew_point(dry, dry - F.col("p_partkey") % 9, F.lit(29.92)), 4).alias("dew_point"))


# --- dates


@query(
    "SELECT o_orderkey, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE + (day(o_orderdate) - 1)::INT AS overflow, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS clamped, last_day(o_orderdate::DATE) AS month_end FROM orders"
)
def month_arithmetic(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.add_months_overflow(d, 1).alias("overflow"), dates.add_months_clamped(d, 1).alias("clamped"), F.last_day(d).alias("month_end"))


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate < o_orderdate THEN -1 ELSE floor(epoch(l_shipdate - o_orderdate) / 86400) END::BIGINT AS days, "
    "CASE WHEN l_shipdate < o_orderdate THEN -1 ELSE floor(epoch(l_shipdate - o_orderdate) / 3600) END::BIGINT AS hours FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
)
def spans_since(spark, sf_dir):
    both = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", "l_linenumber", dates.since("day", F.col("l_shipdate"), F.col("o_orderdate")).alias("days"), dates.since("hour", F.col("l_shipdate"), F.col("o_orderdate")).alias("hours"))


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts + INTERVAL 3 HOURS - INTERVAL 1 MICROSECOND, TIMESTAMP '2000-01-01') AS slot, event_type, count(*) AS n FROM events GROUP BY ALL")
def synoptic_bucket(spark, sf_dir):
    slot = dates.synoptic(F.col("ts")).cast("timestamp_ntz")
    return read(spark, sf_dir, "events").groupBy(slot.alias("slot"), "event_type").agg(F.count(F.lit(1)).alias("n"))


# --- joins


@query(
    "WITH h AS (SELECT user_id, date_trunc('day', ts) + INTERVAL 6 HOUR AS s, date_trunc('day', ts) + INTERVAL 18 HOUR AS e, count(*) AS site FROM events GROUP BY ALL), "
    "r AS (SELECT v.event_id, h.site, h.s, row_number() OVER (PARTITION BY v.event_id ORDER BY h.e < v.ts, CASE WHEN h.e >= v.ts THEN h.s END, h.s DESC) AS rn FROM events v LEFT JOIN h USING (user_id)) "
    "SELECT event_id, site, s AS since FROM r WHERE rn = 1"
)
def history_join(spark, sf_dir):
    """Events with the entry of their user's history that holds, or comes next, or was last."""
    events = read(spark, sf_dir, "events")
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    history = events.groupBy("user_id", (day + F.make_dt_interval(hours=F.lit(6))).alias("s")).agg(F.count(F.lit(1)).alias("site")).withColumn("e", F.expr("s + INTERVAL 12 HOUR"))
    return joins.history_join(events, history, "user_id", "ts", "s", "e").select("event_id", F.col("entry.site").alias("site"), F.col("entry.s").alias("since"))


@query(
    "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(floor(epoch(a.ts) / 3600) - floor(epoch(b.ts) / 3600)) <= 1 AND date_trunc('month', a.ts) = date_trunc('month', b.ts)"
)
def tolerance_join(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return joins.tolerance_join(events, events, "user_id", "ts").filter("l_event_id < r_event_id").select(F.col("l_event_id").alias("a"), F.col("r_event_id").alias("b"))


@query("SELECT k, lat, max(m) FILTER (m <= lat) AS below, min(m) FILTER (m >= lat) AS above FROM " + PLACE_SQL + ", (SELECT DISTINCT s_suppkey % 60 * 3.0::DOUBLE - 90 AS m FROM supplier) GROUP BY ALL")
def latitude_bracket(spark, sf_dir):
    marks = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 60 * 3.0 - 90).alias("m"))
    return joins.nearest_below_above(places(spark, sf_dir).select("k", "lat"), marks, "lat", "m")


@query("SELECT c_custkey, n_name, count(o_orderkey) AS n, max(o_orderdate) AS latest FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL HAVING count(o_orderkey) > 10")
def left_join_having(spark, sf_dir):
    c, n, o = (read(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    # Orders are counted before the join.
    counted = o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.max("o_orderdate").alias("latest")).filter("n > 10")
    return c.join(counted, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "n", "latest")


@query("SELECT n_name AS place FROM nation UNION SELECT r_name FROM region")
def union_distinct(spark, sf_dir):
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("place")).union(read(spark, sf_dir, "region").select("r_name")).distinct()


@query("SELECT 'order' AS kind, o_orderkey AS k, o_orderdate AS moment FROM orders UNION ALL SELECT 'line', l_orderkey, l_shipdate FROM lineitem ORDER BY moment, kind, k")
def union_all_ordered(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("moment"))
    return o.unionByName(read(spark, sf_dir, "lineitem").select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias("moment"))).orderBy("moment", "kind", "k")


@query("SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS status, min(concat(o_orderdate::DATE, ' ', o_orderpriority)) AS first, max(concat(o_orderdate::DATE, ' ', o_orderpriority)) AS last FROM orders GROUP BY 1")
def status_list(spark, sf_dir):
    at = F.concat_ws(" ", F.to_date("o_orderdate").cast("string"), "o_orderpriority")
    status = F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",")
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(status.alias("status"), F.min(at).alias("first"), F.max(at).alias("last"))


@query("SELECT doc_id, CASE WHEN n_chars >= 1000000 THEN concat(n_chars // 1000000, ' MB') WHEN n_chars >= 1000 THEN concat(n_chars // 1000, ' kB') ELSE concat(n_chars, ' B') END AS size FROM documents")
def size_label(spark, sf_dir):
    n = F.col("n_chars")
    unit = lambda d, u: F.concat_ws(" ", F.floor(n / d).cast("string"), F.lit(u))
    return read(spark, sf_dir, "documents").select("doc_id", F.when(n >= 1000000, unit(1000000, "MB")).when(n >= 1000, unit(1000, "kB")).otherwise(unit(1, "B")).alias("size"))


@query(
    "SELECT l_returnflag, l_shipmonth, count(*) FILTER (diff <= 1000) AS good, count(*) FILTER (diff > 1000) AS bad, round(sum(diff), 2) AS total FROM (SELECT l_returnflag, month(l_shipdate)::INT AS l_shipmonth, abs(l_extendedprice / l_quantity - p_retailprice) AS diff FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY GROUPING SETS ((l_returnflag), (l_shipmonth))"
)
def compare_counts(spark, sf_dir):
    """Differences within and beyond a tolerance, by either of two keys in one pass."""
    both = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = both.select("l_returnflag", F.month("l_shipdate").alias("l_shipmonth"), F.abs(F.col("l_extendedprice") / F.col("l_quantity") - F.col("p_retailprice")).alias("diff"))
    out = rows.groupingSets([["l_returnflag"], ["l_shipmonth"]], "l_returnflag", "l_shipmonth")
    return out.agg(F.count_if(F.col("diff") <= 1000).alias("good"), F.count_if(F.col("diff") > 1000).alias("bad"), F.round(F.sum("diff"), 2).alias("total"))


# --- series


@query(
    "SELECT event_type, round(n / s * f, 6) AS rate, unit FROM (SELECT *, unnest([1, 60, 3600, 86400, 604800, day(last_day(b)) * 86400]) AS f, unnest(['second', 'minute', 'hour', 'day', 'week', 'month']) AS unit, unnest([1, 2, 3, 4, 5, 6]) AS i FROM "
    "(SELECT event_type, count(*)::DOUBLE AS n, epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS s, max(ts)::DATE AS b FROM events GROUP BY 1)) WHERE n / s * f > 0.85 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY i) = 1"
)
def observation_rate(spark, sf_dir):
    second = lambda c: F.date_trunc("second", c)
    grouped = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), second(F.min("ts")).alias("a"), second(F.max("ts")).alias("b"))
    return grouped.select("event_type", series.rate(F.col("n"), F.col("a"), F.col("b")).alias("r")).select("event_type", F.round("r.rate", 6).alias("rate"), "r.unit")


@query(
    "WITH d AS (SELECT DISTINCT user_id, (event_id * 7 % 360)::INT AS i FROM events), g AS (SELECT user_id, i, coalesce(lead(i) OVER w, min(i) OVER (PARTITION BY user_id) + 360) AS nxt FROM d WINDOW w AS (PARTITION BY user_id ORDER BY i)), "
    "b AS (SELECT *, nxt - i - 1 AS gap, row_number() OVER (PARTITION BY user_id ORDER BY nxt - i - 1 DESC, i) AS rn FROM g) SELECT user_id, CASE WHEN gap = 0 THEN 0 ELSE nxt % 360 END::INT AS west, CASE WHEN gap = 0 THEN 359 ELSE i END::INT AS east FROM b WHERE rn = 1"
)
def longitude_bounds(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", (F.col("event_id") * 7 % 360).cast("int").alias("i"))
    return series.longitude_bounds(rows, "user_id", "i").select("user_id", F.col("west").cast("int").alias("west"), F.col("east").cast("int").alias("east"))


@query(
    "WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, 1000.0::DOUBLE - l_linenumber * 90 AS p, 280.0::DOUBLE - l_linenumber * 5 + min(l_quantity) / 50 AS tv, 100.0::DOUBLE * l_linenumber AS z FROM lineitem GROUP BY l_orderkey, l_linenumber), "
    "d AS (SELECT *, coalesce(round((tv + lag(tv) OVER w) * ln(lag(p) OVER w / p) * 14.63563358), 0) AS layer, first(z) OVER w AS z0 FROM l WINDOW w AS (PARTITION BY k ORDER BY p DESC)) SELECT k, n, z0 + sum(layer) OVER (PARTITION BY k ORDER BY p DESC) AS computed_height FROM d"
)
def running_height(spark, sf_dir):
    n = F.col("l_linenumber")
    levels = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    rows = levels.select(F.col("l_orderkey").alias("k"), n.alias("n"), (1000.0 - n * 90).alias("p"), (280.0 - n * 5 + F.col("q") / 50).alias("tv"), (100.0 * n).alias("z"))
    return series.running_height(rows, "k", "p", "tv", "z").select("k", "n", "computed_height")


@query("SELECT l_returnflag, (CASE WHEN l_discount >= 0.03 THEN 1 ELSE 0 END + CASE WHEN l_discount >= 0.06 THEN 1 ELSE 0 END)::INT AS bucket, min(l_discount) AS finest FROM lineitem GROUP BY ALL")
def finest_resolution(spark, sf_dir):
    return series.finest_resolution(read(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_discount"), (0.03, 0.06))


@query(f"SELECT min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east, count(*) FILTER (lat > 80 OR lat < -80) AS polar FROM {PLACE_SQL}")
def bounding_box(spark, sf_dir):
    kept = places(spark, sf_dir)
    return kept.agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.count_if(F.abs("lat") > 80).alias("polar"))


# --- text

WORDS_SQL = r"(SELECT doc_id, generate_subscripts(ws, 1) - 1 AS location, unnest(ws) AS raw FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS ws FROM documents))"
CLEAN_SQL = r"nullif(regexp_replace(regexp_replace(lower(trim(raw)), '<[^>]*>', '', 'g'), '^[,:''\"\\(<>]+|[,:''\"\\)+.<>]+$', '', 'g'), '')"


@query(f"SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs, min(location)::INT AS first FROM (SELECT doc_id, location, {CLEAN_SQL} AS word FROM {WORDS_SQL}) WHERE word IS NOT NULL GROUP BY 1")
def word_counts(spark, sf_dir):
    """How often and where the words of all texts come."""
    return search.word_totals(read(spark, sf_dir, "documents"), "text")


@query(
    f"WITH b AS (SELECT DISTINCT {CLEAN_SQL} AS word FROM (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+')) AS raw FROM benchmark)) "
    f"SELECT word, count(*) AS n FROM (SELECT {CLEAN_SQL} AS word FROM {WORDS_SQL}) d WHERE regexp_matches(word, '^[a-z]+$') AND word NOT IN (SELECT word FROM b WHERE word IS NOT NULL) GROUP BY 1"
)
def unknown_words(spark, sf_dir):
    index = search.word_index(read(spark, sf_dir, "documents"), "doc_id", "text")
    known = search.word_index(read(spark, sf_dir, "benchmark").withColumn("item", F.col("item_id")), "item", "text")
    return search.unknown_words(index, known)


def _stem_sql(word: str) -> str:
    for ending in text.ENDINGS:
        word = f"regexp_replace({word}, '^(.+){ending}$', '\\1')"
    for letter in "abcdefghijklmnopqrstuvwxyz":
        word = f"regexp_replace({word}, '{letter}{letter}+$', '{letter}')"
    return word


@query(f"SELECT DISTINCT word, {_stem_sql('word')} AS stem FROM (SELECT unnest(regexp_split_to_array(lower(p_name), ' ')) AS word FROM part) WHERE regexp_matches(word, '^[a-z]+$')")
def stems(spark, sf_dir):
    w = read(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).filter(F.col("word").rlike("^[a-z]+$")).distinct()
    return w.select("word", text.stem(F.col("word")).alias("stem"))


_DIGITS = "translate(regexp_replace(substr(u, 2), '[AEIOUHWY]', '', 'g'), 'BFPVCGJKQSXZDTLMNR', '111122222222334556')"
for _ in "123456":
    _DIGITS = f"regexp_replace({_DIGITS}, '{_}+', '{_}', 'g')"


@query(f"SELECT n_name, CASE WHEN u = '' THEN '' ELSE concat(substr(u, 1, 1), rpad(d, greatest(length(d), 3)::INT, '0')) END AS sound FROM (SELECT *, {_DIGITS} AS d FROM (SELECT n_name, upper(regexp_replace(n_name, '[^A-Za-z]', '', 'g')) AS u FROM nation))")
def sounds(spark, sf_dir):
    """Phonetic codes of names."""
    return read(spark, sf_dir, "nation").select("n_name", text.phonetic(F.regexp_replace("n_name", "[^A-Za-z]", "")).alias("sound"))


@query("SELECT a AS word, b AS other FROM (SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey) UNION SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def synonyms(spark, sf_dir):
    both = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return search.synonyms(both, "n_name", "r_name")


@query("SELECT event_id, (props->>'$.k')::INT AS k, json_type(props) = 'OBJECT' AS is_object, len(json_keys(props))::INT AS n_keys FROM events")
def json_values(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.json_object_keys("props").isNotNull().alias("is_object"), F.size(F.json_object_keys("props")).alias("n_keys"))


@query(r"SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS protocol, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", F.parse_url(u, F.lit("PROTOCOL")).alias("protocol"), F.parse_url(u, F.lit("HOST")).alias("host"), F.parse_url(u, F.lit("QUERY"), F.lit("page")).alias("page"))


# --- bitmaps


@query("SELECT l_orderkey, list_sort(list_distinct(list(l_partkey)))::VARCHAR AS parts, min(l_partkey)::VARCHAR AS first FROM lineitem GROUP BY 1")
def bitmap_round_trip(spark, sf_dir):
    """Part keys of an order through their text form and back."""
    packed = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(bitmaps.encode(F.collect_set("l_partkey")).alias("bits"))
    parts = F.concat(F.lit("["), F.array_join(bitmaps.decode(F.col("bits")), ", "), F.lit("]"))
    return packed.select("l_orderkey", parts.alias("parts"), F.split_part("bits", F.lit(":"), F.lit(1)).alias("first"))


@query("SELECT l_orderkey, bool_or(l_linenumber = 3) AS has_third FROM lineitem GROUP BY 1")
def bitmap_contains(spark, sf_dir):
    packed = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(bitmaps.encode(F.collect_set("l_linenumber")).alias("bits"))
    return packed.select("l_orderkey", bitmaps.contains(F.col("bits"), F.lit(3)).alias("has_third"))


# --- strings, times and catalogue


@query(
    "SELECT c_custkey, list_extract(string_split(c_name, '#'), 2) AS second, (len(c_name) - len(replace(c_name, '0', '')))::INT AS zeros, regexp_matches(c_mktsegment, '^[A-Za-z]*$') AS letters, lower(c_mktsegment) AS low, contains(c_name, '1') AS has_one FROM customer"
)
def string_parts(spark, sf_dir):
    name = F.col("c_name")
    return read(spark, sf_dir, "customer").select(
        "c_custkey", F.nullif(text.token(name, "#", 1), F.lit("")).alias("second"), text.occurs(name, F.lit("0")).alias("zeros"), text.is_class(F.col("c_mktsegment"), "alpha").alias("letters"),
        text.ascii_lower(F.col("c_mktsegment")).alias("low"), text.holds(name, F.lit("1")).alias("has_one"),
    )


@query("SELECT doc_id, format('{:,}', n_chars * 1000 + doc_id) AS grouped FROM documents")
def number_groups(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.with_commas((F.col("n_chars") * 1000 + F.col("doc_id")).cast("string")).alias("grouped"))


@query("SELECT event_id, TIMESTAMP '2000-01-01' + to_microseconds((event_id * 5400000000)::BIGINT) AS at_time, strftime(ts, '%Y-%m') AS month FROM events")
def cf_times(spark, sf_dir):
    at = dates.cf_time(F.col("event_id") * 1.5, F.lit("hours since 2000-01-01 00:00:00"))
    return read(spark, sf_dir, "events").select("event_id", at.cast("timestamp_ntz").alias("at_time"), dates.to_precision(F.col("ts"), F.lit(2)).alias("month"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'Analysis' ELSE concat(o_orderkey % 4 * 6, '-hour Forecast') END WHEN o_orderkey % 3 = 1 THEN concat('Average from ', o_orderkey % 4, ' to ', o_orderkey % 4 + 2) ELSE 'Mean of 5 Analyses' END AS product, "
    "date_trunc('day', o_orderdate) + INTERVAL 6 HOUR * (CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 WHEN o_orderkey % 3 = 1 THEN o_orderkey % 4 + 2 ELSE 4 * (o_orderkey % 4 + 2) END)::INT AS valid FROM orders"
)
def product_times(spark, sf_dir):
    """Product text and valid time of messages made of order keys."""
    k = F.col("o_orderkey")
    code, p1 = F.when(k % 3 == 0, 0).when(k % 3 == 1, 3).otherwise(123), (k % 4).cast("int")
    made = dates.grib_product(F.date_trunc("day", "o_orderdate").cast("timestamp"), F.lit(11), code, p1, p1 + 2, F.lit(5))
    return read(spark, sf_dir, "orders").select("o_orderkey", made.alias("m")).select("o_orderkey", "m.product", F.col("m.valid").cast("timestamp_ntz").alias("valid"))


@query("SELECT p_partkey, p_type, dense_rank() OVER (ORDER BY p_type)::INT - 1 AS code FROM part")
def code_numbers(spark, sf_dir):
    """Types by their place among all types."""
    return catalog.numbered(read(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", "code")


@query(
    "SELECT o_orderkey, concat(c_name, ', ', substr(n_name, 1, 1), '. (', year(o_orderdate), '). ', o_orderpriority, '. ', r_name, '. https://doi.org/10.0/', o_orderkey) AS citation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)
def citations(spark, sf_dir):
    o, c, n, r = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    author = F.array(F.struct(F.col("c_name").alias("last"), F.col("n_name").alias("first")))
    return rows.select("o_orderkey", catalog.citation(author, F.year("o_orderdate"), F.col("o_orderpriority"), F.col("r_name"), F.concat(F.lit("10.0/"), "o_orderkey")).alias("citation"))


@query("SELECT p_partkey, concat('<oai_dc:dc xmlns:oai_dc=\"http://www.openarchives.org/OAI/2.0/oai_dc/\" xmlns:dc=\"http://purl.org/dc/elements/1.1/\"><dc:title>', replace(p_name, '&', '&amp;'), '</dc:title><dc:subject>', p_type, '</dc:subject><dc:subject>', p_brand, '</dc:subject></oai_dc:dc>') AS doc FROM part")
def dublin_core(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", catalog.dublin_core({"title": F.col("p_name"), "subject[]": F.array("p_type", "p_brand")}).alias("doc"))


# --- changes to keyed tables


def stock(spark, sf_dir):
    return read(spark, sf_dir, "orders").filter("o_orderstatus <> 'O'").select("o_orderkey", "o_orderstatus", "o_totalprice")


def deliveries(spark, sf_dir):
    return read(spark, sf_dir, "orders").filter("o_orderpriority < '3'").select("o_orderkey", F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority < '3' THEN 'N' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderpriority < '3' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus <> 'O' OR o_orderpriority < '3'")
def rows_upserted(spark, sf_dir):
    return tables.upsert(stock(spark, sf_dir), deliveries(spark, sf_dir), "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus ELSE 'N' END AS o_orderstatus, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice ELSE o_totalprice * 2 END AS o_totalprice FROM orders WHERE o_orderstatus <> 'O' OR o_orderpriority < '3'")
def rows_inserted(spark, sf_dir):
    return tables.insert_new(stock(spark, sf_dir), deliveries(spark, sf_dir), "o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer WHERE CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END >= 0")
def rows_updated_deleted(spark, sf_dir):
    raised = tables.update(read(spark, sf_dir, "customer"), F.col("c_mktsegment") == "BUILDING", {"c_acctbal": F.col("c_acctbal") + 100})
    return tables.delete(raised, F.col("c_acctbal") < 0).select("c_custkey", "c_acctbal")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN 0.0::DOUBLE ELSE l_quantity END AS l_quantity FROM lineitem WHERE l_orderkey % 5 <> 0 OR l_linenumber <= 2")
def groups_replaced(spark, sf_dir):
    """The lines of every fifth order give way to its first two, with no quantity; orders without these keep theirs."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    fifth = lines.filter("l_orderkey % 5 = 0")
    fresh = fifth.filter("l_linenumber <= 2").withColumn("l_quantity", F.lit(0.0))
    return tables.replace_groups(lines, fresh, "l_orderkey", groups=fifth, parts=ranges.range_count(lines.count()))


# --- intervals and pairs


@query(
    "WITH p AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate + INTERVAL 20 DAY AS due FROM orders), h AS (SELECT o_custkey AS c, o_orderdate + INTERVAL 30 DAY AS s, o_orderdate + INTERVAL 60 DAY AS e, o_orderkey AS wmo FROM orders) "
    "SELECT k, coalesce(arg_min(wmo, (s, e, wmo)), 0) AS wmo FROM p LEFT JOIN h ON p.c = h.c AND s <= due AND e >= due GROUP BY k"
)
def interval_join(spark, sf_dir):
    """Numbers that held at a time, 0 if none did."""
    o = read(spark, sf_dir, "orders")
    later = lambda days: F.col("o_orderdate") + F.make_dt_interval(days=F.lit(days))
    points = o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), later(20).alias("at"))
    history = o.select(F.col("o_custkey").alias("c"), later(30).alias("s"), later(60).alias("e"), F.col("o_orderkey").alias("wmo"))
    return joins.interval_join(points, history, "c", "at", "s", "e").select("k", F.coalesce(F.col("entry.wmo"), F.lit(0).cast("long")).alias("wmo"))


@query(
    "WITH s AS (SELECT user_id, hour(ts)::INT AS hour, event_type, sum(value) AS total FROM events GROUP BY ALL) "
    "SELECT u.user_id, u.hour, round(u.total, 6) AS u_total, round(v.total, 6) AS v_total FROM s u JOIN s v USING (user_id, hour) WHERE u.event_type = 'click' AND v.event_type = 'view'"
)
def component_pairs(spark, sf_dir):
    """Two kinds of values of one user and hour in one row."""
    sums = read(spark, sf_dir, "events").groupBy("user_id", F.hour("ts").alias("hour"), "event_type").agg(F.sum("value").alias("total"))
    return joins.pair_components(sums, "event_type", "click", "view", "user_id", "hour").select("user_id", "hour", F.round("u_total", 6).alias("u_total"), F.round("v_total", 6).alias("v_total"))


# --- more strings and times


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+02:30') AS iso, concat(strftime(o_orderdate, '%-d %B %Y, %a %-H'), ' LST') AS longer, strftime(o_orderdate, '%b/%-m/%d %H:%M') AS mixed FROM orders")
def formatted_times(spark, sf_dir):
    at = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.formatted(at, "%ISO8601", 230).alias("iso"), dates.formatted(at, "%dd %hh %Y, %a %HH %ZZ", -2400).alias("longer"), dates.formatted(at, "%h/%mm/%d %R").alias("mixed"))


_PRINTABLE = "".join(map(chr, range(32, 127)))
_quoted = lambda s: "'" + s.replace("'", "''") + "'"


@query(
    f"SELECT p_partkey, translate(p_name, {_quoted(_PRINTABLE)}, {_quoted(_PRINTABLE[7:] + _PRINTABLE[:7])}) AS shifted, left(p_name, greatest(len(p_name) - 4, 0)::INT) AS chopped, "
    "concat(trunc(p_retailprice)::BIGINT, rpad(string_split(printf('%.2f', p_retailprice), '.')[2], 4, '0')) AS digits FROM part"
)
def string_codes(spark, sf_dir):
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select("p_partkey", text.shift(name, 7).alias("shifted"), text.chop(name, 4).alias("chopped"), text.coordinate_digits(F.format_string("%.2f", "p_retailprice")).alias("digits"))


@query("SELECT p_partkey, rtrim(regexp_replace(p_name || ' ' || p_type, '(.{1,10}|[^ ]+)( |$)', E'  \\\\1\\n', 'g'), E'\n') AS wrapped FROM part")
def wrapped_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.wrap(F.concat_ws(" ", "p_name", "p_type"), 12, 2).alias("wrapped"))


@query(
    "SELECT c_custkey, concat('d', c_custkey) AS dsnum, ['1', c_mktsegment] AS level, c_acctbal AS nlat, -99.0::DOUBLE AS slat, -999.0::DOUBLE AS wlon, 999.0::DOUBLE AS elon, 'g' AS format, '' AS no_format FROM customer"
)
def subset_requests(spark, sf_dir):
    """Requests for parts of a dataset, taken apart."""
    request = F.concat(F.lit("dsnum=d"), "c_custkey", F.lit(";level=1,"), "c_mktsegment", F.lit(";parameters=g!t,u;nlat="), F.col("c_acctbal").cast("string"), F.lit(";slat="))
    r = read(spark, sf_dir, "customer").select("c_custkey", text.subset_request(request).alias("r"))
    return r.select("c_custkey", "r.dsnum", "r.level", "r.nlat", "r.slat", "r.wlon", "r.elon", F.col("r.parameters")["t"].alias("format"), F.col("r.parameters")["u"].alias("no_format"))


@query("SELECT CASE WHEN l_partkey % 130 IN (51, 113, 115, 117, 123) THEN 'average' WHEN l_partkey % 130 IN (114, 116, 124) THEN 'accumulation' END AS kind, count(*) AS n FROM lineitem GROUP BY 1")
def time_range_kinds(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(text.time_range_kind(F.col("l_partkey") % 130).alias("kind")).agg(F.count("*").alias("n"))


# --- more fields and soundings


@query(cells_sql("list_transform(v, lambda x: pow(abs(x), 1.5))"))
def grid_power(spark, sf_dir):
    return cells_of(fields(spark, sf_dir).withColumn("v", grids.power(grids.scalar(F.col("v"), F.abs), 1.5)), "vec_id")


_GAUSSIAN = [70.0, 50.5, 30.25, 10.0, -10.0, -30.25, -50.5, -70.0]
_WANTED = [75.0, 60.0, 50.5, 20.0, 0.0, -40.0]


def _latitude_cell(lat: float, i: int) -> str:
    between = [(n, n + 1) for n in range(7) if _GAUSSIAN[n] >= lat >= _GAUSSIAN[n + 1]]
    if not between:
        return "NULL"
    n, s = between[0]
    share = (lat - _GAUSSIAN[s]) / (_GAUSSIAN[n] - _GAUSSIAN[s])
    if share in (0.0, 1.0):
        return f"v[{(n if share else s) * 8 + i}]"
    return f"v[{n * 8 + i}] * {share!r}::DOUBLE + v[{s * 8 + i}] * {1 - share!r}::DOUBLE"


@query(f"SELECT vec_id, unnest(range({8 * len(_WANTED)}))::INT AS pos, round(unnest([{', '.join(_latitude_cell(lat, i) for lat in _WANTED for i in range(1, 9))}]), 6) AS x FROM {FIELD_SQL}")
def grid_to_latitudes(spark, sf_dir):
    """Rows at unequal latitudes brought to wanted ones, linear in latitude."""
    return cells_of(fields(spark, sf_dir).withColumn("v", grids.to_latitudes(F.col("v"), NX, _GAUSSIAN, _WANTED)), "vec_id")


_VAPOR = "6.1078::DOUBLE * pow(10, 7.5 * {0} / (237.3 + {0}))"


@query(
    f"WITH s AS (SELECT l_orderkey, l_linenumber, 1000.0::DOUBLE - l_quantity * 10 AS p, l_discount * 300 AS t, l_tax * 100 AS m FROM lineitem) SELECT l_orderkey, l_linenumber, round((t + 273.15) / (1 - 0.379 * ({_VAPOR.format('(t - m)')}) / p), 6) AS by_dew_point, "
    f"round((t + 273.15) / (1 - 0.379 * (m / 100 * {_VAPOR.format('t')}) / p), 6) AS by_humidity, round((t + 273.15) / (1 - 0.379 * (p * (m / 10000) / (m / 10000 + 0.62197)) / p), 6) AS by_ratio FROM s"
)
def virtual_temperatures(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (1000.0 - F.col("l_quantity") * 10).alias("p"), (F.col("l_discount") * 300).alias("t"), (F.col("l_tax") * 100).alias("m"))
    tv = lambda m, kind: F.round(soundings.virtual_temperature(F.col("p"), F.col("t"), m, kind), 6)
    return s.select("l_orderkey", "l_linenumber", tv(F.col("t") - F.col("m"), "dew_point").alias("by_dew_point"), tv(F.col("m"), "humidity").alias("by_humidity"), tv(F.col("m"), "mixing_ratio").alias("by_ratio"))


# --- weighted means, presence of longitudes, documents and other calendars


@query(
    "WITH f AS (SELECT label, vec_id % 7 + 1 AS w, v FROM " + FIELD_SQL + "), c AS (SELECT label, w, unnest(range(len(v)))::INT AS pos, unnest(v) AS x FROM f) "
    "SELECT label, pos, round(CASE WHEN count(x) = count(*) THEN sum(x * w) / sum(w) END, 6) AS mean FROM c GROUP BY label, pos"
)
def grid_mean_weighted(spark, sf_dir):
    weighted = fields(spark, sf_dir).withColumn("weight", F.col("vec_id") % 7 + 1)
    return series.grid_mean_weighted(weighted, "label", weight="weight", values="v").withColumn("mean", F.round("mean", 6))


@query(
    "WITH s AS (SELECT user_id, list(DISTINCT (event_id * 7 % 360)::INT) AS have FROM events GROUP BY user_id), t AS (SELECT user_id, list_transform(range(120), lambda i: CASE WHEN list_contains(have, 3 * i) THEN 4 ELSE 0 END "
    "+ CASE WHEN list_contains(have, 3 * i + 1) THEN 2 ELSE 0 END + CASE WHEN list_contains(have, 3 * i + 2) THEN 1 ELSE 0 END) AS d, list_transform(range(360), lambda i: CASE WHEN list_contains(have, i) THEN '1' ELSE '0' END) AS b FROM s) "
    "SELECT user_id, array_to_string(d, '') AS longitudes, array_to_string(b, '') AS bits FROM t"
)
def longitude_presence(spark, sf_dir):
    found = series.longitude_presence(read(spark, sf_dir, "events").withColumn("i", F.col("event_id") * 7 % 360), "user_id", "i")
    return found.withColumn("bits", bitmaps.longitude_bits(F.col("longitudes")))


@query(
    "SELECT r_regionkey, list(n_name ORDER BY n_nationkey) AS names, list(n_nationkey::VARCHAR ORDER BY n_nationkey) AS keys, list(n_name ORDER BY n_nationkey) FILTER (n_nationkey % 2 = 1) AS odd FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey"
)
def xml_elements(spark, sf_dir):
    """Elements and attributes by path from a document a region."""
    nation = read(spark, sf_dir, "nation").select("n_regionkey", F.struct("n_nationkey", F.format_string('<nation key="%d" odd="%d">%s</nation>', "n_nationkey", F.col("n_nationkey") % 2, "n_name").alias("x")).alias("s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]), "")
    documents = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.concat(F.lit("<region>"), body, F.lit("</region>")).alias("xml"))
    odd = text.elements(F.col("xml"), "region/nation@odd=1")
    return documents.select("r_regionkey", text.elements(F.col("xml"), "region/nation").alias("names"), text.attributes(F.col("xml"), "region/nation", "key").alias("keys"), F.when(F.size(odd) > 0, odd).alias("odd"))


def _fixed_sql(length: int) -> str:
    months = [31, length - 337, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    before = str([sum(months[:i]) for i in range(12)])
    n = f"(year(d) * {length} + {before}[month(d)] + day(d) - 1 + k % 1000)"
    at = f"len(list_filter({before}, lambda b: b <= {n} % {length}))"
    return f"concat_ws('-', {n} // {length}, {at}, {n} % {length} - {before}[{at}] + 1)"


@query(f"SELECT k, {_fixed_sql(365)} AS no_leap, {_fixed_sql(366)} AS all_leap FROM (SELECT o_orderkey AS k, o_orderdate AS d FROM orders)")
def calendar_days(spark, sf_dir):
    """Days later in calendars whose years are all of one length."""
    d = F.col("o_orderdate")
    rows = read(spark, sf_dir, "orders")
    later = lambda length: dates.add_days_fixed(F.year(d), F.month(d), F.dayofmonth(d), F.col("o_orderkey") % 1000, length)
    shown = lambda s: F.concat_ws("-", s["year"], s["month"], s["day"])
    return rows.select(F.col("o_orderkey").alias("k"), shown(later(365)).alias("no_leap"), shown(later(366)).alias("all_leap"))


@query("SELECT c_custkey, sha256(c_name) AS digest, upper(to_hex(c_custkey * 977)) AS hex FROM customer")
def digests(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", F.sha2("c_name", 256).alias("digest"), F.hex(F.col("c_custkey") * 977).alias("hex"))
