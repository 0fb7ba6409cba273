"""Round trips of the archive formats: rows of the supplied tables are encoded as records, read back and compared with SQL over the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, tables
from ..sources import binary, packed, sinks, text
from .queries import FIELD_SQL, fields, query, read

#: Moments of events to the minute, as SQL and as columns.
MOMENT = "date_trunc('minute', ts)"
_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute}


def _digits(column, width: int):
    return F.lpad(column.cast("string"), width, "0")


def _date(*parts: str):
    return F.concat(*(_digits(_PARTS[p]("ts"), 4 if p == "year" else 2) for p in parts))


def events(spark, sf_dir):
    """Events with whole numbers k for fields of records."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("k"), "ts", "user_id", "event_type", "value")


def _lines(df, *fields_, length: int = 0):
    return df.select(sinks.fixed_width(*fields_, length=length).alias("value"))


# --- fixed-width text


@query(
    f"SELECT concat(lpad((event_id % 900000)::VARCHAR, 6, '0'), '-99999-KAAAA') AS id, {MOMENT} AS ts, (event_id % 180000 - 90000) / 1000.0::DOUBLE AS lat, (event_id * 7 % 360000 - 180000) / 1000.0::DOUBLE AS lon, "
    "CASE WHEN event_id % 11 > 0 THEN (event_id % 3000)::INT END AS elev, CASE WHEN event_id % 7 > 0 THEN (event_id % 360)::DOUBLE END AS dd, CASE WHEN event_id % 5 > 0 THEN (event_id % 700 - 300) / 10.0::DOUBLE END AS tdry FROM events"
)
def surface_records(spark, sf_dir):
    """Mandatory sections of surface reports, with codes for what is missing."""
    k = F.col("k")
    signed = lambda n, width: F.concat(F.when(n < 0, "-").otherwise("+"), _digits(F.abs(n), width - 1))
    lines = _lines(
        events(spark, sf_dir), (0, 4, F.lit("0000")), (4, 6, _digits(k % 900000, 6)), (10, 5, F.lit("99999")), (15, 12, _date("year", "month", "day", "hour", "minute")), (27, 1, F.lit("4")),
        (28, 6, signed(k % 180000 - 90000, 6)), (34, 7, signed(k * 7 % 360000 - 180000, 7)), (41, 5, F.lit("FM-12")), (46, 5, F.when(k % 11 > 0, signed(k % 3000, 5)).otherwise("+9999")), (51, 5, F.lit("KAAAA")), (56, 4, F.lit("V020")),
        (60, 3, F.when(k % 7 > 0, _digits(k % 360, 3)).otherwise("999")), (63, 1, F.lit("1")), (65, 4, F.lit("9999")), (69, 1, F.lit("9")), (70, 5, F.lit("99999")), (78, 6, F.lit("999999")),
        (87, 5, F.when(k % 5 > 0, signed(k % 700 - 300, 5)).otherwise("+9999")), (92, 1, F.lit("1")), (93, 5, F.lit("+9999")), (98, 1, F.lit("9")), (99, 5, F.lit("99999")), (104, 1, F.lit("9")), length=105,
    )
    return text.isd(spark, lines).select("id", "ts", "lat", "lon", "elev", F.col("dd.value").alias("dd"), F.col("tdry.value").alias("tdry"))


@query(
    "SELECT lpad(o_custkey::VARCHAR, 8, '0') AS id, date_trunc('day', o_orderdate) + INTERVAL (o_orderkey % 24) HOUR AS ts, CASE WHEN o_orderkey % 9 > 0 THEN (o_orderkey % 1000 - 400) / 10.0::DOUBLE END AS value FROM orders"
)
def element_records(spark, sf_dir):
    """Daily element records of one value each."""
    k = F.col("k")
    o = read(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey")).withColumn("ts", F.col("o_orderdate"))
    value = F.when(k % 9 > 0, k % 1000 - 400).otherwise(F.lit(99999))
    lines = _lines(
        o, (0, 4, F.lit("0046")), (4, 3, F.lit("DLY")), (7, 8, _digits(F.col("o_custkey"), 8)), (15, 4, F.lit("TMAX")), (19, 2, F.lit("TF")), (21, 6, _date("year", "month")), (27, 4, F.lit("9999")), (31, 3, F.lit("001")),
        (34, 4, F.concat(_digits(F.dayofmonth("ts"), 2), _digits(k % 24, 2))), (38, 6, value), (44, 2, F.lit("00")),
    )
    return text.td32(spark, lines).select("id", "ts", "value")


@query(
    "SELECT event_id, coalesce(wmo, 0) AS wmo FROM events LEFT JOIN (SELECT s_suppkey + 10000 AS wban, s_suppkey + 70000 AS wmo, make_timestamp(2024, 1, 1, 0, 0, 0) + INTERVAL (s_suppkey % 20) DAY AS s, "
    "make_timestamp(2024, 1, 1, 0, 0, 0) + INTERVAL (s_suppkey % 20 + 40) DAY AS e FROM supplier) ON wban = user_id % 150 + 10000 AND ts BETWEEN s AND e"
)
def station_numbers(spark, sf_dir):
    """One number of a station by the other where the pair holds at the time, or 0."""
    s = F.col("s_suppkey")
    day = lambda n: F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")), "yyMMdd")
    lines = _lines(read(spark, sf_dir, "supplier"), (1, 5, s + 70000), (7, 5, s + 10000), (15, 6, day(s % 20)), (24, 6, day(s % 20 + 40)))
    asked = read(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 150 + 10000).cast("int").alias("wban"))
    found = joins.interval_join(asked, text.station_pairs(spark, lines), "wban", "ts", "start", "end")
    return found.select("event_id", F.coalesce("entry.wmo", F.lit(0)).cast("long").alias("wmo"))


@query("SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS id, make_timestamp(1990 + s_suppkey % 20, 3, 1, 0, 0, 0) AS start, s_suppkey % 90 + 0.5::DOUBLE AS lat, CASE WHEN s_suppkey % 360 > 180 THEN s_suppkey % 360 - 360 ELSE s_suppkey % 360 END::DOUBLE AS lon, (s_suppkey % 3000)::INT AS elev FROM supplier")
def station_places(spark, sf_dir):
    s = F.col("s_suppkey")
    lines = _lines(read(spark, sf_dir, "supplier"), (0, 6, _digits(s, 6)), (16, 10, F.concat((1990 + s % 20).cast("string"), F.lit("030100"))), (27, 10, F.lit("2999123100")), (37, 6, s % 90 + 0.5), (44, 6, s % 360), (50, 8, s % 3000))
    return text.station_history(spark, lines).drop("end")


@query(
    "SELECT (l_orderkey % 1000000)::INT AS stn, make_timestamp(1979, 2, 3, 4, 0, 0) AS ts, l_linenumber::DOUBLE * 100 AS pres, (l_linenumber * 150)::DOUBLE AS hgt, (l_suppkey % 600 - 300) / 10.0::DOUBLE AS temp, (l_quantity::INT)::DOUBLE AS dd FROM lineitem "
    "QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_quantity::INT) = 1"
)
def compared_levels(spark, sf_dir):
    """Levels of records to be compared, of 26 characters each behind a head of 43."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), F.expr("int(round(l_quantity))").alias("q"))
    first = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(line).alias("x"))
    grouped = first.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    level = lambda x: sinks.fixed_width((0, 5, x["n"] * 100), (5, 6, x["n"] * 150), (11, 5, x["s"] % 600 - 300), (16, 5, x["q"]), (21, 5, F.lit(10)))
    head = sinks.fixed_width((1, 2, F.lit(1)), (4, 6, F.col("l_orderkey") % 1000000), (12, 8, F.lit("79020304")), (25, 6, F.lit("10.5")), (31, 7, F.lit("-20.25")), (38, 5, F.lit(7)))
    records = text.compare_records(spark, grouped.select(F.concat(head, F.array_join(F.transform("xs", level), "")).alias("value")))
    return tables.elements(records, "levels", "stn", "ts").select("stn", "ts", "v.pres", "v.hgt", "v.temp", "v.dd")


@query(
    "SELECT concat('S', event_id % 100000) AS id, date_trunc('hour', ts) AS ts, (event_id % 18000 - 9000) / 100.0::DOUBLE AS lat, CASE WHEN event_id * 13 % 36000 >= 18000 THEN (event_id * 13 % 36000 - 36000) ELSE event_id * 13 % 36000 END / 100.0::DOUBLE AS lon FROM events"
)
def marine_reports(spark, sf_dir):
    k = F.col("k")
    lines = _lines(
        events(spark, sf_dir), (0, 8, _date("year", "month", "day")), (8, 4, F.concat(_digits(F.hour("ts"), 2), F.lit("00"))), (12, 5, k % 18000 - 9000), (17, 6, k * 13 % 36000), (23, 2, F.lit(1)), (32, 2, F.lit(1)),
        (34, 9, F.concat(F.lit("S"), k % 100000)), length=108,
    )
    return text.marine(spark, lines).select("id", "ts", "lat", "lon")


@query(
    "SELECT lpad((p_partkey % 10000)::VARCHAR, 4, '0') AS id, (d * 10)::INT AS depth, (p_partkey % 900 + d * 10) / 100.0::DOUBLE AS t, make_timestamp(1987, 6, (p_partkey % 28 + 1)::INT, 12, 30, 0) AS ts, "
    "-round(p_partkey % 80 + (p_partkey % 600) / 600.0::DOUBLE, 3) AS lat FROM part, (SELECT unnest(range(1, 4)) AS d)"
)
def bathythermograph_levels(spark, sf_dir):
    """Three levels a profile; a profile's name stands in two places."""
    p = F.col("p_partkey")
    level = F.concat(*(F.concat(_digits(F.lit(10 * d), 4), _digits(p % 900 + d * 10, 4)) for d in (1, 2, 3)))
    name = _digits(p % 10000, 4)
    lines = _lines(
        read(spark, sf_dir, "part"), (0, 2, F.lit("01")), (3, 2, _digits(p % 80, 2)), (5, 3, _digits(p % 600, 3)), (8, 1, F.lit("S")), (10, 3, F.lit("020")), (13, 3, F.lit("300")), (16, 1, F.lit("E")), (18, 2, F.lit("87")), (20, 2, F.lit("06")),
        (22, 2, _digits(p % 28 + 1, 2)), (24, 4, F.lit("1230")), (44, 2, F.substring(name, 1, 2)), (48, 2, F.substring(name, 3, 2)), (95, 4, F.lit(3)), (100, 24, level),
    )
    return tables.elements(text.bathythermographs(spark, lines), "levels", "id", "ts", "lat").select("id", "v.depth", "v.t", "ts", "lat")


@query("SELECT lpad((o_custkey % 100000000)::VARCHAR, 8, '0') AS id, date_trunc('day', o_orderdate) + INTERVAL (o_orderkey % 24) HOUR AS ts, (o_orderkey % 9000 - 500)::INT AS height, round(-(o_orderkey % 80 + (o_orderkey % 60) / 60.0), 3)::DOUBLE AS lat FROM orders")
def sea_level_heights(spark, sf_dir):
    k = F.col("k")
    o = read(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey")).withColumn("ts", F.col("o_orderdate"))
    lines = _lines(
        o, (0, 8, _digits(F.col("o_custkey") % 100000000, 8)), (8, 2, _digits(k % 80, 2)), (10, 2, _digits(k % 60, 2)), (12, 1, F.lit("S")), (13, 3, F.lit("100")), (16, 2, F.lit("30")), (18, 1, F.lit("W")), (19, 1, F.lit("4")),
        (20, 8, _date("year", "month", "day")), (28, 2, _digits(k % 24, 2)), (30, 4, F.lit("0010")), (34, 5, k % 9000 - 500),
    )
    return text.sea_level(spark, lines).select("id", "ts", "height", "lat")


@query("SELECT lpad((event_id % 10000)::VARCHAR, 4, '0') AS id, date_trunc('hour', ts) AS ts, event_id % 2 = 0 AS typed, (event_id % 9000) / 100.0::DOUBLE AS lat FROM events")
def hourly_layouts(spark, sf_dir):
    """Reports in the long layout for even numbers; the short one has years of two digits, so odd ones are put a century on."""
    k = F.col("k")
    e = events(spark, sf_dir)
    long = _lines(e.filter("k % 2 = 0"), (0, 10, _date("year", "month", "day", "hour")), (10, 4, _digits(k % 10000, 4)), (14, 2, F.lit(3)), (16, 7, (k % 9000) * 100), (23, 8, F.lit(-1000000)), length=150)
    short = _lines(e.filter("k % 2 = 1"), (0, 8, F.substring(_date("year", "month", "day", "hour"), 3, 8)), (8, 4, _digits(k % 10000, 4)), (12, 5, k % 9000), (17, 6, F.lit(-10000)), length=107)
    found = text.tdl_hourly(spark, long.union(short))
    # Both layouts name the same century here.
    ts = F.when(F.year("ts") < 1950, F.add_months("ts", 1200).cast("timestamp_ntz") + (F.col("ts") - F.date_trunc("day", "ts").cast("timestamp_ntz"))).otherwise(F.col("ts"))
    return found.select("id", ts.alias("ts"), F.col("stn_type").isNotNull().alias("typed"), "lat")


@query(
    f"SELECT event_type AS name, {MOMENT} AS ts, CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END * (event_id % 600) / 10.0::DOUBLE AS lat, (event_id % 1800) / -10.0::DOUBLE AS lon, CASE WHEN event_id % 4 > 0 THEN (900 + event_id % 100)::INT END AS min_pres FROM events"
)
def storm_vitals(spark, sf_dir):
    k = F.col("k")
    lines = _lines(
        events(spark, sf_dir), (5, 2, F.lit("07")), (7, 1, F.lit("L")), (9, 9, F.rpad("event_type", 9, " ")), (19, 8, _date("year", "month", "day")), (28, 4, _date("hour", "minute")), (33, 3, _digits(k % 600, 3)), (36, 1, F.when(k % 2 == 0, "S").otherwise("N")),
        (38, 4, _digits(k % 1800, 4)), (42, 1, F.lit("W")), (52, 4, F.when(k % 4 > 0, 900 + k % 100).otherwise(F.lit(-999))), (67, 2, F.lit("33")), length=80,
    )
    return text.tcvitals(spark, lines).select("name", "ts", "lat", "lon", "min_pres")


@query("SELECT concat('P', p_partkey) AS id, make_timestamp(2001, 2, 3, (p_partkey % 24)::INT, 0, 0) AS ts, n::INT AS level, (1000 - n * 50)::DOUBLE AS pressure, CASE WHEN (p_partkey + n) % 3 > 0 THEN (p_partkey % 500 + n)::DOUBLE END AS temperature FROM part, (SELECT unnest(range(1, 4)) AS n)")
def little_r_levels(spark, sf_dir):
    """Files of a report each: a header, three rows of ten values with flags, an end row and a last line."""
    p = F.col("p_partkey")
    head = sinks.fixed_width((0, 20, F.lit("10.5")), (20, 20, F.lit("200.25")), (40, 40, F.rpad(F.concat(F.lit("P"), p), 40, " ")), (123, 3, F.lit(35)), (279, 1, F.lit("T")), (326, 14, F.concat(F.lit("20010203"), _digits(p % 24, 2), F.lit("0000"))), length=600)
    missing = F.lit("-888888.00000")
    cells = lambda n: [F.lit(f"{1000 - 50 * n}.00000"), missing, F.when((p + n) % 3 > 0, F.concat((p % 500 + n).cast("string"), F.lit(".00000"))).otherwise(missing)] + [missing] * 7
    row = lambda values: F.concat(*(F.concat(F.lpad(v, 13, " "), F.lit("      0")) for v in values))
    end = row([F.lit("-777777.00000")] * 2 + [missing] * 8)
    # A key of a few bytes becomes a file of 1,400, so that keys are dealt to as many tasks as a shuffle has.
    parts = read(spark, sf_dir, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = parts.select(F.concat_ws("\n", head, *(row(cells(n)) for n in (1, 2, 3)), end, F.lit("      3      0      0\n")).alias("value"))
    found = tables.elements(text.little_r(spark, whole), "levels", "id", "ts", place="level")
    return found.select("id", "ts", (F.col("level") + 1).alias("level"), "v.pressure", "v.temperature")


@query("SELECT s_suppkey::VARCHAR AS id, make_timestamp(1965, 5, 6, 12, 30, 0) AS ts, s_suppkey % 80 + 0.25::DOUBLE AS lat, (s_suppkey % 4)::INT AS n FROM supplier")
def sounding_headers(spark, sf_dir):
    """Soundings with as many lines of levels as their header says."""
    s = F.col("s_suppkey")
    head = sinks.fixed_width(
        (0, 1, F.lit("H")), (15, 6, s), (22, 2, F.lit(2)), (38, 4, F.lit("1965")), (43, 2, F.lit("05")), (46, 2, F.lit("06")), (49, 2, F.lit("12")), (51, 2, F.lit("50")), (57, 5, s % 80), (63, 4, F.lit("2500")), (68, 5, F.lit("100")), (74, 4, F.lit("5000")),
        (79, 6, F.lit("12.0")), (86, 2, F.lit(1)), (89, 4, s % 4),
    )
    whole = read(spark, sf_dir, "supplier").select(F.concat(head, F.lit("\n"), F.repeat(F.lit("  0  1000.0   100.0\n"), (s % 4).cast("int"))).alias("value"))
    return text.uadb(spark, whole).select("id", "ts", "lat", F.size("levels").alias("n"))


@query(
    "SELECT concat('S', n_nationkey) AS name, make_timestamp(1970, 8, d::INT, (f * 6)::INT, 0, 0) AS ts, CASE WHEN f = 3 THEN 'extratropical' ELSE 'tropical' END AS state, (150 + n_nationkey + f) / 10.0::DOUBLE AS lat, -(600 + d) / 10.0::DOUBLE AS lon, (40 + f)::DOUBLE AS max_wind "
    "FROM nation, (SELECT unnest(range(1, 4)) AS d), (SELECT unnest(range(0, 4)) AS f)"
)
def storm_tracks(spark, sf_dir):
    """Storms of three days with four fixes each between a header and a trailer."""
    n = F.col("n_nationkey")
    head = sinks.fixed_width((0, 5, F.lit("00005")), (6, 10, F.lit("08/01/1970")), (17, 2, F.lit("M=")), (19, 2, F.lit(" 3")), (22, 2, n), (35, 11, F.rpad(F.concat(F.lit("S"), n), 11, " ")), (64, 1, F.lit("N")), (70, 1, F.lit("W")), length=80)
    fix = lambda d, f: F.concat(F.lit("E" if f == 3 else "*"), _digits(150 + n + f, 3), F.lit(f"{600 + d:4}"), F.lit(f"{40 + f:4}"), F.lit(" 1000"))
    day = lambda d: F.concat(F.lit(f"00010 08/{d:02}"), *(fix(d, f) for f in range(4)))
    whole = read(spark, sf_dir, "nation").select(F.concat_ws("\n", head, *(day(d) for d in (1, 2, 3)), F.lit("00025 HR\n")).alias("value"))
    return text.hurdat(spark, whole).select("name", "ts", "state", "lat", "lon", "max_wind")


@query(
    f"SELECT lpad((event_id % 10000)::VARCHAR, 4, '0') AS id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * (event_id % 900) / 10.0::DOUBLE AS lat, ((event_id % 500) * 100)::INT AS altitude, {MOMENT} AS ts FROM events"
)
def aircraft_places(spark, sf_dir):
    k = F.col("k")
    lines = _lines(
        events(spark, sf_dir), (4, 4, _digits(k % 10000, 4)), (12, 10, F.substring(_date("year", "month", "day", "hour", "minute"), 3, 10)), (22, 1, F.when(k % 2 == 0, "0").otherwise("5")), (23, 3, _digits(k % 900, 3)), (26, 3, F.lit("500")),
        (29, 3, _digits(k % 500, 3)), (41, 2, F.lit("27")), (43, 3, F.lit("050")), length=120,
    )
    # The format's years are of the last century.
    ts = F.make_timestamp_ntz(F.year("ts") + 100, F.month("ts"), F.dayofmonth("ts"), F.hour("ts"), F.minute("ts"), F.lit(0))
    return text.aircraft_reports(spark, lines).select("id", "lat", "altitude", ts.alias("ts"))


# --- framed records and bytes


def _order_files(spark, sf_dir, frame):
    """path and content: the orders of a customer, each framed, one after the other."""
    record = F.encode(F.concat_ws("|", "o_orderkey", "o_orderstatus", "o_orderpriority"), "utf-8")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"), "o_orderkey", frame(record).alias("piece"))
    return sinks.in_order(rows, "path", "o_orderkey", F.col("piece"))


_ORDER_RECORDS = "SELECT o_custkey::VARCHAR AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rec_no, concat_ws('|', o_orderkey, o_orderstatus, o_orderpriority) AS record FROM orders"


@query(_ORDER_RECORDS)
def fortran_round_trip(spark, sf_dir):
    """Records between two lengths, written and read back."""
    return binary.f77_records(spark, _order_files(spark, sf_dir, sinks.f77_frame)).select("path", "rec_no", F.col("record").cast("string").alias("record"))


@query(_ORDER_RECORDS)
def spanned_round_trip(spark, sf_dir):
    """Variable records in blocks of ten bytes, so that most span several."""
    return binary.vbs_records(spark, _order_files(spark, sf_dir, lambda r: sinks.vbs_frame(r, 10))).select("path", "rec_no", F.col("record").cast("string").alias("record"))


@query(_ORDER_RECORDS)
def control_word_round_trip(spark, sf_dir):
    """Records of 64-bit words behind control words that say how many bits of the last are unused."""
    record = F.encode(F.concat_ws("|", "o_orderkey", "o_orderstatus", "o_orderpriority"), "utf-8")
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("path")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", record.alias("r")))).alias("rs"))
    files = rows.select("path", sinks.cos_file(F.transform("rs", lambda x: x["r"])).alias("content"))
    return binary.cos_records(spark, files).select("path", "rec_no", F.col("record").cast("string").alias("record"))


@query("SELECT o_custkey::VARCHAR AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rec_no, lpad(o_orderkey::VARCHAR, 12, '0') AS record, 12 * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS \"offset\" FROM orders")
def equal_records(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"), "o_orderkey")
    files = sinks.in_order(rows, "path", "o_orderkey", F.encode(_digits(F.col("o_orderkey"), 12), "utf-8"))
    return binary.fixed_records(spark, files, 12).select("path", "rec_no", F.col("record").cast("string").alias("record"), "offset")


@query("SELECT o_custkey::VARCHAR AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rec_no, (o_orderkey % 16777216)::BIGINT AS code FROM orders")
def report_round_trip(spark, sf_dir):
    """Reports of two 64-bit words, one a block: length, body and checksum."""
    key = F.col("o_orderkey") % 16777216
    report = sinks.bits((0, 12, F.lit(2)), (64, 32, key), length=128)
    head = sinks.bits((0, 4, F.lit(1)), (32, 32, F.lit(4)), length=64)
    block = F.concat(head, report, F.unhex(F.lit("00" * 8)))
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"), "o_orderkey", block.alias("piece"))
    found = binary.report_records(spark, sinks.in_order(rows, "path", "o_orderkey", F.col("piece")))
    return found.select("path", "rec_no", F.conv(F.hex(F.substring("record", 9, 4)), 16, 10).cast("long").alias("code"))


@query("SELECT user_id::VARCHAR AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS msg_no, year(ts)::INT AS year, month(ts)::INT AS month, hour(ts)::INT AS hour, 7 AS centre, (event_id % 200)::INT AS category, ['001001', '012' || lpad((event_id % 200)::VARCHAR, 3, '0')] AS descriptors FROM events")
def message_heads(spark, sf_dir):
    """Messages of edition 3 with two descriptors, found by their marks in files of many."""
    k = F.col("k")
    b = lambda x, width=1: sinks.number_bytes(x if not isinstance(x, int) else F.lit(x), width)
    one = F.concat(b(18, 3), b(0), b(0), b(7), b(0), b(0), b(k % 200), b(0), b(12), b(0), b(F.year("ts") - 2000), b(F.month("ts")), b(F.dayofmonth("ts")), b(F.hour("ts")), b(F.minute("ts")), b(0))
    three = F.concat(b(11, 3), b(0), b(1, 2), b(0x80), b(0 * 64 + 1), b(1), b(12), b(k % 200))
    four = F.concat(b(6, 3), b(0), b(k % 65536, 2))
    body = F.concat(one, three, four, F.lit(b"7777"))
    message = F.concat(F.lit(b"BUFR"), b(F.length(body) + 8, 3), b(3), body)
    files = sinks.in_order(events(spark, sf_dir).withColumn("path", F.col("user_id").cast("string")).withColumn("piece", message), "path", "k", F.col("piece"))
    return binary.bufr_messages(spark, files).select("path", "msg_no", "year", "month", "hour", "centre", "category", "descriptors")


# --- grids


def _grids(spark, sf_dir):
    v = fields(spark, sf_dir)
    place = {"param": F.lit(11), "level_type": F.lit(100), "level": (F.col("vec_id") % 1000).cast("int"), "center": F.lit(7), "nx": F.lit(8), "ny": F.lit(8), "slat": F.lit(80.0), "slon": F.lit(0.0), "elat": F.lit(10.0), "elon": F.lit(315.0)}
    ref = F.timestamp_add("HOUR", (F.col("vec_id") % 100).cast("int"), F.lit("2001-02-03 00:00:00").cast("timestamp"))
    return v.select("vec_id", ref.alias("ref_time"), *(x.cast("double" if n in ("slat", "slon", "elat", "elon") else "int").alias(n) for n, x in place.items()), F.col("v").alias("values"))


@query(f"SELECT vec_id, (vec_id % 1000)::INT AS level, unnest(range(64))::INT AS pos, round(unnest(v), 3) AS x FROM {FIELD_SQL}")
def gridded_messages(spark, sf_dir):
    """Edition 1 messages of 24 bits a cell with a bitmap, written and read back."""
    made = sinks.grib1_messages(_grids(spark, sf_dir), bits=24).select(F.col("vec_id").cast("string").alias("path"), F.col("message").alias("content"))
    found = binary.grib1_grids(spark, made)
    return found.select(F.col("path").cast("long").alias("vec_id"), F.col("level").cast("int").alias("level"), F.posexplode("values").alias("pos", "x")).withColumn("x", F.round("x", 3))


@query(f"SELECT label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS step, unnest(range(64))::INT AS pos, round(unnest(v), 6) AS x FROM {FIELD_SQL}")
def array_files(spark, sf_dir):
    """Classic array files of a label each: a time axis and fields in order."""
    files = sinks.netcdf_files(_grids(spark, sf_dir).join(fields(spark, sf_dir).select("vec_id", "label"), "vec_id"), "label", "vec_id", "field", 8, 8)
    found = binary.netcdf_variables(spark, files.select(F.col("label").cast("string").alias("path"), "content")).filter("name = 'field'")
    cells = found.select(F.col("path").cast("int").alias("label"), F.posexplode("values").alias("n", "x"))
    return cells.select("label", F.expr("int(n div 64)").alias("step"), F.expr("int(n % 64)").alias("pos"), F.round("x", 6).alias("x"))


def _packed(spark, sf_dir, kind: str, head, cell, n: int):
    """Records of a packed format, of one field a nation, read back."""
    layout, p = packed.LAYOUTS[kind], F.col("n_nationkey")
    digits = lambda value, width: F.right(F.lpad(F.bin(value.cast("long")), 64, "0"), F.lit(width))
    cells = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: digits(cell(p, i), layout.width)), "")
    parts, at = [], 0
    for first, width, value in sorted(((*layout.head[name], value) for name, value in head.items()), key=lambda f: f[0]):
        parts += [F.lit("0" * (first - at)), digits(value, width)]
        at = first + width
    whole = F.rpad(F.concat(*parts, F.lit("0" * (layout.first - at)), cells), 8 * layout.length, "0")
    record = F.unhex(F.array_join(F.transform(F.regexp_extract_all(whole, F.lit("[01]{8}"), 0), lambda c: F.lpad(F.conv(c, 2, 16), 2, "0")), ""))
    return packed.packed_grids(read(spark, sf_dir, "nation").select("n_nationkey", record.alias("record")), kind)


def _cells(df):
    return df.select("n_nationkey", "ref_time", F.posexplode("values").alias("pos", "x")).withColumn("x", F.round("x", 1))


@query("SELECT n_nationkey, make_timestamp(1930 + n_nationkey, 5, 6, 0, 0, 0) AS ref_time, unnest(range(1080))::INT AS pos, round(unnest(list_transform(range(1080), lambda i: CASE WHEN (n_nationkey * 31 + i) % 1000 > 0 THEN ((n_nationkey * 31 + i) % 1000 + 9500) * 0.1 END)), 1)::DOUBLE AS x FROM nation")
def pressure_fields(spark, sf_dir):
    """Sea level pressures of 15 rows of 72, in tenths, 0 where missing."""
    p = F.col("n_nationkey")
    head = {"year": 1930 + p, "month": F.lit(5), "day": F.lit(6), "hour": F.lit(0)}
    value = lambda p, i: F.when((p * 31 + i) % 1000 > 0, (p * 31 + i) % 1000 + 9500).otherwise(0)
    return _cells(_packed(spark, sf_dir, "slp", head, value, 1080))


@query("SELECT n_nationkey, make_timestamp(1980, (n_nationkey % 12 + 1)::INT, 2, 0, 0, 0) AS ref_time, unnest(range(576))::INT AS pos, round(unnest(list_transform(range(576), lambda i: CASE WHEN (n_nationkey + i) % 13 > 0 THEN 1000 + ((n_nationkey + i) % 600 - 300) * 0.1 END)), 1)::DOUBLE AS x FROM nation")
def signed_pressure_fields(spark, sf_dir):
    """Tenths above 1000 millibars, signed."""
    p = F.col("n_nationkey")
    value = lambda p, i: F.when((p + i) % 13 > 0, (p + i) % 600 - 300).otherwise(0x7FFF)
    return _cells(_packed(spark, sf_dir, "slp_ussr", {"year": F.lit(1980), "month": p % 12 + 1, "day": F.lit(2)}, value, 576))


@query("SELECT n_nationkey, make_timestamp(1985, 7, 8, 12, 0, 0) AS ref_time, unnest(range(3969))::INT AS pos, round(unnest(list_transform(range(3969), lambda i: CASE WHEN (n_nationkey + i) % 17 > 0 THEN ((n_nationkey + i) % 17 - 100) * 2 END)), 1)::DOUBLE AS x FROM nation")
def scaled_fields(spark, sf_dir):
    """Cells about a bias with a power of two as scale, on a base of 0."""
    head = {"year": F.lit(85), "month": F.lit(7), "day": F.lit(8), "hour": F.lit(12), "level1": F.lit(1023), "bias": F.lit(100), "scale": F.lit(101)}
    return _cells(_packed(spark, sf_dir, "navy", head, lambda p, i: (p + i) % 17, 3969))


@query(
    "SELECT lpad((event_id % 10000000)::VARCHAR, 7, '0') AS id, date_trunc('day', ts) + INTERVAL (hour(ts) - 1) HOUR AS ts, (event_id % 9000) / 100.0::DOUBLE AS lat, (event_id % 36000 - 18000) / 100.0::DOUBLE AS lon, (event_id % 3000)::BIGINT AS elev FROM events"
)
def station_hours(spark, sf_dir):
    """Bit-packed hourly reports, an hour east of their zone."""
    k = F.col("k")
    at = packed.HOURLY
    values = {"id": k % 10000000, "year": F.year("ts"), "month": F.month("ts"), "day": F.dayofmonth("ts"), "hour": F.hour("ts"), "zone": F.lit(9), "lat": k % 9000, "lon": k % 36000, "elev": k % 3000}
    records = events(spark, sf_dir).select(sinks.bits(*((*at[n], v) for n, v in values.items()), length=120).alias("record"))
    return packed.hourly_reports(records)


@query(
    "SELECT s_suppkey, m::INT AS month, (10000 + s_suppkey % 100 + m) / 10.0::DOUBLE AS slp, (s_suppkey % 300 + m - 150) / 10.0::DOUBLE AS temp, CASE WHEN m > 1 THEN (s_suppkey % 90 + m) / 10.0::DOUBLE END AS precipitation, m = 1 AS trace FROM supplier, (SELECT unnest(range(1, 13)) AS m)"
)
def station_months(spark, sf_dir):
    """Twelve months a report, the first with a trace of precipitation."""
    s, month = F.col("s_suppkey"), packed.MONTH
    parts = [(*packed.CLIMATE[n], v) for n, v in {"id": s, "year": F.lit(1950), "lat": F.lit(1200), "lon": F.lit(2500), "elev": F.lit(1100)}.items()]
    for m in range(1, 13):
        base = packed.MONTH_FIRST + (m - 1) * packed.MONTH_BITS
        values = {"slp": 10000 + s % 100 + m, "station_pressure": F.lit(20000), "height": F.lit(5000), "temp": s % 300 + m + 850, "precipitation": F.lit(packed.TRACE) if m == 1 else s % 90 + m}
        parts += [(base + month[n][0], month[n][1], v) for n, v in values.items()]
    records = read(spark, sf_dir, "supplier").select(sinks.bits(*parts, length=1232).alias("record"))
    return packed.station_climate(records).select(F.col("id").cast("long").alias("s_suppkey"), "month", "slp", "temp", "precipitation", "trace")
