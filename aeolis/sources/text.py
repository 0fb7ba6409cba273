"""Readers of fixed-width observation records, by Spark's text source and column expressions.

Each returns a DataFrame, so that lines are split, filtered and pruned by the engine. Codes for missing
values become null. In place of a path a DataFrame may be given that has the lines (or whole files) in `value`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "value"


def _text(start: int, length: int, line: Column | str = LINE) -> Column:
    """Columns from `start`, counted from 0."""
    return F.substring(line, start + 1, length)


def _int(start: int, length: int, line: Column | str = LINE) -> Column:
    return F.trim(_text(start, length, line)).try_cast("int")


def _real(start: int, length: int, scale: float = 1.0, line: Column | str = LINE) -> Column:
    return F.trim(_text(start, length, line)).try_cast("double") / scale


def _known(value: Column, *missing: float) -> Column:
    return F.when(~value.isin(*missing), value)


def _time(year: Column, month: Column, day: Column, hour: Column | int = 0, minute: Column | int = 0) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, int) else F.coalesce(x, F.lit(0))
    return F.try_make_timestamp_ntz(year, month, day, lit(hour), lit(minute), F.lit(0))


def _east(longitude: Column) -> Column:
    return F.when(longitude > 180, longitude - 360).otherwise(longitude)


def _lines(spark: SparkSession, path: str | DataFrame, whole: bool = False) -> DataFrame:
    return path.select(LINE) if isinstance(path, DataFrame) else spark.read.text(path, wholetext=whole)


def tcvitals(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """storm_number, basin, name, ts, lat, lon, min_pres, max_wind."""
    clock = _int(28, 4)
    return _lines(spark, path).filter(F.length(LINE) >= 69).select(
        _int(5, 2).alias("storm_number"), _text(7, 1).alias("basin"), F.trim(_text(9, 9)).alias("name"),
        _time(_int(19, 4), _int(23, 2), _int(25, 2), F.floor(clock / 100).cast("int"), clock % 100).alias("ts"),
        (_real(33, 3, 10) * F.when(_text(36, 1) == "S", -1).otherwise(1)).alias("lat"), (_real(38, 4, 10) * F.when(_text(42, 1) == "W", -1).otherwise(1)).alias("lon"),
        _known(_int(52, 4), -999).alias("min_pres"), _known(_int(67, 2), -9).alias("max_wind"),
    )


#: Letters of a storm's state.
STATES = {"*": "tropical", "X": "tropical", "E": "extratropical", "G": "extratropical_gale", "L": "remnant_low", "P": "post_tropical", "S": "subtropical", "W": "open_wave"}


def hurdat(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """storm, name, type, ts, state, lat, lon, max_wind, min_pres: a row a fix of six hours.

    A storm is a header, lines of a day with four fixes, and a trailer. A month before that of the line
    above begins the next year.
    """
    storms = _lines(spark, path, True).select(F.posexplode(F.split(F.col(LINE), r"(?m)(?=^.{6}\d\d/\d\d/\d{4} M)")).alias("n", "storm")).filter(F.length(F.trim("storm")) > 0)
    lines = storms.withColumn("lines", F.filter(F.split("storm", r"\r?\n"), lambda x: F.trim(x) != ""))
    head = F.element_at("lines", 1)
    name = F.trim(_text(35, 11, head))
    numbered = F.concat_ws("-", name, F.lpad(F.trim(_text(22, 2, head)), 2, "0"))
    side = lambda at, letter: F.when(_text(at, 1, head) == letter, 1).otherwise(-1)
    days = F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 2, F.lit(0)))
    month = lambda x: _int(6, 2, x)
    turns = F.transform(days, lambda x, i: F.size(F.filter(F.sequence(F.lit(0), i), lambda k: (k > 0) & (month(F.get(days, k)) < month(F.get(days, k - 1))))))
    flat = lines.select(
        F.when(name.isin("NOT NAMED", "UNKNOWN"), numbered).otherwise(name).alias("name"), _text(6, 2, F.element_at("lines", -1)).alias("type"), _int(12, 4, head).alias("year"),
        side(64, "N").alias("north"), (-side(70, "W")).alias("east"), F.explode(F.arrays_zip(days.alias("line"), turns.alias("turn"))).alias("d"),
    )
    line = F.col("d.line")
    fixes = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(k.alias("k"), F.substring(line, F.lit(12) + k * 17, F.lit(17)).alias("fix")))
    fix = F.col("f.fix")
    state = F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))
    lon = F.col("east") * _real(4, 4, 10, fix)
    return flat.select("name", "type", "year", "north", "east", "d", F.explode(fixes).alias("f")).filter(F.trim(_text(0, 1, fix)) != "").select(
        "name", "type", _time(F.col("year") + F.col("d.turn"), month(line), _int(9, 2, line), F.col("f.k") * 6).alias("ts"),
        F.coalesce(F.try_element_at(state, _text(0, 1, fix)), F.concat(F.lit("unknown-"), _text(0, 1, fix))).alias("state"),
        (F.col("north") * _real(1, 3, 10, fix)).alias("lat"), F.when(lon < -180, lon + 360).otherwise(_east(lon)).alias("lon"),
        _real(8, 4, 1, fix).alias("max_wind"), _real(12, 5, 1, fix).alias("min_pres"),
    )


def isd(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Mandatory section of surface records; `sections` holds the text from column 105 on."""
    flagged = lambda value, missing, at, scale: F.struct(_known(value, missing).try_cast("double").__truediv__(scale).alias("value"), _text(at, 1).alias("flag"))
    clock = _int(23, 4)
    return _lines(spark, path).filter(F.length(LINE) >= 105).select(
        F.concat_ws("-", _text(4, 6), _text(10, 5), _text(51, 5)).alias("id"), _time(_int(15, 4), _int(19, 2), _int(21, 2), F.floor(clock / 100).cast("int"), clock % 100).alias("ts"),
        (_known(_int(28, 6), 99999) / 1000).alias("lat"), (_known(_int(34, 7), 999999) / 1000).alias("lon"), _text(41, 5).alias("report_type"), _known(_int(46, 5), 9999).alias("elev"), _text(56, 4).alias("qc"),
        flagged(_int(60, 3), 999, 63, 1).alias("dd"), flagged(_int(65, 4), 9999, 69, 10).alias("ff"), _known(_int(70, 5), 99999).alias("ceiling"), _known(_int(78, 6), 999999).alias("visibility"),
        flagged(_int(87, 5), 9999, 92, 10).alias("tdry"), flagged(_int(93, 5), 9999, 98, 10).alias("tdew"), flagged(_int(99, 5), 99999, 104, 10).alias("slp"), F.substring(LINE, 106, 1 << 20).alias("sections"),
    )


#: Sections behind the mandatory one, by the letters before their number: length, and the fields as (name, start, length, missing).
SECTIONS = {
    "AA": (8, (("hours", 0, 2, None), ("depth", 2, 4, "9999"), ("condition", 6, 1, None), ("quality", 7, 1, None))),
    "AJ": (14, (("depth", 0, 4, "9999"), ("condition", 4, 1, None), ("quality", 5, 1, None), ("water", 6, 6, "999999"))),
    "AL": (7, (("hours", 0, 2, None), ("depth", 2, 3, "999"), ("condition", 5, 1, None), ("quality", 6, 1, None))),
    "AW": (3, (("weather", 0, 2, None), ("quality", 2, 1, None))),
    "AY": (5, (("weather", 0, 1, None), ("quality", 1, 1, None), ("hours", 2, 2, None))),
    "GF": (23, (("cover", 0, 2, "99"), ("opaque", 2, 2, "99"), ("low", 5, 2, "99"), ("base", 11, 5, "99999"))),
}


def report_sections(reports: DataFrame, *keys: str) -> DataFrame:
    """keys, section (such as AA1) and its fields as a map, null where missing: a row a section of the text in `sections`.

    Sections of kinds that SECTIONS does not have are passed over, and what follows remarks is not read.
    """
    body = F.regexp_replace(F.regexp_extract("sections", r"(?s)^(?:ADD)?(.*?)(?:REM.*|EQD.*)?$", 1), r"\s+$", "")
    pattern = "|".join(f"{k}[0-9].{{{n}}}" for k, (n, _) in SECTIONS.items())
    found = reports.select(*keys, F.explode(F.regexp_extract_all(body, F.lit(f"({pattern})"), 1)).alias("s"))
    text = F.substring("s", 4, 64)
    cell = lambda at, n, missing: F.nullif(F.substring(text, at + 1, n), F.lit(missing)) if missing else F.substring(text, at + 1, n)
    fields = F.lit(None)
    for k, (_, parts) in SECTIONS.items():
        fields = F.when(F.substring("s", 1, 2) == k, F.map_from_entries(F.array(*(F.struct(F.lit(name), cell(at, n, missing)) for name, at, n, missing in parts)))).otherwise(fields)
    return found.select(*keys, F.substring("s", 1, 3).alias("section"), fields.alias("fields"))


def td32(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """type, id, element, unit, ts, value, flags: a row a value of element records."""
    kind, n = _text(4, 3), _int(31, 3)
    values = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(LINE, F.lit(35) + k * 12, F.lit(12)))
    rows = _lines(spark, path).filter((F.length(LINE) >= 34) & (n > 0)).select("value", kind.alias("type"), F.explode(values).alias("v"))
    v, daily = F.col("v"), F.col("type") == "DLY"
    monthly = F.col("type") == "MLY"
    day = F.when(daily, _int(0, 2, v)).when(monthly, 1).when(F.col("type") == "HLY", _int(29, 2)).otherwise(_int(27, 4))
    hour = F.when(daily, _int(2, 2, v)).when(monthly, 0).otherwise(_int(0, 2, v))
    scale = F.when(_text(19, 1) == "T", 10).when(_text(19, 1) == "H", 100).otherwise(1)
    return rows.select(
        "type", _text(7, 8).alias("id"), _text(15, 4).alias("element"), _text(19, 2).alias("unit"),
        _time(_int(21, 4), F.when(monthly, _int(0, 2, v)).otherwise(_int(25, 2)), day, hour, F.when(daily | monthly, 0).otherwise(_int(2, 2, v))).alias("ts"),
        (_known(_int(4, 6, v), 99999, -99999) / scale).alias("value"), _text(10, 2, v).alias("flags"),
    )


def station_history(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """id, start, end, lat, lon, elev of stations, for history_join."""
    at = lambda k: _time(_int(k, 4), _int(k + 4, 2), _int(k + 6, 2), _int(k + 8, 2))
    return _lines(spark, path).filter(F.length(LINE) >= 50).select(_text(0, 6).alias("id"), at(16).alias("start"), at(27).alias("end"), _real(37, 6).alias("lat"), _east(_real(44, 6)).alias("lon"), _int(50, 8).alias("elev"))


def _degrees(at: int, digits: int, minutes: int, scale: float, side: int, negative: str) -> Column:
    value = _int(at, digits) + _int(at + digits, minutes) / scale
    return F.round(value, 3) * F.when(_text(side, 1) == negative, -1).otherwise(1)


def bathythermographs(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """type, id, ts, lat, lon, levels (depth, t)."""
    year = _int(18, 2)
    levels = F.transform(F.sequence(F.lit(1), _int(95, 4)), lambda k: F.struct(F.trim(F.substring(LINE, k * 8 + 93, F.lit(4))).try_cast("int").alias("depth"), (F.trim(F.substring(LINE, k * 8 + 97, F.lit(4))).try_cast("double") / 100).alias("t")))
    clock = _int(24, 4)
    return _lines(spark, path).filter(F.length(LINE) >= 99).select(
        _text(0, 2).alias("type"), F.concat(_text(44, 2), _text(48, 2)).alias("id"), _time(F.when(year < 30, 2000 + year).otherwise(1900 + year), _int(20, 2), _int(22, 2), F.floor(clock / 100).cast("int"), clock % 100).alias("ts"),
        _degrees(3, 2, 3, 600, 8, "S").alias("lat"), _degrees(10, 3, 3, 600, 16, "W").alias("lon"), F.when(_int(95, 4) > 0, levels).otherwise(F.array().cast("array<struct<depth:int,t:double>>")).alias("levels"),
    )


def sea_level(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """id, format, ts, lat, lon, height; daily values stand at 23 h, monthly ones on the last day."""
    kind, year, month = _text(19, 1), _int(20, 4), _int(24, 2)
    last = F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    return _lines(spark, path).filter(F.length(LINE) >= 39).select(
        _text(0, 8).alias("id"), F.concat(F.lit("F18"), kind).alias("format"),
        _time(year, month, F.when(kind == "6", last).otherwise(_int(26, 2)), F.when(kind == "4", _int(28, 2)).when(kind == "5", 23).otherwise(0)).alias("ts"),
        _degrees(8, 2, 2, 60, 12, "S").alias("lat"), _degrees(13, 3, 2, 60, 18, "W").alias("lon"), (_int(30, 4) / 10).alias("utc_offset"), _int(34, 5).alias("height"),
    )


def marine(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """id, id_type, ts, lat, lon, version and attachments (id, text) of marine reports."""
    minute = F.round(_int(10, 2) * 0.6).cast("int")
    lon = _real(17, 6, 100)
    return _lines(spark, path).filter(F.length(LINE) >= 43).select(
        F.trim(_text(34, 9)).alias("id"), _int(32, 2).alias("id_type"), _time(_int(0, 4), _int(4, 2), _int(6, 2), _int(8, 2), minute).alias("ts"), F.trim(_text(8, 4)).eqNullSafe("").alias("no_hour"),
        _real(12, 5, 100).alias("lat"), F.when((lon >= 180) & (lon < 360), lon - 360).otherwise(lon).alias("lon"), _int(23, 2).alias("version"), F.substring(LINE, 109, 1 << 20).alias("attachments"),
    )


def little_r(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """id, ts, lat, lon, platform, sounding, levels: a header, rows of values with flags, an end row and a last line."""
    fields = ("pressure", "height", "temperature", "dew_point", "speed", "direction", "u", "v", "rh", "thickness")
    reports = _lines(spark, path, True).select(F.explode(F.split(F.col(LINE), r"(?m)(?<=\n)(?=.{326}\d{14})")).alias("value"))
    lines = reports.select(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("lines"))
    cell = lambda row, k: F.trim(F.substring(row, 20 * k + 1, 13)).try_cast("double")
    known = lambda x: F.when(x > -888887, x)
    rows = F.filter(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))), lambda x: (F.length(x) >= 200) & ~x.startswith("-777777"))
    # Cells are parsed once, then compared.
    cells = F.transform(rows, lambda r: F.array(*(cell(r, k) for k in range(len(fields)))))
    levels = F.transform(cells, lambda c: F.struct(*(known(F.get(c, F.lit(k))).alias(f) for k, f in enumerate(fields))))
    head = F.element_at("lines", 1)
    return lines.filter(F.size("lines") > 1).select(
        F.trim(_text(40, 40, head)).alias("id"), F.to_timestamp_ntz(_text(326, 14, head), F.lit("yyyyMMddHHmmss")).alias("ts"), _real(0, 20, 1, head).alias("lat"), _east(_real(20, 20, 1, head)).alias("lon"),
        _int(123, 3, head).alias("platform"), (_text(279, 1, head) == "T").alias("sounding"), levels.alias("levels"),
    )


def uadb(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """id, id_type, ts, lat, lon, elev, obs_type, levels (lines) of soundings with a header line."""
    soundings = _lines(spark, path, True).select(F.explode(F.split(F.col(LINE), r"(?m)(?<=\n)(?=H)")).alias("value"))
    lines = soundings.select(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("lines")).filter(F.size("lines") > 0)
    head = F.element_at("lines", 1)
    place = lambda at: F.concat(F.trim(_text(at, 5, head)), F.lit("."), F.lpad(F.trim(_text(at + 6, 4, head)), 4, "0")).try_cast("double")
    minute = F.round(_int(51, 2, head) * 0.6).cast("int")
    return lines.filter(_text(0, 1, head) == "H").select(
        F.trim(_text(15, 6, head)).alias("id"), _int(22, 2, head).alias("id_type"), _time(_int(38, 4, head), _int(43, 2, head), _int(46, 2, head), _int(49, 2, head), minute).alias("ts"),
        place(57).alias("lat"), _east(place(68)).alias("lon"), _real(79, 6, 1, head).alias("elev"), _int(86, 2, head).alias("obs_type"), F.slice("lines", F.lit(2), F.coalesce(_int(89, 4, head), F.lit(0))).alias("levels"),
    )


def station_pairs(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """wmo, wban, start, end of the numbers that a station had; an end of 0 is open. For history_join by either number."""

    def day(at: int) -> Column:
        year = _int(at, 2)
        return _time(F.when(year < 30, 2000 + year).otherwise(1900 + year), _int(at + 2, 2), _int(at + 4, 2))

    rows = _lines(spark, path).filter(F.length(LINE) >= 30)
    return rows.select(_int(1, 5).alias("wmo"), _int(7, 5).alias("wban"), F.coalesce(day(15), F.lit("1800-01-01").cast("timestamp_ntz")).alias("start"), F.coalesce(day(24), F.lit("2999-12-31").cast("timestamp_ntz")).alias("end"))


def compare_records(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """src, stn, ts, lat, lon, elev, levels (pres, hgt, temp, dd, ff) of records to be compared."""
    n = F.floor((F.length(LINE) - 43) / 26).cast("int")
    cell = lambda k, at, width, scale=1.0: F.trim(F.substring(LINE, F.lit(44 + at) + k * 26, F.lit(width))).try_cast("double") / scale
    levels = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(cell(k, 0, 5).alias("pres"), cell(k, 5, 6).alias("hgt"), cell(k, 11, 5, 10).alias("temp"), cell(k, 16, 5).alias("dd"), cell(k, 21, 5, 10).alias("ff")))
    return _lines(spark, path).filter(F.length(LINE) >= 43).select(
        _text(1, 2).alias("src"), _int(4, 6).alias("stn"), _time(_int(12, 2) + 1900, _int(14, 2), _int(16, 2), _int(18, 2)).alias("ts"), (_real(25, 6)).alias("lat"), _real(31, 7).alias("lon"), _int(38, 5).alias("elev"),
        F.when(n > 0, levels).alias("levels"),
    )


def tdl_hourly(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """ts, id, stn_type, lat, lon of hourly surface reports in the layouts of 107 and 150 characters; other lines are dropped."""
    lines = _lines(spark, path).withColumn("long", F.length(LINE) == 150).filter((F.length(LINE) == 107) | F.col("long"))
    pick = lambda long, short: F.when(F.col("long"), long).otherwise(short)
    return lines.select(
        pick(_time(_int(0, 4), _int(4, 2), _int(6, 2), _int(8, 2)), _time(1900 + _int(0, 2), _int(2, 2), _int(4, 2), _int(6, 2))).alias("ts"), pick(_text(10, 4), _text(8, 4)).alias("id"),
        pick(_int(14, 2), F.lit(None)).alias("stn_type"), pick(_real(16, 7, 1e4), _real(12, 5, 100)).alias("lat"), pick(_real(23, 8, 1e4), _real(17, 6, 100)).alias("lon"),
    )


#: Columns of daily and monthly climate summaries in their later layout, name: (start, length).
DAILY = {
    "tmax": (9, 5), "tmin": (14, 5), "pcp_amt": (19, 6), "eprcp": (25, 6), "vp": (31, 6), "potev": (37, 6), "vpd": (43, 6), "slp06": (49, 6), "slp12": (55, 6), "slp18": (61, 6), "slp00": (67, 6),
    "aptmx": (73, 6), "chillm": (79, 6), "rad": (85, 5), "mxrh": (106, 3), "mnrh": (109, 3),
}
MONTHLY = {
    "tmean": (12, 5), "tmax": (17, 5), "tmin": (22, 5), "hmax": (27, 5), "rminl": (32, 5), "ctmean": (37, 5), "aptmax": (42, 5), "wcmin": (47, 5), "hmaxapt": (52, 5), "wclminl": (57, 5), "rpcp": (62, 7), "epcp": (69, 7),
    "cpcp": (76, 7), "epcpmax": (83, 5), "ahs": (88, 5), "avp": (93, 5), "apet": (98, 5), "avpd": (103, 5), "trad": (114, 5), "amaxrh": (119, 5), "aminrh": (124, 5), "ihdd": (129, 5), "icdd": (134, 5), "igdd": (139, 5),
}


def climate_summaries(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """layout (daily, monthly, old_daily), id, library_id, year, month, day, lat, lon, elev, data (a map of the numbers that are there).

    Later layouts name a station whose place is found by history_join with library_id; the old daily one
    carries the place. Other lines are dropped.
    """
    later, point = _text(0, 1) == " ", _text(17, 1) == "."
    layout = F.when(later & point, "daily").when(later, "monthly").when(_text(6, 1) == " ", "old_daily")
    pick = lambda daily, monthly, old: F.when(F.col("layout") == "daily", daily).when(F.col("layout") == "monthly", monthly).otherwise(old)
    named = lambda fields: F.map_from_entries(F.array(*(F.struct(F.lit(k), _real(*at)) for k, at in fields.items())))
    good = lambda at, flag, bad: F.when(~_text(flag, 1).isin(*bad), _real(at, 5, 10))
    old = F.map_from_entries(F.array(*(F.struct(F.lit(k), v) for k, v in (("tmax", good(34, 40, "9")), ("tmin", good(41, 47, "9")), ("pcp_amt", good(48, 54, "89"))))))
    old_id = F.when(_text(7, 5) == "99999", F.trim(_text(13, 4))).otherwise(F.translate(_text(7, 5), " ", "0"))
    number = F.col("number")
    station = F.when(number.startswith("99"), F.replace(number, F.lit("99"), F.lit(""))).otherwise(number)
    west = _real(23, 6, 100)
    rows = _lines(spark, path).withColumn("layout", layout).filter("layout IS NOT NULL").withColumn("number", pick(_text(9, 5), _text(7, 5), old_id))
    return rows.select(
        "layout", pick(station, station, number).alias("id"), F.when(F.col("layout") != "old_daily", F.when(number.startswith("99"), F.concat(F.lit("K"), station, F.lit("  "))).otherwise(F.concat(number, F.lit("0")))).alias("library_id"),
        pick(_int(1, 4), _int(1, 4), 1900 + _int(0, 2)).alias("year"), pick(_int(5, 2), _int(5, 2), _int(2, 2)).alias("month"), pick(_int(7, 2), F.lit(None), _int(4, 2)).alias("day"),
        pick(F.lit(None), F.lit(None), _real(17, 6, 100)).alias("lat"), pick(F.lit(None), F.lit(None), F.when(west > 180, 360 - west).otherwise(-west)).alias("lon"), pick(F.lit(None), F.lit(None), _int(29, 5)).alias("elev"),
        F.map_filter(pick(named(DAILY), named(MONTHLY), old), lambda k, v: v.isNotNull()).alias("data"),
    )


def aircraft_reports(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """id, ts, lat, lon, altitude, wind_dir, wind_speed, temp, moisture (which kind is given) of aircraft reports with an octant of the globe."""
    octant = _text(22, 1)
    known = ~octant.isin(" ", "*")
    lat, lon = _real(23, 3), _int(26, 3)
    far = F.when((lon <= 800) & octant.isin("1", "2", "6", "7"), lon + 1000).otherwise(lon) / 10
    field = lambda at: ~F.trim(_text(at, 2)).isin("", "*")
    return _lines(spark, path).filter(F.length(LINE) >= 100).select(
        _text(4, 4).alias("id"), _time(1900 + _int(12, 2), _int(14, 2), _int(16, 2), _int(18, 2), _int(20, 2)).alias("ts"),
        F.when(known, F.when(octant.between("5", "8"), -lat).otherwise(lat) / 10).alias("lat"), F.when(known, F.when(octant.isin("0", "1", "5", "6"), -far).otherwise(far)).alias("lon"),
        (_int(29, 3) * 100).alias("altitude"), (_int(41, 2) * 10).alias("wind_dir"), _int(43, 3).alias("wind_speed"), F.when(field(98), _overpunched(_text(98, 2))).alias("temp"),
        F.when(field(100), "dew_point").when(field(102), "wet_bulb_depression").when(field(104), "dew_point_depression").when(field(106), "relative_humidity").alias("moisture"),
    )


def overpunch(number: Column, width: int) -> Column:
    """A number of so many digits whose last also carries the sign."""
    digits, last = F.lpad(F.abs(number).cast("string"), width, "0"), F.pmod(F.abs(number), F.lit(10)).cast("int") + 1
    return F.concat(F.substring(digits, 1, width - 1), F.when(number < 0, F.substring(F.lit("}JKLMNOPQR"), last, F.lit(1))).otherwise(F.substring(F.lit("{ABCDEFGHI"), last, F.lit(1))))


def overpunched_number(field: Column) -> Column:
    return _overpunched(field)


def _overpunched(field: Column) -> Column:
    """A number whose last character also carries the sign."""
    last = F.right(field, F.lit(1))
    digits = F.concat(F.substring(field, 1, 1), F.translate(last, "{ABCDEFGHI}JKLMNOPQR", "01234567890123456789"))
    return F.when(last.rlike("[}J-R]"), -F.trim(digits).try_cast("int")).otherwise(F.trim(digits).try_cast("int"))
