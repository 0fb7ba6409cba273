"""Statistical processes of edition 2 messages: nested ranges as one text with its forecast and valid times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import GRIB_UNITS, sampled_product

#: Time units as (unit, how many), names of processes, templates of points and of processes over time, and local processes of two ranges of centres 7 and 60 as time ranges of edition 1.
UNITS = GRIB_UNITS | {13: ("SECOND", 1)}
PROCESSES = {0: "Average", 1: "Accumulation", 2: "Maximum", 3: "Minimum", 6: "Standard Deviation", 255: "Period"}
POINTS, OVER_TIME = (0, 1, 2), (8, 11, 12, 61)
LOCAL, LOCAL_FROM, LOCAL_CENTERS = {193: 113, 194: 123, 195: 128, 197: 130, 204: 137, 205: 138}, 192, (7, 60)


def _coded(table: dict, code: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), code)


def unit_name(unit: Column) -> Column:
    return _coded({k: name.lower() for k, (name, _) in UNITS.items()}, unit)


def later(ts: Column, n: Column, unit: Column) -> Column:
    """ts and n of a coded unit later; null for other codes."""
    out = F.lit(None).cast("timestamp")
    for name in sorted({name for name, _ in UNITS.values()}):
        codes = {k: times for k, (x, times) in UNITS.items() if x == name}
        out = F.when(unit.isin(*codes), F.timestamp_add(name, (n * _coded(codes, unit)).cast("int"), ts)).otherwise(out)
    return out


def hours_from(ts: Column, ref: Column) -> Column:
    """Text of the whole hours from ref to ts, with its sign."""
    hours = F.floor(F.abs(F.unix_seconds(ts) - F.unix_seconds(ref)) / 3600).cast("string")
    return F.concat(F.when(ts < ref, "-").otherwise("+"), hours)


def folded(ranges: Column, ref: Column, forecast: Column, hour: Column, valid: Column) -> Column:
    """struct(product, forecast, valid) of ranges (array of struct type, length, unit, increment; outermost first), as "X of Y of Z".

    The outermost range ends at the valid time, which is its length after the forecast time; a range of a negative length, of
    accumulations alone, looks back from the valid time, where the forecast time is set. Continuous ranges say where they lie. Null for no ranges,
    and if any process or unit is unknown.
    """
    start = F.struct(F.lit("").alias("product"), forecast.alias("forecast"), valid.alias("valid"), F.lit(True).alias("known"), F.lit(True).alias("outermost"))

    def step(a: Column, r: Column) -> Column:
        length = r["length"] * _coded({k: times for k, (_, times) in UNITS.items()}, r["unit"])
        name, back = _coded(PROCESSES, r["type"]), r["length"] < 0
        begins = later(a["valid"], r["length"], r["unit"])
        span = F.concat(F.abs(length).cast("string"), F.lit("-"), unit_name(r["unit"]), F.lit(" "), name)
        place = F.when(back, F.concat(F.lit(" (initial"), hours_from(begins, ref), F.lit(" to initial"), hours_from(a["valid"], ref), F.lit(")")))
        place = place.when((r["length"] > 0) & (r["increment"] == 0), F.concat(F.lit(" (initial+"), hour.cast("string"), F.lit(" to initial+"), (hour + length).cast("string"), F.lit(")"))).otherwise("")
        known = F.coalesce(a["known"] & span.isNotNull() & (~back | (r["type"] == 1)), F.lit(False))
        return F.struct(
            F.concat(a["product"], F.when(a["outermost"], "").otherwise(" of "), F.coalesce(span, F.lit("")), F.coalesce(place, F.lit(""))).alias("product"), F.when(back, begins).otherwise(a["forecast"]).alias("forecast"),
            F.when(~back & a["outermost"], later(a["forecast"], r["length"], r["unit"])).otherwise(a["valid"]).alias("valid"), known.alias("known"), F.lit(False).alias("outermost"),
        )

    done = F.aggregate(ranges, start, step)
    return F.when(done["known"] & ~done["outermost"], F.struct(done["product"].alias("product"), done["forecast"].alias("forecast"), done["valid"].alias("valid")))


def product(template: Column, center: Column, subcenter: Column, ref: Column, forecast: Column, hour: Column, unit: Column, valid: Column, ranges: Column) -> Column:
    """struct(product, forecast, valid) of an edition 2 message; null for other templates and for processes that are not defined.

    Two ranges of which the outer is a local process of some centres are samples of edition 1: of as many as the outer range is long, each
    ends an increment after the last, and lasts as long as the inner range.
    """
    point = F.struct(F.when(hour == 0, "Analysis").otherwise(F.concat(hour.cast("string"), F.lit("-"), unit_name(unit), F.lit(" Forecast"))).alias("product"), forecast.alias("forecast"), valid.alias("valid"))
    outer, inner = F.get(ranges, F.lit(0)), F.get(ranges, F.lit(1))
    code, apart = _coded(LOCAL, outer["type"]), outer["increment"]
    sampled = sampled_product(forecast, code, center, subcenter, unit, F.when(code == 123, 0).otherwise(apart - inner["length"]), apart, outer["length"])
    local = F.when(center.isin(*LOCAL_CENTERS) & sampled["product"].isNotNull(), F.struct(sampled["product"].alias("product"), forecast.alias("forecast"), sampled["last"].alias("valid")))
    own = (F.size(ranges) == 2) & (outer["type"] >= LOCAL_FROM)
    return F.when(template.isin(*POINTS), point).when(template.isin(*OVER_TIME), F.when(own, local).otherwise(folded(ranges, ref, forecast, hour, valid)))
