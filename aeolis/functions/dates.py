"""Date column functions that Spark has no built-in for."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def add_months_overflow(date: Column, months: int) -> Column:
    """The same day of a later month; days that it lacks run on into the next (31 January + 1: 2 or 3 March)."""
    first = F.add_months(F.trunc(date, "month"), months)
    return F.date_add(first, F.dayofmonth(date) - 1)


def add_months_clamped(date: Column, months: int) -> Column:
    """The same day of another month, or its last."""
    return F.add_months(date, months)


def since(unit: str, later: Column, earlier: Column) -> Column:
    """Whole units from earlier to later; -1 if earlier is the later."""
    seconds = F.timestamp_diff("SECOND", earlier, later)
    return F.when(seconds < 0, F.lit(-1)).otherwise(F.floor(seconds / SECONDS[unit])).cast("long")


def months_since(later: Column, earlier: Column) -> Column:
    """Whole months from earlier to later; -1 if earlier is the later."""
    return F.when(later < earlier, F.lit(-1)).otherwise(F.timestamp_diff("MONTH", earlier, later)).cast("long")


def days_in_month(year: Column, month: Column, calendar: str = "standard") -> Column:
    """Of the calendars standard, noleap (365_day), all_leap (366_day) and 360_day."""
    if calendar == "360_day":
        return F.lit(30)
    leap = {"noleap": F.lit(False), "365_day": F.lit(False), "all_leap": F.lit(True), "366_day": F.lit(True)}.get(calendar, (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def add_days_360(year: Column, month: Column, day: Column, days: int) -> Column:
    """struct(year, month, day) in the calendar of twelve months of 30 days."""
    n = year * 360 + (month - 1) * 30 + (day - 1) + days
    return F.struct(F.floor(n / 360).cast("int").alias("year"), (F.floor(F.pmod(n, F.lit(360)) / 30) + 1).cast("int").alias("month"), (F.pmod(n, F.lit(30)) + 1).cast("int").alias("day"))


def add_days_fixed(year: Column, month: Column, day: Column, days: Column | int, length: int = 365) -> Column:
    """struct(year, month, day) in a calendar whose years all have 365 or all have 366 days."""
    months = [31, length - 337, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    before = F.array(*(F.lit(sum(months[:i])) for i in range(12)))
    n = year * length + F.element_at(before, month) + day - 1 + days
    rest = F.pmod(n, F.lit(length))
    at = F.size(F.filter(before, lambda b: b <= rest))
    return F.struct(F.floor(n / length).cast("int").alias("year"), at.alias("month"), (rest - F.element_at(before, at) + 1).cast("int").alias("day"))


def synoptic(ts: Column) -> Column:
    """00, 06, 12 or 18 hours: each stands for what lies after three hours before it, up to three hours after it."""
    micros = F.unix_micros(ts.cast("timestamp")) + 3 * 3_600_000_000 - 1
    slot = F.floor(micros / (6 * 3_600_000_000)).cast("long")
    return F.timestamp_seconds(slot * 6 * 3600)


def from_digits(n: Column) -> Column:
    """Timestamp of YYYYMMDDHHMMSS as a number or text; fewer digits are a date or hour."""
    return F.try_to_timestamp(F.rpad(n.cast("string"), 14, "0"), F.lit("yyyyMMddHHmmss"))


def add(unit: str, ts: Column, n: Column) -> Column:
    """ts and n units later, by any case of the unit's name, singular or plural."""
    known = {"second": "SECOND", "minute": "MINUTE", "hour": "HOUR", "day": "DAY", "week": "WEEK", "month": "MONTH", "year": "YEAR"}
    return F.timestamp_add(known[unit.lower().rstrip("s")], n.cast("int"), ts)


def cf_time(value: Column, units: Column) -> Column:
    """Timestamp of a count of `seconds|minutes|hours|days since <date>`; null for other units."""
    parts = F.regexp_extract(F.lower(F.trim(units)), r"^(second|minute|hour|day)s? since ", 1)
    start = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(units, r"(?i)^\s*\w+ since ", ""), r"\s*(Z|UTC)$", ""))
    seconds = F.when(parts == "second", 1).when(parts == "minute", 60).when(parts == "hour", 3600).when(parts == "day", 86400)
    return F.timestamp_micros((F.unix_micros(start) + F.round(value * seconds * 1_000_000)).cast("long"))


def to_precision(ts: Column, flag: Column) -> Column:
    """Text of a time whose first 1 to 6 fields, from the year on, are known."""
    formats = ("yyyy", "yyyy-MM", "yyyy-MM-dd", "yyyy-MM-dd HH", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss")
    out = F.lit(None).cast("string")
    for i, f in enumerate(formats, 1):
        out = F.when(flag == i, F.date_format(ts, f)).otherwise(out)
    return out


#: Time units of gridded messages, as (unit, how many).
GRIB_UNITS = {0: ("MINUTE", 1), 1: ("HOUR", 1), 2: ("DAY", 1), 3: ("MONTH", 1), 4: ("YEAR", 1), 5: ("YEAR", 10), 6: ("YEAR", 30), 7: ("YEAR", 100), 10: ("HOUR", 3), 11: ("HOUR", 6), 12: ("HOUR", 12)}


def _units_later(ts: Column, n: Column, unit: Column) -> Column:
    out = F.lit(None).cast("timestamp")
    for code, (name, times) in GRIB_UNITS.items():
        out = F.when(unit == code, F.timestamp_add(name, (n * times).cast("int"), ts)).otherwise(out)
    return out


def grib_product(ref: Column, unit: Column, time_range: Column, p1: Column, p2: Column, n: Column) -> Column:
    """struct(product, forecast, valid) of an edition 1 message: forecasts, spans and means of analyses."""
    name = F.lit(None).cast("string")
    for code, (u, times) in GRIB_UNITS.items():
        name = F.when(unit == code, F.concat((p1 * times).cast("string"), F.lit(f"-{u.lower()}"))).otherwise(name)
    at = lambda k: _units_later(ref, k, unit)
    point, span = time_range.isin(0, 1, 10), time_range.isin(2, 3, 4, 5)
    kind = F.element_at(F.create_map(*(F.lit(x) for x in (2, "Product", 3, "Average", 4, "Accumulation", 5, "Difference"))), F.when(span, time_range).otherwise(2))
    monthly = (time_range == 3) & (unit == 2) & (p1 == 0) & (p2 == F.dayofmonth(F.last_day(ref)))
    product = (
        F.when(point & (p1 == 0) & (time_range != 1), "Analysis").when(point, F.concat(name, F.lit(" Forecast"))).when(monthly, "Monthly Average")
        .when(span, F.concat(kind, F.lit(" from "), p1.cast("string"), F.lit(" to "), p2.cast("string")))
        .when(time_range == 51, F.concat(n.cast("string"), F.lit("-year Climatology"))).when(time_range.isin(113, 123), F.concat(F.lit("Mean of "), n.cast("string"), F.when(time_range == 113, " Forecasts").otherwise(" Analyses")))
    )
    forecast = F.when(time_range == 10, at(p1 * 256 + p2)).when(point | span | (time_range == 113), at(p1)).otherwise(ref)
    valid = F.when(span, at(p2)).when(time_range == 51, F.timestamp_add("YEAR", n - 1, at(F.lit(1)))).when(time_range.isin(113, 123), F.timestamp_add("SECOND", (F.unix_seconds(at((n - 1) * p2)) - F.unix_seconds(ref)).cast("int"), forecast)).otherwise(forecast)
    return F.struct(product.alias("product"), forecast.alias("forecast"), valid.alias("valid"))


#: What is sampled by a time range of a centre (null: any) and its subcentre, in edition 1 messages:
#: measure, what each sample is (Analysis, Forecast, Average, Accumulation), how samples are spaced. Spacings:
#: points are P2 apart; successive spans follow each other, "by day" ones are counted by P2 in a day; daily spans begin 24 hours apart, and
#: six-hourly ones 6 hours.
SAMPLED = (
    (113, None, None, "Mean", "Forecast", "points"), (118, None, None, "Variance/Covariance", "Forecast", "points"), (132, 34, 241, "Variance/Covariance", "Forecast", "points"), (123, None, None, "Mean", "Analysis", "points"),
    (120, None, None, "Mean", "Accumulation", "successive"), (129, 7, None, "Mean", "Accumulation", "successive by day"), (130, 34, 241, "Mean", "Average", "successive by day"), (131, 7, None, "Mean", "Average", "successive by day"),
    (131, 34, 241, "Variance/Covariance", "Average", "successive by day"), (128, 7, None, "Mean", "Accumulation", "daily"), (128, 60, None, "Mean", "Accumulation", "daily"), (128, 34, 241, "Mean", "Average", "daily apart"),
    (130, 7, None, "Mean", "Average", "daily apart"), (129, 34, 241, "Variance/Covariance", "Average", "daily variance"), (137, 7, None, "Mean", "Accumulation", "six-hourly"), (137, 60, None, "Mean", "Accumulation", "six-hourly"),
    (138, 7, None, "Mean", "Average", "six-hourly apart"), (138, 60, None, "Mean", "Average", "six-hourly apart"),
)


def sampled_product(first: Column, time_range: Column, center: Column, subcenter: Column, unit: Column, p1: Column, p2: Column, n: Column) -> Column:
    """struct(product, last) of means and variances of n samples from `first` on, in hours, 6 hours or days; null for what is not defined.

    A product that fills a month is named a monthly one with its samples a day. Also climatologies of n years (51), averages that
    look back (7, centre 7) and the monthly means of one centre (130 and 133, centre 98).
    """
    text = lambda c: c.cast("string")
    fold = F.when(unit == 11, 6).otherwise(1)
    p1, p2 = p1 * fold, p2 * fold
    hourly, daily = unit.isin(1, 11), unit == 2
    u, hours = F.when(daily, "day").otherwise("hour"), F.when(daily, 24).otherwise(1)
    later = lambda ts, h: F.timestamp_add("HOUR", h.cast("int"), ts)
    days = F.dayofmonth(F.last_day(first))
    span = p2 - p1
    a_day = lambda step: F.when(daily, 1).when(step > 0, F.floor(F.lit(24) / step))
    nearly_month = lambda per: (per > 0) & (days - F.floor(n / per)).between(0, 2)
    every = lambda measure, step, what: F.concat(F.lit(f"{measure} of "), text(n), F.lit(f" {what} at "), text(step), F.lit("-"), u, F.lit(" intervals"))
    monthly = lambda measure, per: F.concat(F.lit(f"Monthly {measure} ("), text(per), F.lit(" per day) of "))
    extent = lambda what: F.concat(text(span), F.lit("-"), u, F.lit(f" {what} (initial+"), text(p1), F.lit(" to initial+"), text(p2), F.lit(")"))
    product, last = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    for code, where, sub, measure, what, spacing in SAMPLED:
        forecasts = F.concat(text(p1), F.lit("-"), u, F.lit(" Forecasts"))
        if spacing == "points":
            per = a_day(p2)
            of = F.lit("Analyses") if what == "Analysis" else F.when(p1 == 0, "Analyses").otherwise(forecasts)
            rest = every(measure, p2, "Analyses") if what == "Analysis" else F.concat(F.lit(f"{measure} of "), text(n), F.lit(" "), forecasts, F.lit(" at "), text(p2), F.lit("-"), u, F.lit(" intervals"))
            name, end, known = F.when(nearly_month(per), F.concat(monthly(measure, per), of)).otherwise(rest), (n - 1) * p2 * hours, hourly | daily
        elif spacing.startswith("successive"):
            per = a_day(p2 if spacing.endswith("day") else span)
            lead = F.when(nearly_month(per), F.concat(monthly(measure, per), F.lit("Forecasts of "))).otherwise(F.concat(every(measure, span, "Forecasts"), F.lit(" of ")))
            name, end, known = F.concat(lead, extent(what)), n * span * hours, hourly if what == "Accumulation" and code == 120 or measure != "Mean" else hourly | daily
        elif spacing == "daily variance":
            lead = F.when(nearly_month(F.lit(1)), F.lit(f"Monthly {measure} (1 per day) of Forecasts of ")).otherwise(F.concat(F.lit(f"{measure} of "), text(n), F.lit(" Forecasts at 24-hour intervals of ")))
            name, end, known = F.concat(lead, extent(what)), (n - 1) * 24 + p2, hourly
        else:
            step = span if spacing.endswith("apart") else p2
            lead = F.when(n == days, F.lit("Monthly Mean (1 per day) of ")).otherwise(F.concat(every(measure, step, "Forecasts"), F.lit(" of ")))
            if spacing.startswith("daily"):
                end, known = (n - 1) * 24 + span * hours, hourly | daily
            else:
                four = F.floor(n / 4) == days
                lead = F.when(four, F.lit("Monthly Mean (4 per day) of ")).otherwise(lead)
                end, known = ((n - 1) * 6 if spacing == "six-hourly" else F.when(four, (n - 1) * 6).when(n == days, (n - 1) * 24).otherwise(0)) + span, hourly
            name = F.concat(lead, extent(what))
        here = (time_range == code) & known & (F.lit(True) if where is None else center == where) & (F.lit(True) if sub is None else subcenter == sub)
        product, last = F.when(here, name).otherwise(product), F.when(here, later(first, end)).otherwise(last)
    years = F.timestamp_add("YEAR", (n - 1).cast("int"), first)
    climate = (time_range == 51) & ((hourly & (p2 == 24)) | (unit == 3))
    kind = F.when(hourly, "Daily Means").otherwise("Monthly Means")
    product = F.when(climate, F.concat(text(n), F.lit("-year Climatology of "), kind)).otherwise(product)
    last = F.when(climate, F.when(hourly, F.timestamp_add("DAY", F.lit(1), years)).otherwise(F.timestamp_add("MONTH", F.lit(1), years))).otherwise(last)
    back = (time_range == 7) & (center == 7) & daily & (p2 == 0)
    length, begins = p1 + 1, F.timestamp_add("DAY", (-p1).cast("int"), first)
    looked = F.when(F.dayofmonth(F.last_day(begins)) == length, "Monthly Mean").when(length == 5, "Pentad Mean").when(length == 7, "Weekly Mean").otherwise(F.concat(text(length), F.lit("-day Average")))
    product, last = F.when(back, looked).otherwise(product), F.when(back, first).otherwise(last)
    for code, a_day_, step in ((130, F.lit(24), F.lit(1)), (133, F.when(F.pmod(p1, F.lit(24)) > 0, F.floor(F.lit(24) / F.pmod(p1, F.lit(24)))), None)):
        step = step if step is not None else F.floor(F.lit(24) / a_day_)
        ends = later(first, n * step)
        whole = (time_range == code) & (center == 98) & (unit == 1) & (n == F.dayofmonth(F.last_day(ends)) * a_day_)
        of = F.lit("Forecasts of 1-hour Accumulation") if code == 130 else F.concat(text(step), F.lit("-hour Forecasts"))
        product, last = F.when(whole, F.concat(monthly("Mean", a_day_), of)).otherwise(product), F.when(whole, ends).otherwise(last)
    return F.struct(product.alias("product"), last.alias("last"))


def formatted(ts: Column, pattern: str, utc_offset: int = 0) -> Column:
    """ts by a format with % codes; utc_offset is hhmm, and 2400 or -2400 stand for local times.

    Codes: Y year; m, mm month, h, hh its name, d, dd day, H, HH hour, M, MM minute, S, SS second; R and T times
    of day, a weekday, Z and ZZ zone, ISO8601 all of it. Of months, days and hours the doubled code has no
    leading zero, of minutes and seconds the single one has none; doubled names are whole.
    """
    sign, zone = "-" if utc_offset < 0 else "+", f"{abs(utc_offset):04}"
    local = {2400: "LT", -2400: "LST"}.get(utc_offset)
    forms = {
        "Y": "yyyy", "m": "MM", "mm": "M", "d": "dd", "dd": "d", "H": "HH", "HH": "H", "M": "m", "MM": "mm", "S": "s", "SS": "ss", "h": "MMM", "hh": "MMMM", "R": "HH:mm", "T": "HH:mm:ss", "a": "E",
    }
    fixed = {"Z": local or sign + zone, "ZZ": local or f"{sign}{zone[:2]}:{zone[2:]}"}
    parts = re.split("%(ISO8601|dd|HH|hh|MM|mm|SS|ZZ|[dHhMmRSTYZa])", pattern.replace("%ISO8601", "%Y-%m-%dT%H:%MM:%SS%ZZ"))
    made = [F.lit(x if i % 2 == 0 else fixed[x]) if i % 2 == 0 or x in fixed else F.date_format(ts, forms[x]) for i, x in enumerate(parts)]
    return F.concat(*made)
