"""Queries of nested statistical processes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import processes
from .queries import query, read

#: Of up to three ranges, by the event's number; most of those that look back are sums.
_TYPES, _UNITS, _LENGTHS = (0, 1, 2, 3, 6, 255, 4), (1, 2, 11, 0, 10, 13), (6, 12, 24, -3, 0, 1)


def _range_sql(i: int) -> str:
    return (
        f"CASE WHEN (k // {7 + i}) % 6 = 3 AND k % 5 > 0 THEN 1 ELSE {list(_TYPES)}[(k // {3 + i}) % 7 + 1] END AS t{i}, {list(_UNITS)}[(k // {2 + i}) % 6 + 1] AS u{i}, {list(_LENGTHS)}[(k // {7 + i}) % 6 + 1] AS l{i}, (k // {5 + i}) % 2 AS c{i}"
    )


def _later_sql(ts: str, n: str, u: str) -> str:
    return f"({ts} + CASE {u} WHEN 0 THEN INTERVAL ({n}) MINUTE WHEN 1 THEN INTERVAL ({n}) HOUR WHEN 2 THEN INTERVAL ({n}) DAY WHEN 10 THEN INTERVAL (3 * ({n})) HOUR WHEN 11 THEN INTERVAL (6 * ({n})) HOUR WHEN 13 THEN INTERVAL ({n}) SECOND END)"


_HOURS = "concat(CASE WHEN {0} < ref THEN '-' ELSE '+' END, abs(epoch({0})::BIGINT - epoch(ref)::BIGINT) // 3600)"


def _step_sql(source: str, i: int) -> str:
    """Adds p, f, v and ok after range i."""
    t, u, n, c = (f"{x}{i}" for x in "tulc")
    times = f"(CASE {u} WHEN 10 THEN 3 WHEN 11 THEN 6 ELSE 1 END * {n})"
    name = f"CASE {t} WHEN 0 THEN 'Average' WHEN 1 THEN 'Accumulation' WHEN 2 THEN 'Maximum' WHEN 3 THEN 'Minimum' WHEN 6 THEN 'Standard Deviation' WHEN 255 THEN 'Period' END"
    unit = f"CASE {u} WHEN 0 THEN 'minute' WHEN 2 THEN 'day' WHEN 13 THEN 'second' ELSE 'hour' END"
    back = _later_sql("v", n, u)
    place = f"CASE WHEN {n} < 0 THEN concat(' (initial', {_HOURS.format(back)}, ' to initial', {_HOURS.format('v')}, ')') WHEN {n} > 0 AND {c} = 0 THEN concat(' (initial+', hour, ' to initial+', hour + {times}, ')') ELSE '' END"
    active = f"n >= {i}"
    valid = f"CASE WHEN {active} AND {n} >= 0 THEN {_later_sql('f', n, u)} ELSE v END" if i == 1 else "v"
    return (
        f"(SELECT * REPLACE (CASE WHEN {active} THEN concat(p, {repr(' of ') if i > 1 else repr('')}, abs({times}), '-', {unit}, ' ', {name}, {place}) ELSE p END AS p, CASE WHEN {active} AND {n} < 0 THEN {back} ELSE f END AS f, {valid} AS v, "
        f"ok AND (NOT {active} OR ({t} <> 4 AND ({n} >= 0 OR {t} = 1))) AS ok) FROM {source})"
    )


_START = f"(SELECT *, '' AS p, ref + INTERVAL (hour) HOUR AS f, ref + INTERVAL (hour) HOUR AS v, true AS ok, {', '.join(map(_range_sql, (1, 2, 3)))} FROM (SELECT event_id AS k, date_trunc('hour', ts)::TIMESTAMP AS ref, (event_id % 4 * 6)::INT AS hour, event_id % 3 + 1 AS n FROM events))"


@query(f"SELECT k AS event_id, p AS product, f AS forecast, v AS valid FROM {_step_sql(_step_sql(_step_sql(_START, 1), 2), 3)} WHERE ok AND NOT (n = 2 AND t1 >= 192)")
def nested_processes(spark, sf_dir):
    """Up to three processes within one another, some of which look back."""
    k = F.col("event_id")
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    div = lambda n: F.floor(k / n)

    def one(i: int):
        kind = F.when((div(7 + i) % 6 == 3) & (k % 5 > 0), 1).otherwise(pick(_TYPES, div(3 + i) % 7))
        return F.struct(kind.alias("type"), pick(_LENGTHS, div(7 + i) % 6).alias("length"), pick(_UNITS, div(2 + i) % 6).alias("unit"), (div(5 + i) % 2).cast("int").alias("increment"))

    ref, hour = F.date_trunc("hour", "ts").cast("timestamp"), (k % 4 * 6).cast("int")
    rows = read(spark, sf_dir, "events").select("event_id", ref.alias("ref"), hour.alias("hour"), F.slice(F.array(*map(one, (1, 2, 3))), F.lit(1), (k % 3 + 1).cast("int")).alias("ranges"))
    at = F.timestamp_add("HOUR", F.col("hour"), F.col("ref"))
    made = rows.select("event_id", processes.product(F.lit(8), F.lit(98), F.lit(0), F.col("ref"), at, F.col("hour"), F.lit(1), at, F.col("ranges")).alias("m")).filter("m IS NOT NULL")
    return made.select("event_id", "m.product", *(F.col(f"m.{c}").cast("timestamp_ntz").alias(c) for c in ("forecast", "valid")))


@query(
    "SELECT event_id, CASE WHEN template = 1 THEN CASE WHEN hour = 0 THEN 'Analysis' ELSE concat(hour, '-hour Forecast') END WHEN n = d AND code IN (195, 197) THEN concat('Monthly Mean (1 per day) of ', x) WHEN code IN (195, 197) THEN concat('Mean of ', n, ' Forecasts at ', CASE WHEN code = 195 THEN 24 ELSE 6 END, '-hour intervals of ', x) "
    "WHEN n // 4 = d THEN concat('Monthly Mean (4 per day) of ', x) WHEN n = d THEN concat('Monthly Mean (1 per day) of ', x) ELSE concat('Mean of ', n, ' Forecasts at ', CASE WHEN code = 204 THEN 24 ELSE 6 END, '-hour intervals of ', x) END AS product FROM "
    "(SELECT *, concat('6-hour ', CASE WHEN code IN (195, 204) THEN 'Accumulation' ELSE 'Average' END, ' (initial+18 to initial+24)') AS x, day(last_day(f::DATE)) AS d FROM (SELECT event_id, event_id % 2 * 7 + 1 AS template, event_id % 4 * 6 AS hour, [195, 197, 204, 205][event_id // 2 % 4 + 1] AS code, "
    "[28, 29, 31, 112, 124, 5][event_id // 8 % 6 + 1] AS n, date_trunc('month', ts)::TIMESTAMP + INTERVAL (event_id % 4 * 6) HOUR AS f FROM events))"
)
def local_processes(spark, sf_dir):
    """Samples of local processes of one centre, beside forecasts at points of time."""
    k = F.col("event_id")
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    ranges = F.array(
        F.struct(pick((195, 197, 204, 205), F.floor(k / 2) % 4).alias("type"), pick((28, 29, 31, 112, 124, 5), F.floor(k / 8) % 6).alias("length"), F.lit(1).alias("unit"), F.lit(24).alias("increment")),
        F.struct(F.lit(0).alias("type"), F.lit(6).alias("length"), F.lit(1).alias("unit"), F.lit(0).alias("increment")),
    )
    ref, hour = F.date_trunc("month", "ts").cast("timestamp"), (k % 4 * 6).cast("int")
    at = F.timestamp_add("HOUR", hour, ref)
    return read(spark, sf_dir, "events").select("event_id", processes.product((k % 2 * 7 + 1).cast("int"), F.lit(7), F.lit(0), ref, at, hour, F.lit(1), at, ranges)["product"].alias("product"))
