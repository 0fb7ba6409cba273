"""Conversions between schemas of grids, as projections: codes by tables, values by factor and offset, cells by position.

A message has center, param, level_type, level1, level2, time_range, time_unit, p1, p2, n_mean and values by row. Rows that
the wanted schema has no place for are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Centres of the sources of packed grids; parameters of packed grids in messages; and of these the level type, factor and offset.
SOURCES = {"octagonal": {1: 7, 3: 58}, "latlon": {1: 7, 5: 7, 2: 57, 3: 58, 4: 255}, "slp": {3: 58, 4: 57, 11: 255, 10: 59, 12: 74, 28: 7, 29: 255}}
PARAMETERS = {1: 7, 4: 7, 5: 39, 6: 1, 10: 11, 11: 12, 28: 2, 30: 33, 31: 34, 44: 52, 47: 80, 57: 80}
LEVELS = {1: (1, 100.0, 0.0), 2: (2, 1.0, 0.0), 7: (100, 1.0, 0.0), 11: (100, 1.0, 273.15), 12: (100, 1.0, 273.15), 33: (100, 1.0, 0.0), 34: (100, 1.0, 0.0), 39: (100, 1.0, 0.0), 52: (101, 1.0, 0.0), 80: (1, 1.0, 273.15)}
#: Time ranges of averages and accumulations.
AVERAGED, ACCUMULATED = (51, 113, 115, 117, 123), (114, 116, 124)
SEA_LEVEL, SURFACE = 1013, 1001


def _coded(code: Column, table: dict) -> Column:
    """Null for codes that the table lacks."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), code)


def is_averaged(time_range: Column) -> Column:
    return time_range.isin(*AVERAGED)


def is_accumulated(time_range: Column) -> Column:
    return time_range.isin(*ACCUMULATED)


def packed_to_message(grids: DataFrame, kind: str, *keys: str) -> DataFrame:
    """Forecasts of octagonal or latlon grids as messages; means, and codes without a counterpart, are left out."""
    param = _coded(F.col("param"), PARAMETERS)
    sea = (param == 1) & (F.col("level1") == SEA_LEVEL)
    surface = param.isin(11, 12) & (F.col("level1") == SURFACE)
    number = lambda i: _coded(param, {k: float(v[i]) for k, v in LEVELS.items()})
    level_type = F.when(sea, 2).when(surface, 1).otherwise(number(0).cast("int"))
    near, far = F.col("level1"), F.col("level2")
    if kind == "octagonal":
        level1, level2 = F.when(far != 0, far).otherwise(near), F.when(far != 0, near).otherwise(0)
    else:
        high = level_type > 10
        level1, level2 = F.when(high, near).otherwise(0), F.when(high, far).otherwise(0)
    # Factors are columns of their own, since within a lambda a name may mean the column made beside it.
    made = grids.filter("n_mean = 0").withColumns({"_factor": number(1), "_offset": number(2)}).select(
        *keys, _coded(F.col("source"), SOURCES[kind]).alias("center"), F.when(sea, 2).otherwise(param).alias("param"), level_type.alias("level_type"), level1.alias("level1"), level2.alias("level2"), F.lit(10).alias("time_range"),
        F.lit(1).alias("time_unit"), F.col("forecast_hours").alias("p1"), F.lit(0).alias("p2"), F.lit(0).alias("n_mean"), F.transform("values", lambda v: v * F.col("_factor") + F.col("_offset")).alias("values"),
    )
    return made.filter("center IS NOT NULL AND param IS NOT NULL")


def pressure_to_message(grids: DataFrame, *keys: str, center: int | None = None) -> DataFrame:
    """Sea level pressures, in millibars, as messages in pascals; a month's mean has one or two samples a day of its month.

    Of slp grids, or with a center given of grids without means.
    """
    mean = F.lit(False) if center else F.col("n_mean") > 0
    days = F.dayofmonth(F.last_day(F.make_date("year", "month", F.lit(1))))
    twice = mean & (F.col("n_mean") > days) if not center else F.lit(False)
    code = F.lit(center) if center else _coded(F.col("source"), SOURCES["slp"])
    made = grids.select(
        *keys, code.alias("center"), F.lit(2).alias("param"), F.lit(102).alias("level_type"), F.lit(0).alias("level1"), F.lit(0).alias("level2"), F.when(mean, 113).otherwise(10).alias("time_range"), F.when(mean & ~twice, 2).otherwise(1).alias("time_unit"),
        F.lit(0).alias("p1"), F.when(twice, 12).when(mean, 1).otherwise(0).alias("p2"), F.when(twice, 2 * days).when(mean, days).otherwise(0).alias("n_mean"), F.transform("values", lambda v: v * 100).alias("values"),
    )
    return made.filter("center IS NOT NULL")


def message_to_packed(messages: DataFrame, *keys: str) -> DataFrame:
    """Messages on regular grids as packed latlon grids: param and level1 by theirs; other columns stay.

    Fields near the ground stand at SURFACE, and sea level pressures at SEA_LEVEL.
    """
    kind, level, param = F.col("level_type"), F.col("level1"), F.col("param")
    code = (
        F.when((param == 2) & (kind == 102), 6).when(param == 7, 1).when((param == 11) & (kind == 1), 57).when(param == 11, 10).when(param == 33, 30).when(param == 34, 31).when(param == 39, 5).when(param == 52, 44).when(param == 80, 57)
    )
    at = (
        F.when(param == 2, SEA_LEVEL).when(param.isin(7, 80) & (kind == 1), SURFACE).when((param == 11) & ((kind == 1) | ((kind == 105) & (level == 2))), SURFACE).when(param.isin(33, 34, 52) & (kind == 105), SURFACE).otherwise(level)
    )
    known = kind.isin(1, 100, 101, 102, 105)
    rest = [c for c in messages.columns if c not in (*keys, "param", "level1")]
    return messages.filter(known).select(*keys, code.alias("param"), at.cast("int").alias("level1"), *rest).filter("param IS NOT NULL")


def message_to_pressure(messages: DataFrame, *keys: str, nx: int, south: float, step: float) -> DataFrame:
    """Sea level pressures of one centre on a grid from the south and 0 E, in pascals, as 15 rows of 72 from 15 N on and the pole, in millibars."""
    stride, first = round(5 / step), round((15 - south) / step)
    cell = lambda j, i: F.get("values", (F.lit(first) + j * stride) * nx + i * stride) * 0.01
    cells = F.transform(F.sequence(F.lit(0), F.lit(15 * 72 - 1)), lambda k: cell(F.floor(k / 72).cast("int"), F.pmod(k, F.lit(72))))
    mine = messages.filter("center = 7 AND param = 2 AND level_type = 102")
    return mine.select(*keys, F.lit(28).alias("source"), F.lit(6).alias("param"), F.lit(SEA_LEVEL).alias("level1"), F.when(is_averaged(F.col("time_range")), F.col("n_mean")).otherwise(0).alias("n_mean"), cells.alias("values"), (F.element_at("values", -1) * 0.01).alias("pole"))


def navy_to_octagonal(grids: DataFrame) -> DataFrame:
    """The 51 rows of 47 cells in the middle of 63 by 63, with two parameters renamed; other columns stay."""
    param = F.when(F.col("param") == 6, 28).when(F.col("param") == 57, 47).otherwise(F.col("param"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(51 * 47 - 1)), lambda k: F.get("values", (F.floor(k / 47).cast("int") + 6) * 63 + F.pmod(k, F.lit(47)) + 8))
    return grids.withColumns({"param": param, "values": cells, "nx": F.lit(47), "ny": F.lit(51)})


def doubled_columns(values: Column, nx: int) -> Column:
    """Fields by row with a cell between each two, round the earth: of four known neighbours -1/16, 9/16, 9/16 and -1/16, of two the mean.

    A missing cell between two known ones is their mean first.
    """
    at = lambda v, k, d: F.get(v, (k - F.pmod(k, F.lit(nx)) + F.pmod(k + d, F.lit(nx))).cast("int"))
    full = F.transform(values, lambda x, k: F.coalesce(x, (at(values, k, -1) + at(values, k, 1)) * 0.5))

    def between(v: Column) -> Column:
        mid = lambda k: F.coalesce((at(v, k, 0) + at(v, k, 1)) * (9 / 16) - (at(v, k, -1) + at(v, k, 2)) / 16, (at(v, k, 0) + at(v, k, 1)) * 0.5)
        return F.flatten(F.transform(v, lambda x, k: F.array(x, mid(k))))

    # The lambda binds the filled field, so it is worked out once.
    return F.get(F.transform(F.array(full), between), F.lit(0))


def remapped(messages: DataFrame, table: DataFrame) -> DataFrame:
    """messages with param, level_type and values by a table of from_center, from_param, to_param, to_level_type and factor.

    A null in the table leaves what is there, as does a message without an entry. The table is a list of codes, an entry a code.
    """
    codes = table.select("from_center", "from_param", "to_param", "to_level_type", "factor")
    joined = messages.join(codes, (F.col("center") == F.col("from_center")) & (F.col("param") == F.col("from_param")), "left")
    factor = F.coalesce("factor", F.lit(1.0))
    made = joined.withColumns({"param": F.coalesce("to_param", "param"), "level_type": F.coalesce("to_level_type", "level_type"), "values": F.transform("values", lambda v: v * factor)})
    return made.select(*messages.columns)
