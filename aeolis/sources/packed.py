"""Grids packed into records of bits: one decoder, and for each format a description of its record.

Records come from any framing reader, so a header or a filter on the time costs no cells: values are
unpacked for whole Arrow batches at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary import fixed_records, parsed

#: Records unpacked at a time.
STEP = 64
HEAD = ("year", "month", "day", "hour", "forecast_hours", "level1", "level2", "param", "source", "n_mean")


@dataclass(frozen=True)
class Layout:
    """Bytes of a record, shape, first bit and width of the cells, and (first bit, width) of each header field."""

    length: int
    nx: int
    ny: int
    first: int
    width: int
    head: dict[str, tuple[int, int]]
    #: Raw cells and header to values, NaN where missing.
    value: Callable[[np.ndarray, dict[str, np.ndarray], np.ndarray], np.ndarray]
    #: Changes of the header's raw numbers.
    adjust: dict[str, Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray]] = field(default_factory=dict)
    #: First and last column of each row that is in the record; none: all.
    columns: tuple[tuple[int, int], ...] = ()


def _number(bits: np.ndarray, first: int, width: int) -> np.ndarray:
    """Whole numbers of up to 53 bits, one a record."""
    return (bits[:, first : first + width] @ (2.0 ** np.arange(width - 1, -1, -1))).astype(np.int64)


def cdc_floats(bits: np.ndarray, first: int) -> np.ndarray:
    """Doubles from 60 bits: sign, 11 bits of exponent about 1024 (1023 below it), 48 of a whole coefficient."""
    sign, exponent, coefficient = _number(bits, first, 1), _number(bits, first + 1, 11), _number(bits, first + 12, 48)
    exponent = exponent - np.where(exponent < 1024, 1023, 1024)
    return np.where(sign == 1, -1.0, 1.0) * np.ldexp(coefficient.astype(float), exponent)


def _scaled(cells: np.ndarray, head: dict[str, np.ndarray], bits: np.ndarray) -> np.ndarray:
    """base + (cell - bias) * 2 ** scale; 0 is missing."""
    scale = np.exp2((head["scale"] - head["bias"]).astype(float))
    return np.where(cells > 0, cdc_floats(bits, 120)[:, None] + (cells - head["bias"][:, None]) * scale[:, None], np.nan)


def _signed16(cells: np.ndarray) -> np.ndarray:
    return np.where(cells > 0x7FFF, cells - 0x10000, cells)


def _decipascals(cells: np.ndarray, head: dict[str, np.ndarray], bits: np.ndarray) -> np.ndarray:
    """Tenths of a millibar; the highest bit marks a doubtful cell."""
    tenths = np.where(cells >= 1 << 14, cells - (1 << 14), cells)
    return np.where(tenths > 0, tenths * 0.1, np.nan)


def _from_thousand(missing: int):
    """Tenths above 1000 millibars, signed."""

    def value(cells: np.ndarray, head: dict[str, np.ndarray], bits: np.ndarray) -> np.ndarray:
        signed = _signed16(cells)
        return np.where(signed != missing, 1000 + signed * 0.1, np.nan)

    return value


def _by_meridian(cells: np.ndarray, head: dict[str, np.ndarray], bits: np.ndarray) -> np.ndarray:
    """36 meridians, each a west-positive longitude and 15 cells from north to south, laid out by row from 0 E."""
    cells = cells.reshape(len(cells), 36, 16)
    west = np.fix(_signed16(cells[:, :, 0]) / 10).astype(int)
    column = np.where(west <= 0, -west, 36 - west)
    signed = _signed16(cells[:, :, 1:])
    out = np.full((len(cells), 15, 36), np.nan)
    record = np.arange(len(cells))[:, None]
    out[record, :, column] = np.where(signed != -32768, 1000 + signed * 0.1, np.nan)
    return out.reshape(len(cells), -1)


#: How the formats write years, levels, counts of means and dates, and the fields that most of them share.
_SINCE_1900 = {"year": lambda v, h: 1900 + v}
_LEVELS = {"level1": lambda v, h: 1023 - v, "level2": lambda v, h: 1023 - v}
#: A count of means is given where the day is 0.
_MEANS = {"n_mean": lambda v, h: np.where(h["day"] == 0, v, 0)}
_COMMON = {"year": (6, 7), "month": (13, 4), "day": (17, 5), "hour": (22, 5), "level1": (27, 10), "param": (37, 9), "forecast_hours": (46, 9)}
_TENTHS = {k: (lambda v, h: v // 10) for k in ("month", "day")}


def _octagon() -> tuple[tuple[int, int], ...]:
    """51 rows of up to 47 columns, 14 that widen by one on either side, 23 whole, 14 that narrow."""
    cut = [max(0, 14 - n, n - 36) for n in range(51)]
    return tuple((c, 46 - c) for c in cut)


def _degrees(length: int, nx: int, ny: int) -> Layout:
    head = _COMMON | {"level2": (55, 10), "source": (65, 6), "bias": (76, 15), "scale": (91, 15), "n_mean": (106, 8)}
    return Layout(length, nx, ny, 180, 15, head, _scaled, _SINCE_1900 | _LEVELS | _MEANS)


#: Where each format has its fields.
LAYOUTS = {
    "octagonal": Layout(3000, 47, 51, 216, 12, _COMMON | {"level2": (55, 10), "source": (65, 6), "bias": (76, 12), "scale": (88, 12), "n_mean": (100, 8)}, _scaled, _SINCE_1900 | _LEVELS | _MEANS, _octagon()),
    "latlon_5": _degrees(2600, 72, 19),
    "latlon_2.5": _degrees(10024, 144, 37),
    "navy": Layout(7973, 63, 63, 180, 16, _COMMON | {"source": (67, 6), "bias": (78, 16), "scale": (94, 16), "n_mean": (110, 10)}, _scaled, _SINCE_1900 | {"level1": _LEVELS["level1"]} | _MEANS),
    "slp": Layout(
        2048, 72, 15, 120, 15, {"year": (6, 11), "month": (17, 4), "day": (21, 5), "hour": (26, 5), "level1": (31, 10), "param": (41, 9), "source": (50, 6), "n_mean": (75, 6)}, _decipascals,
        {"n_mean": lambda v, h: np.where((v == 0) & (h["day"] == 0), 999, v)},
    ),
    "slp_ussr": Layout(1158, 36, 16, 48, 16, {"year": (0, 16), "month": (16, 16), "day": (32, 16), "hour": (0, 16)}, _from_thousand(0x7FFF), {"hour": lambda v, h: np.where(v < 1973, 12, 0)}),
    "slp_uk": Layout(1184, 36, 15, 256, 16, {"day": (32, 16), "month": (48, 16), "year": (64, 16)}, _by_meridian, _TENTHS | {"year": lambda v, h: 1900 + v // 10}),
}


def _unpack(layout: Layout, records: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    bits = np.unpackbits(np.frombuffer(b"".join(r[: layout.length] for r in records), np.uint8).reshape(len(records), -1), axis=1)
    raw = {k: _number(bits, *at) for k, at in layout.head.items()}
    head = raw | {k: f(raw[k], raw) for k, f in layout.adjust.items()}
    inside = np.ones((layout.ny, layout.nx), bool)
    for row, (lo, hi) in enumerate(layout.columns):
        inside[row, :lo] = inside[row, hi + 1 :] = False
    n = int(inside.sum()) + (36 if layout.value is _by_meridian else 0)
    packed = bits[:, layout.first : layout.first + n * layout.width].reshape(len(records), n, layout.width)
    cells = (packed @ (2.0 ** np.arange(layout.width - 1, -1, -1))).astype(np.int64)
    values = np.full((len(records), layout.nx * layout.ny), np.nan)
    values[:, inside.ravel()] = layout.value(cells, raw, bits)
    return head, values


def packed_grids(records: DataFrame, kind: str) -> DataFrame:
    """Columns of records but `record`, then ref_time, valid_time, the header fields that the format has, nx, ny, values by row.

    kind: a key of LAYOUTS. Records shorter than the format's are dropped. ref_time is null for means over a
    month, whose day is 0, and where the header gives no valid time; values are null where missing.
    """
    layout = LAYOUTS[kind]
    names = [h for h in HEAD if h in layout.head]

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), STEP):
                part = b.slice(lo, STEP)
                head, values = _unpack(layout, part["record"].to_pylist())
                ends = pa.array(np.arange(0, values.size + 1, layout.nx * layout.ny), pa.int32())
                cells = pa.ListArray.from_arrays(ends, pa.array(values.ravel(), mask=np.isnan(values.ravel())))
                columns = {c: part[c] for c in part.schema.names if c != "record"} | {k: pa.array(head[k].astype(np.int32)) for k in names}
                yield pa.RecordBatch.from_pydict(columns | {"values": cells})

    whole = records.filter(F.length("record") >= layout.length)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in whole.drop("record").schema]
    out = whole.mapInArrow(run, ", ".join([*kept, *(f"{k} int" for k in names), "values array<double>"]))
    hour = F.col("hour") if "hour" in names else F.lit(0)
    ahead = F.col("forecast_hours") if "forecast_hours" in names else F.lit(0)
    ref = F.try_make_timestamp_ntz("year", "month", "day", hour, F.lit(0), F.lit(0))
    others = [c for c in whole.columns if c != "record"]
    return out.select(*others, ref.alias("ref_time"), (ref + F.make_dt_interval(hours=ahead)).alias("valid_time"), *names, F.lit(layout.nx).alias("nx"), F.lit(layout.ny).alias("ny"), "values")


def packed_file(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """packed_grids of files of equal records without framing."""
    return packed_grids(fixed_records(spark, path, LAYOUTS[kind].length), kind)


#: Fields of hourly station reports and of monthly climate reports, (first bit, width), with the value that means missing.
HOURLY = {"id": (16, 24), "year": (40, 12), "month": (52, 4), "day": (56, 5), "hour": (61, 5), "zone": (66, 4), "lat": (70, 14), "lon": (84, 16), "elev": (100, 14)}
CLIMATE = {"format": (16, 6), "data_source": (22, 2), "id": (27, 21), "year": (48, 12), "first_month": (60, 4), "lat": (64, 11), "lon": (75, 12), "elev": (87, 14)}
MONTH = {"slp": (1, 15, 20000), "station_pressure": (18, 15, 20000), "height": (33, 13, 5000), "temp": (46, 11, 1990), "precipitation": (57, 18, 200000)}
MONTH_FIRST, MONTH_BITS, TRACE = 332, 75, 150000


def _padded(records: list[bytes], length: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(r[:length].ljust(length, b"\0") for r in records), np.uint8).reshape(len(records), length), axis=1)


def hourly_reports(records: DataFrame) -> DataFrame:
    """id, ts (UTC), lat, lon, elev of surface reports of a station network, from columns with `record`."""

    def run(batches):
        for b in batches:
            bits = _padded(b["record"].to_pylist(), 15)
            yield pa.RecordBatch.from_pydict({k: pa.array(_number(bits, *at)) for k, at in HOURLY.items()})

    rows = records.filter(F.length("record") >= 15).select("record").mapInArrow(run, ", ".join(f"{k} long" for k in HOURLY))
    day = F.try_make_timestamp_ntz(F.col("year").cast("int"), F.col("month").cast("int"), F.col("day").cast("int"), F.lit(0), F.lit(0), F.lit(0))
    ts = day + F.make_dt_interval(hours=(F.col("hour") - (F.col("zone") - 8)).cast("int"))
    return rows.select(F.lpad(F.col("id").cast("string"), 7, "0").alias("id"), ts.alias("ts"), (F.col("lat") / 100).alias("lat"), ((F.col("lon") - 18000) / 100).alias("lon"), "elev")


def station_climate(records: DataFrame) -> DataFrame:
    """id, year, lat, lon, elev, data_source, month, slp, station_pressure, height, temp, precipitation (millimetres, with `trace` true for less than could be measured): twelve rows a report."""

    def run(batches):
        for b in batches:
            bits = _padded(b["record"].to_pylist(), (MONTH_FIRST + 12 * MONTH_BITS + 7) // 8)
            head = {k: _number(bits, *at) for k, at in CLIMATE.items()}
            for m in range(12):
                raw = {k: _number(bits, MONTH_FIRST + m * MONTH_BITS + at, width) for k, (at, width, _) in MONTH.items()}
                cells = {k: pa.array(v.astype(float), mask=v == MONTH[k][2]) for k, v in raw.items()}
                yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in head.items()} | {"month": pa.array(np.full(len(b), m + 1, np.int32))} | cells)

    rows = records.filter(F.length("record") * 8 >= MONTH_FIRST).select("record").mapInArrow(run, ", ".join(f"{k} long" for k in CLIMATE) + ", month int, " + ", ".join(f"{k} double" for k in MONTH))
    west = (F.col("lon") - 2000) / 10
    return rows.select(
        F.lpad(F.col("id").cast("string"), 6, "0").alias("id"), "year", ((F.col("lat") - 1000) / 10).alias("lat"), F.when(west > -199, -west).alias("lon"), (F.col("elev") - 1000).alias("elev"), "data_source", "month",
        (F.col("slp") / 10).alias("slp"), (F.col("station_pressure") / 10).alias("station_pressure"), "height", ((F.col("temp") - 1000) / 10).alias("temp"),
        F.when(F.col("precipitation") != TRACE, F.col("precipitation") / 10).alias("precipitation"), (F.coalesce(F.col("precipitation"), F.lit(0)) == TRACE).alias("trace"),
    )


def _weekly(data: bytes):
    lines = data.decode("latin-1").splitlines()
    starts = [i for i, x in enumerate(lines) if len(x) == 45]
    for n, (i, j) in enumerate(zip(starts, [*starts[1:], len(lines)])):
        head, body = lines[i], "".join(lines[i + 1 : j])
        number = lambda at: int(head[at : at + 5])
        cells = [int(body[k : k + 4]) / 10 for k in range(0, 4 * 360 * 180, 4)]
        yield {"rec_no": n, "year": number(0), "month": number(5), "day": number(10), "n_mean": number(30), "version": head[35:45].strip(), "nx": 360, "ny": 180, "values": cells}


def sea_surface_weeks(spark: SparkSession, path: str) -> DataFrame:
    """path, rec_no, year, month, day, n_mean, version, nx, ny, values: one-degree fields as text, each after a line of 45 characters, from 89.5 S and 0.5 E."""
    return parsed(spark, path, _weekly, "rec_no long, year int, month int, day int, n_mean int, version string, nx int, ny int, values array<double>", 1)
