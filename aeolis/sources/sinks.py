"""Encoders: rows to the bytes of archive formats, as a column, so that any Spark writer stores them."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binary import NC_FILL


def fixed_width(*fields: tuple[int, int, Column], length: int = 0) -> Column:
    """A record with each value right-aligned in its columns (start from 0, width); the rest is spaces, up to `length`."""
    parts, at = [], 0
    for start, width, value in sorted(fields, key=lambda f: f[0]):
        parts += [F.lit(" " * (start - at)), F.lpad(F.coalesce(value.cast("string"), F.lit("")), width, " ")]
        at = start + width
    return F.concat(*parts, F.lit(" " * max(0, length - at)))


def number_bytes(value: Column, width: int) -> Column:
    """A whole number as so many big-endian bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * width, "0"))


def joined(pieces: Column) -> Column:
    """The bytes of an array of binary values, one after the other."""
    return F.unhex(F.array_join(F.transform(pieces, F.hex), ""))


def in_order(df: DataFrame, key: str, order: str, piece: Column, content: str = "content") -> DataFrame:
    """key and the pieces of its rows in order, joined: the content of a file a key, which should be as much as a file holds."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), piece.alias("piece"))))
    return df.groupBy(key).agg(joined(F.transform(pieces, lambda x: x["piece"])).alias(content))


def f77_frame(record: Column) -> Column:
    """The record between two big-endian lengths of four bytes."""
    size = number_bytes(F.length(record), 4)
    return F.concat(size, record, size)


def vbs_frame(record: Column, most: int = 0) -> Column:
    """A block of its own for a record, or with `most` a block for each piece of so many bytes: first, middle and last segments."""
    block = lambda piece, code: F.concat(number_bytes(F.length(piece) + 8, 2), F.unhex(F.lit("0000")), number_bytes(F.length(piece) + 4, 2), number_bytes(code, 1), F.unhex(F.lit("00")), piece)
    if not most:
        return block(record, F.lit(0))
    last = F.floor((F.length(record) - 1) / most).cast("int")
    code = lambda i: F.when(last == 0, 0).when(i == 0, 1).when(i == last, 2).otherwise(3)
    return joined(F.transform(F.sequence(F.lit(0), last), lambda i: block(F.substring(record, i * most + 1, F.lit(most)), code(i))))


def cos_file(records: Column) -> Column:
    """A file of 64-bit words with a control word before each record's data, and the ends of the file and of the data.

    Records are given as an array of binary values of at most 511 words; a record's end says how many bits of its last word are unused.
    """
    words = lambda r: F.ceil(F.length(r) / 8)
    control = lambda kind, unused, ahead: F.concat(number_bytes((F.lit(kind) * 16 + F.shiftright(unused, 2)), 1), number_bytes(F.pmod(unused, F.lit(4)) * 64, 1), F.unhex(F.lit("00000000")), number_bytes(ahead, 2))
    first = control(0, F.lit(0), F.coalesce(words(F.get(records, F.lit(0))), F.lit(0)))
    pad = lambda r: F.unhex(F.repeat(F.lit("00"), F.pmod(-F.length(r), F.lit(8)).cast("int")))
    body = F.transform(records, lambda r, i: F.concat(r, pad(r), control(8, F.pmod(-F.length(r), F.lit(8)) * 8, F.coalesce(words(F.get(records, i + 1)), F.lit(0)))))
    return F.concat(first, joined(body), control(14, F.lit(0), F.lit(0)), control(15, F.lit(0), F.lit(0)))


def bits(*fields: tuple[int, int, Column], length: int) -> Column:
    """Bytes of `length` bits with whole numbers in their places (first bit, width); negative ones in two's complement."""
    parts, at = [], 0
    for first, width, value in sorted(fields, key=lambda f: f[0]):
        digits = F.right(F.lpad(F.bin(F.coalesce(value, F.lit(0)).cast("long")), 64, "0"), F.lit(width))
        parts += [F.lit("0" * (first - at)), digits]
        at = first + width
    text = F.concat(*parts, F.lit("0" * (length - at)))
    return F.unhex(F.array_join(F.transform(F.regexp_extract_all(text, F.lit("[01]{8}"), 0), lambda c: F.lpad(F.conv(c, 2, 16), 2, "0")), ""))


def f77_file(df: DataFrame, record: str, *order: str) -> DataFrame:
    """Adds framed: the record between two big-endian lengths; rows in order, joined, make a sequential file."""
    return df.withColumn("framed", f77_frame(F.col(record))).orderBy(*order)


def netcdf_head(dims: dict[str, int], variables: list[tuple[str, list[str], dict[str, str]]], attributes: dict[str, str] | None = None) -> tuple[bytes, list[int]]:
    """Head of a classic file of doubles with 64-bit offsets and without a record dimension, and where each variable begins."""
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    n = lambda v: int(v).to_bytes(4, "big")
    name = lambda s: n(len(s.encode())) + pad(s.encode())
    items = lambda tag, parts: (n(tag) + n(len(parts)) if parts else n(0) + n(0)) + b"".join(parts)
    texts = lambda a: items(12, [name(k) + n(2) + name(v) for k, v in (a or {}).items()])
    numbers = {d: i for i, d in enumerate(dims)}
    sizes = [8 * math.prod(dims[d] for d in ds) for _, ds, _ in variables]

    def head(begins):
        # A size beyond 32 bits is written as the largest number; readers take it from the dimensions.
        parts = [name(v) + n(len(ds)) + b"".join(n(numbers[d]) for d in ds) + texts(a) + n(6) + n(min(size, 0xFFFFFFFF)) + int(b).to_bytes(8, "big") for (v, ds, a), size, b in zip(variables, sizes, begins)]
        return b"CDF\2" + n(0) + items(10, [name(d) + n(k) for d, k in dims.items()]) + texts(attributes) + items(11, parts)

    begins = list(itertools.accumulate(sizes, initial=len(head([0] * len(variables)))))[:-1]
    return head(begins), begins


def netcdf_bytes(dims: dict[str, int], variables: list[tuple[str, list[str], np.ndarray, dict[str, str]]], attributes: dict[str, str] | None = None) -> bytes:
    """A classic file of doubles (NaN: unwritten), without a record dimension; 64-bit offsets."""
    head, _ = netcdf_head(dims, [(v, ds, a) for v, ds, _, a in variables], attributes)
    return head + b"".join(netcdf_cells(x) for _, _, x, _ in variables)


def netcdf_cells(values: np.ndarray) -> bytes:
    """Doubles as a file has them (NaN: unwritten)."""
    return np.where(np.isnan(values), NC_FILL["double"], values).astype(">f8").tobytes()


def netcdf_files(grids: DataFrame, key: str, order: str, variable: str, nx: int, ny: int) -> DataFrame:
    """key, content: a file a key with variable(time, y, x) from the arrays in `values`, by ascending order column.

    A file's grids meet in one task, so a key should be as much as one file is meant to hold.
    """

    def build(group: pa.Table) -> pa.Table:
        rows = group.sort_by(order)
        cells = np.array([[np.nan if v is None else v for v in row] for row in rows["values"].to_pylist()], float).reshape(len(rows), ny, nx)
        times = rows["__order"].to_numpy().astype(float)
        content = netcdf_bytes({"time": len(rows), "y": ny, "x": nx}, [("time", ["time"], times, {}), (variable, ["time", "y", "x"], cells, {})])
        return pa.table({key: rows[key].slice(0, 1), "content": pa.array([content], pa.binary())})

    chosen = grids.select(key, order, F.col(order).cast("double").alias("__order"), "values")
    return chosen.groupBy(key).applyInArrow(build, f"{key} {grids.schema[key].dataType.simpleString()}, content binary")


def grib1_messages(grids: DataFrame, bits: int = 12) -> DataFrame:
    """Adds message: edition 1, latitude-longitude grid, simple packing to `bits` bits, a bitmap where cells are null.

    Needs ref_time (timestamp), param, level_type, level, center, nx, ny, slat, slon, elat, elon, values.
    """

    def signed(v: float, width: int) -> bytes:
        n = round(v)
        return (abs(n) | (1 << 8 * width - 1 if n < 0 else 0)).to_bytes(width, "big")

    def ibm(v: float) -> bytes:
        """The base-16 float at or below v in size."""
        if not v:
            return b"\0" * 4
        exponent = 0
        m = abs(v)
        while m >= 1:
            m, exponent = m / 16, exponent + 1
        while m < 1 / 16:
            m, exponent = m * 16, exponent - 1
        fraction = int(m * (1 << 24)) if v > 0 else -int(-m * (1 << 24) // 1)
        if fraction == 1 << 24:
            fraction, exponent = fraction >> 4, exponent + 1
        return ((v < 0) << 31 | (exponent + 64) << 24 | fraction).to_bytes(4, "big")

    def message(r: dict) -> bytes:
        values = np.array([np.nan if v is None else v for v in r["values"]], float)
        there = ~np.isnan(values)
        known = values[there]
        low = float(known.min()) if len(known) else 0.0
        raw = ibm(low)
        word = int.from_bytes(raw, "big")
        low = (-1.0 if word >> 31 else 1.0) * (word & 0xFFFFFF) * 16.0 ** ((word >> 24 & 127) - 70)
        spread = float(known.max() - low) if len(known) else 0.0
        scale = int(np.ceil(np.log2(spread / ((1 << bits) - 1)))) if spread > 0 else 0
        codes = np.clip(np.rint((known - low) / 2.0**scale), 0, (1 << bits) - 1).astype(np.int64)
        packed = np.packbits((codes[:, None] >> np.arange(bits - 1, -1, -1) & 1).astype(np.uint8).ravel()).tobytes()
        t = r["ref_time"]
        century, year = (t.year - 1) // 100 + 1, (t.year - 1) % 100 + 1
        partial = not there.all()
        pds = (28).to_bytes(3, "big") + bytes([2, r["center"], 0, 255, 0x80 | 0x40 * partial, r["param"], r["level_type"]]) + int(r["level"]).to_bytes(2, "big")
        pds += bytes([year, t.month, t.day, t.hour, t.minute, 1, 0, 0, 0, 0, 0, 0, century, 0]) + b"\0\0"
        gds = (32).to_bytes(3, "big") + bytes([0, 255, 0]) + r["nx"].to_bytes(2, "big") + r["ny"].to_bytes(2, "big") + b"".join(signed(r[k] * 1000, 3) for k in ("slat", "slon"))
        gds += b"\x80" + b"".join(signed(r[k] * 1000, 3) for k in ("elat", "elon")) + b"\xff" * 4 + b"\0" * 5
        bitmap = np.packbits(there).tobytes() if partial else b""
        bms = (6 + len(bitmap)).to_bytes(3, "big") + bytes([-len(there) % 8, 0, 0]) + bitmap if partial else b""
        bds = (11 + len(packed)).to_bytes(3, "big") + bytes([len(packed) * 8 - len(known) * bits]) + signed(scale, 2) + raw + bytes([bits]) + packed
        body = pds + gds + bms + bds + b"7777"
        return b"GRIB" + (8 + len(body)).to_bytes(3, "big") + b"\1" + body

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({c: b[c] for c in b.schema.names} | {"message": pa.array([message(r) for r in b.to_pylist()], pa.binary())})

    return grids.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grids.schema) + ", message binary")
