"""Sets of whole numbers as text: the first number, a colon and the bits from it on.

Runs of more than four equal bits are written -n/b. Encoded and decoded by array functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bits(n: Column, bit: str) -> Column:
    return F.when(n > 4, F.concat(F.lit("-"), n.cast("string"), F.lit(f"/{bit}"))).otherwise(F.repeat(F.lit(bit), n))


def encode(values: Column) -> Column:
    """Of an array of numbers in any order; repeats count once; null for an empty array."""
    # A value that a lambda binds is worked out once, whereas one written within a lambda is for every element.
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def pieces(v: Column, starts: Column, ends: Column) -> Column:
        """Joined once, so the work is in proportion to the numbers."""
        gap = lambda s, i: F.when(i == 0, "").otherwise(_bits((s - F.get(ends, i - 1) - 1).cast("int"), "0"))
        text = F.array_join(F.transform(starts, lambda s, i: F.concat(gap(s, i), _bits((F.get(ends, i) - s + 1).cast("int"), "1"))), "")
        return F.when(F.size(v) > 0, F.concat(F.element_at(v, 1).cast("string"), F.lit(":"), text))

    def runs(v: Column) -> Column:
        """v with the first and last numbers of its runs."""
        starts = F.filter(v, lambda x, i: (i == 0) | (x - F.get(v, i - 1) > 1))
        ends = F.filter(v, lambda x, i: (i == F.size(v) - 1) | (F.get(v, i + 1) - x > 1))
        return once(F.struct(starts.alias("s"), ends.alias("e")), lambda r: pieces(v, r["s"], r["e"]))

    return once(F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull()))), runs)


def decode(text: Column) -> Column:
    """The numbers, ascending. Only runs of ones are spread out."""
    first = F.split_part(text, F.lit(":"), F.lit(1)).cast("long")
    runs = F.regexp_extract_all(F.split_part(text, F.lit(":"), F.lit(2)), F.lit(r"(-\d+/[01]|[01])"), 1)
    length = lambda r: F.when(r.startswith("-"), F.regexp_extract(r, r"\d+", 0).try_cast("int")).otherwise(1)
    starts = F.aggregate(runs, F.array(first), lambda a, r: F.concat(a, F.array(F.element_at(a, -1) + length(r))))
    spans = F.zip_with(runs, starts, lambda r, s: F.when(r.endswith("1"), F.sequence(s, s + length(r) - 1)))
    return F.flatten(F.filter(spans, lambda x: x.isNotNull()))


def longitudes(present: Column) -> Column:
    """120 octal digits that say which of 360 longitudes are in an array, three to a digit with the first the highest."""
    bit = lambda at, worth: F.when(F.array_contains(present, at), worth).otherwise(0)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(119)), lambda i: (bit(i * 3, 4) + bit(i * 3 + 1, 2) + bit(i * 3 + 2, 1)).cast("string")), "")


def longitude_bits(text: Column) -> Column:
    """360 zeros and ones of 120 octal digits."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.lpad(F.conv(c, 8, 2), 3, "0")), "")


def contains(text: Column, value: Column) -> Column:
    return F.array_contains(decode(text), value.cast("long"))
