"""Levels of soundings as arrays of structs."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def virtual_temperature(hpa: Column, celsius: Column, moisture: Column, kind: str) -> Column:
    """Kelvin, of moisture as humidity (per cent), mixing_ratio (tenths of g/kg) or dew_point (Celsius).

    Without moisture it is the temperature; without a temperature null.
    """
    over_water = lambda t: 6.1078 * F.pow(F.lit(10.0), 7.5 * t / (237.3 + t))
    if kind == "humidity":
        vapor = F.abs(moisture) / 100 * over_water(celsius)
    elif kind == "mixing_ratio":
        vapor = hpa * (moisture / 10000) / (moisture / 10000 + 0.62197)
    else:
        vapor = over_water(moisture)
    share = 1 - 0.379 * vapor / hpa
    return (celsius + 273.15) / F.when(share >= 0.1, share).otherwise(1.0)


def merge_levels(levels: Column, key: str, *fields: str) -> Column:
    """levels, those that follow each other with an equal key made one if every field is equal or missing in one."""

    def agree(a: Column, b: Column) -> Column:
        out = a[key] == b[key]
        for f in fields:
            out = out & F.coalesce(a[f] == b[f], F.lit(True))
        return F.coalesce(out, F.lit(False))

    def add(held: Column, level: Column) -> Column:
        last = F.element_at(held, -1)
        one = F.struct(level[key].alias(key), *(F.coalesce(level[f], last[f]).alias(f) for f in fields))
        joined = F.concat(F.slice(held, 1, F.size(held) - 1), F.array(one))
        return F.when(F.size(held) == 0, F.array(level)).when(agree(last, level), joined).otherwise(F.concat(held, F.array(level)))

    plain = F.transform(levels, lambda x: F.struct(x[key].alias(key), *(x[f].alias(f) for f in fields)))
    return F.aggregate(plain, F.slice(plain, 1, 0), add)


def _once(value: Column, use) -> Column:
    """use(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def appended(first: Column, second: Column) -> Column:
    """A sounding of two: the levels of the second behind those of the first. A null one gives the other.

    Both are structs of released, ended, indicators (of kinds of quality, 1 for those that are reported) and levels, structs whose
    `quality` is an array of these kinds. A kind that only one reports counts as reported, and is "0" in the levels of the other.
    The release is that of the first, the end that of the second.
    """

    def levels(own: Column, other: Column) -> Column:
        lacking = lambda i: (F.get(own["indicators"], i) == 0) & (F.get(other["indicators"], i) == 1)
        return F.transform(own["levels"], lambda x: x.withField("quality", F.transform(x["quality"], lambda q, i: F.when(lacking(i), "0").otherwise(q))))

    both = F.struct(
        first["released"].alias("released"), second["ended"].alias("ended"), F.zip_with(first["indicators"], second["indicators"], lambda a, b: F.greatest(a, b)).alias("indicators"),
        F.concat(levels(first, second), levels(second, first)).alias("levels"),
    )
    return F.when(second.isNull(), first).when(first.isNull(), second).otherwise(both)


def combined(first: Column, second: Column, key: str, *fields: str) -> Column:
    """The levels of both by descending key: each field from the first sounding that has it there, and `<field>_from`, 1 or 2, null for neither.

    Levels without a key go; a null sounding is one without levels.
    """

    def level(all_levels: Column, k: Column) -> Column:
        def fields_of(own: Column) -> Column:
            held = lambda f: F.get(F.filter(own, lambda x: x[f].isNotNull()), F.lit(0))
            return F.struct(k.alias(key), *(c for f in fields for c in (held(f)[f].alias(f), held(f)["of"].alias(f"{f}_from"))))

        return _once(F.filter(all_levels, lambda x: x[key] == k), fields_of)

    def of(levels: Column, n: int) -> Column:
        plain = F.transform(levels, lambda x: F.struct(x[key].alias(key), F.lit(n).alias("of"), *(x[f].alias(f) for f in fields)))
        return F.coalesce(F.filter(plain, lambda x: x[key].isNotNull()), F.array())

    keys = lambda levels: F.reverse(F.array_sort(F.array_distinct(F.transform(levels, lambda x: x[key]))))
    return _once(F.concat(of(first, 1), of(second, 2)), lambda levels: F.transform(keys(levels), lambda k: level(levels, k)))


def same(first: Column, second: Column, *fields: str, within: float = 1e-9) -> Column:
    """Whether both have as many levels and their fields are equal level by level, numbers within a difference; missing equals missing."""
    near = lambda a, b, f: F.coalesce(F.abs(a[f] - b[f]) < within, a[f].isNull() & b[f].isNull())
    pairs = F.zip_with(first, second, lambda a, b: reduce(and_, (near(a, b, f) for f in fields)))
    return (F.size(first) == F.size(second)) & F.forall(pairs, lambda x: x)


def hydrostatic_check(levels: Column, kind: str, tolerance: float) -> Column:
    """Struct of status (3 passed, 1 failed), surface (place of the first level of type 0 from 1, or 0), surfaces, and checks by level: computed, difference.

    Levels hold type, pressure, height, temperature, moisture (of a kind that virtual_temperature names), from the ground up.
    Heights are computed from the first level that has a height, pressure and temperature on, by layers rounded to whole metres,
    over the levels that have pressure and temperature. A difference is what the reported height gained since the last level with
    both heights, less what the computed one did; it is 0 at the first. One above the tolerance fails the sounding.
    """

    def step(s: Column, x: Column) -> Column:
        tv = virtual_temperature(x["pressure"], x["temperature"], x["moisture"], kind)
        layer = F.round((tv + s["tv"]) * F.ln(s["p"] / x["pressure"]) * 14.63563358).cast("long")
        computed = F.when(x["pressure"].isNotNull() & x["temperature"].isNotNull(), F.when(s["z"].isNull(), x["height"]).otherwise(s["z"] + layer))

        def grown(z: Column) -> Column:
            both = z.isNotNull() & x["height"].isNotNull()
            gap = F.when(both, F.coalesce(x["height"] - s["low"] - (z - s["low_computed"]), F.lit(0).cast("long")))
            here = lambda new, old: F.when(z.isNotNull(), new).otherwise(old)
            return F.struct(
                F.coalesce(z, s["z"]).alias("z"), here(x["pressure"], s["p"]).alias("p"), here(tv, s["tv"]).alias("tv"), F.when(both, x["height"]).otherwise(s["low"]).alias("low"),
                F.when(both, z).otherwise(s["low_computed"]).alias("low_computed"), F.concat(s["checks"], F.array(F.struct(z.alias("computed"), gap.alias("difference")))).alias("checks"),
            )

        return _once(computed, grown)

    start = F.expr("named_struct('z', cast(null as long), 'p', cast(null as double), 'tv', cast(null as double), 'low', cast(null as long), 'low_computed', cast(null as long), 'checks', cast(array() as array<struct<computed: long, difference: long>>))")
    surface = lambda x: x["type"] == 0
    first = F.array_position(F.transform(levels, lambda x: F.coalesce(surface(x), F.lit(False))), True).cast("int")
    failed = lambda checks: F.exists(checks, lambda c: F.coalesce(F.abs(c["difference"]) > tolerance, F.lit(False)))
    return _once(F.aggregate(levels, start, step)["checks"], lambda checks: F.struct(
        F.when(failed(checks), 1).otherwise(3).alias("status"), first.alias("surface"), F.size(F.filter(levels, surface)).alias("surfaces"), checks.alias("checks")))
