"""Rules with fallback: the most specific of the rules that apply to a row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import elements

#: Rules that are broadcast.
MOST = 100_000

# Kinds of platforms and their names.
PLATFORMS = {
    "aircraft": "Aircraft",
    "bogus": "Bogus",
    "CMAN": "Coastal Marine Automated Network (CMAN) Station",
    "driftingBuoy": "Drifting Buoy",
    "landStation": "Land Station",
    "mooredBuoy": "Moored Buoy",
    "rovingShip": "Roving Ship",
    "satellite": "Satellite",
}

_KEYWORD = "ARRAY<STRUCT<_VALUE STRING, _ifLevelType STRING, _ifLevelValue STRING>>"
_MAP = (
    "title STRING, parameter ARRAY<STRUCT<_code STRING, shortName STRING, description STRING, units STRING, comment STRING, "
    f"standardName STRING, longName STRING, GCMD {_KEYWORD}, CF {_KEYWORD}, ISO {_KEYWORD}>>"
)


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda p, q: p & q, conditions, F.lit(True))


def most_specific(rows: DataFrame, rules: DataFrame, levels: Sequence[Sequence[str]], value: str, most: int = MOST) -> DataFrame:
    """rows with `value` of the most specific rule that applies, null where none does.

    levels are the keys that rules state, most specific first, and rows and rules have columns of these names. A
    rule is of the level whose keys are those that it has not null, and applies to rows with these values; a rule
    of no level, or without a value, is left out, and of rules with equal keys the least value counts. A row's null
    matches no stated key. Up to `most` rules are broadcast, a level at a time, and rows stay where they are. Of more
    rules, the distinct keys of rows are generalised to each level and meet the rules in one equi-join, and the
    least level of each goes back to the rows.
    """
    if value in rows.columns:
        raise ValueError(f"rows have a column {value} already")
    keys = list(dict.fromkeys(k for level in levels for k in level))
    stated = lambda level: _all([F.col(k).isNotNull() if k in level else F.col(k).isNull() for k in keys])
    rank = F.coalesce(*(F.when(stated(level), i) for i, level in enumerate(levels)))
    named = [F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)]
    ranked = rules.select(rank.alias("__rank"), *named, F.col(value).alias("__value")).filter("__rank IS NOT NULL AND __value IS NOT NULL")
    ranked = ranked.groupBy("__rank", *(f"__k{j}" for j in range(len(keys)))).agg(F.min("__value").alias("__value"))
    if ranked.limit(most + 1).count() <= most:
        out = rows
        for i, level in enumerate(levels):
            at = [keys.index(k) for k in level]
            own = ranked.filter(F.col("__rank") == i).select(*(F.col(f"__k{j}").alias(f"__k{i}_{j}") for j in at), F.col("__value").alias(f"__v{i}"))
            # A level without keys has one rule at most.
            out = out.join(F.broadcast(own), _all([F.col(keys[j]) == F.col(f"__k{i}_{j}") for j in at]), "left")
        return out.select(*(F.col(f"`{c}`") for c in rows.columns), F.coalesce(*(F.col(f"__v{i}") for i in range(len(levels)))).alias(value))
    asked = rows.select(*(F.col(k).alias(f"__a{j}") for j, k in enumerate(keys))).distinct()
    kinds = [rules.schema[k].dataType for k in keys]
    general = [F.struct(F.lit(i).alias("level"), *(F.col(f"__a{j}").cast(kinds[j]).alias(f"g{j}") if k in level else F.lit(None).cast(kinds[j]).alias(f"g{j}") for j, k in enumerate(keys))) for i, level in enumerate(levels)]
    met = asked.withColumn("__g", F.explode(F.array(*general))).join(ranked, _all([F.col("__g.level") == F.col("__rank"), *(F.col(f"__g.g{j}").eqNullSafe(F.col(f"__k{j}")) for j in range(len(keys)))]))
    found = met.groupBy(*(f"__a{j}" for j in range(len(keys)))).agg(F.min_by("__value", "__rank").alias(value))
    return rows.join(found, _all([F.col(k).eqNullSafe(F.col(f"__a{j}")) for j, k in enumerate(keys)]), "left").select(*(F.col(f"`{c}`") for c in rows.columns), value)


def parameter_code(code: Column) -> Column:
    """struct(special, code) of `special:code@level`; special is null without a colon."""
    bare = F.substring_index(code, "@", 1)
    at = F.instr(bare, ":")
    return F.struct(F.when(at > 0, F.substring_index(bare, ":", 1)).alias("special"), F.when(at > 0, F.substr(bare, at + 1)).otherwise(bare).alias("code"))


def parameter_map(xml: Column) -> Column:
    """struct(title, parameter) of a parameterMap document: codes, names, units and keywords by level; null if not well formed."""
    return F.from_xml(xml, _MAP, {"mode": "PERMISSIVE"})


def keyword_rules(maps: DataFrame, name: str, xml: str) -> DataFrame:
    """map, code, kind (GCMD, CF, ISO), level_type, level_value (null where any), keyword of documents named format or format.special."""
    parameters = elements(maps, parameter_map(F.col(xml))["parameter"], F.col(name).alias("map"), element="p")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"p.{k}").alias("rules")) for k in ("GCMD", "CF", "ISO")))
    rules = elements(elements(parameters, kinds, "map", F.col("p._code").alias("code"), element="k"), "k.rules", "map", "code", "k.kind", element="r")
    stated = lambda c: F.nullif(F.col(f"r.{c}"), F.lit(""))
    return rules.select("map", "code", "kind", stated("_ifLevelType").alias("level_type"), stated("_ifLevelValue").alias("level_value"), F.col("r._VALUE").alias("keyword"))


def keywords(rows: DataFrame, rules: DataFrame, kind: str, most: int = MOST) -> DataFrame:
    """rows (format, parameter, level_type, level_value) with `keyword` of that kind; null where the map does not tell.

    The map of format and specialisation counts if there is one, or else that of the format; in it the keyword for
    level type and value, or else type, or else any. A map without any keyword does not count.
    """
    place = parameter_code(F.col("parameter"))
    asked = rows.withColumns({"__special": place["special"], "__code": place["code"]})
    dot = F.instr("map", ".")
    split = {"format": F.when(dot > 0, F.substr("map", F.lit(1), dot - 1)).otherwise(F.col("map")), "__special": F.when(dot > 0, F.substr("map", dot + 1))}
    maps = rules.select(F.col("map").alias("__map")).distinct().withColumn("map", F.col("__map")).withColumns(split)
    asked = most_specific(asked, maps.select("format", "__special", "__map"), (("format", "__special"), ("format",)), "__map", most)
    own = rules.filter(F.col("kind") == kind).select(F.col("map").alias("__map"), F.col("code").alias("__code"), "level_type", "level_value", "keyword")
    by = ("__map", "__code")
    return most_specific(asked, own, ((*by, "level_type", "level_value"), (*by, "level_type"), by), "keyword", most).drop("__special", "__code", "__map")


def platform(kind: Column) -> Column:
    """The name of a kind of platform, empty for others."""
    names = F.create_map(*(F.lit(x) for pair in PLATFORMS.items() for x in pair))
    return F.coalesce(F.try_element_at(names, kind), F.lit(""))
