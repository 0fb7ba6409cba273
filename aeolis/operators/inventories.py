"""Listings of what a file holds: codes from bitmaps, numbered by the order of their names, and a line for each grid."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bitmaps
from .tables import elements

#: Maps that the codes of a file are dealt to.
SLOTS = 32

#: Order of names by kind: U time ranges, G grids, L levels, P parameters, R processes. Names that tie are one entry.
ORDER: dict[str, Callable[[Column, Column], Column]] = {
    "U": lambda name, code: name, "G": lambda name, code: F.lpad(code, 20, "0"), "L": lambda name, code: name, "P": lambda name, code: F.lower(name), "R": lambda name, code: name,
}


def codes(fields: DataFrame, file: str, packed: dict[str, str], plain: dict[str, str]) -> DataFrame:
    """file, kind, code: what the bitmaps (packed) and the columns (plain) of fields say of each file, once each, codes as text.

    A bitmap that many fields of a file share is decoded once. Null and empty ones say nothing. Fields are read once, whatever the number of kinds.
    """
    said = [F.struct(F.lit(k).alias("kind"), F.lit(bits).alias("packed"), F.col(c).cast("string").alias("text")) for bits, columns in ((True, packed), (False, plain)) for k, c in columns.items()]
    texts = elements(fields, F.array(*said), F.col(file).alias("file")).select("file", "v.*").filter("text IS NOT NULL").distinct()
    listed = F.when(F.col("packed"), bitmaps.decode(F.col("text")).cast("array<string>")).otherwise(F.array("text"))
    return elements(texts, listed, "file", "kind", element="code").filter("code IS NOT NULL").select("file", "kind", "code").distinct()


def numbered_codes(found: DataFrame, names: DataFrame, order: dict[str, Callable[[Column, Column], Column]] = ORDER) -> DataFrame:
    """found (of codes()) with name and number, the dense place from 0 of the name in its file and kind.

    names holds kind, code, name. A code without a name is called "", but of a kind that names lacks altogether it is its own name.
    A group is the codes of one file and kind, which the number of codes bounds, whatever the number of grids.
    """
    named = names.select("kind", F.col("code").cast("string").alias("code"), "name").dropDuplicates(["kind", "code"])
    known = F.broadcast(names.select("kind").distinct().withColumn("known", F.lit(True)))
    rows = found.join(named, ["kind", "code"], "left").join(known, "kind", "left")
    rows = rows.withColumn("name", F.coalesce("name", F.when(F.col("known"), "").otherwise(F.col("code"))))
    key = reduce(lambda held, kind: F.when(F.col("kind") == kind, order[kind](F.col("name"), F.col("code"))).otherwise(held), order, F.col("name"))
    rows = rows.withColumn("_key", key).withColumn("number", (F.dense_rank().over(Window.partitionBy("file", "kind").orderBy("_key")) - 1).cast("int"))
    return rows.select("file", "kind", "code", "name", "number")


def legend(numbered: DataFrame, prefix: str = "") -> DataFrame:
    """file, kind, number, text: a line for each number, of the least code of those that share it; prefix stands before codes of parameters."""
    least = numbered.groupBy("file", "kind", "number").agg(F.min_by("name", F.struct(F.length("code"), "code")).alias("name"), F.min(F.struct(F.length("code"), "code"))["code"].alias("code"))
    code = F.when(F.col("kind") == "P", F.concat(F.lit(prefix), "code")).otherwise(F.col("code"))
    tail = F.when(F.col("kind") == "R", F.col("name")).otherwise(F.concat_ws("<!>", code, "name"))
    return least.select("file", "kind", "number", F.concat_ws("<!>", "kind", F.col("number").cast("string"), tail).alias("text"))


def renumbered(rows: DataFrame, numbered: DataFrame, file: str, columns: dict[str, str]) -> DataFrame:
    """rows of the files in numbered, with the number of each code in columns n_<kind>, null for a code that the file does not list.

    The codes of a file travel as one map, so rows meet them by a single join whatever the number of kinds. Spark searches a map from
    its start, so codes lie in maps of a few, by a hash.
    """
    slot = lambda key: F.pmod(F.hash(key), F.lit(SLOTS))
    keyed = numbered.select(F.col("file").alias("_file"), F.concat("kind", "code").alias("_key"), "number")
    few = keyed.groupBy("_file", slot(F.col("_key")).alias("_slot")).agg(F.map_from_entries(F.collect_list(F.struct("_key", "number"))).alias("_few"))
    maps = few.groupBy("_file").agg(F.map_from_entries(F.collect_list(F.struct("_slot", "_few"))).alias("_numbers"))
    found = rows.join(maps, rows[file] == maps["_file"])

    def number(kind: str, column: str) -> Column:
        key = F.concat(F.lit(kind), F.col(column).cast("string"))
        return F.try_element_at(F.try_element_at("_numbers", slot(key)), key)

    return found.withColumns({f"n_{k}": number(k, c) for k, c in columns.items()}).drop("_file", "_numbers")


def lines(renumbered_rows: DataFrame, *columns: str) -> Column:
    """Columns joined by bars, null ones empty."""
    return F.concat_ws("|", *(F.coalesce(renumbered_rows[c].cast("string"), F.lit("")) for c in columns))
