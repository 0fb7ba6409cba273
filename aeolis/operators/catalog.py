"""Inventories and dataset descriptions: sort orders, code numbers, citations and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .ranges import blocks, place, range_count


def level_order(level_type: Column, value: Column) -> list[Column]:
    """Sort keys: by type, pressures and sigma levels from the ground up, that is descending, others ascending."""
    return [level_type, F.when(level_type.isin("pressure", "sigma", "isobaric"), -value).otherwise(value)]


def resolution_order(definition: Column) -> list[Column]:
    """Sort keys of grid names: those in degrees first and by number, then the rest by name without case."""
    degrees = F.regexp_extract(definition, r"^([0-9.]+)\s*(?:°|deg)", 1).try_cast("double")
    return [degrees.isNull(), degrees, F.lower(definition)]


#: Ranges at least of values that are numbered apart, and values drawn for the bounds of each.
RANGES, DRAWN = 8, 32


def numbered(df: DataFrame, column: str, code: str) -> DataFrame:
    """Adds the place, from 0, of a row's value among the distinct values in order, null first.

    Distinct values are dealt into ranges, as many as they need, by bounds from a sample with the smallest hashes,
    numbered within each, and offset by the sizes of the ranges before.
    """
    value = F.col("__value")
    values = df.select(F.col(column).alias("__value")).distinct()
    n = range_count(values.count(), RANGES)
    drawn = sorted(r[0] for r in values.filter(value.isNotNull()).orderBy(F.xxhash64(value), value).limit(DRAWN * n).collect())
    bounds = sorted({drawn[len(drawn) * i // n] for i in range(1, n)}) if drawn else []
    held = df.sparkSession.createDataFrame([(bounds,)], StructType([StructField("__cuts", ArrayType(df.schema[column].dataType))])).select(blocks(F.col("__cuts")).alias("__cuts"))
    placed = values.join(F.broadcast(held)).select("__value", F.when(value.isNull(), -1).otherwise(place(F.col("__cuts"), value)).alias("__range"))
    # A row a range.
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = placed.groupBy("__range").agg(F.count("*").alias("n")).select("__range", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(value)) - 1
    codes = placed.withColumn("__within", within).join(F.broadcast(sizes), "__range").select("__value", (F.col("__before") + F.col("__within")).cast("int").alias(code))
    return df.join(codes, F.col(column).eqNullSafe(value), "left").drop("__value")


def authors_text(authors: Column, most: int = 10) -> Column:
    """Of an array of struct(last, first): Last, F., F. Last, and F. Last; `et al.` after too many."""
    initial = lambda a: F.concat(F.substring(a["first"], 1, 1), F.lit("."))
    named = F.transform(authors, lambda a, i: F.when(i == 0, F.concat_ws(", ", a["last"], initial(a))).otherwise(F.concat_ws(" ", initial(a), a["last"])))
    n = F.size(authors)
    joined = F.when(n == 1, F.element_at(named, 1)).otherwise(F.concat(F.array_join(F.slice(named, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(named, -1)))
    return F.when(n > most, F.concat(F.element_at(named, 1), F.lit(" et al."))).otherwise(joined)


def citation(authors: Column, year: Column, title: Column, publisher: Column, doi: Column) -> Column:
    """Authors (year). Title. Publisher. https://doi.org/..."""
    return F.concat(authors_text(authors), F.lit(" ("), year.cast("string"), F.lit("). "), title, F.lit(". "), publisher, F.lit(". https://doi.org/"), doi)


def bibtex(key: Column, authors: Column, year: Column, title: Column, publisher: Column, doi: Column) -> Column:
    names = F.array_join(F.transform(authors, lambda a: F.concat_ws(", ", a["last"], a["first"])), " and ")
    fields = (("author", names), ("title", title), ("publisher", publisher), ("year", year.cast("string")), ("doi", doi))
    return F.concat(F.lit("@misc{"), key, *(F.concat(F.lit(f",\n  {k} = {{"), v, F.lit("}")) for k, v in fields), F.lit("\n}"))


def _escaped(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def dublin_core(fields: dict[str, Column]) -> Column:
    """An OAI Dublin Core document; columns that are arrays give an element each, null ones none."""
    parts = [F.lit('<oai_dc:dc xmlns:oai_dc="http://www.openarchives.org/OAI/2.0/oai_dc/" xmlns:dc="http://purl.org/dc/elements/1.1/">')]
    for name, values in fields.items():
        many = F.filter(F.array(values) if not name.endswith("[]") else values, lambda x: x.isNotNull())
        tag = name.removesuffix("[]")
        parts.append(F.coalesce(F.array_join(F.transform(many, lambda x: F.concat(F.lit(f"<dc:{tag}>"), _escaped(x.cast("string")), F.lit(f"</dc:{tag}>"))), ""), F.lit("")))  # noqa: B023
    return F.concat(*parts, F.lit("</oai_dc:dc>"))


def json_ld(fields: dict[str, Column]) -> Column:
    """A schema.org Dataset."""
    return F.to_json(F.struct(F.lit("https://schema.org/").alias("@context"), F.lit("Dataset").alias("@type"), *(v.alias(k) for k, v in fields.items())))
