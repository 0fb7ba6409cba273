"""A corpus pipeline of five operators; every stage's result is written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolis.llm import langid, lines, mixing, near, packing
from aeolis.llm._common import cut, table, unique_ids, with_row

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Byte contexts and the tokenizer have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those that are null or have no letter go."""
    return langid.identify(docs, carry=("lang", "source", "n_chars")).filter(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents have; n_chars follows the text."""
    kept = lines.drop_common_lines(docs, carry=("lang", "source"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def placed(docs: DataFrame) -> DataFrame:
    """docs with a number of each row in `place`: doc_id where each row has its own, else one that is kept with a copy of the rows."""
    docs = docs.select(*COLUMNS)
    return docs.withColumn("place", F.col("doc_id")) if unique_ids(docs) else cut(with_row(docs, "place"))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id (null last), of these the first in the table."""
    rows = placed(docs)
    linked = near.link_near(rows, carry=("place",)).select("doc_id", "place", "class")
    first = linked.filter("class IS NOT NULL").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "place"))["place"].alias("place"))
    kept = first.select("place").union(linked.filter("class IS NULL").select("place"))
    return rows.join(kept, "place", "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = placed(docs)
    copies = mixing.mix_sources(rows, row="place").filter("copies > 0").select(F.col("row").alias("place"), "copies")
    taken = rows.join(copies, "place")
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return packing.digest(packing.pack(docs))


STAGES = [("language", identify_language), ("lines", drop_lines), ("near", drop_near), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
