"""Word index, synonyms and spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_word, phonetic, stem, words


def word_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, location, word, stem, sound: each word that is left when cleaned, numbered from 0 in its text."""
    found = docs.select(key, F.posexplode(words(F.coalesce(F.col(text), F.lit("")))).alias("location", "raw"))
    return found.withColumn("word", clean_word(F.col("raw"))).filter("word IS NOT NULL").select(key, "location", "word", stem(F.col("word")).alias("stem"), phonetic(F.col("word")).alias("sound"))


def word_totals(docs: DataFrame, text: str) -> DataFrame:
    """word, n, docs, first: how often each cleaned word comes, in how many texts, and its first place in any.

    A text is one row, so its distinct words are told there; what is exchanged is a row for each word and task.
    """
    cleaned = F.transform(words(F.coalesce(F.col(text), F.lit(""))), clean_word)
    rows = docs.select(cleaned.alias("all"))
    there = lambda a: F.filter(a, lambda w: w.isNotNull())
    each = F.transform("all", lambda w, i: F.struct(w.alias("word"), F.lit(1).alias("n"), F.lit(0).alias("docs"), i.alias("first")))
    once = F.transform(F.array_distinct(there(F.col("all"))), lambda w: F.struct(w.alias("word"), F.lit(0).alias("n"), F.lit(1).alias("docs"), F.lit(None).cast("int").alias("first")))
    found = rows.select(F.inline(F.concat(each, once))).filter("word IS NOT NULL")
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.min("first").alias("first"))


def unknown_words(index: DataFrame, known: DataFrame) -> DataFrame:
    """word, n: words of letters that the list `known` (word) lacks, with how often they come."""
    counted = index.filter(F.col("word").rlike("^[a-z]+$")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(known.select("word").distinct(), "word", "left_anti")


def synonyms(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """word, other: pairs in both directions, each once."""
    return pairs.select(F.col(a).alias("word"), F.col(b).alias("other")).union(pairs.select(b, a)).distinct()
