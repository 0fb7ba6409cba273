"""Filter interaction audit: every order of the filters is replayed over the documents' flags."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import NO_ID, table

#: Filters in the order of their bits in `mask`: the first four judge a text alone, the last compares texts.
FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

ORACLE = r"""
WITH d AS (
  SELECT coalesce(source, '') AS part, coalesce(doc_id, 9223372036854775807) AS id, coalesce(text, '') AS text, coalesce(l.good, false) AS good, coalesce(l.bad, false) AS bad
  FROM documents LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY 1) l USING (doc_id)
), f AS (
  SELECT part, good, bad, concat(
    CASE WHEN len(ws) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END, CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' END,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN id > first THEN 'E' END) AS fails
  FROM (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(id) OVER (PARTITION BY text) AS first FROM d)
), g AS (
  SELECT part, good, bad, fails, count(*) AS n FROM f GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT concat(p.l, q.l, r.l, s.l, t.l) AS filter_order FROM letters p, letters q, letters r, letters s, letters t WHERE len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5
), replayed AS (
  SELECT *, (SELECT coalesce(min(k), 6) FROM range(1, 6) r(k) WHERE contains(fails, filter_order[k])) AS failed FROM g, orders
), steps AS (
  SELECT part, filter_order, step, coalesce(sum(n) FILTER (failed > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (failed = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (contains(fails, filter_order[step]) AND failed < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = filter_order[step]), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (failed = step AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (failed = step AND bad), 0)::BIGINT AS toxic_lost
  FROM replayed, (SELECT unnest(range(1, 6))::INT AS step) GROUP BY ALL
)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM steps
"""


def text_mask(text: Column) -> Column:
    """Bits of the filters that judge a text alone, which is not null."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    total = F.size(words)
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    fails = (total < 200, 100 * F.size(F.array_distinct(words)) < 50 * total, 100 * capitals.cast("long") > 2 * F.char_length(text), text.rlike(r"[#$%&*|]"))
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: the documents of each source by the filters that they fail and by their labels.

    Texts never leave their task: what is shuffled is a digest, the mask and the id of each document. Whether a smaller
    doc_id has the same text is settled by minima: equal rows are counted, then each digest, source and label keeps
    its smallest id and how many rows have it, so a text that a third of all rows share is a row a task and source.
    Null source is '', null text is empty, and a null doc_id counts as the largest; rows that repeat the smallest
    doc_id of a text are none of them copies of a smaller one. A document is good or toxic if any label of its id says so,
    and neither without one; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask"))
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    rows = rows.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")} | {"doc_id": F.coalesce("doc_id", F.lit(NO_ID))})
    same = rows.groupBy("doc_id", "part", "digest", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    least = F.min(F.struct("doc_id", "n")).alias("least")
    kinds = same.groupBy("digest", "part", "mask", "good", "toxic").agg(least, F.sum("n").alias("n"))
    kinds = kinds.withColumn("first", F.min("least.doc_id").over(Window.partitionBy("digest")))
    originals = F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    copies = 1 << FILTERS.index("E")
    pair = F.array(F.struct(F.lit(0).alias("more"), originals.alias("n")), F.struct(F.lit(copies).alias("more"), (F.col("n") - originals).alias("n")))
    return (
        kinds.select("part", "mask", "good", "toxic", F.explode(pair).alias("x")).select("part", (F.col("mask") + F.col("x.more")).alias("mask"), "good", "toxic", F.col("x.n").alias("n"))
        .groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).filter("n > 0")
    )


def orders(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """filter_order and its filters' bits: every order of the filters, of which five have 120."""
    found = F.array(*(F.struct(F.lit("".join(p)).alias("filter_order"), F.array(*(F.lit(1 << filters.index(x)) for x in p)).alias("bits")) for p in permutations(filters)))
    return spark.range(1).select(F.inline(found))


def replay(flagged: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the COUNTS, for every part, order and step, zeros included.

    flagged has part, mask, good, toxic and n, the number of documents that a row stands for. Each row meets every
    order (a table of fixed size, broadcast) and every step; the first of its filters that it fails in that order
    removes it. Counts are sums by partial aggregation, so a task sends one row a part, order and step. No rows give none.
    """
    met = flagged.join(F.broadcast(orders(flagged.sparkSession, filters)))
    fails = F.transform("bits", lambda b: F.col("mask").bitwiseAND(b) != 0)
    first = F.array_position(fails, F.lit(True))
    met = met.select("part", "mask", "good", "toxic", "n", "filter_order", F.when(first == 0, len(filters) + 1).otherwise(first).alias("failed"), F.posexplode("bits").alias("pos", "bit"))
    step, here = F.col("pos") + 1, F.col("failed") == F.col("pos") + 1
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    counts = met.groupBy("part", "filter_order", step.alias("step")).agg(
        total(F.col("failed") > step).alias("kept"), total(here).alias("removed"), total((F.col("mask").bitwiseAND(F.col("bit")) != 0) & (F.col("failed") < step)).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(here & F.col("good")).alias("good_lost"), total(here & F.col("toxic")).alias("toxic_lost"),
    )
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))).select("part", "filter_order", "step", *COUNTS)
