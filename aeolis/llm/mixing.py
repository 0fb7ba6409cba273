"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import cut, documents, named, shuffle_partitions, table, with_row

WORD = r"[^\x20\x09-\x0D]+"
#: A source repeats its documents at most so often.
MOST = 3
#: Ranges that virtual finish times are dealt into, and copies of one range that are sorted in one task.
RANGES, SORTED = 1 << 14, 1 << 20


def numbered(sources: DataFrame) -> DataFrame:
    """sources with `rank`, from 0 by code point of source, null last: ranges are sorted apart and offset by those before."""
    placed = sources.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id())
    placed = cut(placed)
    # One row a partition of the sort.
    sizes = placed.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(before), "part").select(*sources.columns, rank.alias("rank"))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, target of source and source_size rows, one a source; null is a source of its own.

    All sources weigh weights[0], weights[1], ... in turn and get a share of all sizes by weight, but MOST times their own size
    at most. Each round takes those above that out and raises the level of the rest, by sums alone, so there
    may be any number of sources; a source of size 0 has target 0, and no sources give no rows.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    caps = cut(numbered(sources).select("source", "source_size", weight.alias("weight"), (MOST * F.col("source_size")).cast("double").alias("cap")))
    total = float(caps.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") < level * F.col("weight")
        r = caps.agg(F.sum(F.when(over, F.col("cap"))).alias("fixed"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free"), F.count(F.when(over, 1)).alias("n")).first()
        if r["n"] == capped or not r["free"]:
            break
        level, capped = (total - (r["fixed"] or 0.0)) / r["free"], r["n"]
    return caps.select("source", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, seed: int = 0, row: str | None = None) -> DataFrame:
    """row, doc_id, size, source, source_size, target, copies, taken: one row a row of docs.

    row is the column of that name, which differs in every row, or else with_row(docs). Every source is shuffled by a hash of seed, doc_id and text and
    repeated up to MOST times; a copy's virtual
    finish time is its source's cumulative tokens over the source's target. Copies in the order of finish
    times are taken until the budget, all tokens, is reached: the first that would exceed it and all after it
    go. Equal finish times are ordered by the hash, doc_id and source. Running sums go through hash ranges of a
    source, so a source of any share is summed by many tasks. Null text has size 0 and is never taken;
    null is a source of its own; of rows with equal or null doc_id each counts; an empty table gives no rows.
    """
    spark = docs.sparkSession
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text")), F.lit(1 << 40)).alias("u")
    rows = with_row(docs) if row is None else docs.withColumn("row", F.col(row))
    sized = documents(rows, "row", "source").select("row", "doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), u)
    # Only ids and sizes from here on; texts are read once.
    sized = cut(sized)
    n = sized.count()
    parts = max(64, 4 * shuffle_partitions(spark), n // 4096)
    sized = sized.withColumn("part", F.floor(F.col("u") / F.lit((1 << 40) / parts)).cast("long"))
    by_part = cut(sized.groupBy("source", "part").agg(F.sum("size").alias("part_size")))
    sources = by_part.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    targets = source_targets(sources)
    w = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("part_size").over(w), F.lit(0)).alias("before"))
    offsets = offsets.join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    within = Window.partitionBy("source", "part").orderBy("u", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    summed = sized.withColumn("run", F.sum("size").over(within))
    timed = summed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    finish = lambda copy: (copy * F.col("source_size") + F.col("before") + F.col("run")) / F.col("target")
    times = F.when((F.col("size") > 0) & (F.col("target") > 0), F.filter(F.transform(F.array(*map(F.lit, range(MOST))), finish), lambda v: v < 2)).otherwise(F.array().cast("array<double>"))
    timed = cut(timed.select("row", "doc_id", "source", "size", "source_size", "target", "u", times.alias("times")))
    before = end_of_budget(timed.select("size", *ORDER[1:], F.explode("times").alias("v")), sources.agg(F.sum("source_size")).first()[0] or 0)
    taken = F.size(F.filter("times", before)).cast("long")
    return named(timed.withColumn("copies", taken).withColumn("taken", F.col("copies") * F.col("size")).drop("times", "u"))


#: What orders copies: finish time, then the shuffle's hash, doc_id, source and row.
ORDER = ("v", "u", "doc_id", "source", "row")


def end_of_budget(copies: DataFrame, budget: int):
    """Whether a finish time comes before the first copy that exceeds the budget, as a function of it and the row's columns.

    Range sort: the tokens of ranges of finish times are summed, the range where the budget ends is dealt into ranges
    in turn until it is small, and its copies are put in order.
    """
    lo, width, before = 0.0, 2.0, 0
    while True:
        upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
        inside = copies.filter((F.col("v") >= lo) & (F.col("v") < lo + width))
        ranges = inside.groupBy(F.floor((F.col("v") - lo) * (RANGES / width)).alias("range")).agg(F.sum("size").alias("tokens"), F.count("*").alias("n"))
        # At most RANGES rows.
        last = ranges.withColumn("upto", F.sum("tokens").over(upto) + before).filter(F.col("upto") > budget).orderBy("range").first()
        if last is None:
            return lambda v: F.lit(True)
        lo, width, before = lo + last["range"] * (width / RANGES), width / RANGES, last["upto"] - last["tokens"]
        if last["n"] <= SORTED or width < 1e-12:
            break
    # Bounds are multiples of powers of two, so nothing is rounded.
    near = copies.filter((F.col("v") >= lo) & (F.col("v") < lo + width))
    key = [F.col(c).asc_nulls_last() for c in ORDER]
    order = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
    end = near.withColumn("upto", F.sum("size").over(order) + before).filter(F.col("upto") > budget).orderBy(*key).first()

    def comes_before(v):
        tie, equal = F.lit(False), v == F.lit(end["v"])
        for c in ORDER[1:]:
            own, bound = F.col(c), F.lit(end[c])
            less = F.coalesce(own < bound, own.isNotNull() & bound.isNull())
            tie, equal = tie | (equal & less), equal & own.eqNullSafe(bound)
        return (v < F.lit(end["v"])) | tie

    return comes_before


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.col("target").cast("double"), "taken", "source", "copies")
