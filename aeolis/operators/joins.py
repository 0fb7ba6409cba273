"""Joins on intervals and within tolerances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import RANGE_ROWS, above, below, blocks, bounds, place, range_count

#: Ranges at least, of about as many rows each, in which histories and marks are searched; rows ask for more.
RANGES = 1
#: Marks that are broadcast.
MARKS = 10_000


def _due_and_last(events: DataFrame, history: DataFrame, key: str, ts: str, start: str, end: str) -> DataFrame:
    """event, due, last: each event with its key's first entry that does not end before ts, and its last entry.

    Entries are ordered by start, end and the other columns. One that does not end after all before it is
    never the first, and the others end in their order, so the first is the one with the next end. Keys and
    ranges of time are sorted together, and what lies in other ranges of a key comes from one row a range,
    so no group holds more than a range's rows, however many of all rows a key has.
    """
    entry = F.struct(F.col(start), F.col(end), *(c for c in history.columns if c not in (key, start, end)))
    own = history.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), entry.alias("entry"))
    begins, ends = F.col("entry").getField(start), F.col("entry").getField(end)
    moments = events.select(F.col(ts).alias("at")).union(own.select(begins)).union(own.select(ends))
    sizes = events.select(F.col(key).alias("key"), F.lit(1).alias("n")).union(own.select("key", F.lit(2))).groupBy("key").agg(F.sum("n").alias("n"))
    total, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    # Keys that are small by themselves need no ranges.
    n = RANGES if largest <= RANGE_ROWS else range_count(total, RANGES)
    cuts = F.broadcast(bounds(moments, "at", n)) if n > 1 else None
    ranged = lambda df, at, *columns: df.select(*columns, F.lit(0).alias("range")) if n == 1 else df.join(cuts).select(*columns, place(F.col("cuts"), at).alias("range"))
    before = lambda *by: Window.partitionBy("key", *by).rowsBetween(Window.unboundedPreceding, -1)

    own = ranged(own, begins, "key", "entry")
    own = own.withColumn("own_top", F.max(ends).over(before("range").orderBy("entry")))
    passed = F.col("own_top")
    if n > 1:
        sums = own.groupBy("key", "range").agg(F.max(ends).alias("top"))
        own = own.join(sums.select("key", "range", F.max("top").over(before().orderBy("range")).alias("top")), ["key", "range"])
        passed = F.greatest("top", "own_top")
    own = own.select("key", "entry", F.when(ends.isNotNull() & (passed.isNull() | (ends > passed)), ends).alias("until"))
    own = own.select("key", F.col("until").alias("at"), "until", "entry", F.lit(None).cast(events.select(F.struct("*")).schema[0].dataType).alias("event"))
    asked = events.select(F.col(key).alias("key"), F.col(ts).alias("at"), F.lit(None).cast(own.schema["until"].dataType).alias("until"), F.lit(None).cast(own.schema["entry"].dataType).alias("entry"), F.struct("*").alias("event"))
    columns = ("key", "at", "until", "entry", "event")
    rows = ranged(own, F.col("at"), *columns).union(ranged(asked, F.col("at"), *columns))

    down = Window.partitionBy("key", "range").orderBy(F.desc("at"), F.col("event").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = F.last(F.when(F.col("until").isNotNull(), F.col("entry")), True).over(down)
    if n == 1:
        found = rows.select("event", "at", near.alias("near"), F.max("entry").over(Window.partitionBy("key", "range")).alias("last")).filter("event IS NOT NULL")
        return found.select("event", F.when(F.col("at").isNotNull(), F.col("near")).alias("due"), "last")
    sums = rows.groupBy("key", "range").agg(F.min_by("entry", "until").alias("least"), F.max("entry").alias("most"))
    sums = sums.select(
        "key", "range", F.last("least", True).over(before().orderBy(F.desc("range"))).alias("later"), F.max("most").over(Window.partitionBy("key")).alias("last")
    )
    found = rows.withColumn("near", near).filter("event IS NOT NULL").join(sums, ["key", "range"], "left")
    return found.select("event", F.when(F.col("at").isNotNull(), F.coalesce("near", "later")).alias("due"), "last")


def _with_entry(found: DataFrame, events: DataFrame, entry) -> DataFrame:
    return found.select(*(F.col("event").getField(c).alias(c) for c in events.columns if c != "entry"), entry.alias("entry"))


def history_join(events: DataFrame, history: DataFrame, key: str, ts: str, start: str, end: str) -> DataFrame:
    """Each event with the entry of its key's history that holds at ts; columns of history but key in a struct `entry`.

    That is the first that does not end before ts, which may begin after it, or else the last; null without
    a history.
    """
    return _with_entry(_due_and_last(events, history, key, ts, start, end), events, F.coalesce("due", "last"))


def tolerance_join(left: DataFrame, right: DataFrame, key: str, ts: str, hours: int = 1) -> DataFrame:
    """Pairs of rows with one key, in one month, whose hours are at most `hours` apart: columns prefixed l_ and r_.

    The left side meets the hours around its own, so this is an equi-join on key and hour.
    """
    hour = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / 3600)
    a = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns), F.explode(F.sequence(hour - hours, hour + hours)).alias("hour"))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns), hour.alias("r_hour"))
    month = lambda side: F.date_trunc("month", f"{side}_{ts}")
    return a.join(b, (F.col(f"l_{key}") == F.col(f"r_{key}")) & (F.col("hour") == F.col("r_hour")) & (month("l") == month("r"))).drop("hour", "r_hour")


def nearest_below_above(points: DataFrame, marks: DataFrame, point: str, mark: str, most: int = MARKS) -> DataFrame:
    """points with `below` and `above`, the marks next to each (a mark at the point is both); null where there is none.

    Up to `most` marks are broadcast as one sorted array in blocks. More of them are sorted together with the points,
    range by range, with the outermost marks of the ranges around; rows ask for as many ranges as they need.
    """
    distinct = marks.select(F.col(mark).alias("mark")).filter("mark IS NOT NULL").distinct()
    if distinct.limit(most + 1).count() <= most:
        held = distinct.agg(F.array_sort(F.collect_list("mark")).alias("marks")).select(blocks(F.col("marks")).alias("marks"))
        found = {"below": below(F.col("marks"), F.col(point)), "above": above(F.col("marks"), F.col(point))}
        return points.join(F.broadcast(held)).withColumns(found).drop("marks")
    rows = distinct.select(F.col("mark").alias("at"), "mark", F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType).alias("row"))
    rows = rows.unionByName(points.select(F.col(point).alias("at"), F.lit(None).cast(distinct.schema["mark"].dataType).alias("mark"), F.struct("*").alias("row")))
    cuts = bounds(rows, "at", range_count(points.count() + distinct.count(), max(RANGES, 2)))
    placed = rows.join(F.broadcast(cuts)).withColumn("range", place(F.col("cuts"), F.col("at"))).drop("cuts")
    # A row a range: the last mark before it and the first behind it.
    ends = placed.groupBy("range").agg(F.min("mark").alias("low"), F.max("mark").alias("high"))
    order = Window.orderBy("range")
    ends = ends.select("range", F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("under"), F.min("low").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("over"))
    near = Window.partitionBy("range").orderBy("at")
    found = placed.withColumns({"below": F.max("mark").over(near.rangeBetween(Window.unboundedPreceding, Window.currentRow)), "above": F.min("mark").over(near.rangeBetween(Window.currentRow, Window.unboundedFollowing))})
    known = F.col("at").isNotNull()
    found = found.filter("row IS NOT NULL").join(F.broadcast(ends), "range")
    return found.select("row.*", F.when(known, F.coalesce("below", "under")).alias("below"), F.when(known, F.coalesce("above", "over")).alias("above"))


def interval_join(events: DataFrame, history: DataFrame, key: str, ts: str, start: str, end: str) -> DataFrame:
    """As history_join, but `entry` is the first that begins at or before ts and does not end before it, else null."""
    began = F.col("due").getField(start) <= F.col("event").getField(ts)
    return _with_entry(_due_and_last(events, history.filter(F.col(start).isNotNull()), key, ts, start, end), events, F.when(began, F.col("due")))


def pair_components(fields: DataFrame, kind: str, u: str, v: str, *keys: str) -> DataFrame:
    """Fields of kind u beside those of kind v with equal keys: columns prefixed u_ and v_; fields without a partner go."""
    side = lambda name, value: fields.filter(F.col(kind) == value).drop(kind).select(*keys, *(F.col(c).alias(f"{name}_{c}") for c in fields.columns if c not in (kind, *keys)))
    return side("u", u).join(side("v", v), list(keys))
