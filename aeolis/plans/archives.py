"""Queries of framed archives: rows of the supplied tables written to a few files, which many tasks read by byte ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import framed, sinks
from .queries import query, read

FILES = 4
#: Bytes of a range at least: small, so that files of the supplied tables are split; ranges of all files, about, up to where each has the most bytes of one.
RANGE, RANGES, MOST = 1 << 15, 1 << 6, 1 << 24


def _round_trip(spark, rows, kind: str, most: int = 0):
    """rows (file, at, record) in files and back: file, rec_no and the reader's other columns."""
    folder = framed.shared_folder(spark)
    framed.write_framed(rows, folder, kind, "file", "at", most=most).collect()
    found = framed.framed_records(spark, folder, kind, min(max(RANGE, sum(size for _, size in framed.files_of(folder)) // RANGES), MOST))
    return found.withColumn("file", F.substring_index("path", "/", -1)).drop("path")


def _orders(spark, sf_dir):
    record = F.encode(F.concat_ws("|", "o_orderkey", "o_orderstatus", "o_orderpriority", F.repeat("o_orderstatus", (F.col("o_orderkey") % 50).cast("int"))), "utf-8")
    return read(spark, sf_dir, "orders").select((F.col("o_orderkey") % FILES).cast("string").alias("file"), F.col("o_orderkey").alias("at"), record.alias("record"))


_TEXT = "concat_ws('|', o_orderkey, o_orderstatus, o_orderpriority, repeat(o_orderstatus, (o_orderkey % 50)::INT))"
_RECORDS = f"SELECT (o_orderkey % {FILES})::VARCHAR AS file, row_number() OVER (PARTITION BY o_orderkey % {FILES} ORDER BY o_orderkey) - 1 AS rec_no, {_TEXT} AS record, length({_TEXT}) AS size FROM orders"


def _texts(found):
    return found.select("file", "rec_no", F.col("record").cast("string").alias("record"), "size")


@query(
    f"SELECT *, (sum(size + 8) OVER (PARTITION BY file ORDER BY rec_no ROWS UNBOUNDED PRECEDING) - size - 8)::BIGINT AS \"offset\" FROM ({_RECORDS})"
)
def fortran_archive(spark, sf_dir):
    """Records between two lengths, with the places where they begin."""
    found = _round_trip(spark, _orders(spark, sf_dir), "f77")
    return found.select("file", "rec_no", F.col("record").cast("string").alias("record"), "size", "offset")


@query(_RECORDS)
def spanned_archive(spark, sf_dir):
    """Records in segments of up to 20 bytes, a block each."""
    return _texts(_round_trip(spark, _orders(spark, sf_dir), "vbs", 20))


@query(_RECORDS)
def control_word_archive(spark, sf_dir):
    """Records of 64-bit words in blocks of 4096 bytes with control words."""
    return _texts(_round_trip(spark, _orders(spark, sf_dir), "cos"))


@query(
    f"SELECT file, rec_no, edition, centre, code, size FROM (SELECT (event_id % {FILES})::VARCHAR AS file, row_number() OVER (PARTITION BY event_id % {FILES} ORDER BY event_id) - 1 AS rec_no, 3 + (event_id % 2)::INT AS edition, (event_id % 100)::INT AS centre, "
    "(event_id % 200)::INT AS code, CASE WHEN event_id % 2 = 0 THEN 30 ELSE 34 END + length(event_type) AS size FROM events) WHERE code < 20 AND edition = 4"
)
def message_archive(spark, sf_dir):
    """Messages of editions 3 and 4; the filter on their heads reaches the reader where pushdown is on."""
    k = F.col("event_id")
    b = lambda x, width=1: sinks.number_bytes(x if not isinstance(x, int) else F.lit(x), width)
    zeros = lambda n: F.unhex(F.lit("00" * n))
    three = F.concat(b(18, 3), zeros(2), b(k % 100), zeros(2), b(k % 200), zeros(9))
    four = F.concat(b(22, 3), zeros(1), b(k % 100, 2), zeros(4), b(k % 200), zeros(11))
    body = F.concat(F.when(k % 2 == 0, three).otherwise(four), F.encode("event_type", "utf-8"), F.lit(b"7777"))
    message = F.concat(F.lit(b"BUFR"), b(F.length(body) + 8, 3), b(3 + k % 2), body)
    rows = read(spark, sf_dir, "events").select((k % FILES).cast("string").alias("file"), k.alias("at"), message.alias("record"))
    return _round_trip(spark, rows, "bufr").filter("code < 20 AND edition = 4").select("file", "rec_no", "edition", "centre", "code", "size")
