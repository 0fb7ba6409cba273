"""What the corpus operators share: reading tables, sizing, and cutting lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one group of documents should hold when documents are dealt out by group.
CHUNK_BYTES = 4 << 20
#: Stands for a null doc_id inside the operators: rows without one are like rows that repeat the largest id.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id (null: NO_ID) and text (null: empty) and any further columns named; other columns are left unread."""
    return df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def named(df: DataFrame, *columns: str) -> DataFrame:
    """df with NO_ID as null again in doc_id and the columns given."""
    return df.withColumns({c: F.nullif(c, F.lit(NO_ID)) for c in ("doc_id", *columns)})


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; costs no job. 0 if it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else 0


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, by one scan."""
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def chunk_count(df: DataFrame, size: int) -> int:
    """Groups of about CHUNK_BYTES of `size` bytes of text, at least eight a shuffle partition so that hashing spreads them evenly."""
    return max(8 * shuffle_partitions(df.sparkSession), size // CHUNK_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """URI of the checkpoint folder, which must be set on a cluster; a local session may go without."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all hosts share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="aeolis-checkpoints-"))
    return re.sub("^file:/(?!/)", "file:///", context._jsc.sc().getCheckpointDir().get())


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in spark.checkpoint.dir, which must be set on a cluster; a local session may go without."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def with_row(docs: DataFrame, name: str = "row") -> DataFrame:
    """docs with a number for each row. It is the same in two plans only where docs is read from files or a checkpoint, so cut the rows that are to be met again."""
    return docs.withColumn(name, F.monotonically_increasing_id())


def looked_up(rows: DataFrame, key: str, by: str, found: DataFrame, at: str, how: str = "left", salts: int = 8) -> DataFrame:
    """rows with the columns of found where key equals at, of which found has each value once at most.

    Many rows may have one key: they are spread by a hash of their column `by`, and found comes in as many copies.
    """
    copies = found.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return spread.join(copies, (spread[key] == copies[at]) & (spread["_salt"] == copies["_copy"]), how).drop("_salt", "_copy")


def unique_ids(docs: DataFrame) -> bool:
    """Whether each row has a doc_id of its own."""
    ids = docs.select("doc_id")
    return ids.filter("doc_id IS NULL").isEmpty() and ids.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def ordered(docs: DataFrame, *more: str) -> DataFrame:
    """documents() with `at`, which differs in every row and orders rows by doc_id, null last.

    It is doc_id itself where no row lacks or repeats one, which a count of ids tells. Else rows are numbered
    in the order of doc_id and, within one, of the table, by a range sort of ids, and a numbered copy of the
    table is kept in the checkpoint folder.
    """
    n = shuffle_partitions(docs.sparkSession)
    if unique_ids(docs):
        return documents(docs, *more).withColumn("at", F.col("doc_id"))
    rows = cut(with_row(documents(docs, *more), "_row"))
    places = rows.select("doc_id", F.col("_row").alias("_r")).repartitionByRange(n, "doc_id", "_r").sortWithinPartitions("doc_id", "_r")
    places = cut(with_row(places.select("_r"), "at"))
    return rows.join(places, F.col("_row") == F.col("_r")).drop("_row", "_r")
