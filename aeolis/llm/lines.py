"""Line dedup: a sharded minimal perfect hash indexes fingerprints and counts, which documents probe."""

from __future__ import annotations

import pickle
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import U64, Rolling, blocks, lines, stripped
from ._common import cut, documents, named, table, unique_ids, with_row
from .mph import PerfectHash

MIN_DOCS = 10
#: Lines of a shard, bytes of shards that are broadcast at most, and hashes that meet a shard in one group beyond that.
SHARD_LINES, TABLE_BYTES, GROUP_HASHES = 1 << 18, 128 << 20, 1 << 20

ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), k AS (
  SELECT doc_id, i, ls[i] AS line,
    translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), often AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k.key IN (SELECT key FROM often)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (k.key NOT IN (SELECT key FROM often)), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""


def line_keys(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends, first line of each document, which lines are not white space, and two hashes of each."""
    starts, ends, first = lines(data, at)
    s, e = stripped(data, starts, ends)
    return starts, ends, first, s < e, Rolling(data, lower=True)(s, e), Rolling(data, lower=True, second=True)(s, e)


def _hashed(batches):
    """The distinct lines of each row by their two hashes."""
    for b in batches:
        for lo, hi, data, at in blocks(b["text"]):
            _, _, first, solid, one, two = line_keys(data, at)
            row = np.repeat(np.arange(lo, hi), np.diff(first))[solid]
            one, two = one[solid], two[solid]
            order = np.lexsort((two, one, row))
            row, one, two = row[order], one[order], two[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            row = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(row), b["row"].take(row), pa.array(one[new].view(np.int64)), pa.array(two[new].view(np.int64))], ["doc_id", "row", "one", "two"])


def line_counts(docs: DataFrame) -> DataFrame:
    """one, two (hashes of a line) and n, the documents that have it.

    Rows that repeat a doc_id are one document, rows without one are a document each.
    """
    alone = F.when(F.col("doc_id").isNull(), F.col("row")).otherwise(F.lit(0))
    rows = documents(with_row(docs).withColumn("row", alone), "row")
    n = F.count("*") if unique_ids(docs) else F.count_distinct("doc_id", "row")
    return rows.mapInArrow(_hashed, "doc_id long, row long, one long, two long").groupBy("one", "two").agg(n.alias("n"))


class Shard:
    """Counts of lines by perfect hash: the second hash as fingerprint and a saturated 8-bit count in each slot."""

    def __init__(self, one: np.ndarray, two: np.ndarray, counts: np.ndarray):
        order = np.argsort(one, kind="stable")
        one, two, counts = one[order], two[order], np.minimum(counts[order], 255).astype(np.uint8)
        again = np.zeros(len(one), bool)
        again[1:] = one[1:] == one[:-1]
        # Different lines with the same first hash: one has the slot, the others are listed.
        self.others = list(zip(one[again].tolist(), two[again].tolist(), counts[again].tolist()))
        one, two, counts = one[~again], two[~again], counts[~again]
        self.slots = PerfectHash(one)
        at = self.slots(one)
        self.prints, self.counts = np.zeros(len(at), U64), np.zeros(len(at), np.uint8)
        self.prints[at], self.counts[at] = two, counts

    def __call__(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Documents with each line, 255 for more; 0 for a line that is not in the table."""
        at = self.slots(one)
        known = at >= 0
        known[known] = self.prints[at[known]] == two[known]
        out = np.where(known, self.counts[np.where(known, at, 0)], 0) if len(self.counts) else np.zeros(len(one), np.uint8)
        for a, b, n in self.others:
            out[(one == U64(a)) & (two == U64(b))] = n
        return out


def _shard(group: pa.Table) -> pa.Table:
    one, two, n = (group[c].to_numpy() for c in ("one", "two", "n"))
    return pa.table({"shard": group["shard"][:1].cast(pa.int32()), "arrays": pa.array([pickle.dumps(Shard(one.view(U64), two.view(U64), n))], pa.binary())})


def shards_of(counts: DataFrame, min_docs: int) -> tuple[DataFrame, int]:
    """shard, arrays (a pickled Shard) of the lines with min_docs documents, kept in the checkpoint folder; number of shards."""
    often = cut(counts.filter(F.col("n") >= min_docs))
    n = max(1, often.count() // SHARD_LINES)
    numbered = often.withColumn("shard", F.expr(f"int(shiftrightunsigned(one, 33) % {n})"))
    return cut(numbered.groupBy("shard").applyInArrow(_shard, "shard int, arrays binary")), n


@lru_cache(maxsize=1)
def _held(key: int, broadcast) -> dict[int, Shard]:
    return {k: pickle.loads(x) for k, x in broadcast.value.items()}


def _often(shared, n: int, min_docs: int):
    """Lines with min_docs documents by the shards of a broadcast."""
    key = int(shared._jbroadcast.id())

    def often(batch: pa.RecordBatch, row: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        shard, out = (one >> U64(33)) % U64(n), np.zeros(len(one), bool)
        for k, arrays in _held(key, shared).items():
            own = np.flatnonzero(shard == U64(k))
            out[own] = arrays(one[own], two[own]) >= min_docs
        return out

    return often


def _listed(batch: pa.RecordBatch, row: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Lines that the row itself lists, by their hashes in _one and _two."""
    lists = [batch[c].slice(row[0], row[-1] + 1 - row[0]) for c in ("_one", "_two")]
    sizes = np.diff(np.concatenate([[0], np.cumsum(lists[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]))
    fields = [("row", np.int64), ("one", np.int64), ("two", np.int64)]
    wanted, mine = np.empty(int(sizes.sum()), fields), np.empty(len(row), fields)
    wanted["row"], wanted["one"], wanted["two"] = np.repeat(np.arange(row[0], row[-1] + 1), sizes), *(x.flatten().to_numpy() for x in lists)
    mine["row"], mine["one"], mine["two"] = row, one.view(np.int64), two.view(np.int64)
    return np.isin(mine, wanted)


def _drop(often):
    """Texts without the lines that `often` tells from a batch, the rows of lines in it and their hashes."""

    def run(batches):
        for b in batches:
            for lo, hi, data, at in blocks(b["text"]):
                starts, ends, first, solid, one, two = line_keys(data, at)
                gone = often(b, np.repeat(np.arange(lo, hi), np.diff(first)), one, two) & solid
                per, raw, texts = np.add.reduceat(gone, first[:-1], dtype=np.int64), data.tobytes(), []
                for i, k in enumerate(per):
                    if k:
                        keep = np.flatnonzero(~gone[first[i] : first[i + 1]]) + first[i]
                        texts.append(b"\n".join([raw[s:e] for s, e in zip(starts[keep], ends[keep])]))
                    else:
                        texts.append(raw[at[i] : at[i + 1]])
                same = {c: b[c].slice(lo, hi - lo) for c in b.schema.names if c not in ("text", "_row", "_one", "_two")}
                yield pa.RecordBatch.from_pydict(same | {
                    "text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(np.diff(first), pa.int64()), "n_dropped": pa.array(per, pa.int64()),
                    "kept_sha256": pa.array([sha256(t).hexdigest() for t in texts], pa.string()),
                })

    return run


def _probed(min_docs: int):
    def run(hashes: pa.Table, arrays: pa.Table) -> pa.Table:
        found = np.zeros(len(hashes), bool)
        if len(arrays):
            one, two = (hashes[c].to_numpy().view(U64) for c in ("one", "two"))
            found = pickle.loads(arrays["arrays"][0].as_py())(one, two) >= min_docs
        return hashes.select(["row", "one", "two"]).filter(pa.array(found))

    return run


def listed_lines(rows: DataFrame, arrays: DataFrame, n: int, min_docs: int) -> DataFrame:
    """_row, _one, _two (arrays of hashes): the lines of rows (_row, doc_id, text) that have min_docs documents; rows without any are left out.

    Hashes meet the arrays of their shard by shuffle, in groups of about GROUP_HASHES, so a shard whose lines are in many documents is
    met in many tasks, each with a copy of its arrays. A list holds the distinct lines of one row.
    """
    hashes = rows.select("doc_id", F.col("_row").alias("row"), "text").mapInArrow(_hashed, "doc_id long, row long, one long, two long").drop("doc_id")
    hashes = hashes.withColumn("shard", F.expr(f"int(shiftrightunsigned(one, 33) % {n})"))
    sizes = cut(hashes.groupBy("shard").agg(F.ceil(F.count("*") / GROUP_HASHES).cast("int").alias("parts")))
    hashes = hashes.join(F.broadcast(sizes), "shard").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    copies = arrays.join(F.broadcast(sizes), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found = hashes.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(_probed(min_docs), "row long, one long, two long")
    lists = found.groupBy("row").agg(F.collect_list(F.struct("one", "two")).alias("gone"))
    return lists.select(F.col("row").alias("_row"), F.col("gone.one").alias("_one"), F.col("gone.two").alias("_two"))


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, carry: tuple[str, ...] = (), table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, the columns of carry, text without the lines that min_docs documents have, n_lines, n_dropped, kept_sha256.

    A line is compared without white space at its ends and with A-Z lowered, by two 64-bit hashes; lines of
    white space stay. Only hashes are shuffled, to count the documents of each line; a perfect hash of the
    first hash of the lines with min_docs documents indexes arrays of second hashes and counts, and the texts are
    filtered where they are by probing these, if they take table_bytes at most and so may be broadcast. Beyond
    that hashes are sent to the shards, and texts are shuffled once, to meet the lines that each is to lose,
    however many shards there are. Null or empty text is one empty line; rows that repeat a doc_id are
    all filtered and count as one document, rows with a null one as a document each; an empty table gives no rows.
    """
    if docs.schema["text"].dataType.typeName() != "string" or min_docs > 255:
        raise ValueError("text must be a string column and min_docs at most 255")
    if clash := {"text", "n_lines", "n_dropped", "kept_sha256", "_row", "_one", "_two"} & set(carry):
        raise ValueError(f"columns that cannot be carried: {sorted(clash)}")
    arrays, n = shards_of(line_counts(docs), min_docs)
    size = arrays.agg(F.sum(F.octet_length("arrays").cast("long"))).first()[0] or 0
    out = documents(docs, *carry)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.select("doc_id", *carry).schema)
    if size <= table_bytes:
        held = {r["shard"]: bytes(r["arrays"]) for r in arrays.collect()}
        often = _often(docs.sparkSession.sparkContext.broadcast(held), n, min_docs)
    else:
        rows = out.withColumn("_row", F.col("doc_id")) if unique_ids(docs) else cut(with_row(out, "_row"))
        out, often = rows.join(listed_lines(rows, arrays, n, min_docs), "_row", "left"), _listed
    return named(out.mapInArrow(_drop(often), f"{kept}, text string, n_lines long, n_dropped long, kept_sha256 string"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_common_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
