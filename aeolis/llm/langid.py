"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import LOWER, blocks
from ._common import documents, table

#: Bounds of the training sample: about so many documents of each language, whole texts, and so many bytes of them.
DOCS_PER_LANG, BYTES_PER_LANG = 600, 16 << 20
UNKNOWN = "und"


def held_out() -> Column:
    """A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each byte, A-Z lowered: itself in the lowest byte, the three before it above; zeros before a document."""
    low = LOWER[data].astype(np.uint32)
    out = low.copy()
    for back in (1, 2, 3):
        before = np.zeros_like(low)
        before[back:] = low[:-back]
        for k in range(back):
            first = at[:-1] + k
            before[first[first < at[1:]]] = 0
        out |= before << np.uint32(8 * back)
    return out


def _count(batches):
    for b in batches:
        found: dict[str, list] = {}
        langs = b["lang"].to_pylist()
        for lo, hi, data, at in blocks(b["text"]):
            grams = _grams(data, at)
            for i in range(lo, hi):
                found.setdefault(langs[i], []).append(grams[at[i - lo] : at[i - lo + 1]])
        for lang, g in found.items():
            keys, counts = np.unique(np.concatenate(g), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": [lang], "keys": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([counts.astype(np.uint32).tobytes()], pa.binary())})


def learn(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Counts of four-byte strings by language, over a hash sample of documents that are not held out.

    The sample is drawn by doc_id and text, rows alike in both being one, so it spreads over rows without a doc_id
    too. It is bounded by docs_per_lang whole documents and BYTES_PER_LANG bytes a language (in expectation),
    and holds one document of each language at least, so what reaches the driver is bounded too.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    known = documents(known, "lang").withColumn("u", F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min("u").alias("least")).collect()
    if not sizes:
        return {}
    share = {r["lang"]: max(r["least"], min(1.0, docs_per_lang / r["n"], BYTES_PER_LANG / max(1, r["bytes"]))) for r in sizes}
    sample = known.filter(F.col("u") <= F.element_at(F.create_map(*(F.lit(x) for pair in share.items() for x in pair)), F.col("lang")))
    sample = sample.select("lang", "doc_id", "text").distinct()
    parts: dict[str, list] = {}
    for r in sample.mapInArrow(_count, "lang string, keys binary, counts binary").toLocalIterator():
        parts.setdefault(r["lang"], []).append((np.frombuffer(r["keys"], np.uint32), np.frombuffer(r["counts"], np.uint32)))
        if len(parts[r["lang"]]) >= 16:
            parts[r["lang"]] = [_merged(parts[r["lang"]])]
    return {lang: _merged(p) for lang, p in sorted(parts.items())}


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([c for _, c in parts]), len(keys)).astype(np.uint32)


class Model:
    """Exact code lengths in bits under frozen context trees of order 3, one a language.

    In a context with total count T and D different next bytes, a byte counted n times costs
    log2((T + D) / n) bits; any other costs the escape, log2((T + D) / D), and what it costs in the
    context one byte shorter. Below the empty context a byte costs 8 bits. The trees are laid out as one
    row for each context of three bytes that any language has, and one for each pair of bytes for
    the rest.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = list(counts)
        keys = [k for k, _ in counts.values()]
        used = np.unique(np.concatenate([np.zeros(1, np.uint32), *(k >> np.uint32(s) & np.uint32(255) for k in keys for s in (0, 8, 16, 24))]))
        a = self.size = len(used) + 1  # the last symbol stands for all other bytes
        self.symbol = np.full(256, a - 1, np.int32)
        self.symbol[used] = np.arange(len(used))
        coded = [self.code(k, 4) for k in keys]
        contexts = np.unique(np.concatenate([c // a for c in coded]))
        self.row = np.tile(np.arange(a * a, dtype=np.int32), a)
        self.row[contexts] = a * a + np.arange(len(contexts))
        self.bits = np.empty((a * a + len(contexts), a, len(keys)), np.float32)
        for i, (c, (_, n)) in enumerate(zip(coded, counts.values())):
            table = np.full((1, a), 8.0)
            for order in range(3):
                table = self._tree(table[np.tile(np.arange(len(table)), a if order else 1)], *self._suffixes(c, n, order))
            self.bits[: a * a, :, i] = table
            local = np.searchsorted(contexts, c // a) * a + c % a
            self.bits[a * a :, :, i] = self._tree(table[contexts % (a * a)], local, n)

    def code(self, grams: np.ndarray, length: int) -> np.ndarray:
        out = np.zeros(len(grams), np.int64)
        for back in range(length - 1, -1, -1):
            out = out * self.size + self.symbol[grams >> np.uint32(8 * back) & np.uint32(255)]
        return out

    def _suffixes(self, coded: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(coded % self.size ** (order + 1), return_inverse=True)
        return keys, np.bincount(where, n, len(keys))

    def _tree(self, shorter: np.ndarray, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        """shorter: costs in each context less its first byte; keys: context * size + byte."""
        context = keys // self.size
        total, distinct = np.bincount(context, n, len(shorter)), np.bincount(context, minlength=len(shorter))
        seen = total > 0
        out = shorter.copy()
        out[seen] += np.log2((total[seen] + distinct[seen]) / distinct[seen])[:, None]
        out[context, keys % self.size] = np.log2((total + distinct)[context] / n)
        return out

    def lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of each document by language."""
        grams = _grams(data, at)
        out = np.zeros((len(at) - 1, len(self.langs)))
        sums = np.zeros((len(data) + 1, len(self.langs)))
        cost = self.bits[self.row[self.code(grams >> np.uint32(8), 3)], self.symbol[grams & np.uint32(255)]]
        np.cumsum(cost, axis=0, dtype=np.float64, out=sums[1:])
        out[:] = sums[at[1:]] - sums[at[:-1]]
        return out


@lru_cache(maxsize=1)
def _model(broadcast_id: int, broadcast) -> Model:
    return Model(broadcast.value)


def identify(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns of carry, text, held_out, lang_pred, score: one row a row of docs.

    Learns from lang and text of rows that are not held out; the prediction sees the text alone. score is
    the winner's share of the languages' likelihoods. A null doc_id is not held out. A text that is null or has no letter, or any text if
    nothing could be learned, gets und and 0; ties go to the first language by code point; repeated rows
    are scored each; texts of any length are scored whole; an empty table gives no rows.
    """
    spark = docs.sparkSession
    counts = learn(docs, docs_per_lang)
    shared = spark.sparkContext.broadcast(counts)
    key = int(shared._jbroadcast.id())

    def run(batches):
        model = _model(key, shared) if shared.value else None
        for b in batches:
            letters = b["letters"].to_numpy(zero_copy_only=False).astype(bool)
            pred, score = np.full(len(b), UNKNOWN, object), np.zeros(len(b))
            for lo, hi, data, at in blocks(b["text"], 1 << 18) if model else ():
                bits = model.lengths(data, at)
                best = bits.argmin(1)
                with np.errstate(over="ignore"):
                    share = 1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1)
                pred[lo:hi], score[lo:hi] = np.array(model.langs, object)[best], share
            pred[~letters], score[~letters] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_pydict({c: b[c] for c in b.schema.names if c != "letters"} | {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry, held_out().alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("letters").schema)
    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")
