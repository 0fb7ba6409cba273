"""Document fingerprints by SpotSigs: chains of content words after common-word anchors."""

from __future__ import annotations

import math
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bytes import BASE, U64, Rolling, blocks, mix
from ._common import documents, named, ordered, shuffle_partitions, table, text_bytes

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his in is it its not of on or that the their this to was were will with "
    "au aux avec ce ces dans de des du elle en est et il je la le les leur mais ne nous ou par pas pour que qui sa se ses son sur un une vous "
    "als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im ist mit nicht sich sie sind und von vor werden wie zu zum zur "
    "al como con del el ella entre era esta este fue ha la las lo los más me no para pero por que se sin su sus una y"
).split()
#: Content words of a chain.
CHAIN = 2
#: Every run of so many words has an anchor: its common words, or else its word with the smallest hash.
RUN = 3
#: Stands for each content word that the end of the text leaves out of a chain.
END = U64(0x5851F42D4C957F2D)
#: Text bytes of a range of documents in order and of a task, ranges at most (they widen beyond), ids sampled for the bounds of a range, and characters worked on at a time.
RANGE_BYTES, PART_BYTES, MOST_RANGES, SAMPLES, BLOCK_CHARS = 16 << 20, 64 << 20, 1 << 16, 16, 1 << 20

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return Rolling(data, lower=True)(np.concatenate([[0], ends[:-1]]), ends)


ANCHOR_HASHES = np.unique(_hash_words(ANCHORS))


def _anchors(hashes: np.ndarray, common: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The common words, and words with the smallest hash of a run of RUN words (or a whole shorter text) without one.

    So a word is an anchor by its nearest RUN - 1 words on either side, whatever the length of the text.
    """
    low = np.where(common, U64(0), hashes)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    spread = np.ones(len(low), np.int64)  # words around this one, with it, that are not smaller
    ahead, behind = np.ones(len(low), bool), np.ones(len(low), bool)
    for k in range(1, RUN):
        one = doc[k:] == doc[:-k]
        ahead[:-k] &= one & (low[k:] >= low[:-k])
        behind[k:] &= one & (low[:-k] >= low[k:])
        ahead[len(low) - k :] = behind[:k] = False
        spread += ahead.astype(np.int64) + behind
    return common | (spread >= np.minimum(RUN, n)[doc])


def spot_signatures(column: pa.Array) -> list[np.ndarray]:
    """Of each text the sorted distinct 32-bit hashes of (anchor, the CHAIN content words after it).

    Words are runs of letters and digits with A-Z lowered, content words those that are not common. Anchors
    are chosen in each run of RUN words by one rule, and a chain at the end of a text counts the end for the
    words it lacks, so any text with a word has a fingerprint and a changed word changes only chains near it.
    """
    out = []
    for lo, hi, data, at in blocks(column):
        inside = WORD_BYTE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        s, e = inside.copy(), inside.copy()
        s[1:] &= ~inside[:-1] | edge[1:-1]
        e[:-1] &= ~inside[1:] | edge[1:-1]
        s, e = np.flatnonzero(s), np.flatnonzero(e) + 1
        first = np.searchsorted(s, at)
        hashes = Rolling(data, lower=True)(s, e)
        common = np.isin(hashes, ANCHOR_HASHES)
        # The end of the block follows its last content words.
        content = np.concatenate([np.flatnonzero(~common), np.full(CHAIN, len(s))])
        worth = np.append(hashes, END)
        spots = np.flatnonzero(_anchors(hashes, common, first))
        doc = np.searchsorted(first, spots, "right") - 1
        after = np.searchsorted(content, spots, "right")
        sig = hashes[spots]
        for i in range(CHAIN):
            word = content[after + i]
            sig = sig * U64(BASE) + np.where(word < first[doc + 1], worth[word], END)
        sig = (mix(sig) >> U64(32)).astype(np.uint32)
        cut = np.searchsorted(doc, np.arange(hi - lo + 1))
        out += [np.unique(sig[cut[i] : cut[i + 1]]) for i in range(hi - lo)]
    return out


def hexed(sigs: np.ndarray) -> str:
    """Eight hex digits a signature, ascending."""
    return sigs.astype(">u4").tobytes().hex()


def partition(n: np.ndarray | int, least: float):
    """Partitions of set lengths that grow by 1 / least: sets of likeness `least` lie in one or in two that adjoin."""
    return np.floor(np.log(np.maximum(n, 1)) / -math.log(least) + 1e-9).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of sorted sets if it is `least` or more, else 0; 1 for two empty sets.

    Sets whose lengths, or whose smallest signatures, rule `least` out are not compared further.
    """
    small, large = sorted((a, b), key=len)
    if not len(large):
        return 1.0
    if len(small) < least * len(large) or not len(small):
        return 0.0
    # Sets that share `need` signatures share one of the first len - need + 1 of either in any common order.
    need = max(1, math.ceil(least / (1 + least) * (len(a) + len(b)) - 1e-9))
    x, y = small[: len(small) - need + 1], large[: len(large) - need + 1]
    if x[-1] < y[0] or y[-1] < x[0] or (need > 1 and not np.isin(x, y, assume_unique=True).any()):
        return 0.0
    both = len(np.intersect1d(small, large, assume_unique=True))
    found = both / (len(small) + len(large) - both)
    return found if found >= least else 0.0


def likenesses(a: list[np.ndarray], b: list[np.ndarray], least: float = 0.0) -> np.ndarray:
    """likeness() of each a[i] and b[i]; with `least` only pairs in one partition of set lengths or in two that adjoin are compared."""
    if not least:
        return np.array([likeness(x, y) for x, y in zip(a, b)], np.float64)
    n, m = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out = np.where((n == 0) & (m == 0), 1.0, 0.0)
    for i in np.flatnonzero((n > 0) & (m > 0) & (np.abs(partition(n, least) - partition(m, least)) <= 1)):
        out[i] = likeness(a[i], b[i], least)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), n_sigs: one row a row; null or empty text has an empty fingerprint."""

    def run(batches):
        for b in batches:
            sigs = spot_signatures(b["text"])
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "fingerprint": pa.array([hexed(s) for s in sigs], pa.string()), "n_sigs": pa.array([len(s) for s in sigs], pa.int64())})

    return named(documents(docs).mapInArrow(run, "doc_id long, fingerprint string, n_sigs long"))


def similar(prints: DataFrame, least: float = 0.75) -> DataFrame:
    """a, b, likeness: pairs of different fingerprints with a Jaccard similarity of `least` or more.

    prints: fingerprint, n_sigs. Equal fingerprints are one row first. Fingerprints are partitioned by set
    length into ranges that grow by 1 / least, so a pair lies in one range or in two that adjoin. In each
    range a fingerprint is indexed by its rarest signatures, as many as any similar set must share one of,
    and candidates whose lengths rule the pair out are never compared.
    """
    sets = prints.filter("n_sigs > 0").select("fingerprint", "n_sigs").distinct()
    sets = sets.withColumn("range", F.floor(F.log("n_sigs") / F.lit(-math.log(least)) + 1e-9).cast("int"))  # as partition()
    sig = sets.select("fingerprint", "n_sigs", "range", F.explode(F.expr("transform(sequence(0, int(n_sigs) - 1), i -> substr(fingerprint, 8 * i + 1, 8))")).alias("sig"))
    often = sig.groupBy("sig").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("fingerprint").orderBy("df", "sig"))
    index = sig.join(often, "sig").withColumn("rank", rank).filter(F.col("rank") <= F.col("n_sigs") - F.ceil(F.col("n_sigs") * least - 1e-9) + 1)
    left = index.select("sig", "range", F.col("fingerprint").alias("a"), F.col("n_sigs").alias("na"))
    right = index.select("sig", F.explode(F.array("range", F.col("range") - 1)).alias("range"), F.col("range").alias("own"), F.col("fingerprint").alias("b"), F.col("n_sigs").alias("nb"))
    near = (F.least("na", "nb") >= least * F.greatest("na", "nb")) & ((F.col("own") > F.col("range")) | (F.col("a") < F.col("b")))
    pairs = left.join(right, ["sig", "range"]).filter(near).select("a", "b").distinct()

    def run(batches):
        for b in batches:
            both = [[np.frombuffer(bytes.fromhex(x), ">u4") for x in b[c].to_pylist()] for c in ("a", "b")]
            found = [likeness(x, y, least) for x, y in zip(*both)]
            yield pa.RecordBatch.from_pydict({"a": b["a"], "b": b["b"], "likeness": pa.array(found, pa.float64())})

    return pairs.mapInArrow(run, "a string, b string, likeness double").filter(F.col("likeness") >= least)


def in_order(docs: DataFrame) -> DataFrame:
    """at, doc_id, text, bucket, tail: ranges of documents in order, each with (tail 1) the first document after it again.

    The range after the last is the first. Bounds come from a sample of some SAMPLES rows a range, so ranges hold
    about RANGE_BYTES of text, or more where MOST_RANGES would not hold it, so that bounds and heads are few at any size; a range is read as a sorted stream, so it may be of any size.
    """
    sp, size = shuffle_partitions(docs.sparkSession), text_bytes(docs)
    parts = max(sp, size // PART_BYTES)
    rows, n = ordered(docs), min(max(32 * sp, size // RANGE_BYTES), MOST_RANGES)
    at = rows.select(F.col("at").cast("double").alias("at"))
    drawn = F.pmod(F.xxhash64("at"), F.lit(1 << 40)) < F.lit(int(min(1.0, SAMPLES * n / max(1, docs.count())) * (1 << 40)))
    sample = np.sort(at.filter(drawn).toPandas()["at"].to_numpy())
    bounds = np.unique(sample[np.arange(1, n) * len(sample) // n]).tolist() if len(sample) else [0.0]
    splits = [-math.inf, *bounds, math.inf]
    bucketed = lambda df: Bucketizer(splits=splits, inputCol="x", outputCol="bucket").transform(df.withColumn("x", F.col("at").cast("double"))).drop("x")
    heads = bucketed(rows.select("at")).groupBy("bucket").agg(F.min("at").alias("head"))
    # One row a range.
    w = Window.orderBy("bucket")
    heads = heads.select("head", F.coalesce(F.lag("bucket").over(w), F.last("bucket").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    found = bucketed(rows).join(F.broadcast(heads), F.col("at") == F.col("head"), "left")
    places = F.expr("filter(array(bucket, before), x -> x IS NOT NULL)")
    placed = found.select("at", "doc_id", "text", F.posexplode(places).alias("tail", "bucket"))
    return placed.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", "at")


def _edited(held: list[tuple[int, str]]) -> pa.RecordBatch:
    """Rows for all documents held but the last, which is the next of the one before it."""
    texts = [t for _, t in held]
    sigs = spot_signatures(pa.array(texts, pa.string()))
    own = [len(t) for t in texts[:-1]]
    edited = [t[: n - n // 2] + x[: n // 2] for t, x, n in zip(texts, texts[1:], own)]
    changed = spot_signatures(pa.array(edited, pa.string()))
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([d for d, _ in held[:-1]], pa.int64()), "n_chars": pa.array(own, pa.int64()), "edited_sha256": pa.array([sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        "fingerprint": pa.array([hexed(s) for s in sigs[:-1]], pa.string()), "edited_fingerprint": pa.array([hexed(s) for s in changed], pa.string()),
        "near_edited": pa.array(likenesses(sigs[:-1], changed), pa.float64()), "near_next": pa.array(likenesses(sigs[:-1], sigs[1:]), pa.float64()),
    })


def with_next(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document; one row a row.

    Sorted ranges are streamed in blocks of about block_chars, so a task holds a block or one document. Likeness
    is exact: these pairs are given, so no bound passes over any. Null text is empty; rows that repeat a doc_id follow each other as in the table, and those with a
    null one come last; a single row is its own next; an empty table gives no rows.
    """

    def run(batches):
        bucket, done, held, size = None, False, [], 0
        for b in batches:
            for lo in range(0, len(b), 256):
                for at, tail, doc_id, text in zip(*(b[c].slice(lo, 256).to_pylist() for c in ("bucket", "tail", "doc_id", "text"))):
                    if at != bucket:
                        bucket, held, size = at, [], 0
                    held.append((doc_id, text))
                    size += len(text)
                    done = tail == 1
                    if len(held) > 1 and (done or size >= block_chars):
                        yield _edited(held)
                        held, size = held[-1:], len(text)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return named(in_order(docs).mapInArrow(run, schema))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"))
