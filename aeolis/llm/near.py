"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import U64, Rolling, blocks, mix, shingles, words
from ._common import cut, documents, looked_up, named, table
from .components import components

WORDS = 5
#: Linked with 100 * shared >= PERCENT * union.
PERCENT = 75
#: Hashes of a signature, 16 bits each, and rows of a band. A pair at the threshold shares none of the
#: 32 bands with probability (1 - 0.75 ** 4) ** 32 = 5e-6.
HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
#: A candidate is dropped once the posterior probability that it reaches the threshold is below this.
MISS = 1e-5
#: Hashes compared at a time.
BATCH = 32
#: Members of a bucket that are compared at once; larger buckets are dealt out in blocks of as many, and
#: in the first pass each block is also compared with so many members of the bucket, the same for all blocks.
BUCKET, PIVOTS = 512, 8
#: Pairs to verify go in blocks of so many by so many members of a bucket, texts of at most twice as many.
GROUP = 128
#: Up to so many ids are broadcast to pick texts; more are joined by shuffling.
BROADCAST_IDS = 1 << 21

_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | U64(1)


def shingle_sets(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Of each document the sorted distinct hashes of its runs of WORDS words, A-Z lowered."""
    s, e, first = words(data, at)
    h = Rolling(data, lower=True)(s, e)
    return [np.unique(shingles(h[i:j], WORDS)) for i, j in zip(first, first[1:])]


def signature(found: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 2**64 - 1, np.uint64)
    for i in range(0, len(found), 1024):
        np.minimum(low, (found[i : i + 1024, None] * _FACTORS).min(0), out=low)
    return mix(low).astype(np.uint16)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), class AS (
  -- Equal sets are one class, named by its smallest doc_id.
  SELECT doc_id, min(doc_id) OVER (PARTITION BY all_shingles) AS rep FROM (SELECT doc_id, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS all_shingles FROM s GROUP BY 1)
), r AS (SELECT s.* FROM s JOIN class USING (doc_id) WHERE doc_id = rep
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM r a JOIN r b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (SELECT DISTINCT rep AS a, rep AS b FROM class UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
), top AS (SELECT a, min(b) AS top FROM reach GROUP BY 1
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(top, doc_id) AS component_id, coalesce(top, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN class USING (doc_id) LEFT JOIN top ON top.a = class.rep
"""


def _rows(docs: DataFrame, *more: str) -> DataFrame:
    """documents() with a name for each pair of doc_id and text, so texts that share a doc_id stay apart."""
    return documents(docs, *more).withColumn("name", F.xxhash64("doc_id", "text"))


def _sign(batches):
    for b in batches:
        n, keys, sigs = [], [], []
        for _, _, data, at in blocks(b["text"]):
            for found in shingle_sets(data, at):
                n.append(len(found))
                keys.append(np.array([mix(found).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(found + U64(9)))], np.uint64).tobytes() if len(found) else None)
                sigs.append(signature(found).tobytes() if len(found) else None)
        same = {c: b[c] for c in b.schema.names if c not in ("doc_id", "name", "text")}
        yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "name": b["name"]} | same | {"n_shingles": pa.array(n, pa.int64()), "key": pa.array(keys, pa.binary()), "sig": pa.array(sigs, pa.binary())})


def least_matches(n: int) -> int:
    """Fewest matches of n hashes at which P(similarity >= threshold) is MISS or more, with a uniform prior.

    That posterior is the chance that n + 1 throws at the threshold succeed at most as often.
    """
    t, total = PERCENT / 100, 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= MISS:
            return m
    return n


LEAST = {n: least_matches(n) for n in range(BATCH, HASHES + 1, BATCH)}


def _survivors(sig: np.ndarray, band: int, label: np.ndarray, left: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of the bucket that differ in label, meet in no earlier band and pass every batch; matches.

    left: if not 0, i is one of the first `left` members and j one of the others.
    """
    found = []
    rows = sig.view(np.uint64).reshape(len(sig), BANDS)  # a band's four hashes as one number
    step = max(1, (1 << 18) // len(sig))
    for lo in range(0, left or len(sig), step):
        i, j = np.meshgrid(np.arange(lo, min(lo + step, left or len(sig))), np.arange(left, len(sig)), indexing="ij")
        own = (j > i) & (label[i] != label[j])
        i, j = i[own], j[own]
        for k in range(0, band, 4):
            if not len(i):
                break
            ok = ~(rows[i, k : min(k + 4, band)] == rows[j, k : min(k + 4, band)]).any(1)
            i, j = i[ok], j[ok]
        total = np.zeros(len(i), np.int32)
        for at in range(0, HASHES, BATCH):
            total += (sig[i, at : at + BATCH] == sig[j, at : at + BATCH]).sum(1, dtype=np.int32)
            ok = total >= LEAST[at + BATCH]
            i, j, total = i[ok], j[ok], total[ok]
        found.append((i, j, total))
    return tuple(np.concatenate(x) for x in zip(*found))


def _forest(n: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which pairs make a spanning forest of the heaviest."""
    root = list(range(n))

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    keep = np.zeros(len(i), bool)
    for k in np.argsort(-weight, kind="stable"):
        x, y = top(int(i[k])), top(int(j[k]))
        if x != y:
            root[y], keep[k] = x, True
    return keep


def _compare(forest: bool):
    """Rows come bucket by bucket: bucket, id, band, left, label, sig."""

    def judged(rows: pa.Table):
        ids, label = rows["id"].to_numpy(), rows["label"].to_numpy()
        if len(rows) < 2 or (label == label[0]).all():
            return []
        side = rows["left"].to_numpy()
        order = np.lexsort((ids, ~side))
        ids, label, side = ids[order], label[order], side[order]
        sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint16).reshape(-1, HASHES)[order]
        i, j, matches = _survivors(sig, rows["band"][0].as_py(), label, int(side.sum()))
        if forest and len(i):
            keep = _forest(len(ids), i, j, matches)
            i, j = i[keep], j[keep]
        return _grouped(rows["bucket"][0].as_py(), ids, i, j)

    def run(batches):
        held, found = [], []
        for b in batches:
            bucket = b["bucket"].to_numpy()
            edges = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            parts = [b.slice(i, j - i) for i, j in zip([0, *edges], [*edges, len(b)]) if j > i]
            for part in parts:
                if held and held[0]["bucket"][0].as_py() != part["bucket"][0].as_py():
                    found += judged(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(part)
            if len(found) > 1000:
                yield _groups(found)
                found = []
        if held:
            found += judged(pa.Table.from_batches(held).combine_chunks())
        if found:
            yield _groups(found)

    return run


def _grouped(bucket: int, ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, list[int], bytes]]:
    """The pairs dealt to blocks of GROUP by GROUP members: (group, ids, pairs of positions in ids)."""
    out = []
    code = (i // GROUP) * (len(ids) // GROUP + 1) + j // GROUP
    order = np.argsort(code, kind="stable")
    cuts = np.flatnonzero(np.diff(code[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        used, where = np.unique(np.concatenate([i[part], j[part]]), return_inverse=True)
        name = mix(np.array([bucket, code[part[0]]], np.int64).view(U64))
        out.append((int(mix(name[:1] + U64(3) * name[1:]).view(np.int64)[0]), ids[used].tolist(), where.astype(np.uint8).reshape(2, -1).tobytes()))
    return out


def _groups(found):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.list_(pa.int64()), pa.binary()))], ["group", "ids", "pairs"])


def _first_pass(members: DataFrame) -> DataFrame:
    """bucket, band, id, left, label: groups that link most of what is alike, in proportion to the members.

    A large bucket is dealt out in blocks, to each of which its PIVOTS smallest ids are added, so blocks of
    near copies of one text are linked through these.
    """
    parts = F.ceil(F.col("n") / BUCKET).cast("int")
    label = F.col("id").alias("label")
    whole = members.filter(F.col("n") <= BUCKET).select("bucket", "band", "id", F.lit(False).alias("left"), label)
    hot = members.filter(F.col("n") > BUCKET).withColumn("own", F.pmod(F.xxhash64("id"), parts).cast("int"))
    # min of a set of ids, PIVOTS times: what is kept of a bucket before the exchange is PIVOTS ids.
    pivots = hot.groupBy("bucket", "band", "n").agg(F.expr(f"slice(array_sort(collect_set(id) FILTER (WHERE pmod(xxhash64(id, 1), greatest(1, int(n / {8 * PIVOTS}))) = 0)), 1, {PIVOTS})").alias("ids"))
    pivots = pivots.withColumn("own", F.explode(F.sequence(F.lit(0), parts - 1))).select("bucket", "band", F.explode("ids").alias("id"), "own")
    hot = hot.select("bucket", "band", "id", "own").union(pivots).distinct()
    return whole.union(hot.select(F.xxhash64("bucket", "own").alias("bucket"), "band", "id", F.lit(False), label))


def _second_pass(members: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, band, id, left, label: groups of all pairs of a bucket whose labels differ.

    Buckets of one label are left out. In a large one, members are dealt out in blocks, and those without the
    label that comes most often go to every block; blocks of those alone are paired.
    """
    known = members.join(labels.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left").select("bucket", "band", "id", "n", F.coalesce("label", "id").alias("label"))
    mixed = known.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select(F.col("bucket").alias("b"))
    known = cut(known.join(mixed, F.col("bucket") == F.col("b"), "left_semi"))
    whole = known.filter(F.col("n") <= BUCKET).select("bucket", "band", "id", F.lit(False).alias("left"), "label")
    hot = known.filter(F.col("n") > BUCKET)
    most = hot.groupBy("bucket", "label").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.max(F.struct("m", "label")).alias("most"))
    hot = hot.join(most.select(F.col("bucket").alias("b"), F.col("most.label").alias("main"), F.col("most.m").alias("m")), F.col("bucket") == F.col("b")).drop("b")
    main = F.col("label") == F.col("main")
    mains, others = F.ceil(F.col("m") / BUCKET).cast("int"), F.ceil((F.col("n") - F.col("m")) / BUCKET).cast("int")
    own = hot.withColumn("own", F.pmod(F.xxhash64("id"), F.when(main, mains).otherwise(others)).cast("int"))
    # Blocks of the most frequent label against blocks of the others.
    across = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(main, others).otherwise(mains) - 1)))
    x, y = F.when(main, F.col("own")).otherwise(F.col("other")), F.when(main, F.col("other")).otherwise(F.col("own"))
    across = across.select(F.xxhash64("bucket", F.lit(1), x, y).alias("bucket"), "band", "id", main.alias("left"), "label")
    # Blocks of the others against each other.
    rest = own.filter(~main).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    rest = rest.select(F.xxhash64("bucket", F.lit(2), F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "band", "id", (F.col("own") < F.col("other")).alias("left"), "label")
    return whole.union(across).union(rest)


def _candidates(groups: DataFrame, reps: DataFrame, forest: bool) -> DataFrame:
    """Groups of pairs to verify, of the members of groups."""
    rows = groups.join(reps.select("id", "sig"), "id").select("bucket", "band", "id", "left", "label", "sig")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_compare(forest), "group long, ids array<long>, pairs binary")


def _confirm(batches):
    """Rows come group by group, first its pairs, then its texts: group, id (null with the pairs), ids, pairs, text."""
    at, pairs, sets = None, None, {}

    def links():
        if pairs is None:
            return
        for x, y in zip(*pairs):
            one, two = sets.get(x), sets.get(y)
            both = len(np.intersect1d(one, two, assume_unique=True))
            if 100 * both >= PERCENT * (len(one) + len(two) - both):
                yield min(x, y), max(x, y)

    for b in batches:
        groups, ids = b["group"].to_pylist(), b["id"].to_pylist()
        found = []
        for lo, hi, data, offsets in blocks(b["text"]):
            for k, own in zip(range(lo, hi), shingle_sets(data, offsets)):
                if groups[k] != at:
                    found += links()
                    at, pairs, sets = groups[k], None, {}
                if ids[k] is None:
                    names = b["ids"][k].as_py()
                    pairs = [[names[i] for i in side] for side in np.frombuffer(b["pairs"][k].as_py(), np.uint8).reshape(2, -1)]
                else:
                    sets[ids[k]] = own
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])
    found = list(links())
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def _verified(groups: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that are linked by their full sets; a text goes once to each group that needs it."""
    groups = cut(groups)
    wanted = groups.select("group", F.explode("ids").alias("id"))
    if (groups.agg(F.sum(F.size("ids"))).first()[0] or 0) <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = _rows(docs).join(wanted, F.col("name") == F.col("id")).select("group", "id", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("binary").alias("pairs"), "text")
    rows = texts.union(groups.select("group", F.lit(None).cast("long"), "ids", "pairs", F.lit("")))
    return rows.repartition("group").sortWithinPartitions("group", F.col("id").asc_nulls_first()).mapInArrow(_confirm, "a long, b long")


def link_near(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns of carry, n_shingles, component_id, kept, class: one row a row of docs.

    Documents are linked if the Jaccard similarity of their sets of WORDS-word shingles is PERCENT or more;
    component_id is the smallest doc_id reachable. Equal sets are one class and only its row with the
    smallest doc_id goes on, under a name made of doc_id and text. Members of a band's bucket are compared by
    signature, BATCH hashes at a time, and those whose posterior falls below MISS are dropped. The first pass links
    the spanning forest of a bucket's survivors, verified on full sets; the second verifies every surviving pair between
    different components, in the buckets that have any. So near-identical groups give few pairs and no link between
    components goes unverified. class names the component (null: a text without words, alone).

    Null texts and texts without words have no shingles and stay alone; rows that repeat a doc_id are each
    linked by their own text, and so are rows with a null one, which counts as the largest; rows of one
    component with its smallest doc_id are all kept; an empty table gives no rows.
    """
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*carry).schema)
    signed = cut(_rows(docs, *carry).mapInArrow(_sign, f"doc_id long, name long, {types}n_shingles long, key binary, sig binary"))
    # Equal keys have equal signatures, so any of them will do.
    classes = signed.filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "name")).alias("least"), F.any_value("sig").alias("sig"), F.count("*").alias("rows"))
    classes = cut(classes.select("key", F.col("least.doc_id").alias("least"), F.col("least.name").alias("id"), "sig", "rows"))
    reps = classes.select("id", "sig")
    band = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(sig, 8 * i + 1, 8)))")
    banded = reps.select("id", F.posexplode(band).alias("band", "bucket"))
    full = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = cut(banded.join(full, "bucket"))
    edges = cut(_verified(_candidates(_first_pass(members), reps, forest=True), docs))
    labels = components(edges)
    more = cut(_verified(_candidates(_second_pass(members, labels), reps, forest=False), docs))
    # The links found last are between components, whose labels stand for their members.
    tops = components(_between(more, labels))
    risen = looked_up(labels, "label", "id", tops.select(F.col("id").alias("l"), F.col("label").alias("top")), "l").select("id", F.coalesce("top", "label").alias("label"))
    labels = cut(risen.union(tops.select("id", "label").join(labels.select("id"), "id", "left_anti")))
    least = classes.join(labels, "id").groupBy(F.col("label").alias("l")).agg(F.min("least").alias("component"))
    linked = looked_up(labels, "label", "id", least, "l").select("id", "label", "component")
    # Rows alone in their class and component are their own; the rest is looked up by key, of which one may be that of many rows.
    by_key = classes.join(linked, "id", "left").filter("rows > 1 OR label IS NOT NULL")
    by_key = by_key.select(F.col("key").alias("k"), F.coalesce("component", "least").alias("component"), F.coalesce("label", "id").alias("class"))
    rows = signed.withColumn("nth", F.monotonically_increasing_id())
    out = looked_up(rows.filter("key IS NOT NULL"), "key", "nth", by_key, "k")
    out = out.select("doc_id", *carry, "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("class", "name").alias("class"))
    out = out.union(signed.filter("key IS NULL").select("doc_id", *carry, "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long")))
    return named(out.withColumn("kept", F.col("component_id") == F.col("doc_id")), "component_id")


def _between(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges as edges of the labels of their ends; an end without one stands for itself."""
    of = labels.select("id", "label")
    edges = edges.join(of, F.col("a") == F.col("id"), "left").select(F.coalesce("label", "a").alias("a"), "b")
    return edges.join(of, F.col("b") == F.col("id"), "left").select("a", F.coalesce("label", "b").alias("b")).distinct()


def op4_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_near(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
