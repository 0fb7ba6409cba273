"""Source divergence audit: term shares of sources against one another and against their language."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bytes import LOWER, blocks
from ._common import cut, table

#: Terms kept in a language have this many of its documents; a group reports this many terms; added to each count, in shares of SCALE.
LEAST_DOCS, TOP, ADDED, SCALE = 30, 50, 5, 1_000_000_000
#: Cells of a tile of groups by terms (8 bytes each), of a broadcast of some groups against all, and groups that one task compares with all of its language.
CELLS, BROADCAST_CELLS, STRIPE = 1 << 18, 1 << 21, 512
#: Bytes of text that are counted together.
COUNTED = 8 << 20
#: Letters, and the bytes of all that is not ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), t AS (
  SELECT doc, lang, source, unnest(ts) AS term FROM d
), kept AS (
  SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 30
), v AS (
  SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY 1
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN kept k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL) x USING (lang, source, term)
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM c JOIN v USING (lang)
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms)) WHERE part = 'pair' OR rank <= 50
"""


def _counts(batches):
    """lang, source, term, n, docs of runs of documents: occurrences, and documents that have the term; and each group with the term ''."""
    names = ["lang", "source", "term", "n", "docs"]
    for b in batches:
        groups = pa.StructArray.from_arrays([b["lang"], b["source"]], ["lang", "source"])
        present, none = pa.Table.from_batches([b.select(["lang", "source"])]).group_by(["lang", "source"]).aggregate([]), np.zeros(len(b), np.int64)
        for x in present.to_batches():
            yield pa.RecordBatch.from_arrays([x["lang"], x["source"], pa.array([""] * len(x)), pa.array(none[: len(x)]), pa.array(none[: len(x)])], names)
        for lo, hi, data, at in blocks(b["text"], COUNTED):
            inside = TERM[data]
            edge = np.zeros(len(data) + 1, bool)
            edge[at] = True
            first = inside.copy()
            first[1:] &= ~inside[:-1] | edge[1:-1]
            starts = np.flatnonzero(first)
            if not len(starts):
                continue
            # The terms back to back, so that where one starts is the number of term bytes before it.
            solid = np.cumsum(inside)
            ends = np.append(solid[starts] - 1, solid[-1])
            found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(LOWER[data[inside]])).dictionary_encode()
            code, size = found.indices.to_numpy().astype(np.int64), len(found.dictionary)
            doc = np.searchsorted(at, starts, "right") - 1
            both, n = np.unique(doc * size + code, return_counts=True)
            keys = groups.slice(lo, hi - lo)
            group = pa.array([f"{len(x['lang'])} {x['lang']}{x['source']}" for x in keys.to_pylist()]).dictionary_encode().indices.to_numpy().astype(np.int64)
            place, where = np.unique(group[both // size] * size + both % size, return_inverse=True)
            of_group = np.zeros(group.max() + 1, np.int64)
            of_group[group] = np.arange(hi - lo)
            picked = keys.take(pa.array(of_group[place // size]))
            yield pa.RecordBatch.from_arrays(
                [picked.field("lang"), picked.field("source"), found.dictionary.take(pa.array(place % size)), pa.array(np.bincount(where, weights=n).astype(np.int64)), pa.array(np.bincount(where).astype(np.int64))],
                names,
            )


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n, first: occurrences of the terms that are kept in the language, and 1 in one row of each; null lang, source and text are ''.

    Every group also has a row of 0 with the term ''.
    Runs of documents are counted in their task, so a term that every document has is shuffled as a row a task and source.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    found = docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    sums = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    sums = sums.withColumns({"docs": F.sum("docs").over(of_term), "first": (F.col("source") == F.min("source").over(of_term)).cast("long")})
    return sums.filter((F.col("docs") >= least_docs) | (F.col("term") == "")).withColumn("first", F.when(F.col("term") == "", 0).otherwise(F.col("first"))).drop("docs")


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * counts / total) for counts up to total, digit by digit to base 1000, so that no product passes 64 bits while totals stay below 9e15."""
    value, rest = np.divmod(counts, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        value = value * 1000 + digit
    return value + 1


def tile(counts: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each group (rows) and of their language, of the terms in the columns; totals: of each group, then of the language, with what is added."""
    return shares(counts + ADDED, totals[:-1, None]), shares(counts.sum(axis=0) + ADDED, totals[-1])


def differences(p: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Sums over the columns of abs(p[i] - p[j]) for i from lo to hi and all j, some rows against all at once."""
    out = np.zeros((hi - lo, len(p)), np.int64)
    rows = max(1, BROADCAST_CELLS // max(1, p.size))
    for i in range(lo, hi, rows):
        out[i - lo : i - lo + rows] = np.abs(p[i : min(i + rows, hi), None, :] - p[None, :, :]).sum(axis=2)
    return out


def compared(entries: pd.DataFrame, groups: pd.DataFrame, size: int = STRIPE, top: int = TOP) -> pd.DataFrame:
    """One block of terms of one language: partial sums of pairs, and the best terms of each group, for a stripe of `size` groups."""
    none = pd.DataFrame(columns=["lang", "source", "item", "part", "value"])
    if not len(groups):
        return none
    groups = groups.sort_values("source")
    lang, block, stripe = groups["lang"].iloc[0], groups["block"].iloc[0], groups["stripe"].iloc[0]
    sources = groups["source"].to_numpy(object)
    terms = np.unique(entries["term"].to_numpy(object)) if len(entries) else np.zeros(0, object)
    counts = np.zeros((len(sources), len(terms)), np.int64)
    if len(entries):
        counts[np.searchsorted(sources, entries["source"].to_numpy(object)), np.searchsorted(terms, entries["term"].to_numpy(object))] = entries["n"].to_numpy()
    elif block:
        return none
    totals = np.append(groups["total"].to_numpy(np.int64), np.int64(groups["of_lang"].iloc[0])) + ADDED * np.int64(groups["terms"].iloc[0])
    p, q = tile(counts, totals)
    lo, hi = stripe * size, min(len(sources), (stripe + 1) * size)
    sums = differences(p, lo, hi)
    i, j = np.nonzero(np.arange(len(sources))[None, :] > np.arange(lo, hi)[:, None])
    out = [pd.DataFrame({"source": sources[lo + i], "item": sources[j], "part": "pair", "value": sums[i, j]})]
    for g in range(lo, hi):
        over = np.flatnonzero((counts[g] > 0) & (p[g] > q))
        best = heapq.nsmallest(top, zip((q[over] - p[g, over]).tolist(), terms[over]))
        out.append(pd.DataFrame({"source": sources[g], "item": [t for _, t in best], "part": "term", "value": np.array([-v for v, _ in best], np.int64)}))
    return pd.concat(out).assign(lang=lang)


def diverge(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, cells: int = CELLS, stripe: int = STRIPE) -> DataFrame:
    """lang, source, part, item, value, rank: how far the shares of terms differ between the sources of a language (part
    `pair`, all) and which terms, found in least_docs documents of the language, a source has more of than its language (part `term`, the first `top`).

    Kept terms are dealt into blocks by a hash; a task makes a dense matrix of groups by terms for one block of one
    language and compares all its groups by broadcasting, some rows at a time. The partial sums of pairs are added
    up by partial aggregation, and the best terms of the blocks are merged by rank, which Spark cuts to `top` in every task
    before the shuffle. A block has so many terms that its matrix has about `cells` cells; a language with more than
    `stripe` sources is dealt to several tasks a block, so memory is bounded by `stripe` by sources. Null lang, source and text are ''; repeated rows count each;
    a language without kept terms has pairs of value 0; equal values are ranked by the bytes of the item; no rows give none.
    """
    counts = cut(term_counts(docs, least_docs))
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("first"))
    of_lang = Window.partitionBy("lang")
    known = cut(groups.select("lang", "source", "total", F.sum("total").over(of_lang).alias("of_lang"), F.sum("first").over(of_lang).alias("terms"), F.count("*").over(of_lang).alias("sources")))
    most_terms, most = known.agg(F.max("terms"), F.max("sources")).first()
    most = most or 1
    n_blocks, n_stripes = -(-(most_terms or 1) // max(16, cells // most)) or 1, -(-most // stripe)
    dealt = lambda df, block: df.withColumns({"block": block, "stripe": F.explode(F.sequence(F.lit(0), F.lit(n_stripes - 1)))})
    tiles = dealt(counts.filter("term <> ''").drop("first"), F.pmod(F.xxhash64("term"), F.lit(n_blocks)).cast("int")).groupBy("lang", "block", "stripe")
    # A stripe beyond a language's sources has nothing to do.
    sides = dealt(known.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))), F.col("b")).filter(F.col("stripe") * stripe < F.col("sources")).groupBy("lang", "block", "stripe")
    parts = cut(tiles.cogroup(sides).applyInPandas(lambda a, b: compared(a, b, stripe, top), "lang string, source string, item string, part string, value long"))
    pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "item", "part").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", "part", "value", ways.alias("x")).select("lang", "x.source", "part", "x.item", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).cast("int").alias("rank")
    columns = ("lang", "source", "part", "item", "value")
    return pairs.select(*columns, place).union(parts.filter("part = 'term'").select(*columns, place).filter(F.col("rank") <= top))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diverge(table(spark, sf_dir, "documents"))
