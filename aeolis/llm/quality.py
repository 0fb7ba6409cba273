"""Quality rules with thresholds from mergeable quantile sketches per language and source."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bytes import SPACE, Rolling, blocks, lines, shingles, words
from ._common import cut, documents, named, table

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rate, as SQL over the counts, and the least by which a document must exceed its group's upper quantile to fail.
RATES = {
    "symbol_rate": ("n_symbols / greatest(word_chars, 1)", 0.05),
    "dup_line_rate": ("n_dup_lines / greatest(n_words, 1)", 0.05),
    "repeat_rate": ("n_repeat_words / greatest(n_words, 1)", 0.25),
    "word_length": ("word_chars / greatest(n_words, 1)", 4.0),
}
#: A threshold stands so many interquartile ranges above the upper quartile.
SPREAD = 4.0
#: Quartiles of a group are drawn towards those of its language as by so many documents of it, and these towards those of all.
WEIGHT = 200
#: A group's threshold is at most so many margins above that of the rest of its language, so a spoilt source sets no mark of its own.
CEILING = 2
#: Bins of the sketch: their upper ends grow by this factor from the least value told from 0.
GROWTH, LEAST = 1.01, 1e-4


def _oracle() -> str:
    """SQL of op9, thresholds as well; bins are numbered by the same rule."""
    quartiles = lambda name, source, *keys: f"""{name} AS (
  SELECT {"".join(k + ", " for k in keys)}rate, max(total) AS total, min(e) FILTER (upto >= 0.25 * total) AS low, min(e) FILTER (upto >= 0.75 * total) AS high FROM (
    SELECT *, sum(n) OVER (PARTITION BY {"".join(k + ", " for k in keys)}rate ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {"".join(k + ", " for k in keys)}rate) AS total,
      CASE WHEN bin = 0 THEN 0 ELSE {LEAST} * pow({GROWTH}::DOUBLE, bin) END AS e FROM ({source}) WHERE n > 0) GROUP BY {"".join(k + ", " for k in keys)}rate
)"""  # noqa: E731
    merged = lambda *keys: f"SELECT {''.join(k + ', ' for k in keys)}rate, bin, sum(n) AS n FROM bins GROUP BY ALL"
    rest = "SELECT lang, source, rate, bin, sum(n) AS n FROM (SELECT b.lang, l.source, b.rate, b.bin, b.n FROM groups l JOIN bins b ON l.lang IS NOT DISTINCT FROM b.lang UNION ALL SELECT lang, source, rate, bin, -n FROM bins) GROUP BY ALL"
    limit = lambda low, high: f"{high} + greatest(margin, {SPREAD} * ({high} - {low}))"
    drawn = lambda t, own, other: f"({t} * {own} + {WEIGHT} * {other}) / ({t} + {WEIGHT})"
    margins = "CASE rate " + " ".join(f"WHEN '{r}' THEN {m}::DOUBLE" for r, (_, m) in RATES.items()) + " END"
    return rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), runs AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) > 1 AS twice FROM (SELECT doc_id, i, CASE WHEN i + 7 <= len(ws) THEN array_to_string(ws[i : i + 7], ' ') ELSE concat(chr(10), i) END AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w))
), repeats AS (
  SELECT doc_id, count(*) FILTER (covered) AS n_repeat_words FROM (SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM runs) GROUP BY 1
), c AS (
  SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN repeats USING (doc_id)
), rated AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {", ".join(f"({sql})::DOUBLE AS {r}" for r, (sql, _) in RATES.items())} FROM c
), bins AS (
  SELECT lang, source, rate, CASE WHEN value <= {LEAST} THEN 0 ELSE ceil(ln(value / {LEAST}) / {math.log(GROWTH)!r}::DOUBLE) END::INT AS bin, count(*) AS n FROM (SELECT lang, source, unnest([{", ".join(f"'{r}'" for r in RATES)}]) AS rate, unnest([{", ".join(RATES)}]) AS value FROM rated WHERE NOT base_failed) GROUP BY ALL
), {quartiles("own", "SELECT * FROM bins", "lang", "source")}, {quartiles("of_lang", merged("lang"), "lang")}, {quartiles("every", merged())}, groups AS (
  SELECT DISTINCT lang, source FROM bins
), {quartiles("rest", rest, "lang", "source")}, marks AS (
  SELECT lang, source, rate, least({limit("g_low", "g_high")}, {limit("r_low", "r_high")} + {CEILING} * margin) AS mark FROM (
    SELECT own.lang, own.source, own.rate, {margins.replace("CASE rate", "CASE own.rate")} AS margin, coalesce(rest.low, l.low) AS r_low, coalesce(rest.high, l.high) AS r_high,
      {drawn("own.total", "own.low", "(" + drawn("l.total", "l.low", "every.low") + ")")} AS g_low, {drawn("own.total", "own.high", "(" + drawn("l.total", "l.high", "every.high") + ")")} AS g_high
    FROM own JOIN of_lang l ON own.lang IS NOT DISTINCT FROM l.lang AND own.rate = l.rate JOIN every ON every.rate = own.rate LEFT JOIN rest ON own.lang IS NOT DISTINCT FROM rest.lang AND own.source IS NOT DISTINCT FROM rest.source AND own.rate = rest.rate)
), limits AS (
  SELECT lang, source, {", ".join(f"max(mark) FILTER (rate = '{r}') AS max_{r}" for r in RATES)} FROM marks GROUP BY ALL
)
SELECT doc_id, {", ".join(COUNTS)}, base_failed, NOT base_failed AND {" AND ".join(f"coalesce({r} <= max_{r}, true)" for r in RATES)} AS kept, {", ".join(f"round(max_{r}, 6) AS max_{r}" for r in RATES)}
FROM rated LEFT JOIN limits ON rated.lang IS NOT DISTINCT FROM limits.lang AND rated.source IS NOT DISTINCT FROM limits.source
"""


def _counts(batches):
    for b in batches:
        out = {k: np.zeros(len(b), np.int64) for k in COUNTS}
        for lo, hi, data, at in blocks(b["text"]):
            s, e, first = words(data, at)
            solid = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~SPACE[data])])
            symbols = np.concatenate([[0], np.cumsum(SYMBOL[data])])
            rolling = Rolling(data)
            out["n_words"][lo:hi] = np.diff(first)
            out["word_chars"][lo:hi] = np.diff(solid[at])
            out["n_symbols"][lo:hi] = np.diff(symbols[at])
            ls, le, lfirst = lines(data, at)
            lhash, some = rolling(ls, le), solid[le] > solid[ls]
            whash = rolling(s, e)
            for i in range(hi - lo):
                own = lhash[lfirst[i] : lfirst[i + 1]][some[lfirst[i] : lfirst[i + 1]]]
                if len(own) > 1:
                    out["n_dup_lines"][lo + i] = len(own) - len(np.unique(own))
                if (n := first[i + 1] - first[i]) > WINDOW:
                    runs = shingles(whash[first[i] : first[i + 1]], WINDOW)
                    _, where, times = np.unique(runs, return_inverse=True, return_counts=True)
                    at_twice = np.flatnonzero(times[where] > 1)
                    if len(at_twice):
                        cover = np.zeros(n + 1, np.int64)
                        np.add.at(cover, at_twice, 1)
                        np.add.at(cover, at_twice + WINDOW, -1)
                        out["n_repeat_words"][lo + i] = int((np.cumsum(cover[:-1]) > 0).sum())
        arrays = {k: pa.array(v) for k, v in out.items()}
        yield pa.RecordBatch.from_pydict({c: b[c] for c in b.schema.names if c != "text"} | arrays)


def quality_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the COUNTS of each document, one row a row; null text has no words, a null doc_id stays null."""
    return named(documents(docs, "lang", "source").mapInArrow(_counts, "doc_id long, lang string, source string, " + ", ".join(f"{k} long" for k in COUNTS)))


def _sketch(rated: DataFrame) -> DataFrame:
    """lang, source, rate, bin, n: how many documents of a group have the rate in a bin.

    Counts of bins of fixed relative width are a quantile sketch with error GROWTH that merges by sums, in any
    order to the same result, and a group has at most some 1,500 bins a rate however many documents it has.
    """
    value = F.col("value")
    bin_of = F.when(value <= LEAST, 0).otherwise(F.ceil(F.log(value / LEAST) / math.log(GROWTH))).cast("int").alias("bin")
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), F.col(r).alias("value")) for r in RATES)))
    return rated.select("lang", "source", pairs.alias("x")).select("lang", "source", "x.*").select("lang", "source", "rate", bin_of).groupBy("lang", "source", "rate", "bin").agg(F.count("*").alias("n"))


def _quartiles(bins: DataFrame, *keys: str) -> DataFrame:
    """keys, rate, total and the lower and upper quartile of bins with counts n (upper ends of the bins that hold them)."""
    by = Window.partitionBy(*keys, "rate")
    upto = bins.withColumns({"upto": F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(by)}).filter("n > 0")
    end = F.when(F.col("bin") == 0, 0.0).otherwise(LEAST * F.pow(F.lit(GROWTH), F.col("bin")))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), end))
    return upto.groupBy(*keys, "rate").agg(F.max("total").alias("total"), quartile(0.25).alias("low"), quartile(0.75).alias("high"))


def thresholds(rated: DataFrame) -> DataFrame:
    """lang, source, max_<rate> for each rate: upper quartile + max(margin, SPREAD * interquartile range).

    The quartiles are those of a group of language and source, drawn towards its language's as by WEIGHT
    documents of it, as these are towards those of all documents. No threshold is more than CEILING margins above that
    of the rest of its language.
    """
    groups = cut(_sketch(rated))
    merged = lambda *keys: groups.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))
    own, lang, every = _quartiles(groups, "lang", "source"), _quartiles(merged("lang"), "lang"), _quartiles(merged())
    # Sketches subtract too: the rest of a language is its sketch less the group's, some thousands of bins a group.
    each = own.select(F.col("lang").alias("g"), F.col("source").alias("s")).distinct()
    spread = each.join(merged("lang"), F.col("g").eqNullSafe(F.col("lang"))).select("lang", F.col("s").alias("source"), "rate", "bin", "n")
    minus = groups.select("lang", "source", "rate", "bin", -F.col("n"))
    rest = _quartiles(spread.union(minus).groupBy("lang", "source", "rate", "bin").agg(F.sum("n").alias("n")), "lang", "source")
    drawn = lambda a, b: {q: (F.col(f"{a}_total") * F.col(f"{a}_{q}") + WEIGHT * F.col(f"{b}_{q}")) / (F.col(f"{a}_total") + WEIGHT) for q in ("low", "high")}
    named_as = lambda df, x: df.select([F.col(c).alias(f"{x}_{c}") for c in df.columns])
    same = lambda a, b, *keys: functools.reduce(lambda p, q: p & q, (F.col(f"{a}_{k}").eqNullSafe(F.col(f"{b}_{k}")) for k in (*keys, "rate")))
    # One row for each language, source and rate.
    lang = named_as(lang, "l").join(named_as(every, "a"), F.col("l_rate") == F.col("a_rate")).withColumns({f"raw_{q}": F.col(f"l_{q}") for q in ("low", "high")})
    lang = lang.withColumns({f"l_{q}": e for q, e in drawn("l", "a").items()})
    raw = {f"r_{q}": F.coalesce(f"r_{q}", f"raw_{q}") for q in ("low", "high")}
    both = named_as(own, "g").join(lang, same("g", "l", "lang")).join(named_as(rest, "r"), same("g", "r", "lang", "source"), "left").withColumns(raw)
    both = both.withColumns({f"g_{q}": e for q, e in drawn("g", "l").items()})
    margin = F.element_at(F.create_map(*(F.lit(x) for r, (_, m) in RATES.items() for x in (r, m))), F.col("g_rate"))
    limit = lambda x: F.col(f"{x}_high") + F.greatest(margin, SPREAD * (F.col(f"{x}_high") - F.col(f"{x}_low")))
    mark = F.least(limit("g"), limit("r") + CEILING * margin)
    return both.groupBy(F.col("g_lang").alias("lang"), F.col("g_source").alias("source")).agg(*(F.max(F.when(F.col("g_rate") == r, mark)).alias(f"max_{r}") for r in RATES))


def judge(counts: DataFrame) -> DataFrame:
    """Adds base_failed, each rate's threshold and kept.

    The sketches of language and source are sums by partial aggregation, so a hot source costs one row a task
    and bin, and the same rows give the same verdicts in any order. Null language and null source are groups of their
    own; a group whose documents all fail the base rule has no thresholds; repeated rows count each; no rows give none.
    """
    rated = counts.withColumns({r: F.expr(f"double({sql})") for r, (sql, _) in RATES.items()})
    rated = rated.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))
    limits = thresholds(rated.filter("NOT base_failed")).withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    joined = rated.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left").drop("g_lang", "g_source")
    passes = F.lit(True)
    for r in RATES:
        passes = passes & F.coalesce(F.col(r) <= F.col(f"max_{r}"), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & passes)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The counts are read twice, for the sketches and for the verdicts.
    counts = cut(quality_counts(table(spark, sf_dir, "documents")))
    return judge(counts).select("doc_id", *COUNTS, "base_failed", "kept", *(F.round(f"max_{r}", 6).alias(f"max_{r}") for r in RATES))


ORACLE = _oracle()
