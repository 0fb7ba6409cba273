"""Removal of repeated passages by prefix-free parsing.

Rolling-hash triggers cut every document into phrases: the starts p whose window of WINDOW rolling
hashes has its minimum at the same trigger. A phrase with the LENGTH - 1 bytes after it is a dictionary
entry, and the parse says where each entry comes. Equal entries are one, so their later places in the
parse are settled at once. Entries that share the text at their trigger with others meet in one task, which
sorts their suffixes into a suffix array, cut at LENGTH bytes; with the places from the parse, suffixes
next to each other that agree on LENGTH bytes come in corpus order, and all but the first are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bytes import BLOCK, U64, Rolling, blocks, mix, strings
from ._common import chunk_count, named, ordered, shuffle_partitions, table, text_bytes

LENGTH = 100
#: Bytes of a rolling hash and hashes of a window: a window lies within any LENGTH bytes.
GRAM, WINDOW = 12, 61
#: All strings of LENGTH bytes with the same trigger share so many bytes from it on.
SHARED = LENGTH + 1 - WINDOW
#: A trigger text with more dictionary entries than this in a chunk, or in all, is hot: each suffix is dealt by its own hash.
HOT = 64
#: Text bytes of a task where that needs more tasks than the session's shuffle partitions.
PART_BYTES = 64 << 20
#: Longer documents are parsed in segments, which only cuts a phrase in two.
SEGMENT = 1 << 22
_AT = (1 << 24) - 1
_ROW = 40

DUPLICATE, OPEN, OPEN_HOT = 1, 2, 3


def phrases(data: np.ndarray, at: np.ndarray) -> tuple[Rolling, np.ndarray, np.ndarray, np.ndarray]:
    """Rolling hashes; first and last start of each phrase, and its trigger."""
    rolling, n = Rolling(data), len(data)
    if n < LENGTH:
        return rolling, *(np.zeros(0, np.int64) for _ in range(3))
    p = np.arange(n - GRAM + 1)
    # The position in the low bits makes the first of equal hashes the minimum.
    low = (mix((rolling.sums[p + GRAM] - rolling.sums[p]) * rolling.down[p]) & U64(2**64 - 1 - _AT)) | p.astype(U64)
    width = 1
    while 2 * width <= WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < WINDOW:
        low = np.minimum(low[: width - WINDOW], low[WINDOW - width :])
    inside = np.zeros(n + 1, np.int8)
    long = np.diff(at) >= LENGTH
    np.add.at(inside, at[:-1][long], 1)
    np.add.at(inside, at[1:][long] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[: len(low)], dtype=np.int8))
    trigger = (low[starts] & U64(_AT)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    return rolling, starts[first], starts[np.append(first[1:], len(starts)) - 1] if len(first) else first, trigger[first]


def _parts(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Bytes, offsets, each piece's place as row << _ROW | offset in the row's text, and the place after them."""
    for lo, hi, data, at in blocks(group["text"], min(BLOCK, SEGMENT)):
        if hi == lo + 1 and len(data) > SEGMENT:
            for s in range(0, len(data) - LENGTH + 1, SEGMENT):
                part = data[s : s + SEGMENT + LENGTH - 1]
                yield part, np.array([0, len(part)]), np.array([lo << _ROW | s]), lo << _ROW | s + SEGMENT
        else:
            yield data, at, np.arange(lo, hi) << _ROW, hi << _ROW


class Parse:
    """The phrases of a chunk in order of rows and offsets, and what the chunk alone shows of them."""

    def __init__(self, group: pa.Table):
        self.group = group.sort_by("at")
        found = []
        for data, at, place, _ in _parts(self.group):
            rolling, s, e, t = phrases(data, at)
            piece = np.searchsorted(at, s, "right") - 1
            found.append((place[piece] + s - at[piece], e - s + 1, rolling(t, t + SHARED), rolling(s, e + LENGTH)))
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64))
        self.places, self.n, self.key, self.entry = (np.concatenate(x) for x in zip(empty, *found))
        first = np.zeros(len(self.places), bool)
        first[np.unique(self.entry, return_index=True)[1]] = True
        keys, where, times = np.unique(self.key[first], return_inverse=True, return_counts=True)
        self.hot_keys = keys[times > HOT]
        self.status = np.where(first, 0, DUPLICATE).astype(np.uint8)
        self.status[np.flatnonzero(first)[times[where] > HOT]] = OPEN_HOT
        self.rows = self.group["at"].to_numpy()

    def position(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and offset, which order all places."""
        return self.rows[place >> _ROW], place & (1 << _ROW) - 1

    def place(self, at: np.ndarray, offset: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.rows, at) << _ROW | offset


def _table(**columns: np.ndarray) -> pa.Table:
    return pa.table({k: pa.array(v.view(np.int64) if v.dtype == U64 else v) for k, v in columns.items()})


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Values of these sizes that follow each other in data."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _entries(group: pa.Table) -> pa.Table:
    """Each chunk's dictionary entries, those of hot triggers left out but for a mark (offset -1)."""
    parse = Parse(group)
    sent, hot = parse.status == 0, parse.hot_keys
    at, offset = parse.position(parse.places[sent])
    none = np.full(len(hot), -1, np.int64)
    return _table(key=np.concatenate([parse.key[sent], hot]), entry=np.concatenate([parse.entry[sent], np.zeros(len(hot), U64)]), at=np.concatenate([at, none]), offset=np.concatenate([offset, none]))


def _classed(entries: DataFrame) -> DataFrame:
    """at, offset, status of entries that came before (DUPLICATE), or share a trigger text with other entries.

    An entry is told by the hashes of its trigger text and of itself, 128 bits.
    """
    same, shared = Window.partitionBy("key", "entry").orderBy("at", "offset"), Window.partitionBy("key")
    rows = entries.repartition("key").withColumn("first", (F.row_number().over(same) == 1) & (F.col("offset") >= 0))
    rows = rows.withColumns({"times": F.sum(F.col("first").cast("int")).over(shared), "marked": F.min("offset").over(shared) < 0})
    status = F.when(~F.col("first"), DUPLICATE).when((F.col("times") > HOT) | F.col("marked"), OPEN_HOT).when(F.col("times") > 1, OPEN).otherwise(0)
    return rows.filter("offset >= 0").select("at", "offset", status.alias("status")).filter("status > 0")


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then those of the next."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _first_of_equals(by: np.ndarray, place: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which of the strings of LENGTH bytes (rows of text, by their hashes) come first by place."""
    order = np.lexsort((place, by))
    new = np.ones(len(order), bool)
    new[1:] = by[order[1:]] != by[order[:-1]]
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    first = np.zeros(len(order), bool)
    first[order] = new | (text[order] != text[head]).any(1)
    return first


def _suffixes(group: pa.Table, told: pa.Table) -> pa.Table:
    """The open dictionary entries, dealt by their trigger text, and (text null) the ranges of starts that are settled."""
    parse = Parse(group)
    if len(told):
        parse.status[np.searchsorted(parse.places, parse.place(told["at"].to_numpy(), told["offset"].to_numpy()))] = told["status"].to_numpy()
    entries, hot = [], []
    settled = [(parse.places[parse.status == DUPLICATE], parse.n[parse.status == DUPLICATE])]
    for data, at, place, end in _parts(parse.group):
        lo, hi = np.searchsorted(parse.places, [place[0], end])
        for status in (OPEN, OPEN_HOT):
            own = np.flatnonzero(parse.status[lo:hi] == status) + lo
            if not len(own):
                continue
            piece = np.searchsorted(place, parse.places[own], "right") - 1
            begin, n, where = parse.places[own] - place[piece] + at[piece], parse.n[own], parse.places[own]
            if status == OPEN:
                entries.append((parse.key[own], where, n, data[_spread(begin, n + LENGTH - 1)]))
                continue
            # An entry for each suffix, dealt by the suffix itself; the chunk asks once for each.
            where, begin = _spread(where, n), _spread(begin, n)
            by = Rolling(data)(begin, begin + LENGTH)
            text = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[begin]
            first = _first_of_equals(by, where, text)
            hot.append((by[first], where[first], text[first]))
            settled.append((where[~first], np.ones(int((~first).sum()), np.int64)))
    if hot:
        by, where, text = (np.concatenate(x) for x in zip(*hot))
        first = _first_of_equals(by, where, text) if len(hot) > 1 else np.ones(len(by), bool)
        settled.append((where[~first], np.ones(int((~first).sum()), np.int64)))
        entries.append((by[first], where[first], np.ones(int(first.sum()), np.int64), text[first].ravel()))
    out = []
    for by, where, n, text in entries:
        at, offset = parse.position(where)
        out.append(_table(by=by, at=at, offset=offset, n=n).append_column("text", _binary(text, n + LENGTH - 1)))
    where, n = (np.concatenate(x) for x in zip(*settled))
    order = np.argsort(where, kind="stable")
    at, offset, n = _merged(*parse.position(where[order]), n[order])
    out.append(_table(by=mix(at.view(U64)), at=at, offset=offset, n=n).append_column("text", pa.nulls(len(at), pa.binary())))
    return pa.concat_tables(out)


def _merged(at: np.ndarray, offset: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of starts, in order, with those that adjoin made one."""
    if not len(at):
        return at, offset, n
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (offset[1:] != offset[:-1] + n[:-1])
    first = np.flatnonzero(new)
    return at[first], offset[first], np.add.reduceat(n, first)


def _repeats(text: np.ndarray, starts: np.ndarray, at: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Which of the suffixes of text at starts agree on LENGTH bytes with one that comes earlier by at and offset."""
    order = np.lexsort((offset, at))
    suffixes = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[starts[order]].view(f"V{LENGTH}").ravel()
    array = np.argsort(suffixes, kind="stable")  # the suffix array; equals stay in corpus order
    ranked = suffixes[array]
    later = np.zeros(len(order), bool)
    later[order[array[1:]]] = ranked[1:] == ranked[:-1]
    return later


def _later(asked: pa.Table, seen: set[bytes]) -> pa.Table:
    """Ranges of starts in whole entries whose suffix comes earlier, in these or (entries of one suffix) in those seen."""
    at, offset, n = (asked[c].to_numpy() for c in ("at", "offset", "n"))
    text, cut = strings(asked["text"])
    entry = np.repeat(cut[:-1], n)
    at, offset, starts = np.repeat(at, n), _spread(offset, n), entry + _spread(np.zeros(len(n), np.int64), n)
    later = _repeats(text, starts, at, offset)
    if seen:
        later |= np.array([text[s : s + LENGTH].tobytes() in seen for s in starts])
    order = np.flatnonzero(later)[np.lexsort((offset[later], at[later]))]
    at, offset, n = _merged(at[order], offset[order], np.ones(len(order), np.int64))
    return _table(at=at, offset=offset, n=n)


def _removed(batches):
    """Rows come by `by`, at and offset; ranges of starts whose suffix also starts earlier.

    Entries of one trigger text are few and held together. Those of one hot suffix may be many: they are
    worked off batch by batch, and the suffixes seen are remembered.
    """
    names = ["at", "offset", "n"]
    held, seen, name = [], set(), None

    def work(rows: pa.Table, by):
        nonlocal seen, name
        if by != name:
            seen, name = set(), by
        if len(rows):
            # What was remembered belongs to the first rows alone; texts of other groups differ from it.
            yield from _later(rows, seen).to_batches()

    for b in batches:
        rows = pa.Table.from_batches([b])
        yield from rows.filter(pc.is_null(rows["text"])).select(names).to_batches()
        rows = rows.filter(pc.is_valid(rows["text"]))
        if not len(rows):
            continue
        rows = pa.concat_tables([*held, rows]).combine_chunks()
        by = rows["by"].to_numpy()
        tail = int(np.searchsorted(by, by[-1]))
        if len(rows) - tail > 4 * HOT and (rows["n"].to_numpy()[tail:] == 1).all():
            yield from work(rows, by[0])
            if name != by[-1]:
                seen, name = set(), by[-1]
            text, cut = strings(rows["text"].slice(tail))
            seen |= {text[s : s + LENGTH].tobytes() for s in cut[:-1]}
            held = []
        else:
            yield from work(rows.slice(0, tail), by[0])
            held = [rows.slice(tail)]
    if held:
        yield from work(held[0], held[0]["by"][0].as_py())


def _cleared(group: pa.Table, ranges: pa.Table) -> pa.Table:
    group = group.sort_by("at")
    row = np.searchsorted(group["at"].to_numpy(), ranges["at"].to_numpy())
    order = np.argsort(row, kind="stable")
    row, start, n = row[order], ranges["offset"].to_numpy()[order], ranges["n"].to_numpy()[order]
    cut = np.searchsorted(row, np.arange(len(group) + 1))
    kept, sizes, removed, spans = [], [], [], []
    for lo, hi, data, at in blocks(group["text"]):
        for i in range(lo, hi):
            own = data[at[i - lo] : at[i - lo + 1]]
            s, m = start[cut[i] : cut[i + 1]], n[cut[i] : cut[i + 1]]
            sizes.append(len(own))
            if len(s):
                cover = np.zeros(len(own) + 1, np.int32)
                np.add.at(cover, s, 1)
                np.add.at(cover, s + m + LENGTH - 1, -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                own = own[~gone]
            else:
                removed.append(0)
                spans.append(0)
            kept.append(own.tobytes())
    count = lambda x: pa.array(x, pa.int64())
    return pa.table({"doc_id": group["doc_id"], "kept": pa.array(kept, pa.binary()), "n_bytes": count(sizes), "n_removed": count(removed), "n_spans": count(spans), "kept_sha256": pa.array([sha256(k).hexdigest() for k in kept], pa.string())})


def drop_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (bytes that stay), n_bytes, n_removed, n_spans, kept_sha256: one row a row of docs.

    A byte goes if a string of LENGTH bytes that covers it also starts earlier in the table, in a smaller
    doc_id or earlier in the same document. Texts are shuffled once and read three times; else a row for each
    distinct entry of a chunk travels, and the text of open entries, so all exchanges grow in proportion to
    the texts. The entries at a trigger that many share are dealt suffix by suffix. Null and empty texts
    lose nothing; of rows that repeat a doc_id, as of those with a null one, which come last, those later in the
    table count as later; texts shorter than LENGTH bytes stay; an empty table gives no rows.
    """
    size = text_bytes(docs)
    chunk = F.pmod(F.xxhash64("at"), F.lit(chunk_count(docs, size))).cast("int")
    parts = max(shuffle_partitions(docs.sparkSession), size // PART_BYTES)
    dealt = ordered(docs).withColumn("chunk", chunk).repartition(parts, "chunk")
    by_chunk = lambda df: df.withColumn("chunk", chunk).groupBy("chunk")
    told = _classed(dealt.groupBy("chunk").applyInArrow(_entries, "key long, entry long, at long, offset long"))
    asked = dealt.groupBy("chunk").cogroup(by_chunk(told)).applyInArrow(_suffixes, "by long, at long, offset long, n long, text binary")
    ranges = asked.repartition("by").sortWithinPartitions("by", "at", "offset").mapInArrow(_removed, "at long, offset long, n long")
    return named(dealt.groupBy("chunk").cogroup(by_chunk(ranges)).applyInArrow(_cleared, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
