"""Framed archives of any size, read by byte ranges: each range finds its first record itself, and the ranges are checked against each other.

A range holds the records that begin in it. Where it begins within a record, its reader looks for the first place from which
frames follow each other to the end of the range. Text inside a record may look like frames, so the ranges are met
once without their contents: where a range does not begin where the one before it ended, its file is read from its start by one task.
Records are thus those of a reader of the whole file, whatever the ranges are.
"""

from __future__ import annotations

import json
import struct
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Bytes of a range; ranges of all files, which grow where that would be more; bytes read at a time; records that must follow a found one; largest record that is looked for.
RANGE_BYTES, MOST_RANGES, WINDOW, FOLLOWING, LONGEST = 256 << 20, 1 << 17, 1 << 20, 8, 64 << 20
#: A message has its head and its end at least.
LEAST_MESSAGE = 12
RECORDS = "path string, rec_no long, offset long, size long, edition int, centre int, code int, record binary"
RANGES = "path string, start long, first long, next long, records long, bytes long"
PARTS = "file string, part long, name string, records long"
#: Bytes of a batch of records; rows of a written part, about.
BATCH, PART_ROWS = 8 << 20, 1 << 17


class Broken(ValueError):
    """Frames that do not fit each other."""


class Bytes:
    """A file's bytes at any place, read in windows."""

    def __init__(self, file, size: int):
        self.file, self.size, self.lo, self.held = file, size, 0, b""

    def at(self, start: int, n: int) -> bytes:
        """Up to n bytes from start, fewer at the end of the file."""
        if start >= self.lo and 0 <= n <= self.lo + len(self.held) - start:
            return self.held[start - self.lo : start - self.lo + n]
        n = max(0, min(n, self.size - start))
        if not n:
            return b""
        if n > WINDOW:
            self.file.seek(start)
            return self.file.read(n)
        if start < self.lo or start + n > self.lo + len(self.held):
            self.file.seek(start)
            self.lo, self.held = start, self.file.read(min(WINDOW, self.size - start))
        return self.held[start - self.lo : start - self.lo + n]

    def number(self, start: int, n: int) -> int:
        return int.from_bytes(self.at(start, n), "big")

    def window(self, start: int) -> tuple[bytes, int]:
        """Bytes from start or before, of a window's length or up to the end of the file where fewer than half of one are held, and where they begin."""
        if start < self.lo or start + WINDOW // 2 > self.lo + len(self.held) < self.size:
            self.held = b""
            self.at(start, 1)
        return self.held, self.lo

    def find(self, mark: bytes, start: int, end: int) -> int:
        """The first place from start to end where the mark begins, or -1; nothing is copied."""
        while start < end and len(self.at(start, len(mark))) == len(mark):
            ahead = min(end + len(mark) - 1, self.lo + len(self.held))
            place = self.held.find(mark, start - self.lo, ahead - self.lo)
            if place >= 0:
                return self.lo + place
            start = ahead - len(mark) + 1
        return -1


@dataclass
class Found:
    """A record: where it begins, the places and lengths of its parts, and what its head says."""

    offset: int
    parts: list[tuple[int, int]]
    head: tuple[int | None, int | None, int | None] = (None, None, None)

    @property
    def size(self) -> int:
        return sum(n for _, n in self.parts)


@dataclass
class Some:
    """Records in their order: where they begin, their sizes and heads, and the places and lengths of all their parts."""

    offsets: list[int]
    sizes: list[int]
    starts: list[int]
    lengths: list[int]
    heads: list[tuple] | None = None


def some(records: Iterator[Found]) -> Iterator[Some]:
    """Found records, BATCH bytes or 8192 of them at a time, about."""
    made, held = Some([], [], [], [], []), 0
    for r in records:
        size = r.size
        made.offsets.append(r.offset)
        made.sizes.append(size)
        made.heads.append(r.head)
        for start, n in r.parts:
            made.starts.append(start)
            made.lengths.append(n)
        held += size
        if held >= BATCH or len(made.sizes) == 8192:
            yield made
            made, held = Some([], [], [], [], []), 0
    if made.sizes:
        yield made


class _Chained:
    """Frames without anything between them."""

    def after(self, data: Bytes, at: int) -> int | None:
        """End of the frame at `at`; None where the file ends."""
        raise NotImplementedError

    def likely(self, data: Bytes, start: int, end: int) -> Iterator[int]:
        """Places from start to end where a frame may begin, in order."""
        raise NotImplementedError

    def first(self, data: Bytes, start: int, end: int) -> int | None:
        if start == 0:
            return 0
        return next((p for p in self.likely(data, start, end) if self._holds(data, p, end)), None)

    def _holds(self, data: Bytes, at: int, end: int) -> bool:
        """Whether frames follow from `at` past the end of the range, and FOLLOWING more or the end of the file."""
        beyond = 0
        try:
            while beyond < FOLLOWING:
                after = self.after(data, at)
                if after is None:
                    return True
                at, beyond = after, beyond + (after >= end)
        except Broken:
            return False
        return True

    def next(self, data: Bytes, at: int, end: int) -> int:
        """The first frame at or after end, from one at `at`."""
        while at < end and (after := self.after(data, at)) is not None:
            at = after
        return at

    def some(self, data: Bytes, at: int, end: int) -> Iterator[Some]:
        """What `records` gives, many at a time."""
        return some(self.records(data, at, end))

    def scan(self, data: Bytes, at: int, end: int) -> tuple[int, int]:
        """What `next` gives, and how many records begin from `at` to end."""
        return self.next(data, at, end), sum(len(x.sizes) for x in self.some(data, at, end))


class Fortran(_Chained):
    """Records between two big-endian lengths of four bytes. The rest of a file below eight bytes is left.

    Empty records are read but not looked for, since runs of zeros look like them.
    """

    LENGTH = struct.Struct(">I")

    def after(self, data, at):
        if at + 8 > data.size:
            return None
        n = data.number(at, 4)
        if at + 8 + n > data.size or data.number(at + 4 + n, 4) != n:
            raise Broken(f"the record at byte {at}: its two lengths differ")
        return at + 8 + n

    def likely(self, data, start, end):
        for lo in range(start, end, WINDOW - 4):
            raw = np.frombuffer(data.at(lo, min(WINDOW, end + 3 - lo)), np.uint8).astype(np.int64)
            if len(raw) < 4:
                return
            size = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
            tail = np.arange(len(size)) + 4 + size
            fits = (size > 0) & (size <= LONGEST) & (lo + tail + 4 <= data.size)
            inside = fits & (tail < len(size))
            fits[inside] = size[tail[inside]] == size[inside]
            for p in np.flatnonzero(fits[: end - lo]).tolist():
                yield lo + p

    def _holds(self, data, at, end):
        try:
            return super()._holds(data, self.scan(data, at, end)[0], end)
        except Broken:
            return False

    def scan(self, data, at, end):
        n = 0
        for x in self.some(data, at, end):
            at, n = x.starts[-1] + x.sizes[-1] + 4, n + len(x.sizes)
        return at, n

    def records(self, data, at, end):
        for x in self.some(data, at, end):
            yield from (Found(*f) for f in zip(x.offsets, ([p] for p in zip(x.starts, x.sizes))))

    def some(self, data, at, end):
        number = self.LENGTH.unpack_from
        while at < end and at + 8 <= data.size:
            held, lo = data.window(at)
            p, stop, last, places, sizes = at - lo, end - lo, len(held) - 4, [], []
            while p < stop and p < last:
                n = number(held, p)[0]
                behind = p + 4 + n
                if behind > last or number(held, behind)[0] != n:
                    break
                places.append(lo + p)
                sizes.append(n)
                p = behind + 4
            if not places:
                # Longer than a window, or broken.
                p = self.after(data, at) - lo
                places, sizes = [at], [p + lo - at - 8]
            yield Some(places, sizes, [x + 4 for x in places], sizes)
            at = lo + p


class Spanned(_Chained):
    """Variable records in blocks, as segments that are whole, first, last or in the middle."""

    #: Lengths of a block and of its first segment, and the segment's code.
    HEAD = struct.Struct(">HHHBB")

    def _segments(self, data: Bytes, at: int, after: int) -> list[tuple[int, int, int]]:
        """place, length and code of the segments of a block."""
        out, p = [], at + 4
        while p < after:
            size, code = data.number(p, 2), data.number(p + 2, 1)
            if size < 4 or code > 3 or p + size > after:
                raise Broken(f"the segment at byte {p} does not fit its block")
            out.append((p + 4, size - 4, code))
            p += size
        return out

    def _block(self, data: Bytes, at: int) -> tuple[int, list[tuple[int, int, int]]] | None:
        """End and segments of the block at `at`; None where the file ends."""
        if at + 4 > data.size:
            return None
        head = data.at(at, 8)
        if len(head) == 8:
            size, zero, held, code, _ = self.HEAD.unpack(head)
            if not zero and held + 4 == size and held >= 4 and code < 4 and at + size <= data.size:
                return at + size, [(at + 8, held - 4, code)]
        size = data.number(at, 2)
        if size < 4 or data.number(at + 2, 2) or at + size > data.size:
            raise Broken(f"no block at byte {at}")
        return at + size, self._segments(data, at, at + size)

    def after(self, data, at):
        block = self._block(data, at)
        return block and block[0]

    def likely(self, data, start, end):
        for lo in range(start, end, WINDOW - 8):
            raw = np.frombuffer(data.at(lo, min(WINDOW, end + 7 - lo)), np.uint8).astype(np.int64)
            if len(raw) < 8:
                return
            n = len(raw) - 7
            block, segment = raw[:n] << 8 | raw[1 : n + 1], raw[4 : n + 4] << 8 | raw[5 : n + 5]
            fits = (block > 4) & (raw[2 : n + 2] == 0) & (raw[3 : n + 3] == 0) & (segment >= 4) & (segment + 4 <= block) & (raw[6 : n + 6] < 4) & (raw[7:] == 0)
            for p in np.flatnonzero(fits[: end - lo]).tolist():
                yield lo + p

    def scan(self, data, at, end):
        n, held, behind = 0, False, None
        while at < end or held:
            if at >= end and behind is None:
                behind = at
            if (block := self._block(data, at)) is None:
                break
            for _, _, code in block[1]:
                if code < 2:
                    if at >= end:
                        return behind, n
                    held = True
                if held and code in (0, 2):
                    n, held = n + 1, False
            at = block[0]
        return at if behind is None else behind, n

    def records(self, data, at, end):
        held = None
        while (at < end or held) and (block := self._block(data, at)) is not None:
            after, segments = block
            for place, size, code in segments:
                if code in (0, 1):
                    if at >= end:
                        return
                    held = Found(place - 4, [])
                if held:
                    held.parts.append((place, size))
                    if code in (0, 2):
                        yield held
                        held = None
            at = after


class ControlWords(_Chained):
    """Words of 64 bits in blocks of 4096 bytes, which begin with a control word that has their number; others end records and files."""

    BLOCK, WORD = 4096, struct.Struct(">Q")

    def after(self, data, at):
        if at >= data.size:
            return None
        word = data.number(at, 8)
        if word >> 60 or word >> 9 & 0xFFFFFF != at // self.BLOCK & 0xFFFFFF:
            raise Broken(f"no block control word at byte {at}")
        return min(at + self.BLOCK, data.size)

    def likely(self, data, start, end):
        yield from range(-(-start // self.BLOCK) * self.BLOCK, end, self.BLOCK)

    def _words(self, data: Bytes, at: int) -> Iterator[tuple[int, int, int, int]]:
        """place, kind, unused bits and bytes of data behind each control word of a block."""
        after, p = self.after(data, at), at
        while p is not None and after is not None and p + 8 <= after:
            word = data.number(p, 8)
            kind = word >> 60
            if kind not in (0, 8, 14, 15) or (kind == 0 and p != at):
                raise Broken(f"unknown control word at byte {p}")
            ahead = min(8 * (word & 511), after - p - 8)
            yield p, kind, word >> 54 & 63, ahead
            p = None if kind == 15 else p + 8 + ahead

    def records(self, data, at, end):
        for x in self.some(data, at, end):
            k = 0
            for offset, size in zip(x.offsets, x.sizes):
                parts = []
                while size:
                    parts.append((x.starts[k], x.lengths[k]))
                    size, k = size - x.lengths[k], k + 1
                yield Found(offset, parts)

    def some(self, data, at, end):
        # A record begins behind the control word that ends the one before it, which may be the last of the block before.
        begun = at if at == 0 or self._closed(data, at - self.BLOCK) else None
        made, starts, lengths, held, number = Some([], [], [], []), [], [], 0, self.WORD.unpack_from
        while at < end or begun is not None:
            after = self.after(data, at)
            if after is None:
                break
            block = data.at(at, after - at)
            p, n = 0, after - at
            while p + 8 <= n:
                word = number(block, p)[0]
                kind = word >> 60
                if kind == 8:
                    if begun is not None:
                        if lengths:
                            lengths[-1] -= (word >> 54 & 63) // 8
                        size = sum(lengths)
                        made.offsets.append(begun)
                        made.sizes.append(size)
                        if size:
                            made.starts += starts
                            made.lengths += lengths
                        held += size
                elif kind == 15:
                    if made.sizes:
                        yield made
                    return
                elif kind not in (0, 14) or kind == 0 and p:
                    raise Broken(f"unknown control word at byte {at + p}")
                if kind:
                    if at >= end:
                        if made.sizes:
                            yield made
                        return
                    begun, starts, lengths = at + p + 8, [], []
                ahead = min(8 * (word & 511), n - p - 8)
                if ahead and begun is not None:
                    starts.append(at + p + 8)
                    lengths.append(ahead)
                p += 8 + ahead
            if at + self.BLOCK >= end and begun is not None and not lengths and self._closed(data, at):
                # What begins with the next block is its range's.
                break
            at += self.BLOCK
            if held >= BATCH or len(made.sizes) >= 8192:
                yield made
                made, held = Some([], [], [], []), 0
        if made.sizes:
            yield made

    def _closed(self, data: Bytes, at: int) -> bool:
        """Whether the last word of a block is a control word that ends a record or file."""
        *_, (place, kind, _, ahead) = self._words(data, at)
        return kind in (8, 14) and not ahead and place + 8 == at + self.BLOCK


class Equal(_Chained):
    """Records of one length; a shorter rest is a record."""

    def __init__(self, length: int):
        self.length = length

    def after(self, data, at):
        return min(at + self.length, data.size) if at < data.size else None

    def likely(self, data, start, end):
        yield from range(-(-start // self.length) * self.length, end, self.length)

    def _holds(self, data, at, end):
        return True

    def next(self, data, at, end):
        return min(data.size, at + -(-max(0, end - at) // self.length) * self.length)

    def records(self, data, at, end):
        for p in range(at, min(end, data.size), self.length):
            yield Found(p, [(p, min(self.length, data.size - p))])


class Marked:
    """Messages that begin with a mark, say how long they are and end with four sevens; what lies between is left."""

    MARK, HEAD = b"", 24

    def measure(self, raw: bytes) -> tuple[int, tuple] | None:
        """Length and head of the message of these first HEAD bytes; None where it is none."""
        raise NotImplementedError

    def _messages(self, data: Bytes, at: int, end: int) -> Iterator[tuple[int, int, tuple]]:
        """Messages that begin from `at` to end: place, length, head."""
        while (at := data.find(self.MARK, at, end)) >= 0:
            found = self.measure(data.at(at, self.HEAD))
            if found and found[0] >= LEAST_MESSAGE and at + found[0] <= data.size and data.at(at + found[0] - 4, 4) == b"7777":
                yield at, *found
                at += found[0]
            else:
                at += 4

    def first(self, data, start, end):
        return next((p for p, _, _ in self._messages(data, start, end)), None)

    def next(self, data, at, end):
        return self.scan(data, at, end)[0]

    def scan(self, data, at, end):
        n = 0
        for p, size, _ in self._messages(data, at, end):
            at, n = p + size, n + 1
        return at, n

    def records(self, data, at, end):
        for p, size, head in self._messages(data, at, end):
            yield Found(p, [(p, size)], head)

    def some(self, data, at, end):
        made, held = Some([], [], [], [], []), 0
        for p, size, head in self._messages(data, at, end):
            made.offsets.append(p)
            made.sizes.append(size)
            made.heads.append(head)
            held += size
            if held >= BATCH or len(made.sizes) == 8192:
                made.starts, made.lengths = made.offsets, made.sizes
                yield made
                made, held = Some([], [], [], [], []), 0
        made.starts, made.lengths = made.offsets, made.sizes
        if made.sizes:
            yield made


class Gridded(Marked):
    """Gridded messages of editions 1 and 2; code: parameter or discipline."""

    MARK = b"GRIB"

    def measure(self, raw):
        edition = raw[7] if len(raw) > 7 else 0
        if edition == 1:
            return _number(raw[4:7]), (1, _number(raw[12:13]), _number(raw[16:17]))
        if edition == 2:
            return _number(raw[8:16]), (2, _number(raw[21:23]), _number(raw[6:7]))
        return None


class Reported(Marked):
    """Messages of reports of editions 2 to 4; code: data category."""

    MARK = b"BUFR"

    def measure(self, raw):
        edition = raw[7] if len(raw) > 7 else 0
        if edition < 2:
            return None
        if edition >= 4:
            return _number(raw[4:7]), (edition, _number(raw[12:14]), _number(raw[18:19]))
        return _number(raw[4:7]), (edition, _number(raw[13:14]), _number(raw[16:17]))


def _number(raw: bytes) -> int:
    return int.from_bytes(raw, "big")


KINDS = {"f77": Fortran, "vbs": Spanned, "cos": ControlWords, "grib": Gridded, "bufr": Reported, "equal": Equal}


def kind_of(options: dict[str, str]):
    kind = options["kind"]
    return Equal(int(options["length"])) if kind == "equal" else KINDS[kind]()


@dataclass
class Range(InputPartition):
    path: str
    bytes: int
    start: int
    end: int
    first: int | None = None
    base: int = 0


def files_of(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files at or below a path or URI, hidden ones left out."""
    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    info = store.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
    scheme = path.partition("://")[0] + "://" if "://" in path else ""
    # A store without an authority in its paths gets that of the path asked for.
    root = path[: len(path) - len(at)] if path.endswith(at) else scheme
    return sorted((root + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def opened(path: str):
    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store.open_input_file(at)


_TESTS = {
    EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v,
}


class FramedReader(DataSourceReader):
    """Ranges alone, with option ranges, or the records of the ranges in option plan."""

    def __init__(self, options: dict[str, str]):
        self.options, self.tests = dict(options), []

    def __getstate__(self) -> dict:
        """A task has its own range and not the plan of all, which would grow with the square of the ranges."""
        return self.__dict__ | {"options": _bare(self.options)}

    def partitions(self) -> Sequence[Range]:
        if self.options.get("ranges") == "true":
            files = files_of(self.options["path"])
            size = max(int(self.options.get("rangebytes", RANGE_BYTES)), -(-sum(n for _, n in files) // MOST_RANGES), 1)
            made = [Range(path, n, lo, min(n, lo + size)) for path, n in files for lo in range(0, n, size)]
        else:
            made = [Range(*r) for r in json.loads(self.options["plan"])]
            made = [r for r in made if all(f(r) for f in self.tests if getattr(f, "of_range", False))]
        return made or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.bytes:
            return
        kind = kind_of(self.options)
        with opened(partition.path) as file:
            data = Bytes(file, partition.bytes)
            if self.options.get("ranges") == "true":
                first = kind.first(data, partition.start, partition.end)
                # A file that breaks off is told when it is read.
                try:
                    after, n = (None, 0) if first is None else kind.scan(data, first, partition.end)
                except Broken:
                    after, n = -1, 0
                yield pa.RecordBatch.from_pylist([{"path": partition.path, "start": partition.start, "first": first, "next": after, "records": n, "bytes": partition.bytes}], _arrow(RANGES))
            else:
                yield from self._records(kind, data, partition)

    def _records(self, kind, data: Bytes, r: Range) -> Iterator[pa.RecordBatch]:
        names, base, schema = [x.split()[0] for x in RECORDS.split(", ")], r.base, _arrow(RECORDS)
        tests = [(names.index(f.column), f) for f in self.tests if not getattr(f, "of_range", False)]
        for x in kind.some(data, r.first, r.end):
            n = len(x.sizes)
            heads = [list(c) for c in zip(*x.heads)] if x.heads is not None else [[None] * n] * 3
            columns = [[r.path] * n, list(range(base, base + n)), x.offsets, x.sizes, *heads]
            base += n
            # Heads that the pushed filters refuse are passed over before their contents are read.
            if tests:
                kept = [k for k in range(n) if all(columns[c][k] is not None and f(columns[c][k]) for c, f in tests)]
                columns = [[c[k] for k in kept] for c in columns]
                x = _chosen(x, kept)
            if x.sizes:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, schema)), _contents(data, x)], schema=schema)


def _chosen(x: Some, kept: list[int]) -> Some:
    """The records of these numbers."""
    first = np.searchsorted(np.cumsum(x.lengths), np.cumsum(x.sizes) - x.sizes, "right").tolist()
    starts, lengths = [], []
    for k in kept:
        left, p = x.sizes[k], first[k]
        while left:
            starts.append(x.starts[p])
            lengths.append(x.lengths[p])
            left, p = left - x.lengths[p], p + 1
    return Some([x.offsets[k] for k in kept], [x.sizes[k] for k in kept], starts, lengths)


def _contents(data: Bytes, x: Some) -> pa.BinaryArray:
    """The records' bytes: read as one where little lies between their parts, else part by part."""
    starts, lengths, sizes = (np.array(c, np.int64) for c in (x.starts, x.lengths, x.sizes))
    held = int(sizes.sum())
    if held >= 1 << 31:
        raise ValueError("records of 2 GB or more at a time do not fit a column")
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    lo, hi = (int(starts[0]), int(starts[-1] + lengths[-1])) if len(starts) else (0, 0)
    if not held:
        joined = b""
    elif hi - lo <= min(2 * held + (1 << 16), 1 << 30) and (np.diff(starts) >= lengths[:-1]).all():
        # Parts and what lies between them in turn; the parts are taken.
        cuts = np.empty(2 * len(starts), np.int32)
        cuts[::2], cuts[1::2] = starts - lo, starts + lengths - lo
        turns = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data.at(lo, hi - lo))])
        taken = turns.take(pa.array(np.arange(0, len(cuts) - 1, 2)))
        joined = taken.buffers()[2]
    else:
        joined = b"".join([data.at(p, n) for p, n in zip(x.starts, x.lengths)])
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(joined)])


@dataclass
class Test:
    """A comparison of a column with a value; of_range: one that whole ranges can be judged by."""

    column: str
    kind: type
    value: object
    of_range: bool = False

    def __call__(self, x) -> bool:
        if not self.of_range:
            return _TESTS[self.kind](x, self.value)
        if self.column == "path":
            return _TESTS[self.kind](x.path, self.value)
        # A record may begin up to a block behind its range's end.
        if self.kind in (GreaterThan, GreaterThanOrEqual):
            return x.end + (1 << 16) > self.value
        return x.start <= self.value


class PushedReader(FramedReader):
    """As FramedReader, with filters on heads, places and paths judged before contents are read."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        columns = {x.split()[0] for x in RECORDS.split(", ")} - {"record"}
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in columns:
                value = f.value
                self.tests.append(Test(f.attribute[0], type(f), value))
                if f.attribute[0] == "path" or f.attribute[0] == "offset" and type(f) is not In:
                    self.tests.append(Test(f.attribute[0], type(f), value, of_range=True))
            else:
                yield f


class FramedSource(DataSource):
    """format("aeolis_framed"), made by `framed_records`."""

    @classmethod
    def name(cls) -> str:
        return "aeolis_framed"

    def schema(self) -> str:
        return RANGES if self.options.get("ranges") == "true" else RECORDS

    def reader(self, schema) -> DataSourceReader:
        made = (PushedReader if self.options.get("push") == "true" else FramedReader)(self.options)
        # The source itself goes along with the reader.
        self.options = _bare(self.options)
        return made


def _bare(options: dict[str, str]) -> dict[str, str]:
    return {k: v for k, v in options.items() if k != "plan"}


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def framed(kind: str, most: int = 0):
    """A function that makes a file's bytes of an iterator of records, piece by piece; most: bytes of a segment of kind vbs."""

    def f77(records):
        for r in records:
            n = len(r).to_bytes(4, "big")
            yield n + r + n

    def vbs(records):
        size = most or 32752
        for r in records:
            pieces = [r[i : i + size] for i in range(0, len(r), size)] or [b""]
            for k, x in enumerate(pieces):
                code = 0 if len(pieces) == 1 else 1 if k == 0 else 2 if k == len(pieces) - 1 else 3
                yield (len(x) + 8).to_bytes(2, "big") + b"\0\0" + (len(x) + 4).to_bytes(2, "big") + bytes([code, 0]) + x

    def cos(records):
        """Control words stand at the start of a block and behind each record; each says how many words follow up to the next."""
        size = ControlWords.BLOCK // 8
        block, last, number = [0], 0, 0

        def put(word: int, control: bool):
            nonlocal block, last, number
            done = b""
            if len(block) == size:
                done = b"".join(w.to_bytes(8, "big") for w in block)
                number += 1
                block, last = [(number & 0xFFFFFF) << 9], 0
            if control:
                last = len(block)
            else:
                block[last] += 1
            block.append(word)
            return done

        for r in records:
            padded = r + b"\0" * (-len(r) % 8)
            words = [int.from_bytes(padded[i : i + 8], "big") for i in range(0, len(padded), 8)]
            yield b"".join([put(w, False) for w in words] + [put(8 << 60 | 8 * (-len(r) % 8) << 54, True)])
        yield put(14 << 60, True) + put(15 << 60, True)
        yield b"".join(w.to_bytes(8, "big") for w in block + [0] * (size - len(block)))

    return {"f77": f77, "vbs": vbs, "cos": cos}.get(kind, iter)


def _moved(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: int, after: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of data, each with so many zeros before and behind it, and where the pieces begin there."""
    ends = np.cumsum(sizes + before + after)
    places = ends - after - sizes
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    to, held = memoryview(out), memoryview(data)
    for start, size, place in zip(starts.tolist(), sizes.tolist(), places.tolist()):
        to[place : place + size] = held[start : start + size]
    return out, places


def _put(out: np.ndarray, places: np.ndarray, numbers: np.ndarray, kind: str) -> None:
    """Numbers written at places."""
    raw = np.ascontiguousarray(numbers.astype(kind)).view(np.uint8).reshape(len(numbers), -1)
    out[places[:, None] + np.arange(raw.shape[1])] = raw


def framed_batch(kind: str, records: pa.LargeBinaryArray, most: int = 0) -> Iterator[bytes | np.ndarray]:
    """What `framed` makes of the records, all at once. For kind cos their number, the words of each, and words without blocks, which `laid_blocks` reads."""
    ends = np.frombuffer(records.buffers()[1], np.int64)[records.offset : records.offset + len(records) + 1]
    held = records.buffers()[2]
    data, starts, sizes = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8), ends[:-1], np.diff(ends)
    if kind == "f77":
        if len(sizes) and sizes.max() >> 32:
            raise ValueError("a record of 4 GB or more has no length of four bytes")
        out, places = _moved(data, starts, sizes, 4, 4)
        _put(out, places - 4, sizes, ">u4")
        _put(out, places + sizes, sizes, ">u4")
        yield out
    elif kind == "vbs":
        size = most or 32752
        pieces = np.maximum(1, -(-sizes // size))
        of = np.repeat(np.arange(len(sizes)), pieces)
        k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lengths = np.minimum(size, sizes[of] - k * size)
        out, places = _moved(data, starts[of] + k * size, lengths, 8, 0)
        last = k == pieces[of] - 1
        code = np.where(pieces[of] == 1, 0, np.where(k == 0, 1, np.where(last, 2, 3)))
        _put(out, places - 8, (lengths + 8) << 48 | (lengths + 4) << 16 | code << 8, ">u8")
        yield out
    elif kind == "cos":
        pad = -sizes % 8
        out, places = _moved(data, starts, sizes, 0, pad + 8)
        _put(out, places + sizes + pad, np.uint64(8 << 60) | (8 * pad).astype(np.uint64) << np.uint64(54), ">u8")
        yield np.array([len(sizes)], ">i8")
        yield ((sizes + pad) // 8).astype(">i8")
        yield out
    else:
        yield data[int(ends[0]) : int(ends[-1])]


def laid_blocks(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    """Blocks of kind cos of (words of each record, words with a control word behind each record), and the ends of file and data.

    A control word says how many words follow up to the next one in its block, so a block is laid out once all its words are there.
    """
    room, number, words, controls = ControlWords.BLOCK // 8 - 1, 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def blocks(words, controls, ended):
        n = len(words) // room
        flags = np.zeros((n, room + 2), bool)
        flags[:, 0] = flags[:, -1] = True
        flags[controls // room, controls % room + 1] = True
        places = np.flatnonzero(flags)
        row, at = places // (room + 2), places % (room + 2)
        inside = at <= room
        ahead = np.diff(places, append=places[-1] + 1)[inside] - 1
        if ended:
            ahead[-1] = 0
        out = np.zeros((n, room + 1), np.uint64)
        out[:, 1:] = words.reshape(n, room)
        out[:, 0] = (np.arange(number, number + n).astype(np.uint64) & np.uint64(0xFFFFFF)) << np.uint64(9)
        out[row[inside], at[inside]] |= ahead.astype(np.uint64)
        return out.astype(">u8")

    for sizes, held in parts:
        controls = np.concatenate([controls, len(words) + np.cumsum(sizes + 1) - 1])
        words = np.concatenate([words, held.astype(np.uint64)])
        if n := len(words) // room:
            full = controls < n * room
            yield blocks(words[: n * room], controls[full], False)
            number += n
            words, controls = words[n * room :], controls[~full] - n * room
    controls = np.concatenate([controls, [len(words), len(words) + 1]])
    words = np.concatenate([words, np.array([14 << 60, 15 << 60], np.uint64)])
    yield blocks(np.concatenate([words, np.zeros(-len(words) % room, np.uint64)]), controls, True)


def _chunks(store, path: str, kind: str) -> Iterator:
    """What a written part holds, some of it at a time."""
    with store.open_input_stream(path, compression=None) as held:
        while kind == "cos" and (n := held.read(8)):
            sizes = np.frombuffer(held.read(8 * int.from_bytes(n, "big")), ">i8").astype(np.int64)
            yield sizes, np.frombuffer(held.read(8 * int(sizes.sum() + len(sizes))), ">u8")
        while kind != "cos" and (x := held.read(BATCH)):
            yield x


def write_framed(df: DataFrame, folder: str, kind: str, file: str, order: str, record: str = "record", most: int = 0) -> DataFrame:
    """path and records of a file for each value of column `file` (text that may name a file), its records framed in order; null records are left out.

    folder is a path or URI that all executors reach. Rows are sorted and framed in ranges of file and order, PART_ROWS in each, about, however few the files are;
    then a task a file puts its parts one behind the other as they are (kind cos: lays their words into blocks). Parts and files have a name of the attempt first,
    so that an attempt that is lost leaves no file of that name. Rows of df are counted first; the result is what the files hold and must be run once.
    """

    def store_of():
        return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)

    def parts(batches):
        from pyspark import TaskContext

        store, root = store_of()
        store.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        runs = ((name, x) for b in batches for name, x in _runs(b[file], b[record]))
        for name, held in groupby(runs, key=lambda x: x[0]):
            n, made = 0, f".{name}-{part}-{attempt}"
            with store.open_output_stream(f"{root}/{made}", compression=None) as out:
                for _, x in held:
                    n += len(x)
                    for piece in framed_batch(kind, x, most):
                        out.write(pa.py_buffer(piece))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((name, part, made, n), _arrow(PARTS).types)], schema=_arrow(PARTS))

    def files(batches):
        from pyspark import TaskContext

        store, root = store_of()
        attempt = TaskContext.get().taskAttemptId()
        rows = (r for b in batches for r in b.to_pylist())
        for name, held in groupby(rows, key=lambda r: r["file"]):
            made = list(held)
            names = [f"{root}/{r['name']}" for r in made]
            # Parts are deleted behind the file: without one of them an attempt before has made it.
            if all(i.type == fs.FileType.File for i in store.get_file_info(names)):
                whole = f"{root}/.{name}-{attempt}"
                if len(names) == 1 and kind != "cos":
                    whole = names[0]
                else:
                    with store.open_output_stream(whole, compression=None) as out:
                        pieces = (x for path in names for x in _chunks(store, path, kind))
                        for x in laid_blocks(pieces) if kind == "cos" else pieces:
                            out.write(pa.py_buffer(x))
                store.move(whole, f"{root}/{name}")
            elif store.get_file_info(f"{root}/{name}").type != fs.FileType.File:
                raise FileNotFoundError(f"parts of {name} are missing")
            for path in names:
                if store.get_file_info(path).type == fs.FileType.File:
                    store.delete_file(path)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [sum(r["records"] for r in made)]})

    n = df.count() // PART_ROWS + 1
    chosen = df.select(file, order, record).repartitionByRange(n, file, order).sortWithinPartitions(file, order).mapInArrow(parts, PARTS)
    # A number of partitions of its own, so that small rows that stand for long files are not put together in one task.
    apart = max(n, df.sparkSession.sparkContext.defaultParallelism)
    return chosen.repartition(apart, "file").sortWithinPartitions("file", "part").mapInArrow(files, "path string, records long")


def _runs(names: pa.Array, records: pa.Array) -> Iterator[tuple[str, pa.LargeBinaryArray]]:
    """A name and the records of each run of one name; rows without one of both are left out."""
    there = pc.and_(pc.is_valid(names), pc.is_valid(records))
    runs, records, start = pc.run_end_encode(names.filter(there).cast(pa.string())), records.filter(there).cast(pa.large_binary()), 0
    for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
        yield name, records.slice(start, end - start)
        start = end


def shared_folder(spark: SparkSession) -> str:
    """URI of a new folder below spark.checkpoint.dir, which must be set on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or (tempfile.mkdtemp(prefix="aeolis-") if spark.sparkContext.master.startswith("local") else None)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that all hosts share")
    base = base if "://" in base else "file://" + base.removeprefix("file:")
    return f"{base.rstrip('/')}/framed-{uuid.uuid4().hex}"


def ranges(spark: SparkSession, path: str, kind: str, range_bytes: int = RANGE_BYTES, length: int = 0) -> DataFrame:
    """path, start, first, next, records, bytes of each byte range: its first record, what follows its last one, and how many it holds."""
    spark.dataSource.register(FramedSource)
    return spark.read.format("aeolis_framed").options(path=path, kind=kind, ranges="true", rangebytes=str(range_bytes), length=str(length)).load()


def checked(found: list[tuple], kind: str) -> list[tuple]:
    """Ranges to read (path, bytes, start, end, first, base) of rows of `ranges`: as found where each range goes on where the one before it ended, else whole files."""
    by_path: dict[str, list[tuple]] = {}
    for row in sorted(found):
        by_path.setdefault(row[0], []).append(row)
    out, chained = [], issubclass(KINDS[kind], _Chained)
    for path, rows in by_path.items():
        size, ends = rows[0][5], [r[1] for r in rows[1:]] + [rows[0][5]]
        made, at, base, fits = [], 0, 0, True
        for (_, start, first, after, n, _), end in zip(rows, ends):
            if first is None:
                continue
            fits &= after >= 0 and (first == at if chained else first >= at)
            made.append((path, size, start, end, first, base))
            at, base = after, base + n
        # Frames that were lost sight of before the end.
        fits &= not chained or at + 8 > size
        out += made if fits else [(path, size, 0, size, 0, 0)]
    return out


def framed_records(spark: SparkSession, path: str, kind: str, range_bytes: int = RANGE_BYTES, length: int = 0) -> DataFrame:
    """path, rec_no, offset, size, edition, centre, code, record of the framed files at or below a path or URI.

    kind: f77, vbs, cos, grib, bufr, or equal with a length. Files of any size are read by many tasks; records and their numbers, from 0 in each file,
    are those of a reader of the whole file, and Broken ends the job where that fails. The heads of messages are in edition, centre and code,
    else null. With spark.sql.python.filterPushdown.enabled, filters that compare columns other than record with values are judged
    before contents are read, and those on path and offset before ranges are. Empty files have no records.
    """
    plan = checked([tuple(r) for r in ranges(spark, path, kind, range_bytes, length).collect()], kind)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    return spark.read.format("aeolis_framed").options(kind=kind, length=str(length), plan=json.dumps(plan), push=push).load()
