"""WARC archives: written as one gzip member a record, read back in sequence with every length and digest verified."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, looked_up, shared_folder, table

#: Bytes of payload from which equal payloads are stored once; compressed bytes after which an archive is closed; bytes read at a time; a record's header is at most so long.
LEAST_REPEATED, ARCHIVE_BYTES, PIECE, LONGEST_HEADER = 1000, 256 << 20, 1 << 16, 1 << 20
#: Repeated payloads that are broadcast (some 50 bytes each); more are joined by a shuffle.
BROADCAST_REPEATS = 1_000_000
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION, SAME_PAYLOAD, ENDED = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"\r\n\r\n"
WRITTEN = "path string, records long, bytes long"
READ = "path string, record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary"

ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), t AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM t
"""


class Damaged(ValueError):
    """An archive that breaks off, or a record whose lengths or digests do not hold."""


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def marked(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def member(headers: dict[str, str], block: bytes, level: int) -> bytes:
    """A record, its block's digest and length added, as a gzip member."""
    headers = headers | {"WARC-Block-Digest": marked(hashlib.sha1(block).digest()), "Content-Length": str(len(block))}
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    head = VERSION + "".join(f"\r\n{k}: {v}" for k, v in headers.items()).encode() + ENDED
    return z.compress(head) + z.compress(block) + z.compress(ENDED) + z.flush()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def written(page_id: int | None, url: str | None, payload: bytes, response: int | None, date: str, level: int) -> bytes:
    """A page's record: a revisit of the page `response` if that is given, else a response."""
    digest = hashlib.sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    identity = record_id(page_id, digest.hexdigest())
    # What would end a header's line or its value is escaped.
    uri = re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: f"%{ord(m[0]):02X}", url or "") or identity[1:-1]
    headers = {"WARC-Type": "response" if response is None else "revisit", "WARC-Record-ID": identity, "WARC-Date": date, "WARC-Target-URI": uri, "WARC-Payload-Digest": marked(digest.digest()), "Content-Type": "application/http;msgtype=response"}
    if response is None:
        return member(headers, http + payload, level)
    return member(headers | {"WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": record_id(response, digest.hexdigest())}, http, level)


class Reader:
    """The records of one archive in sequence; memory holds one record and a piece."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.rest = stream, b""

    def _pieces(self) -> Iterator[bytes]:
        """One member, piece by piece; zlib verifies its check sum and length."""
        z = zlib.decompressobj(wbits=31)
        while not z.eof:
            raw = self.rest or self.stream.read(PIECE)
            if not raw:
                raise Damaged("the archive breaks off within a record")
            self.rest = b""
            try:
                piece = z.decompress(raw)
            except zlib.error as e:
                raise Damaged(f"the member is damaged: {e}") from None
            if piece:
                yield piece
        self.rest = z.unused_data

    def __iter__(self) -> Iterator[Record]:
        while True:
            self.rest = self.rest or self.stream.read(PIECE)
            if not self.rest:
                return
            yield self._record()

    def _record(self) -> Record:
        pieces = self._pieces()
        head = b""
        while (end := head.find(ENDED)) < 0:
            if len(head) > LONGEST_HEADER or not (piece := next(pieces, b"")):
                raise Damaged("a record without the end of its header")
            head += piece
        version, *lines = head[:end].split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise Damaged("a record without a version")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
        try:
            length = int(headers["content-length"])
        except (KeyError, ValueError):
            raise Damaged("a record without its length") from None
        parts, got, digest, after = [], 0, hashlib.sha1(), b""
        piece = head[end + len(ENDED) :]
        while piece is not None:
            mine = piece[: max(0, length - got)]
            digest.update(mine)
            parts.append(mine)
            got += len(mine)
            after += piece[len(mine) :]
            piece = next(pieces, None)
        if got != length or after != ENDED:
            raise Damaged(f"a block of {got} bytes and {after[:8]!r} where {length} were told")
        if (told := headers.get("warc-block-digest")) and told != marked(digest.digest()):
            raise Damaged("a block that its digest does not fit")
        return Record(headers, b"".join(parts))


def opened(record: Record) -> tuple[bytes | None, int | None]:
    """Payload, verified against its digest, and its length of a response; a revisit has the length alone."""
    kind = record.headers.get("warc-type")
    if kind not in ("response", "revisit"):
        return None, None
    head, _, payload = record.block.partition(ENDED)
    told = re.search(rb"(?im)^content-length: *(\d+)", head)
    length = int(told[1]) if told else None
    if kind == "revisit":
        return None, length
    if length not in (None, len(payload)):
        raise Damaged(f"a payload of {len(payload)} bytes where {length} were told")
    if (digest := record.headers.get("warc-payload-digest")) and digest != marked(hashlib.sha1(payload).digest()):
        raise Damaged("a payload that its digest does not fit")
    return payload, len(payload)


def _hex(digest: str | None) -> str | None:
    return digest and base64.b32decode(digest.partition(":")[2]).hex()


def with_response(pages: DataFrame, broadcast_repeats: int = BROADCAST_REPEATS) -> DataFrame:
    """page_id, url, html (null: empty) and response: the largest page_id with the same payload, where that is another.

    Digests and ids alone are shuffled to find payloads that repeat; up to broadcast_repeats of them are broadcast, and
    beyond that pages meet them by a shuffle in which those with one payload are spread by their ids.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumn("key", F.when(F.octet_length("html") >= LEAST_REPEATED, F.unhex(F.sha2("html", 256))))
    repeats = rows.filter("key IS NOT NULL").groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("k"), "last")
    repeats = cut(repeats)
    if repeats.limit(broadcast_repeats + 1).count() <= broadcast_repeats:
        met = rows.join(F.broadcast(repeats), F.col("key") == F.col("k"), "left")
    else:
        met = looked_up(rows, "key", "page_id", repeats, "k", salts=32)
    return met.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("response"))


def write_archives(pages: DataFrame, folder: str | None = None, date: str = DATE, level: int = 6) -> DataFrame:
    """path, records and bytes of the archives written below folder, a URI that all executors reach (else spark.checkpoint.dir).

    A task streams its pages to archives of about ARCHIVE_BYTES, each begun by a warcinfo record. The names hold the attempt,
    and only archives that a task finished are in the result, which is kept: an attempt that is lost or repeated leaves a file that nothing
    names. Of equal payloads of LEAST_REPEATED bytes or more the one with the largest page_id is written whole, the others
    as revisits of it; rows that repeat that page_id are whole too. A null page_id is smaller than any, a null html is
    empty, a null or empty url is that of the record; other columns are ignored; no rows give no archive.
    """
    folder = f"{folder or shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        done, out, path, n, size = [], None, None, 0, 0
        try:
            for b in batches:
                for page_id, url, html, response in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html", "response"))):
                    if out is None:
                        name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done)}.warc.gz"
                        store.create_dir(root, recursive=True)
                        path, n, size = f"{folder}/{name}", 1, 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                        info = member({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:x-archive:{name}>", "WARC-Date": date, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n", level)
                        size += out.write(info)
                    size += out.write(written(page_id, url, html.encode(), response, date, level))
                    n += 1
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        out = done.append((path, n, size))
            if out is not None:
                out.close()
                out = done.append((path, n, size))
        finally:
            if out is not None:
                out.close()
        paths, records, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    return cut(with_response(pages).mapInArrow(run, WRITTEN))


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in column `path`, in sequence, each verified; Damaged ends the job where one does not hold.

    record_type, record_id, target_uri, date and refers_to as written, payload_digest in lower-case hex, payload_bytes and, if payloads, the
    payload of responses; null where a record has none. An archive is read by one task, in pieces of PIECE bytes.
    """

    def run(batches):
        kinds = [pa.string()] * 7 + [pa.int64(), pa.binary()]
        names = [x.split()[0] for x in READ.split(", ")]
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        for b in batches:
            for path in b["path"].to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None, buffer_size=0) as stream:
                    for record in Reader(stream):
                        payload, length = opened(record)
                        of = record.headers.get
                        rows.append((path, of("warc-type"), of("warc-record-id"), of("warc-target-uri"), of("warc-date"), of("warc-refers-to"), _hex(of("warc-payload-digest")), length, payload if payloads else None))
                        held += len(record.block) if payloads else 0
                        if len(rows) == 4096 or held > 16 << 20:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    return archives.select("path").mapInArrow(run, READ)


def digest(records: DataFrame) -> DataFrame:
    """A row for each page of archives that write_archives made."""
    page = lambda c: F.nullif(F.element_at(F.split(c, ":"), 3), F.lit("")).cast("long")
    return records.filter(F.col("record_type").isin("response", "revisit")).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read_archives(write_archives(table(spark, sf_dir, "pages")), payloads=False))
