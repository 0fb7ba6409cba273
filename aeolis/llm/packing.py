"""Packing: sum-of-squares online bin packing of tokenized documents into training sequences."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, named, table

LENGTH = 4096
END = 2
#: Tokens that one task packs and holds at a time.
GROUP_TOKENS = 1 << 21
#: Parts of texts whose ids a Python worker keeps.
MOST_PARTS = 400_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Ids:
    """Token ids of texts as little-endian 32-bit bytes.

    Where the tokenizer's file says that it lowers a text, splits it by PATTERN and ends each part's last token by ENDED, a text of
    printable Latin letters and white space is split here in the same way, and only parts not met before
    are tokenized; any other text, and with other files every text, is tokenized as it is.
    """

    #: Fixed values of the tokenizer whose parts are remembered.
    NORMALIZERS, PATTERN, ENDED, ADDED = ["NFC", "Replace", "Lowercase"], "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+", "</w>", "<|"

    OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-\u012f\u0131-\u017e]|<\|")
    # The pattern of the tokenizer file for these characters, lowered.
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-\u017e]+|[0-9²³¹¼½¾]|[^\s0-9a-zªµºß-öø-\u017e²³¹¼½¾]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.parts = Tokenizer.from_file(path), {}
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a part
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith(self.ENDED)
        self.split = self._splits(json.loads(self.tokenizer.to_str()))

    def _splits(self, file: dict) -> bool:
        """Whether the file's texts are split as PARTS splits them."""
        normal, before = file["normalizer"] or {}, file["pre_tokenizer"] or {}
        steps, first = normal.get("normalizers", []), (before.get("pretokenizers") or [{}])[0]
        return (
            [x["type"] for x in steps] == self.NORMALIZERS and steps[1]["pattern"] == {"Regex": "\\s+"} and steps[1]["content"] == " "
            and first.get("pattern") == {"Regex": self.PATTERN} and first.get("behavior") == "Removed" and first.get("invert") is True
            and [x["type"] for x in before["pretokenizers"][1:]] == ["ByteLevel"] and not before["pretokenizers"][1]["add_prefix_space"] and not before["pretokenizers"][1]["use_regex"]
            and file["model"]["type"] == "BPE" and file["model"].get("end_of_word_suffix") == self.ENDED and not file["model"].get("ignore_merges") and file["post_processor"] is None
            and all(x["content"].startswith(self.ADDED) for x in file["added_tokens"])
        )

    def _learn(self, parts: list[str]) -> None:
        for i in range(0, len(parts), 4096):
            some = parts[i : i + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
                self.parts.update(zip(some, (raw[x:y] for x, y in zip(at, at[1:]))))
            else:
                self.parts.update((p, self._whole(p)) for p in some)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [None if not self.split or self.OTHER.search(t) else self.PARTS.findall((t if t.isascii() else unicodedata.normalize("NFC", t)).lower()) for t in texts]
        if len(self.parts) > MOST_PARTS:
            # Common parts are met early, so the older half stays.
            self.parts = dict(islice(self.parts.items(), MOST_PARTS // 2))
        if new := set().union(*filter(None, split)).difference(self.parts):
            self._learn(list(new))
        end, known = np.array([END], "<u4").tobytes(), self.parts.__getitem__
        return [(self._whole(t) if ps is None else b"".join(map(known, ps))) + end for t, ps in zip(texts, split)]


@lru_cache(maxsize=1)
def _ids(path: str) -> Ids:
    return Ids(path)


class Packer:
    """Pieces of at most `length` tokens for windows of that many, chosen by the sum-of-squares rule."""

    def __init__(self, length: int):
        self.length = length
        self.level = np.zeros(length + 1, np.int64)  # windows by fill; empty and full ones count 0
        self.open: dict[int, list[list]] = {}
        self.full: list[list] = []

    def add(self, piece: tuple[int, int, int]) -> None:
        """piece: document, start, length. It goes where the sum of squared level counts grows least."""
        size = piece[2]
        if size == self.length:
            self.full.append([piece])
            return
        # Moving a window from fill h to h + size changes the sum by 2 (N[h + size] - N[h] + 1); a new one
        # by 2 N[size] + 1, and a filled one leaves the levels.
        change = 2 * (self.level[size:] - self.level[: self.length + 1 - size] + 1)
        change[0] = 2 * self.level[size] + 1
        change[-1] = 1 - 2 * self.level[self.length - size]
        change[1:][self.level[1 : self.length + 1 - size] == 0] = np.iinfo(np.int64).max
        fill = len(change) - 1 - int(np.argmin(change[::-1]))  # of equals the fullest
        window = self.open[fill].pop() if fill else []
        if fill:
            self.level[fill] -= 1
        window.append(piece)
        if fill + size == self.length:
            self.full.append(window)
        else:
            self.level[fill + size] += 1
            self.open.setdefault(fill + size, []).append(window)

    def close(self) -> list[list]:
        """All windows. Open ones are topped up with cuts from the emptiest; the rest is cut at powers of two."""
        rest = [(h, w) for h in sorted(self.open, reverse=True) for w in self.open[h]]
        out, spare = self.full, []
        lo, hi = 0, len(rest) - 1
        while lo <= hi:
            fill, window = rest[lo]
            lo += 1
            while fill < self.length and (spare or lo <= hi):
                if not spare:
                    spare = rest[hi][1]
                    hi -= 1
                doc, start, n = spare.pop()
                take = min(n, self.length - fill)
                window.append((doc, start, take))
                fill += take
                if take < n:
                    spare.append((doc, start + take, n - take))
            out.append(window)
        if spare:
            out.append(spare)
        if out and (n := sum(p[2] for p in out[-1])) < self.length:
            last, pieces = [], out.pop()[::-1]
            while n:
                room = 1 << n.bit_length() - 1
                n -= room
                last.append([])
                while room:
                    doc, start, size = pieces.pop()
                    take = min(size, room)
                    last[-1].append((doc, start, take))
                    room -= take
                    if take < size:
                        pieces.append((doc, start + take, size - take))
            out += last
        return out


def _pack(path: str, length: int):
    def run(batches):
        ids_of, first = _ids(path), TaskContext.get().partitionId() << 36

        def flush(docs, sequence):
            packer, rows = Packer(length), []
            for d, (_, ids) in enumerate(docs):
                n = len(ids) // 4
                for start in range(0, n, length):
                    packer.add((d, start, min(length, n - start)))
            for window in packer.close():
                at = 0
                for d, start, n in window:
                    doc_id, ids = docs[d]
                    rows.append((doc_id, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, sequence, at))
                    at += n
                sequence += 1
            for i in range(0, len(rows), 10_000):
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                yield sequence, pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, zip(*rows[i : i + 10_000]))], names)

        sequence, docs, tokens = first, [], 0
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                for doc_id, ids in zip(part["doc_id"].to_pylist(), ids_of([t or "" for t in part["text"].to_pylist()])):
                    docs.append((doc_id, ids))
                    tokens += len(ids) // 4
                if tokens >= GROUP_TOKENS:
                    for sequence, out in flush(docs, sequence):  # noqa: B020
                        yield out
                    docs, tokens = [], 0
        for _, out in flush(docs, sequence):
            yield out

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces of documents with their ids (little-endian 32-bit), each in one sequence of at most `length` tokens.

    path: tokenizer file. A document is its ids and then id 2; it is cut into whole sequences and a rest,
    and rests are packed online by the sum-of-squares rule, a group of about GROUP_TOKENS tokens at a time
    where the documents are, without a shuffle. At the end of a group open sequences are topped up with cuts
    from the emptiest and the last is cut at powers of two, so that no padding is left. Sequence ids hold
    the partition's number. Null or empty text is id 2 alone; repeated rows and rows with a null doc_id are packed each; an empty table
    gives no rows.
    """
    return named(documents(docs).mapInArrow(_pack(path or tokenizer_path(), length), SCHEMA))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
