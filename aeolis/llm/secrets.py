"""Secret scan: keyword prefilter, anchored expressions near hits, embedded checksums."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, named, table

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
STRIPE = re.compile(r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}")
GOOGLE = re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])")
SLACK = re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: kind: (expression anchored at the hit, test of its match).
KINDS = {
    "assign": (ASSIGN, lambda m: len(m[1]) >= 12),
    "access": (ACCESS, lambda m: m.end() - m.start() >= 18),
    "hex": (HEX, lambda m: m.end() - m.start() >= 16),
    "checked": (CHECKED, lambda m: base62(zlib.crc32(m[1].encode())) == m[2]),
    "stripe": (STRIPE, lambda m: True),
    "google": (GOOGLE, lambda m: True),
    "slack": (SLACK, lambda m: True),
    "pem": (PEM, lambda m: True),
}
RANK = {k: i for i, k in enumerate(KINDS)}
BASE_KINDS = ("assign", "access", "hex")
#: Lower-case keywords; a match of a kind begins where one of its keywords begins.
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "checked": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"],
    "stripe": ["sk_live_", "sk_test_", "rk_live_", "rk_test_"],
    "google": ["aiza"],
    "slack": ["xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"],
    "pem": ["-----begin "],
}


def base62(n: int, width: int = 6) -> str:
    out = ""
    while n:
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out.rjust(width, "0")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Over the keywords and, as a hex run has no keyword, over all runs of four hex digits: prose has few."""
    a = ahocorasick.Automaton()
    for kind, found in KEYWORDS.items():
        for w in found:
            a.add_word(w, (kind, len(w)))
    for w in map("".join, product("0123456789abcdef", repeat=4)):
        a.add_word(w, ("hex", 4))
    a.make_automaton()
    return a


def scan(text: str, keywords: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, leftmost and non-overlapping per kind, by start, then kind."""
    # One character a code point, A-Z lowered and nothing else, so offsets hold.
    low = text.encode("latin-1", "replace").lower().decode("latin-1")
    after = dict.fromkeys(KINDS, 0)
    out = []
    for end, (kind, length) in keywords.iter(low):
        start = end + 1 - length
        if start < after[kind]:
            continue
        pattern, valid = KINDS[kind]
        if m := pattern.match(text, start):
            after[kind] = m.end()
            if valid(m):
                out.append((start, m.end(), kind))
    return sorted(out, key=lambda x: (x[0], RANK[x[2]]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, found (array of kind, start, end and the secret's text).

    Null or empty texts have an empty array; repeated rows and repeated or null doc_ids are scanned one by one;
    columns other than doc_id and text are ignored.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())]))

    def run(batches):
        keywords = automaton()
        for b in batches:
            found = []
            for i in range(len(b)):
                text = b["text"][i].as_py()
                found.append([{"kind": k, "start": s, "end": e, "secret": text[s:e]} for s, e, k in scan(text, keywords)])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found, kind)], ["doc_id", "found"])

    return named(documents(docs).mapInArrow(run, "doc_id long, found array<struct<kind string, start long, end long, secret string>>"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans, and all spans as text."""
    base = F.filter("found", lambda x: x["kind"].isin(*BASE_KINDS))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(table(spark, sf_dir, "documents")))
