"""Audits of sources and of filters, and archives, against brute force, with edge cases and damaged bytes."""

import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from aeolis.llm import audit, divergence, warc

EXTRA = "rank string, mask string, step string, key string, total string, block string, n string, path string"

# --- divergence


@pytest.fixture(scope="module")
def sourced(spark):
    """Terms with and without case, digits between, other scripts, nulls and a language without kept terms."""
    rng = random.Random(3)
    terms = ["the", "The", "of", "été", "ÉTÉ", "x1y", "π", "stone-wall", "under_score", "a", "𝔘", " ", "ſ", "K"]
    rows = []
    for i in range(300):
        lang, source = [None, "", "en", "en", "fr", "en"][i % 6], [None, "", "b", "c", "é", "z", "b"][rng.randrange(7)]
        text = [None, "", "12 34"][i % 3] if i % 11 == 0 else " ".join(rng.choice(terms) for _ in range(rng.randrange(40)))
        rows.append((None if i % 9 == 0 else i, text, lang, source, *["clash"] * 8))
    rows += [(900 + i, f"rare{i}", "xx", s, *["clash"] * 8) for i, s in enumerate("abc")] + [rows[-1]] * 3
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {EXTRA}").repartition(5)


def brute_divergence(rows, least, top):
    found, docs = defaultdict(Counter), defaultdict(Counter)
    groups = {(r["lang"] or "", r["source"] or "") for r in rows}
    for r in rows:
        ts = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or ""))
        found[r["lang"] or "", r["source"] or ""].update(ts)
        docs[r["lang"] or ""].update(set(ts))
    out = set()
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]
        n = {s: sum(found[lang, s][t] for t in kept) for s in sources}
        share = lambda c, total: 1 + 10**9 * (c + 5) // (total + 5 * len(kept))
        p = {s: {t: share(found[lang, s][t], n[s]) for t in kept} for s in sources}
        q = {t: share(sum(found[lang, s][t] for s in sources), sum(n.values())) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if found[lang, s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, o) in enumerate(sorted(pairs, key=lambda x: (x[0], x[1].encode())))}
            out |= {(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(terms)}
    return out


@pytest.mark.parametrize("least, top, cells, stripe", [(30, 50, 1 << 21, 512), (1, 3, 1, 2), (10_000, 50, 1 << 21, 512)])
def test_divergence(sourced, least, top, cells, stripe):
    got = [tuple(r) for r in divergence.diverge(sourced, least, top, cells, stripe).collect()]
    want = brute_divergence(sourced.collect(), least, top)
    assert len(got) == len(want) and set(got) == want
    assert any(r[4] for r in got) == (least < 10_000)


def test_divergence_of_supplied_and_empty(sample, empty, sourced):
    assert {tuple(r) for r in divergence.diverge(sample).collect()} == brute_divergence(sample.collect(), 30, 50)
    assert not divergence.diverge(empty).collect()
    alone = sourced.filter("lang = 'fr'").limit(1)
    assert {r["part"] for r in divergence.diverge(alone, least_docs=1).collect()} <= {"term"}


def test_shares_are_exact():
    """Counts of a very large corpus, whose product with a thousand million needs 83 bits."""
    rng = random.Random(1)
    totals = [rng.randrange(1, 9 * 10**15) for _ in range(200)] + [5, 1, 9 * 10**15 - 1]
    counts = [rng.randrange(0, t + 1) for t in totals]
    got = divergence.shares(np.array(counts, np.int64), np.array(totals, np.int64))
    assert got.tolist() == [1 + 10**9 * c // t for c, t in zip(counts, totals)]


def test_differences_by_any_rows(monkeypatch):
    p = np.random.default_rng(0).integers(0, 10**9, (7, 30))
    want = np.abs(p[:, None] - p[None]).sum(axis=2)
    for cells in (1, 500, 1 << 21):
        monkeypatch.setattr(divergence, "BROADCAST_CELLS", cells)
        assert (divergence.differences(p, 0, 7) == want).all() and (divergence.differences(p, 2, 5) == want[2:5]).all()


# --- filters


@pytest.fixture(scope="module")
def judged(spark):
    long = " ".join(f"word{i}" for i in range(200))
    texts = [None, "", "a", "a", "A B C", long, long, long + " #", "x " * 300, "CAPS " * 250, "\t word\n" * 210, long, "é" * 10, "A" + "x" * 49, "A" + "x" * 48, " ".join(["a", "b"] * 150)]
    rows = [(i, t, ["s", None, "", "t"][i % 4], *["clash"] * 8) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (5, long, "t", *["clash"] * 8), (None, long, "s", *["clash"] * 8), (None, None, None, *["clash"] * 8), (None, "only null", "s", *["clash"] * 8), (None, "only null", "s", *["clash"] * 8), (2**60, long, "u", *["clash"] * 8)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 16, 2)] + [(5, 0, 0), (5, 1, 1), (None, 1, 1), (77, 1, 1), (7, None, None)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, {EXTRA}").repartition(4)
    return docs, spark.createDataFrame([(a, b, None if c is None else int(c), "clash") for a, b, c in labels], "doc_id long, quality int, toxic int, source string")


def brute_audit(docs, labels):
    good = {r["doc_id"] for r in labels if r["quality"] == 1} - {None}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1} - {None}
    at = lambda r: 2**63 - 1 if r["doc_id"] is None else r["doc_id"]
    first = {}
    for r in docs:
        first[r["text"] or ""] = min(first.get(r["text"] or "", at(r)), at(r))
    flagged = []
    for r in docs:
        t = r["text"] or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": first[t] < at(r)}
        flagged.append((r["source"] or "", {k for k, v in fails.items() if v}, r["doc_id"] in good, r["doc_id"] in toxic))
    out = {}
    for part in {f[0] for f in flagged}:
        mine, shapley = [f for f in flagged if f[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, x in enumerate(order):
                here = [f for f in left if x in f[1]]
                shapley[x] += len(here)
                failing = sum(x in f[1] for f in mine)
                left = [f for f in left if x not in f[1]]
                out[part, order, k + 1] = (len(left), len(here), failing - len(here), sum(f[1] == {x} for f in mine), sum(f[2] for f in here), sum(f[3] for f in here))
        for p, order, k in list(out):
            if p == part:
                out[p, order, k] += (shapley[order[k - 1]],)
    return out


def test_audit(spark, judged, sample):
    supplied = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for docs, labels in (judged, (sample, supplied)):
        rows = audit.replay(audit.flags(docs, labels)).collect()
        got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in audit.COUNTS) for r in rows}
        assert len(got) == len(rows) and got == brute_audit(docs.collect(), labels.collect())


def test_audit_of_nothing(spark, empty, judged):
    docs, labels = judged
    assert not audit.replay(audit.flags(empty, labels)).collect()
    rows = audit.replay(audit.flags(docs, labels.limit(0))).collect()
    assert rows and not any(r["good_lost"] or r["toxic_lost"] for r in rows)


def test_audit_counts_in_tasks(judged):
    """What leaves a task is at most a row a source and pattern, however many rows share a text."""
    docs, labels = judged
    many = docs.filter("doc_id = 2").withColumn("doc_id", F.explode(F.sequence(F.lit(100), F.lit(5099))))
    flagged = audit.flags(many, labels).collect()
    assert sorted((r["mask"], r["n"]) for r in flagged) == [(1, 1), (17, 4999)]


# --- archives

PAGES = "page_id long, url string, html string, " + EXTRA


@pytest.fixture(scope="module")
def paged(spark):
    big, wide = "<p>" + "lorem " * 400 + "</p>", "é" * 500
    htmls = [None, "", "short", "short", big, big, big, wide, wide, "é" * 499 + "x", "é" * 499 + "x", "\r\n\r\nWARC/1.1\r\n\r\n" * 60, "𝔘" * 40_000, "\0" * 2000]
    rows = [(i, [f"http://h{i}/a b", None, "", "http://x/\r\nEvil: 1", "https://é/π"][i % 5], h) for i, h in enumerate(htmls)]
    rows += [(None, None, big), (None, None, None), (6, "http://again/", big), (2**62, "u", wide), (-3, "u", wide), (None, "u", "z" * 1000), (None, "v", "z" * 1000)]
    return spark.createDataFrame([(*r, *["clash"] * 8) for r in rows], PAGES).repartition(4)


def brute_roles(rows):
    ids = defaultdict(list)
    for r in rows:
        ids[r["html"] or ""].append(r["page_id"])
    out = Counter()
    for r in rows:
        html, mine = r["html"] or "", r["page_id"]
        last = max((i for i in ids[html] if i is not None), default=None)
        whole = len(html.encode()) < 1000 or mine == last
        out[mine, len(html.encode()), hashlib.sha1(html.encode()).hexdigest(), "response" if whole else "revisit", None if whole else last] += 1
    return out


@pytest.mark.parametrize("repeats", [1_000_000, 0])
def test_archives(spark, paged, monkeypatch, repeats):
    chosen = warc.with_response
    monkeypatch.setattr(warc, "with_response", lambda pages: chosen(pages, repeats))
    archives = warc.write_archives(paged)
    assert archives.agg(F.sum("records")).first()[0] == paged.count() + archives.count()
    records = warc.read_archives(archives)
    assert Counter(tuple(r) for r in warc.digest(records).collect()) == brute_roles(paged.collect())
    # The payloads come back whole, once each, with the revisits' by their reference.
    found = {r["record_id"]: bytes(r["payload"]) for r in records.filter("record_type = 'response'").collect()}
    revisits = records.filter("record_type = 'revisit'").collect()
    assert len(found) + len(revisits) == paged.count() - 2  # two rows that repeat another whole
    for r in revisits:
        assert r["payload"] is None and hashlib.sha1(found[r["refers_to"]]).hexdigest() == r["payload_digest"]
    assert {x.decode() for x in found.values()} == {r["html"] or "" for r in paged.collect()}
    assert all(re.fullmatch(r"[^\x00-\x20]+", r["target_uri"]) for r in records.filter("record_type <> 'warcinfo'").collect())


def test_archives_are_plain_files(paged):
    """Each record is a gzip member of its own, which common tools read; a task's archives hold what it wrote."""
    for r in warc.write_archives(paged).collect():
        store, at = fs.FileSystem.from_uri(r["path"])
        data = store.open_input_stream(at, compression=None).read()
        assert len(data) == r["bytes"]
        members, rest = 0, data
        while rest:
            z = zlib.decompressobj(31)
            record = z.decompress(rest)
            assert z.eof and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            rest, members = z.unused_data, members + 1
        assert members == r["records"] and gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_no_pages(spark):
    archives = warc.write_archives(spark.createDataFrame([], PAGES))
    assert not archives.collect() and not warc.digest(warc.read_archives(archives)).collect()


def two_records():
    a = warc.written(1, "http://a/", b"payload " * 500, None, warc.DATE, 6)
    return a, warc.written(2, "http://b/", b"payload " * 500, 1, warc.DATE, 6)


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_reader_at_any_piece(monkeypatch, piece):
    monkeypatch.setattr(warc, "PIECE", piece)
    records = list(warc.Reader(io.BytesIO(b"".join(two_records()))))
    assert [warc.opened(r) for r in records] == [(b"payload " * 500, 4000), (None, 4000)]
    assert list(warc.Reader(io.BytesIO(b""))) == []


def test_damage_is_told():
    a, b = two_records()
    for cut in range(len(a) + 1, len(a) + len(b), 3):
        with pytest.raises(warc.Damaged):
            list(warc.Reader(io.BytesIO((a + b)[:cut])))
    for place in range(10, len(a), 5):
        with pytest.raises(warc.Damaged):
            list(map(warc.opened, warc.Reader(io.BytesIO(a[:place] + bytes([a[place] ^ 0x10]) + a[place + 1 :] + b))))
    plain = zlib.decompress(a, 31)
    for old, new in ((b"Content-Length: 40", b"Content-Length: 39"), (b"payload pay", b"payload pax"), (b"WARC/1.1", b"HTTP/1.1"), (b"\r\n\r\n", b"\r\n"), (b"WARC-Block-Digest: sha1:", b"WARC-Block-Digest: sha1:A")):
        with pytest.raises(warc.Damaged):
            list(map(warc.opened, warc.Reader(io.BytesIO(gzip.compress(plain.replace(old, new, 1))))))
    # A payload that only its own digest tells.
    headers = warc.Reader(io.BytesIO(a))._record().headers
    other = warc.member({"WARC-Type": "response", "WARC-Payload-Digest": headers["warc-payload-digest"]}, b"HTTP/1.1 200 OK\r\n\r\nother", 6)
    with pytest.raises(warc.Damaged):
        list(map(warc.opened, warc.Reader(io.BytesIO(other))))
