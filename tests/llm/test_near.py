"""Near duplicates and repeated passages, against brute force."""

import re

import pytest

from aeolis.llm import near
from aeolis.llm.components import components

from .conftest import texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    ws = WORD.findall(text.translate(LOWER))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(texts):
    sets, root = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: (len(sets[k]), top(k)) for k in ids}


@pytest.mark.parametrize("bucket", [4096, 4])
def test_near(small, sample, monkeypatch, bucket):
    """With a small bucket size, buckets are dealt out in blocks."""
    monkeypatch.setattr(near, "BUCKET", bucket)
    for df in (small, sample):
        want = brute(texts_of(df))
        got = {r["doc_id"]: r for r in near.link_near(df).collect()}
        assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == want
        assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())
    assert len({c for _, c in want.values()}) < len(want)


def test_near_large_group(spark, monkeypatch):
    """One large group of near copies and one of texts that share much but not enough, in blocks of few."""
    monkeypatch.setattr(near, "BUCKET", 32)
    rng = __import__("random").Random(4)
    base = [f"w{i}" for i in range(80)]
    changed = lambda n: " ".join(f"x{rng.random()}" if i in spots else w for spots in [set(rng.sample(range(80), n))] for i, w in enumerate(base))
    texts = [changed(1) for _ in range(260)] + [changed(3) for _ in range(120)] + [" ".join(base)] * 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = brute(dict(enumerate(texts)))
    got = near.link_near(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len({c for _, c in want.values()}) > 10
    assert len({r["class"] for r in got}) == len({c for _, c in want.values()})


def test_near_by_join(small, monkeypatch):
    monkeypatch.setattr(near, "BROADCAST_IDS", 0)
    assert {r["doc_id"]: r["component_id"] for r in near.link_near(small).collect()} == {k: c for k, (_, c) in brute(texts_of(small)).items()}


def test_near_odd_tables(empty, sample):
    assert near.link_near(empty).count() == 0
    assert near.link_near(sample.union(sample)).count() == 2 * sample.count()


def test_near_shared_ids(spark):
    """Distinct texts under a null or a repeated doc_id, each linked by its own text."""
    base = [" ".join(f"w{t}x{i}" for i in range(60)) for t in range(8)]
    rows = [(None, t) for t in base] + [(None, t + " more") for t in base[:4]] + [(7, base[0] + " end"), (7, base[1] + " end"), (7, "alone by itself"), (3, base[1]), (9, base[5] + " x"), (9, base[6] + " y"), (9, base[6]), (4, None)]
    found = brute(dict(enumerate(t or "" for _, t in rows)))
    big = lambda k: (k is None, k or 0)
    least = {}
    for n, (k, _) in enumerate(rows):
        c = found[n][1]
        least[c] = min(least.get(c, k), k, key=big)
    want = [(k, found[n][0], least[found[n][1]], k == least[found[n][1]]) for n, (k, _) in enumerate(rows)]
    order = lambda r: [big(x) for x in r]
    got = near.link_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_posterior():
    assert near.LEAST[128] / 128 < 0.62 and near.LEAST[32] < 17


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(7, 5), (5, 5), (9, 3), (3, 7)]
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 181)}, **{i: 3 for i in (3, 5, 7, 9)}}
