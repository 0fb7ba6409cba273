"""Repeated passages against a table of all strings of 100 bytes."""

import hashlib
import random

import pytest

from aeolis.llm import passages

from .conftest import texts_of


def brute(texts):
    seen, out = set(), {}
    for k in sorted(texts):
        data = texts[k].encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            x = data[i : i + 100]
            if x in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(x)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[k] = (len(data), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


def made():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(5)]
    texts = [None, "", "a" * 99, "a" * 100, "a" * 101, "ab" * 200, "abc" * 500, "é" * 120]
    for _ in range(120):
        texts.append(prose(rng.randint(0, 30)) + rng.choice(shared)[rng.randint(0, 80) :] + prose(rng.randint(0, 30)) + rng.choice(shared))
    base = shared[0]
    texts += [base[:50] + rng.choice("xyz") + base[51:] for _ in range(20)]
    return texts


@pytest.mark.parametrize("hot", [64, 1])
def test_passages(spark, small, sample, monkeypatch, hot):
    """With a low bound nearly every shared trigger is hot."""
    monkeypatch.setattr(passages, "HOT", hot)
    table = spark.createDataFrame(list(enumerate(made())), "doc_id long, text string").repartition(4)
    for df in (table, small, sample):
        want = brute(texts_of(df))
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in passages.drop_repeats(df).collect()}
        assert got == want
        assert sum(w[1] for w in want.values()) > 500


def test_segments(spark, monkeypatch):
    monkeypatch.setattr(passages, "SEGMENT", 256)
    table = spark.createDataFrame([(i, (t or "") * 3) for i, t in enumerate(made())], "doc_id long, text string")
    want = brute(texts_of(table))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in passages.drop_repeats(table).collect()}
    assert got == want


def test_odd_tables(spark, empty, sample):
    assert passages.drop_repeats(empty).count() == 0
    twice = passages.drop_repeats(sample.union(sample)).collect()
    assert len(twice) == 2 * sample.count()
    # The second of equal rows repeats the first.
    assert sum(r["n_bytes"] - r["n_removed"] for r in twice) <= sum(r["n_bytes"] for r in twice) / 2 + 100 * len(twice)
