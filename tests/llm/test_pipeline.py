"""The pipeline against its stages done by brute force."""

from collections import Counter

import corpus_pipeline as pipeline

from .conftest import texts_of
from .test_near import LOWER, brute


def through(spark, docs, tmp_path):
    out = [docs]
    for name, stage in pipeline.STAGES:
        stage(spark, out[-1], "").write.parquet(str(tmp_path / name))
        out.append(spark.read.parquet(str(tmp_path / name)))
    return out


def test_pipeline(spark, small, sample, tmp_path):
    columns = small.select(*pipeline.COLUMNS)
    docs = columns.union(sample.selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars"))
    first, language, lines, near, mixed, packed = through(spark, docs, tmp_path)
    assert all(x.columns == list(pipeline.COLUMNS) for x in (language, lines, near, mixed))
    texts = texts_of(first)
    want = {k: t for k, t in texts.items() if any(c.isalpha() for c in t)}
    assert texts_of(language) == want
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)
    often = Counter(k for t in want.values() for k in {key(x) for x in t.split("\n")})
    want = {k: "\n".join(x for x in t.split("\n") if not key(x) or often[key(x)] < 10) for k, t in want.items()}
    assert texts_of(lines) == want and all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    want = {k: t for k, t in want.items() if brute_components(want)[k] == k}
    assert texts_of(near) == want
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert times and set(times) <= set(want) and max(times.values()) <= 3
    assert all(r["text"] == want[r["doc_id"]] for r in mixed.collect())
    tokens = Counter()
    for r in packed.collect():
        tokens[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert {k: n // m for (k, m), n in tokens.items()} == times


_CACHE = {}


def brute_components(texts):
    if id(texts) not in _CACHE:
        _CACHE[id(texts)] = {k: c for k, (_, c) in brute(texts).items()}
    return _CACHE[id(texts)]


def test_run(spark):
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 200


def test_odd_tables(spark, empty, sample, tmp_path):
    assert through(spark, empty.select(*pipeline.COLUMNS), tmp_path / "a")[-1].count() == 0
    twice = through(spark, sample.union(sample), tmp_path / "b")
    assert twice[3].count() == twice[3].select("doc_id").distinct().count()
