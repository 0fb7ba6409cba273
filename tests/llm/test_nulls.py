"""Nulls in every column, doc_id too, beside ids that need all 64 bits, and extra columns with clashing names."""

import pytest

import corpus_pipeline as pipeline
from aeolis.llm import langid, lines, mixing, near, packing, passages, quality, secrets, spotsigs

LONG = " ".join(f"word{i} the tower" for i in range(80))
EXTRA = "id string, key string, chunk string, label string, copy string, bucket string, size string, range string"
BIG = 2**60


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, LONG, "en", "a", 1), (None, LONG + " x", None, None, None), (None, None, "fr", "b", None), (None, "common\nb", "fr", "b", None)]
    rows += [(5, LONG + " y", "en", "a", 3), (BIG + 1, LONG + " z", "en", "c", 3), (BIG + 2, "other text entirely with the moon in view", "en", "c", 3)]
    rows += [(BIG + 10 + k, f"common\nline {k}", "en", "a", 3) for k in range(9)]
    return spark.createDataFrame([(*r, *["clash"] * 8) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


@pytest.mark.parametrize(
    "run",
    [
        lambda d: secrets.digest(secrets.find_secrets(d)), passages.drop_repeats, near.link_near, spotsigs.fingerprints, spotsigs.with_next, mixing.mix_sources, langid.identify,
        lambda d: packing.pack(d).filter("start = 0"), lambda d: quality.judge(quality.quality_counts(d)), lines.drop_common_lines,
    ],
)
def test_every_row_comes_back(docs, run):
    key = lambda x: (x is None, x or 0)
    ids = lambda df: sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=key)
    assert ids(run(docs)) == ids(docs)


def test_null_ids_count_as_one_that_comes_last(docs):
    found = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in passages.drop_repeats(docs).collect()}
    n = len(LONG)
    # 5 keeps all but what its own text repeats; each later copy loses what 5 has.
    assert found[5, n + 2] < 100 and found[BIG + 1, n + 2] == found[None, n + 2] == n + 1 and found[None, n] == n
    linked = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in near.link_near(docs).collect()}
    assert {v for (k, m), v in linked.items() if k != 5 and m > 200} == {(5, False)}
    assert linked[None, 0] == (None, True)
    # Nine documents and those without an id, which count as one.
    assert {r["n_dropped"] for r in lines.drop_common_lines(docs).filter("n_lines = 2").collect()} == {1}
    assert {r["held_out"] for r in langid.identify(docs).filter("doc_id IS NULL").collect()} == {False}
    last = spotsigs.with_next(docs).filter("doc_id IS NULL").collect()
    assert len(last) == 4


def test_stages(spark, docs):
    rows = {name: stage(spark, docs, "").collect() for name, stage in pipeline.STAGES}
    nulls = {name: sum(r["doc_id"] is None for r in rs) for name, rs in rows.items()}
    assert (nulls["language"], nulls["lines"], nulls["near"]) == (3, 4, 2) and nulls["mix"] and nulls["pack"]
    assert {r["doc_id"] for r in rows["near"]} >= {5, BIG + 2} and BIG + 1 not in {r["doc_id"] for r in rows["near"]}


@pytest.mark.parametrize("doc_id", [None, 7])
def test_ids_that_tell_nothing_apart(spark, sample, doc_id):
    """All ids null, or all equal: rows are dealt out, learned from and kept as rows."""
    from pyspark.sql import functions as F

    alike = sample.withColumn("doc_id", F.lit(doc_id).cast("long"))
    assert set(langid.learn(alike)) == ({"de", "en", "es", "fr"} if not doc_id or __import__("zlib").crc32(b"7") % 4 != 2 else set())
    bounded = langid.learn(alike, docs_per_lang=5)
    assert all(n.sum() < 40_000 * 5 for _, n in bounded.values())
    rows = passages.ordered(alike)
    places = [r["at"] for r in rows.select("at").collect()]
    assert len(set(places)) == len(places)
    chunks = [r["count"] for r in rows.groupBy(F.pmod(F.xxhash64("at"), F.lit(4))).count().collect()]
    assert max(chunks) < 2 * sum(chunks) / len(chunks)
    # As with ids in the order of the table.
    numbered = lines.with_row(sample, "n").withColumn("doc_id", F.col("n"))
    result = lambda df: sorted((r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in passages.drop_repeats(df).collect())
    assert result(alike) == result(numbered)
    if doc_id is None:
        dropped = lambda df: sorted(r["kept_sha256"] for r in lines.drop_common_lines(df).collect())
        assert dropped(alike) == dropped(numbered)
    kept = pipeline.drop_near(spark, alike, "")
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted(r["text"] or "" for r in pipeline.drop_near(spark, numbered.select(*pipeline.COLUMNS), "").collect())
    taken = mixing.mix_sources(alike)
    assert taken.agg(F.sum("taken")).first()[0] <= taken.agg(F.sum("size")).first()[0]
    assert sorted(r["text"] for r in pipeline.mix(spark, alike, "").collect()) == sorted(r["text"] for r in pipeline.mix(spark, alike, "").collect())
    assert pipeline.mix(spark, alike, "").count() == taken.agg(F.sum("copies")).first()[0]
