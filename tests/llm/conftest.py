import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, key string"


def small_texts() -> list:
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "to", "Maison", "été", "straße", "noch", "agua", "niño", "tower", "river", "stone,", "cloud.", "***", "a|b", "x", "π≈3", "𝔘nicode"]
    prose = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", "\t "]) for _ in range(n))
    shared = prose(60)
    texts = [None, "", " ", "\n", "\n\n a \n\n", "one", "one two three four", "x y", " ", "a" * 300, "ab" * 400, "é" * 101]
    texts += [prose(n) for n in (3, 5, 19, 20, 60, 200, 2000)]
    texts += [shared] * 12 + [prose(15) + shared + prose(15) for _ in range(12)]
    texts += ["Common Line\n" + prose(9) + "\n  common line\t\n" + prose(5) + "\r\nend" for _ in range(11)]
    base = prose(150).split(" ")
    for i in range(15):
        changed = list(base)
        for k in range(0, len(changed), 40 + i):
            changed[k] = f"w{i}"
        texts.append(" ".join(changed))
    return texts


@pytest.fixture(scope="session")
def small(spark):
    """Edge cases, copies and near copies, with repeated texts, nulls in every column but doc_id, and extra columns."""
    langs, sources = ["en", "fr", None, "de"], ["b", "a", None, "c", "b", "b"]
    rows = [(3 * i + 1, t, langs[i % 4], sources[i % 6], None, "clash", "clash") for i, t in enumerate(small_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    """The first 200 documents of the smallest supplied table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def texts_of(df) -> dict:
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}
