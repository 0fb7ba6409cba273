"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from aeolis.plans import archives, arrays, conversions, documents, functions, processes, records, regridding, relations, soundings, wording  # noqa: F401  each adds its queries
from aeolis.plans.queries import ORACLE_SQL, QUERIES

from .conftest import SF


def plain(x):
    return None if x is None else round(x, 5) + 0.0 if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    assert got
    if name in ORACLE_SQL:
        cursor = duck.execute(ORACLE_SQL[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        order = sorted(columns)
        key = lambda rows: sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)
        a, b = key(got), key([dict(zip(columns, r)) for r in cursor.fetchall()])
        assert len(a) == len(b)
        assert [x for x in zip(a, b) if x[0] != x[1]][:3] == []
