"""Queries with SQL against DuckDB on the smallest tables, their null texts and languages too."""

import duckdb
import pytest

from aeolis.llm.queries import ORACLE_SQL, QUERIES

SUPPLIED = "/root/testdata/sf0.001"


def plain(x):
    return round(x, 5) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, small, tmp_path, name):
    small.select("doc_id", "text", "lang", "source").write.parquet(str(tmp_path / "documents.parquet"))
    for other in ("labels", "pages"):
        (tmp_path / f"{other}.parquet").symlink_to(f"{SUPPLIED}/{other}.parquet")
    for folder in (SUPPLIED, str(tmp_path)):
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet{'' if 'testdata' in folder else '/*.parquet'}'")
        for other in ("labels", "pages"):
            duck.execute(f"CREATE VIEW {other} AS SELECT * FROM '{SUPPLIED}/{other}.parquet'")
        cursor = duck.execute(ORACLE_SQL[name])
        columns = [d[0] for d in cursor.description]
        want = [tuple(map(plain, r)) for r in cursor.fetchall()]
        df = QUERIES[name](spark, folder)
        assert sorted(df.columns) == sorted(columns)
        got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
