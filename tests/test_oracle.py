"""Each query of the engine against its twin in SQL, on the smallest tables."""

from __future__ import annotations

import glob
from pathlib import Path

import pytest

from veritally import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    import duckdb

    connection = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        connection.sql(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return connection


def shown(value: object) -> str:
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_and_twin_agree(spark, duck, small, name):
    found = QUERIES[name](spark, small)
    columns = sorted(found.columns)
    rows = found.select(*[f"`{c}`" for c in columns]).collect()
    if name not in SQL:
        assert columns
        return
    twin = duck.sql(SQL[name])
    assert sorted(twin.columns) == columns
    at = [twin.columns.index(c) for c in columns]
    assert sorted(tuple(map(shown, r)) for r in rows) == sorted(tuple(shown(r[i]) for i in at) for r in twin.fetchall())
