"""Queries against their twins in SQL on tables whose keys have more digits than the printed numbers of the smaller ones."""

from __future__ import annotations

import pytest

from veritally import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()
#: What is added to the keys of each copy: six digits, and seven whose first six are another part's number.
SHIFTS = (0, 100_000, 1_000_000)
KEYS = {"part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_partkey"], "supplier": []}


@pytest.fixture(scope="module")
def long_keys(small, tmp_path_factory):
    import duckdb

    folder, connection = tmp_path_factory.mktemp("long_keys"), duckdb.connect()
    for table, keys in KEYS.items():
        copies = [f"SELECT * {'REPLACE (' + ', '.join(f'{k} + {s} AS {k}' for k in keys) + ')' if keys else ''} FROM '{small}/{table}.parquet'" for s in (SHIFTS if keys else (0,))]
        connection.sql(f"COPY ({' UNION ALL '.join(copies)}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return str(folder), connection


def agree(spark, tables, name):
    folder, connection = tables
    twin = connection.sql(SQL[name])
    columns = sorted(twin.columns)
    at = [twin.columns.index(c) for c in columns]
    found = QUERIES[name](spark, folder).select(*[f"`{c}`" for c in columns]).collect()
    wanted = twin.fetchall()
    assert wanted
    assert sorted(tuple(map(str, r)) for r in found) == sorted(tuple(str(r[i]) for i in at) for r in wanted)


@pytest.mark.parametrize("name", ["j07_match_lines", "j08_vpn_items", "j09_ocr_matches", "l02_items_by_part_number", "r15_lookup_source", "x03_line_match", "x15_invoice_status"])
def test_part_numbers_of_long_keys(spark, long_keys, name):
    agree(spark, long_keys, name)
