"""Queries that SQL can express, against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from patchloom.llm.queries import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"create view {p.stem} as from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, str(SF))
    cols = sorted(got.columns)
    want = duck.sql(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want))
