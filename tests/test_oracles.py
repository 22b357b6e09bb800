"""Every query of the library with an SQL equivalent gives the same rows as DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

from claimloom.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(rows: list[tuple]) -> list[tuple]:
    return sorted((tuple(round(v, 6) if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    found = registry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    expected = duck.sql(registry.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    got = [tuple(r) for r in found.select(*columns).collect()]
    want = expected.select(*[f'"{c}"' for c in columns]).fetchall()
    assert plain(got) == plain(want)


def test_every_query_has_an_equivalent():
    assert set(registry.queries()) == set(registry.oracle_sql())
