"""Queries on the trade ledger where keys are far apart: no two entities, claims or edges may get one number."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from claimloom.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, customers", [("a15_ledger_cascade", 10**9), ("c21_ledger_orphans", 10**9), ("d12_ledger_insights", 10**9), ("b9_followed_counts", 0)])
def test_far_keys(spark, tmp_path, name, customers):
    """Every second supplier's key is 99,999 above its neighbour's, so order o with one meets order o - 1 with the other; customers' keys reach what the query adds to suppliers'."""
    far = lambda c: F.col(c) + F.when(F.col(c) % 2 == 1, 99_999).otherwise(0)
    changed = {"lineitem": {"l_suppkey": far("l_suppkey")}, "supplier": {"s_suppkey": far("s_suppkey")}, "orders": {"o_custkey": F.col("o_custkey") + customers}, "customer": {"c_custkey": F.col("c_custkey") + customers}, "region": {}}
    con = duckdb.connect()
    for t, columns in changed.items():
        spark.read.parquet(f"{SMALL}/{t}.parquet").withColumns(columns).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
