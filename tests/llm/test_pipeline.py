from __future__ import annotations

import os

import numpy as np
import pytest

import corpus_pipeline
from claimloom.llm import bpe, registry
from claimloom.llm.common import materialize
from tests.llm import tables

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    docs = tables.frame(spark).withColumnRenamed("n_chars", "n_chars")
    seen = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = materialize(stage(spark, docs, ""), f"test-{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        seen.append(out.count())
        docs = out
    assert seen[1] < seen[0] and seen[2] < seen[1] and seen[3] == seen[2] and seen[5] == seen[4] > 0
    a = bpe.automaton(bpe.vocabulary_path())
    for r in docs.limit(5).collect():
        assert r["n_tokens"] == len(np.frombuffer(r["ids"], "<u4")) and a.decode(r["ids"])


def test_stages_take_an_empty_table(spark):
    docs = spark.createDataFrame([], tables.SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    found = registry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=repr) == sorted(want.select(*columns).fetchall(), key=repr)
