"""What is broadcast follows from measured sizes, not from those of files."""

from __future__ import annotations

import os
import time
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from claimloom.operators import grams
from claimloom.plans import flows, registry
from claimloom.plans.scratch import materialize, measured_broadcasts, passing_tables, scratch_path, shared_folder
from claimloom.sources.ledger import Ledger, Table

LONG = "x" * 200


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_files_of_many_rows_are_not_broadcast(spark):
    many = materialize(spark.range(300_000).select((F.col("id") % 7).alias("k"), F.lit(LONG).alias("text")), "many")
    few = materialize(spark.range(3).select(F.col("id").alias("k")), "few")
    before = [spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")]
    with measured_broadcasts(spark):
        by_many, by_few = many.join(many.withColumnRenamed("text", "t"), "k", "left_anti"), many.join(few, "k", "left_anti")
        assert by_many.count() == 0 and by_few.count() == 171_428  # four of seven values
        assert "BroadcastHashJoin" not in plan_of(by_many)
    assert before == [spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")]


def test_an_index_writes_without_broadcasting_postings(spark, tmp_path, monkeypatch):
    """A second change compares old postings with new ones: many rows in small files."""
    seen = []
    monkeypatch.setattr(grams, "materialize", lambda df, label: seen.append(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")) or materialize(df, label))
    commit = Ledger._commit
    monkeypatch.setattr(Ledger, "_commit", lambda self, *a: seen.append(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")) or commit(self, *a))
    index = grams.GramIndex(spark, str(tmp_path / "i"))
    index.change(spark.createDataFrame([(1, "abc")], "id long, text string"))
    assert seen[-1] == "-1"


def test_newer_folders_of_many_rows_are_not_broadcast(spark):
    led = Ledger(spark, scratch_path(spark, "many"), {"t": Table("id bigint, text string", ("id",), ("id",))}, bucket_rows=1_000_000)
    rows = spark.range(150_000).select("id", F.lit(LONG).alias("text"))
    led.commit({"t": rows})
    led.commit({"t": rows.withColumn("text", F.lit("new"))})
    found = led.table("t")
    assert found.where("text = 'new'").count() == 150_000
    assert "BroadcastHashJoin" not in plan_of(found)


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}


def test_shuffle_files_go_with_their_job(spark):
    before = _shuffle_files(spark)
    kept = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and kept.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_passing_tables_go_at_the_end(spark):
    outside = materialize(spark.range(3), "outside")
    with passing_tables(spark):
        inside = materialize(spark.range(4), "inside")
        with passing_tables(spark):
            nested = materialize(spark.range(5), "nested")
        assert inside.count() == 4
    assert outside.count() == 3
    assert [os.path.exists(urlparse(t.inputFiles()[0]).path if t.inputFiles() else "") for t in (inside, nested, outside)] == [False, False, True]


def test_folds_leave_their_ledger_only(spark):
    folder = urlparse(shared_folder(spark)).path
    before = set(os.listdir(folder))
    out = flows.c16_ledger_fold(spark, "/root/testdata/sf0.001")
    assert out.count() > 0
    assert sorted(name.split("-")[0] for name in set(os.listdir(folder)) - before) == ["folded", "ledger"]


@pytest.mark.parametrize("name", ["c13_intake_edges", "c16_intake_evidence", "c17_primary_nodes", "c18_intake_counters", "c4_c6_write_limits"])
def test_a_processed_batch_leaves_its_result_only(spark, name):
    folder = urlparse(shared_folder(spark)).path
    before = set(os.listdir(folder))
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    left = sorted(x.split("-")[0] for x in set(os.listdir(folder)) - before)
    assert left == ["made"] + ["stored"] * (6 if name == "c18_intake_counters" else 0)


def test_what_is_kept_stays(spark):
    with passing_tables(spark):
        with passing_tables(spark) as keep:
            kept = keep(materialize(spark.range(4), "kept"))
        assert kept.count() == 4
    assert not os.path.exists(urlparse(kept.inputFiles()[0]).path)  # it went with the outer one
