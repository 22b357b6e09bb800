"""Places pushed apart through a grid against all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from claimloom.operators import ranking


def brute(points: dict, distance: float, rounds: int) -> dict:
    for _ in range(rounds):
        new = {}
        for i, (x, y) in points.items():
            pushes = []
            for j, (u, v) in points.items():
                d = math.sqrt((x - u) ** 2 + (y - v) ** 2)
                if i != j and 0.001 < d < distance:
                    pushes.append(((x - u) / d * (distance - d) * 0.225, (y - v) / d * (distance - d) * 0.225))
            n = max(len(pushes), 1)
            new[i] = (x + sum(p[0] for p in pushes) / n, y + sum(p[1] for p in pushes) / n)
        points = new
    return points


def test_places_equal_those_of_all_pairs_in_two_layouts_at_once(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.uniform(-300, 300), rng.uniform(-200, 200), "kept") for g, n in (("a", 200), ("b", 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "layout string, id bigint, x double, y double, cell_x string")
    got = {(r.layout, r.id): (r.x, r.y) for r in ranking.relaxed(df, rounds=5, by=("layout",)).collect()}
    for g in "ab":
        want = brute({i: (x, y) for k, i, x, y, _ in rows if k == g}, 80.0, 5)
        assert max(math.dist(got[g, i], p) for i, p in want.items()) < 1e-5


def test_pairs_without_places_and_coinciding_ones(spark):
    rows = [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 500.0, 0.0), (4, 540.0, 0.0), (5, None, 1.0), (6, float("nan"), 1.0)]
    got = {r.id: r for r in ranking.relaxed(spark.createDataFrame(rows, "id bigint, x double, y double"), rounds=1).collect()}
    assert (got[1].x, got[2].x, got[5].x) == (0.0, 0.0, None) and math.isnan(got[6].x)
    assert (got[3].x, got[4].x) == (491.0, 549.0)  # 0.225 of the 40 that they lack, each
    assert ranking.relaxed(spark.createDataFrame([], "id bigint, x double, y double")).count() == 0


def test_blocks_of_a_crowd_meet_once_and_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 40)
    rng = random.Random(5)
    rows = [(i, rng.uniform(-30, 30), rng.uniform(70, 130)) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double")
    got = {r.id: (r.x, r.y) for r in ranking.relaxed(df, rounds=3).collect()}
    want = brute({i: (x, y) for i, x, y in rows}, 80.0, 3)
    assert max(math.dist(got[i], p) for i, p in want.items()) < 1e-6
    groups, apply = [], type(df.groupBy("id")).applyInPandas

    def seen(grouped, *args):
        groups.append(grouped._df.rdd.getNumPartitions())
        return apply(grouped, *args)

    monkeypatch.setattr(type(df.groupBy("id")), "applyInPandas", seen)
    ranking.relaxed(df, rounds=1).collect()
    assert min(groups) >= 4 * spark.sparkContext.defaultParallelism  # a few bytes, but not one task


def test_a_block_s_pairs_are_those_of_a_loop():
    """Strips that are wholly near, partly near and far, and points that coincide."""
    rng = np.random.default_rng(7)
    a, b = (rng.uniform(0, 80, (2, n)).round(1) for n in (700, 300))
    b[0] += 60

    def plain(p, q):
        dx, dy = (p[k][:, None] - q[k][None] for k in (0, 1))
        dist = np.sqrt(dx * dx + dy * dy)
        near = (dist < 80) & (dist > 0.001)
        lack, dist = np.where(near, 80 - dist, 0), np.where(near, dist, 1)
        x, y = (d / dist * lack * 0.225 * 1e9 for d in (dx, dy))
        pushes = [np.where(v < 0, np.ceil(v - 0.5), np.floor(v + 0.5)).astype(np.int64).sum(axis=1) for v in (x, y)]
        return np.stack([*pushes, near.sum(axis=1)])

    got = ranking._push_blocks(*a, *b, 80.0, False)
    assert (got[0] == plain(a, b)).all() and (got[1] == plain(b, a)).all()
    got = ranking._push_blocks(*a, *a, 80.0, True)
    assert (got[0] + got[1] == plain(a, a)).all()


def test_a_crowd_of_twelve_thousand_points_is_sent_once(spark, monkeypatch):
    sent, apply = [], type(spark.range(1).groupBy("id")).applyInPandas

    def seen(grouped, *args):
        sent.append(grouped._df.count())
        return apply(grouped, *args)

    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "applyInPandas", seen)
    crowd = spark.range(12_000).select("id", (F.col("id") % 79 + 0.5).alias("x"), (F.col("id") % 71 + 0.25).alias("y"))
    assert ranking.relaxed(crowd, rounds=1).count() == 12_000
    assert sent == [12_000]
