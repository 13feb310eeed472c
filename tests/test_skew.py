"""Folds, runs and reach where one key or file has most of the rows, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import memory as M
from tessera.operators import graph
from tessera.streaming import reinforce, watch


def fold(ts):
    s, at, n = M.BASE_STABILITY, ts[0], 0
    for t in ts[1:]:
        if math.exp(-max((t - at) / M.DAY, 0.0) / max(s, M.LEAST_STABILITY)) >= M.NEEDS_UPDATE:
            s, at, n = max(s, M.BASE_STABILITY) * M.GROWTH, t, n + 1
    return s, at, n


def test_fold_of_a_hot_key(spark):
    rnd = random.Random(1)
    logs = {k: sorted(rnd.randrange(0, rnd.choice([50, 500, 5000]) * M.DAY) for _ in range(rnd.randrange(1, 200))) for k in range(60)}
    logs |= {1000: sorted(rnd.randrange(0, 400 * M.DAY) for _ in range(20_000)), 1001: [5] * 100, 1002: [0, 2**60], 1003: list(range(0, 65 * 60, 60)), 1004: list(range(64))}
    log = spark.createDataFrame([(k, t) for k, ts in logs.items() for t in ts], "key long, at long").repartition(6)
    got = {r.key: (r.stability, r.recalled_at, r.recalls) for r in reinforce.folded(log, "key", "at").collect()}
    want = {k: fold(ts) for k, ts in logs.items()}
    assert {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in want.items()}
    assert all(got[k][0] == pytest.approx(want[k][0], rel=1e-12) for k in want)
    assert reinforce.folded(log.limit(0), "key", "at").collect() == []


def test_runs_of_a_hot_key(spark):
    rnd = random.Random(2)
    events = {k: sorted(rnd.randrange(0, 100_000) for _ in range(rnd.randrange(1, 40))) for k in ["a", "b", None]}
    events |= {"hot": sorted(rnd.randrange(0, 400_000) for _ in range(30_000)), "dense": list(range(5000)), "z": [1, 1, 1]}
    df = spark.createDataFrame([(k, t) for k, ts in events.items() for t in ts], "k string, t long").select("k", F.timestamp_seconds("t").alias("ts")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(((r.k, r.begins.timestamp(), r.ends.timestamp(), r.n) for r in watch.bursts(df, "k", "ts", 30).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for k, ts in events.items():
        for i, t in enumerate(ts):
            if i and t - ts[i - 1] <= 30:
                want[-1][2:] = [float(t), want[-1][3] + 1]
            else:
                want.append([k, float(t), float(t), 1])
    assert got == sorted(map(tuple, want), key=repr)


def test_reach_through_hubs(spark, monkeypatch):
    rnd = random.Random(3)
    n = 300
    links = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(350)} | {(0, i) for i in range(1, 120)} | {(i, 7) for i in range(100, 220)}
    nodes = spark.createDataFrame([(f"s{i}", f"f{i // 2}") for i in range(n)], "id string, file_path string")
    edges = spark.createDataFrame([(f"s{a}", f"s{b}", "calls") for a, b in links], "source string, target string, kind string")
    near = {}
    for a, b in links:
        if a // 2 != b // 2:
            near.setdefault(a // 2, set()).add(b // 2)
            near.setdefault(b // 2, set()).add(a // 2)
    want = {f"f{i}": (len(near.get(i, ())), len(set().union(near.get(i, set()), *[near[j] for j in near.get(i, ())]) - {i})) for i in range(n // 2)}
    for hub in (8, 64, 10_000):
        monkeypatch.setattr(graph, "HUB", hub)
        assert {r.file_path: (r.hop1, r.hop2) for r in graph.reach(edges, nodes).collect()} == want


def test_a_file_with_a_hundred_thousand_neighbours(spark):
    nodes = spark.range(100_001).select(F.concat(F.lit("s"), "id").alias("id"), F.concat(F.lit("f"), "id").alias("file_path"))
    edges = spark.range(1, 100_001).select(F.concat(F.lit("s"), "id").alias("source"), F.lit("s0").alias("target"), F.lit("calls").alias("kind"))
    got = graph.reach(edges, nodes).groupBy("hop1", "hop2").count().collect()
    assert sorted(map(tuple, got)) == [(1, 100_000, 100_000), (100_000, 100_000, 1)]


def test_members_of_one_file_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "MET", 4)
    nodes = spark.createDataFrame([(f"s{i}", "trait", f"n{i}", "supply.rs", 1, 1) for i in range(30)] + [("c1", "class", "c", "a.rs", 1, 9), ("m1", "method", "m", "a.rs", 2, 3), ("file:a.rs", "file", "a.rs", "a.rs", 1, 9)], "id string, kind string, name string, file_path string, start_line int, end_line int")
    edges = spark.createDataFrame([("c1", "m1", "contains", 2)], "source string, target string, kind string, line int")
    asked = nodes.filter("kind in ('trait', 'class')").select(F.col("id").alias("asked"))
    rows = graph.members(nodes, edges, asked)
    assert sorted((r.asked, r.id) for r in rows.collect()) == sorted([("c1", "m1")] + [(f"s{i}", f"s{j}") for i in range(30) for j in range(30)])
    per_task = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(per_task) < 600


def test_members_of_one_file_are_few_bytes(spark, monkeypatch, tmp_path):
    """Only the result is quadratic: what is shuffled is copied a fixed number of times, and pairs repeat a few ids as written."""
    n, seen, real = 1203, [], type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda rows, *a: (seen.append(rows.count()) if "across_at" in rows.columns else None) or real(rows, *a))
    nodes = spark.range(n).select(F.concat(F.lit("s"), "id").alias("id"), F.lit("trait").alias("kind"), F.lit("supply.rs").alias("file_path"))
    edges = spark.createDataFrame([], "source string, target string, kind string, line int")
    asked = nodes.select(F.col("id").alias("asked"))
    graph.members(nodes, edges, asked).write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == rows.distinct().count() == n * n and rows.select("id").distinct().count() == n
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.3 * n * n
    monkeypatch.setattr(graph, "MET", 4)
    seen.clear()
    assert graph.members(nodes, edges, asked).count() == n * n
    assert len(seen) == 2 and max(seen) < 4 * n


def test_edges_are_dealt_out_before_repeated_ones_go(spark):
    edges = spark.createDataFrame([("a", "b", "calls", None), ("a", "b", "calls", None), ("a", "b", "calls", 3), ("b", "a", "calls", 3)], "source string, target string, kind string, line int")
    rows = graph.unique_edges(edges)
    assert sorted((r.source, r.target, r.line or 0) for r in rows.collect()) == [("a", "b", 0), ("a", "b", 3), ("b", "a", 3)]
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert "Exchange" in plan and plan.rindex("Aggregate") < plan.index("Exchange")
