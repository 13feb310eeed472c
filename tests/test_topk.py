"""The first rows of each key, combined before the shuffle, against sorting them all."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import topk, vfs


@pytest.mark.parametrize("k", [1, 7, 5000])
def test_first_k(spark, k, monkeypatch):
    rnd = random.Random(k)
    rows = [(rnd.choice([None, "a", "b", "hot", "hot", "hot"]), rnd.choice([True, False, None]), rnd.randrange(50), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "q string, b boolean, v int, id long").repartition(5)
    got = topk.first_k(df, ["q", "b"], [("v", "descending"), ("id", "ascending")], k)
    by = {}
    for r in rows:
        by.setdefault(r[:2], []).append(r)
    want = [(*r, i, len(own)) for own in by.values() for i, r in enumerate(sorted(own, key=lambda r: (-r[2], r[3]))[:k], 1)]
    assert sorted(map(tuple, got.select("q", "b", "v", "id", "rank", "total").collect()), key=repr) == sorted(want, key=repr)
    assert topk.first_k(df.limit(0), ["q"], [("v", "ascending")], k).collect() == []


def test_each_task_sends_k_rows(spark):
    """One key in every row: k rows of each of eight tasks meet, and the count is that of all."""
    df = spark.range(400_000, numPartitions=8).select(F.lit("needle").alias("q"), "id")
    few = topk.partial_firsts(df, ["q"], [("id", "descending")], 20)
    assert few.count() == 160 and few.agg(F.sum("n")).first()[0] == 400_000
    assert [r.id for r in topk.first_k(df, ["q"], [("id", "descending")], 3).orderBy("rank").collect()] == [399_999, 399_998, 399_997]


def test_ranked_goes_by_ranges(spark):
    """All ranks of a key, without a window over the key alone: each task has a range of it."""
    rnd = random.Random(3)
    rows = [(rnd.choice([None, "a", "hot", "hot", "hot"]), rnd.randrange(40), i) for i in range(3000)]
    got = topk.ranked(spark.createDataFrame(rows, "q string, v int, id long").repartition(5), "q", ["v", "id"])
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    want = [(*r, i, len(own)) for own in by.values() for i, r in enumerate(sorted(own, key=lambda r: r[1:]), 1)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    files = spark.createDataFrame([(f"f{i:03d}", "x\nneedle\nneedle") for i in range(50)], "file_path string, text string")
    found = vfs.grep(files, spark.createDataFrame([("n", "needle")], "qid string, query string"))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(range#" in plan and "row_number() windowspecdefinition(qid#" not in plan
    assert [(r.file_path, r.line, r.total) for r in found.orderBy("rank").collect()] == [(f"f{i:03d}", n, 100) for i in range(50) for n in (2, 3)]
