"""Streaming forms against their batch forms."""

import math

from pyspark.sql import functions as F

from tessera.functions import memory as M
from tessera.streaming import reinforce, watch


def test_quiet_gap():
    assert [watch.quiet_gap(x) for x in (None, 5, 10**6, 500)] == [2000, 100, 60000, 500]


def test_watch_syncs_once_per_batch(spark, tmp_path):
    events = spark.createDataFrame([("modify_data", "a.rs"), ("modify_data", "target/x.rs"), ("access", "b.rs"), ("remove", "gone")], "kind string, path string")
    events.coalesce(1).write.json(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(events.schema).json(str(tmp_path / "in"))
    watch.watch(stream, lambda df, n: seen.append(sorted(r.path for r in df.collect())), str(tmp_path / "cp")).awaitTermination(60)
    assert seen == [["a.rs", "gone"]]


def test_windows_match_bursts(spark, tmp_path):
    rows = [("k", "2024-01-01 00:00:00"), ("k", "2024-01-01 00:00:05"), ("k", "2024-01-01 00:01:00"), ("z", "2024-01-03 00:00:00")]
    e = spark.createDataFrame(rows, "key string, t string").select("key", F.to_timestamp("t").alias("ts"))
    e.filter("key = 'k'").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    e.filter("key = 'z'").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = watch.windows(stream, "key", "ts", "10 seconds", "1 second").writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = sorted((r.key, r.n) for r in spark.table("closed").collect() if r.key == "k")
    want = sorted((r.key, r.n) for r in watch.bursts(e, "key", "ts", 10).filter("key = 'k'").collect())
    assert got == want == [("k", 1), ("k", 2)]


def test_reinforcement_fold(spark):
    day = M.DAY
    log = spark.createDataFrame([(1, 0), (1, day), (1, 60 * day), (2, 5)], "key long, at long")
    got = {r.key: (r.stability, r.recalled_at, r.recalls) for r in reinforce.folded(log, "key", "at").collect()}
    assert math.isclose(got[1][0], 11.9) and got[1][1:] == (day, 1) and got[2] == (7.0, 5, 0)


def test_streamed_reinforcement_matches_the_fold(spark, tmp_path):
    day = M.DAY
    log = spark.createDataFrame([(1, 0), (1, day), (1, 60 * day), (2, 5), (2, 6)], "key long, at long")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = reinforce.streamed(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName("reinforced").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(90)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.key, round(r.stability, 9), r.recalled_at, r.recalls) for r in spark.table("reinforced").collect())
    assert got == sorted((r.key, round(r.stability, 9), r.recalled_at, r.recalls) for r in reinforce.folded(log, "key", "at").collect())
