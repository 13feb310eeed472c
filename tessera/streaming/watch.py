"""Change events to synchronisations: relevant events, quiet gaps, one sync a burst."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.operators import stored_graph
from tessera.sources.shared import cut
from tessera.sources.store import Lease, Store

# Bounds and default of the quiet gap, in milliseconds.
LEAST_MS, MOST_MS, DEFAULT_MS = 100, 60_000, 2_000
RELEVANT = ("create", "remove", "modify_data", "modify_name", "modify_any")


def quiet_gap(ms: int | None) -> int:
    return max(LEAST_MS, min(MOST_MS, DEFAULT_MS if ms is None else ms))


def relevant(events: DataFrame) -> DataFrame:
    """Events that call for a sync: a relevant kind, on a source path (or a removed one) outside skipped directories."""
    skipped = "(^|/)(" + "|".join(d.replace(".", "\\.") for d in P.SKIPPED_DIRECTORIES) + ")(/|$)"
    source = P.language(F.col("path")).isNotNull() | (F.col("kind") == "remove")
    return events.filter(F.col("kind").isin(*RELEVANT) & source & ~F.col("path").rlike(skipped))


def bursts(events: DataFrame, key: str, ts: str, gap_seconds: float) -> DataFrame:
    """(key, begins, ends, n): runs of events of a key whose gaps are at most gap_seconds. Batch form of windows().

    Events are dealt by ranges of (key, time), which splits a key of any size. Each task finds the runs of its events as
    they stream by; only its first and its last run can go on in another task, and are joined with their neighbours.
    """
    rows = events.filter(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    key_type = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None  # key, begin, end, n of the run that is open
        is_first = True
        for batch in batches:
            done = []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("t").to_pylist(), strict=True):
                if now is not None and now[0] == k and t - now[2] <= gap_seconds * 1_000_000:
                    now[2], now[3] = t, now[3] + 1
                    continue
                if now is not None:
                    done.append((*now, is_first))
                    is_first = False
                now = [k, t, t, 1]
            yield _runs(batch.schema.field("key").type, done)
        if now is not None:
            yield _runs(batch.schema.field("key").type, [(*now, True)])

    runs = cut(rows.repartitionByRange("key", "t").sortWithinPartitions("key", "t").mapInArrow(run, f"key {key_type}, begins long, ends long, n long, edge boolean"))
    order = Window.partitionBy("key").orderBy("begins", "ends")
    edges = runs.filter("edge")
    new = F.coalesce((F.col("begins") - F.lag("ends").over(order) > F.lit(int(gap_seconds * 1_000_000))).cast("int"), F.lit(1))
    edges = edges.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = edges.groupBy("key", "run").agg(F.min("begins").alias("begins"), F.max("ends").alias("ends"), F.sum("n").alias("n")).drop("run")
    whole = runs.filter("not edge").select("key", "begins", "ends", "n").unionByName(joined)
    kind = events.schema[ts].dataType
    return whole.select(F.col("key").alias(key), F.timestamp_micros("begins").cast(kind).alias("begins"), F.timestamp_micros("ends").cast(kind).alias("ends"), "n")


def _runs(key_type: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    types = [key_type, pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "begins", "ends", "n", "edge"])


def windows(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Streaming form of bursts: session windows that close when the watermark passes."""
    found = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    return found.select(key, F.col("session_window.start").alias("begins"), F.col("session_window.end").alias("closes"), "n")


def watch(events: DataFrame, sync: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Runs sync(batch of relevant events, batch id) for every micro-batch that has any; one query per checkpoint.

    The checkpoint makes restarts go on where they were, and lets no second query write at the same time.
    """

    def each(batch: DataFrame, number: int) -> None:
        found = relevant(batch)
        if not found.isEmpty():
            sync(found, number)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def event_time(column: Column) -> Column:
    return F.to_timestamp(column)


def keep_graph(events: DataFrame, store: Store, files_now: Callable[[DataFrame], DataFrame], checkpoint: str, stream: str = "watch", lease: Lease | None = None, trigger: dict | None = None):
    """Keeps a stored graph up to date with a stream of change events (kind, path).

    files_now: gets (path) and gives those of the paths that are there: path, size, mtime, hash, language, text. Each
    micro-batch is one commit that carries the batch's number, so a batch that a restart brings again changes nothing.
    """

    def sync(batch: DataFrame, number: int) -> None:
        paths = batch.select("path").distinct()
        stored_graph.sync(store, files_now(paths), paths, {stream: number}, lease)

    return watch(events, sync, checkpoint, trigger)
