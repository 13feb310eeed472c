"""Shared-folder and session helpers of the training-data operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The null doc_id sorts after every other one.
LAST_ID = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in a local session without one, as in tests, a folder of its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """For a job whose whole result gets written: its shuffle files go as soon as it ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
        release(spark)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of fewer rows than Spark's default, for columns of whole texts; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder; for small steps, whose files Spark drops with the plan."""
    spark = df.sparkSession
    shared_dir(spark)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str, scratch_of: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder; for large steps, whose shuffle files must not outlive them.

    The folder goes when the driver's Python ends, or with drop() where its path is added to scratch_of.
    """
    spark = df.sparkSession
    path, schema = scratch(spark, what), df.schema
    with own_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_drop_written)
    _written.append((spark, path))
    if scratch_of is not None:
        scratch_of.append(path)
    return spark.read.schema(schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


def drop(paths: list[str]) -> None:
    """Deletes written tables that nothing reads any more."""
    for entry in [e for e in _written if e[1] in paths]:
        _written.remove(entry)
        delete(*entry)
    paths.clear()


def _drop_written() -> None:
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is not None:
            delete(spark, path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nobody holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder of a shared store has."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return [x.getPath().getName() for x in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]


#: Tables of ids of up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_IDS = 200_000


def broadcast_if_small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids (doc_id); rows of a null id stay."""
    return docs.join(broadcast_if_small(ids), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def id_or_last(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_mod(name: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n (null id: as of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def power_of_two(n: float) -> int:
    return 1 << max(0, int(n) - 1).bit_length()
