"""Snapshot diff and incremental maintenance of derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, force: Column | None = None) -> DataFrame:
    """(path, status): added, removed, unchanged (same size and time), touched (same hash), modified.

    old, new: path, size, mtime, hash. A row of `new` without a hash was unreadable: skipped, or still unchanged. force
    (over path) makes unchanged and touched rows modified, as a change of version does.
    """
    n = new.select("path", *[F.col(c).alias(f"new_{c}") for c in ("size", "mtime", "hash")], F.lit(True).alias("is_new"))
    o = old.select("path", *[F.col(c).alias(f"old_{c}") for c in ("size", "mtime", "hash")], F.lit(True).alias("is_old"))
    rows = o.join(n, "path", "full_outer")
    same = (F.col("old_size") == F.col("new_size")) & (F.col("old_mtime") == F.col("new_mtime"))
    status = F.when(F.col("is_new").isNull(), "removed").when(F.col("is_old").isNotNull() & F.coalesce(same, F.lit(False)), "unchanged")
    status = status.when(F.col("new_hash").isNull(), "skipped").when(F.col("is_old").isNull(), "added")
    status = status.when(F.col("old_hash") == F.col("new_hash"), "touched").otherwise("modified")
    if force is not None:
        status = F.when(force & status.isin("unchanged", "touched"), "modified").otherwise(status)
    return rows.select("path", status.alias("status"))


def report(statuses: DataFrame) -> DataFrame:
    """One row: checked, added, modified, touched, removed, parsed, skipped."""
    def n(*names: str) -> Column:
        return F.count_if(F.col("status").isin(*names))

    return statuses.agg(n("added", "modified", "touched", "unchanged", "skipped").alias("checked"), n("added").alias("added"), n("modified").alias("modified"), n("touched").alias("touched"), n("removed").alias("removed"), n("added", "modified").alias("parsed"), n("skipped").alias("skipped"))


def replaced(old: DataFrame, fresh: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """old with the rows of changed keys replaced by fresh ones, and without those of gone keys. gone: key."""
    drop = fresh.select(key).union(gone.select(key)).distinct()
    return old.join(drop, key, "left_anti").unionByName(fresh)


def touched(old: DataFrame, new: DataFrame, statuses: DataFrame) -> DataFrame:
    """Stored file rows with the new times of touched files."""
    fresh = new.join(statuses.filter("status = 'touched'").select("path"), "path", "left_semi").select("path", F.col("mtime").alias("new_mtime"))
    return old.join(fresh, "path", "left").withColumn("mtime", F.coalesce("new_mtime", "mtime")).drop("new_mtime")


def without_edges_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are still nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)
