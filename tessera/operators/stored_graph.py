"""A code graph in a versioned store, kept up by the changes of files alone.

Rows say at which commit they were made (at), and a table of owners says for each file which commit made it last; rows
of older commits are dead. A sync appends rows of the files that changed and of the edges that they affect, nothing else,
and commits all tables at once. From MOST_PARTS appended folders on, live rows are written anew into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import index, snapshot
from tessera.sources.shared import shuffled
from tessera.sources.store import Lease, Store, Version

#: Tables by the owners that say which of their rows live, and their key.
OWNERS = {"files": ("sources", "path"), "nodes": ("sources", "file_path"), "refs": ("sources", "file_path"), "impls": ("sources", "file_path"), "edges": ("users", "file_path")}
MOST_PARTS = 16


def live(store: Store, name: str, version: Version) -> DataFrame:
    owners, key = OWNERS[name]
    last = store.table(owners, version).groupBy(F.col("file_path").alias(key)).agg(F.max("at").alias("at"))
    rows = store.table(name, version)
    return rows.join(shuffled(last), [key, "at"], "left_semi").select(*[c for c in rows.columns if c != "at"])


def read(store: Store, version: Version | None = None) -> index.Graph | None:
    """The last committed graph; none if there is none."""
    version = version or store.latest()
    return index.Graph(*[live(store, name, version) for name in index.Graph._fields]) if "nodes" in version.tables else None


def sync(store: Store, files: DataFrame, only: DataFrame | None = None, marks: dict[str, int] | None = None, lease: Lease | None = None, tell: Callable[[str], None] = lambda _phase: None) -> DataFrame | None:
    """Brings the stored graph up to date and returns the report; None where marks say that this batch was applied.

    files: path, size, mtime, hash, language, text; all of them, or with only (path) those of the changed paths.
    """
    base = store.latest()
    if marks and all(base.marks.get(source, -1) >= number for source, number in marks.items()):
        return None
    old = read(store, base)
    if old is None:
        g = index.full(files, tell)
        tables, status = dict(zip(index.Graph._fields, g, strict=True)), snapshot.diff(g.files.limit(0), g.files)
        paths = g.files.select(F.col("path").alias("file_path"))
        owners = {"sources": paths, "users": paths}
    else:
        c = index.changes(old, files, only, tell)
        tables, status = {name: getattr(c, name) for name in index.Graph._fields}, c.status
        # A touched file has new times, and keeps its other rows: they are written again with it.
        touched = c.files.select(F.col("path").alias("file_path")).join(c.gone, "file_path", "left_anti")
        for name in ("nodes", "refs", "impls"):
            tables[name] = tables[name].unionByName(getattr(old, name).join(touched, "file_path", "left_semi"))
        owners = {"sources": c.gone.union(touched), "users": c.affected}
    at = F.lit(base.number + 1).cast("long")
    rows = {name: t.withColumn("at", at) for name, t in (tables | owners).items()}
    done = store.commit(append=rows, marks=marks, base=base, lease=lease)
    if len(store.parts("nodes", done)) > MOST_PARTS:
        compact(store, lease)
    return snapshot.report(status)


def compact(store: Store, lease: Lease | None = None) -> Version:
    base = store.latest()
    g = read(store, base)
    at = F.lit(base.number + 1).cast("long")
    paths = g.files.select(F.col("path").alias("file_path"))
    rows = dict(zip(index.Graph._fields, g, strict=True)) | {"sources": paths, "users": g.edges.select("file_path").union(paths).distinct()}
    return store.commit(replace={name: t.withColumn("at", at) for name, t in rows.items()}, base=base, lease=lease)
