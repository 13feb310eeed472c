"""The code graph from source text: definitions, references and implementations as tables, edges from them, and their
upkeep when files change.

A graph is a set of tables: files (path, size, mtime, hash), nodes (id, kind, name, file_path, start_line, end_line,
signature), refs (file_path, source_id, target_name, edge_kind, line, qualifier, prefer: call or type), impls (file_path,
type_name, trait_name, line, method_id, method_line) and edges (source, target, kind, line, file_path: the file whose
rows make the edge). Names are resolved against all nodes, so edges of a file may change when another file does.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.operators import graph, parsers, snapshot
from tessera.sources.shared import cut, shuffled

# Kinds that stand for a trait.
TRAIT_KINDS = ["trait", "class", "struct"]
#: Bytes of text that a task parses, beyond a part for each core.
PART_BYTES = 16 << 20


class Graph(NamedTuple):
    files: DataFrame
    nodes: DataFrame
    refs: DataFrame
    impls: DataFrame
    edges: DataFrame


def symbol_id(file: Column, kind: Column, name: Column, line: Column) -> Column:
    return F.concat_ws(":", file, kind, name, line.cast("string"))


def extracted(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, refs, impls) of source files. files: path, language, text.

    A reference belongs to the innermost definition around it; outside every one it is dropped. An implementation block
    makes a row of its own and one for each method that starts in it.
    """
    # Many sources may come from few tasks: they are dealt out before they are parsed. What is parsed stays in these parts, and
    # each of them writes to all parts of a later shuffle, so there are no more than the bytes call for.
    size = files.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(files.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    found = cut(parsers.parsed(files.withColumnRenamed("path", "file_path").repartition(n, "file_path")))
    return tables_of(files.select(F.col("path").alias("file_path")), found)


def tables_of(files: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, refs, impls) of findings. files: file_path; found: as from parsers.parsed."""
    defs = found.filter("what = 'def'").withColumn("id", symbol_id(F.col("file_path"), F.col("kind"), F.col("name"), F.col("start_line"))).dropDuplicates(["id"])
    defs = defs.select("id", "kind", "name", "file_path", "start_line", "end_line", "signature")
    own = files.select(F.concat(F.lit("file:"), F.col("file_path")).alias("id"), F.lit("file").alias("kind"), P.file_name(F.col("file_path")).alias("name"), "file_path", F.lit(1).alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("string").alias("signature"))
    points = found.filter("what = 'ref'").select("file_path", F.col("start_line").alias("line"), F.col("name").alias("target_name"), F.col("kind").alias("edge_kind"), "qualifier").distinct()
    points = points.withColumn("point_id", F.struct("file_path", "line", "target_name", "edge_kind", "qualifier"))
    placed = graph.innermost(points, shuffled(defs.select("id", "file_path", "start_line", "end_line")))
    refs = placed.select("file_path", F.col("span_id").alias("source_id"), "target_name", "edge_kind", "line", "qualifier", F.when(F.col("edge_kind") == "calls", "call").otherwise("type").alias("prefer"))
    blocks = found.filter("what = 'impl'").select("file_path", F.col("within").alias("type_name"), F.col("name").alias("trait_name"), F.col("start_line").alias("line"), "end_line").distinct()
    methods = defs.filter("kind = 'method'").select("file_path", F.col("id").alias("method_id"), F.col("start_line").alias("method_line"))
    inside = blocks.join(shuffled(methods), "file_path").filter("method_line between line and end_line")
    columns = ["file_path", "type_name", "trait_name", "line", "method_id", "method_line"]
    header = blocks.select("file_path", "type_name", "trait_name", "line", F.lit(None).cast("string").alias("method_id"), F.lit(None).cast("int").alias("method_line"))
    return own.union(defs), refs, header.union(inside.select(*columns))


def edges_of(nodes: DataFrame, refs: DataFrame, impls: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """The edges that the rows of all files make, or of those in `only` (file_path), resolved against all nodes."""
    candidates = nodes.filter("kind <> 'file'").select("id", "name", "kind", "file_path")
    if only is not None:
        nodes, refs, impls = (t.join(only, "file_path", "left_semi") for t in (nodes, refs, impls))

    def asked(rows: DataFrame, what: str, name: str, prefer: Column, **more: Column) -> DataFrame:
        own = [more.get(c, F.lit(None)).cast(t).alias(c) for c, t in (("source_id", "string"), ("edge_kind", "string"), ("line", "int"))]
        ref_id = F.struct(F.lit(what).alias("what"), "file_path", F.col(name).alias("name"), *own)
        return rows.select(ref_id.alias("ref_id"), F.col(name).alias("name"), "file_path", prefer.alias("prefer"), more.get("qualifier", F.lit(None)).cast("string").alias("qualifier")).distinct()

    def kinds(names: list[str]) -> Column:
        return F.array(*[F.lit(k) for k in names])

    # All names are resolved in one go, against the same classes of candidates.
    prefer = F.when(F.col("prefer") == "call", kinds(P.CALL_KINDS)).otherwise(kinds(P.TYPE_KINDS))
    names = asked(refs, "ref", "target_name", prefer, **{c: F.col(c) for c in ("source_id", "edge_kind", "line", "qualifier")})
    for column, wanted in (("type_name", P.TYPE_KINDS), ("trait_name", TRAIT_KINDS)):
        names = names.union(asked(impls.filter(F.col(column).isNotNull()), column, column, kinds(wanted)))
    found = cut(graph.resolve(names, candidates).select("ref_id.*", "id"))
    resolved = found.filter("what = 'ref'").select(F.col("source_id").alias("source"), F.col("id").alias("target"), F.col("edge_kind").alias("kind"), "line", "file_path")

    def named(column: str, out: str) -> DataFrame:
        return shuffled(found.filter(F.col("what") == column).select("file_path", F.col("name").alias(column), F.col("id").alias(out)))

    blocks = impls.join(named("type_name", "type_id"), ["file_path", "type_name"]).join(named("trait_name", "trait_id"), ["file_path", "trait_name"], "left")
    return graph.built_edges(nodes, resolved, blocks)


def _quiet(_phase: str) -> None:
    pass


def full(files: DataFrame, tell: Callable[[str], None] = _quiet) -> Graph:
    """The graph of source files. files: path, size, mtime, hash, language, text. tell: gets each phase as it begins."""
    tell("parsing")
    tables = extracted(files)
    tell("storing")
    nodes, refs, impls = (cut(t) for t in tables)
    tell("resolving")
    return Graph(files.select("path", "size", "mtime", "hash"), nodes, refs, impls, cut(edges_of(nodes, refs, impls)))


class Changes(NamedTuple):
    """What a change of files does to a graph: keys whose rows go (gone: file_path; affected: file_path of edges), the new
    rows, and the status of each file."""

    status: DataFrame
    gone: DataFrame
    affected: DataFrame
    files: DataFrame
    nodes: DataFrame
    refs: DataFrame
    impls: DataFrame
    edges: DataFrame


def changes(old: Graph, files: DataFrame, only: DataFrame | None = None, tell: Callable[[str], None] = _quiet) -> Changes:
    """Only new and changed files are parsed, and edges are made anew only for them and for files that use a name they
    define or defined. only (path): the files that may differ; files need then have no others."""
    tell("scanning")
    before = old.files if only is None else old.files.join(only, "path", "left_semi")
    status = cut(snapshot.diff(before, files.select("path", "size", "mtime", "hash")))
    changed = status.filter("status in ('added', 'modified')").select("path")
    gone = status.filter("status in ('added', 'modified', 'removed')").select(F.col("path").alias("file_path"))
    tell("parsing")
    fresh = [cut(t) for t in extracted(files.join(changed, "path", "left_semi"))]
    tell("storing")
    nodes, refs, impls = (t.join(gone, "file_path", "left_anti").unionByName(f) for t, f in zip(old[1:4], fresh, strict=True))
    names = old.nodes.join(gone, "file_path", "left_semi").filter("kind <> 'file'").select("name").union(fresh[0].filter("kind <> 'file'").select("name"))
    affected = cut(graph.affected_files(gone, names, refs, impls))
    tell("resolving")
    seen = status.filter("status in ('added', 'modified', 'touched')").select("path")
    rows = files.select("path", "size", "mtime", "hash").join(seen, "path", "left_semi")
    return Changes(status, gone, affected, rows, *fresh, cut(edges_of(nodes, refs, impls, affected)))


def synced(old: Graph, files: DataFrame, tell: Callable[[str], None] = _quiet) -> tuple[Graph, DataFrame]:
    """(graph, report) after a change of files. The same as full() of the new files."""
    c = changes(old, files, None, tell)
    nodes, refs, impls = (cut(t.join(c.gone, "file_path", "left_anti").unionByName(f)) for t, f in zip(old[1:4], (c.nodes, c.refs, c.impls), strict=True))
    edges = old.edges.join(c.affected, "file_path", "left_anti").unionByName(c.edges)
    return Graph(files.select("path", "size", "mtime", "hash"), nodes, refs, impls, cut(snapshot.without_edges_of(edges, shuffled(nodes)))), snapshot.report(c.status)


def refreshed(old: Graph | None, files: DataFrame) -> Graph:
    """A graph that fits the files: indexed as a whole where there is none yet, else brought up to date."""
    return full(files) if old is None or old.nodes.isEmpty() else synced(old, files)[0]
