"""Virtual filesystem: listings, routing, outlines, reading, literal line search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions import text as T
from tessera.operators import graph, retrieval, scan, topk


def listing(files: DataFrame, prefix: str = "") -> DataFrame:
    """(name, kind): what is directly under a directory, directories first. files: path."""
    at = F.lit(prefix + "/" if prefix else "")
    rest = F.expr(f"substring(path, {len(prefix) + 2 if prefix else 1})")
    under = files.filter(F.startswith("path", at)).select(rest.alias("rest"))
    found = under.select(F.split_part("rest", F.lit("/"), F.lit(1)).alias("name"), F.contains("rest", F.lit("/")).alias("deep"))
    return found.groupBy("name").agg(F.when(F.max("deep"), "dir").otherwise("file").alias("kind")).filter("name <> ''")


def children(files: DataFrame) -> DataFrame:
    """(dir, name, kind, n_files): the listing of every directory at once; the root is ''."""
    parts = files.select(F.split("path", "/").alias("p")).select("p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("i"))
    at = F.expr("array_join(slice(p, 1, i), '/')")
    rows = parts.select(at.alias("dir"), F.expr("element_at(p, i + 1)").alias("name"), F.when(F.expr("i + 1 < size(p)"), "dir").otherwise("file").alias("kind"))
    return rows.filter("name <> ''").groupBy("dir", "name", "kind").agg(F.count("*").alias("n_files"))


def with_nested(entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Entries whose name is a nested project become projects; nested projects without an entry are added. catalog: name."""
    marked = entries.join(catalog.select("name", F.lit(True).alias("nested")), "name", "full_outer")
    return marked.select("name", F.when(F.col("nested"), "project").otherwise(F.col("kind")).alias("kind"))


def route(paths: DataFrame, shards: DataFrame) -> DataFrame:
    """(path, prefix, rest): the longest shard prefix above each path ('' where none is). shards: prefix."""
    # Every directory above a path is a possible prefix: an equality instead of a range.
    parts = paths.select("path", F.split("path", "/").alias("p")).select("path", F.explode(F.expr("transform(sequence(1, size(p)), i -> array_join(slice(p, 1, i), '/'))")).alias("prefix"))
    near = parts.join(shards.filter("prefix <> ''").distinct(), "prefix")
    best = paths.distinct().join(near.groupBy("path").agg(F.max_by("prefix", F.length("prefix")).alias("prefix")), "path", "left")
    return best.select("path", F.coalesce("prefix", F.lit("")).alias("prefix"), F.when(F.col("prefix").isNull(), F.col("path")).otherwise(F.expr("substring(path, length(prefix) + 2)")).alias("rest"))


def outline(nodes: DataFrame) -> DataFrame:
    """(file_path, text): a header and a line per symbol, in the order of their lines."""
    line = F.format_string("  %s  %s  %d-%d", "name", "kind", "start_line", "end_line")
    rows = nodes.filter("kind <> 'file'").groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", "id", line.alias("l")))).alias("ls"))
    return rows.select("file_path", F.concat_ws("\n", F.col("file_path"), F.expr("array_join(transform(ls, x -> x.l), '\n')")).alias("text"))


def read_spans(files: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, text): the lines of each span. files: file_path, text; spans: id, file_path, start_line, end_line."""
    return spans.join(files, "file_path").select("id", T.slice_lines("text", F.col("start_line"), F.col("end_line")).alias("text"))


def read(files: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, status, kind, path, start_line, end_line, text, id): what each virtual path shows.

    asked: qid, path, full (boolean). In this order: the source of the node with that id; the source of file/symbol
    (status ambiguous and a row per candidate where several share the name, not_found where none has it); with full the
    whole file; else the file's outline. A path that is no source file is refused (no_file).
    """
    symbols = nodes.filter("kind <> 'file'")
    asked = asked.select("qid", P.normalized(F.col("path")).alias("path"), "full")
    by_id = asked.filter(F.contains("path", F.lit(":"))).join(symbols, F.col("path") == F.col("id")).select("qid", "id")
    rest = asked.join(by_id.select("qid"), "qid", "left_anti")
    file, symbol = P.file_and_symbol(F.col("path"))
    rest = rest.select("qid", "path", "full", file.alias("file"), symbol.alias("symbol"))
    named = rest.filter("symbol is not null").join(symbols.select("id", F.col("file_path").alias("file"), F.col("name").alias("symbol")), ["file", "symbol"], "left").select("qid", "id")
    meant = by_id.union(named).withColumn("n", F.count("id").over(Window.partitionBy("qid")))
    found = meant.join(symbols, "id", "left")
    one = read_spans(files, found.filter("n = 1").select("id", "file_path", "start_line", "end_line"))
    shown = found.join(one.distinct(), "id", "left")
    status = F.when(F.col("n") == 0, "not_found").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    columns = ["qid", status.alias("status"), "kind", F.concat_ws("/", "file_path", "name").alias("path"), "start_line", "end_line", F.when(F.col("n") == 1, F.col("text")).alias("text"), "id"]
    spans = shown.select(*columns)
    whole = rest.filter("symbol is null")
    none = F.lit(None).cast("int")
    source = whole.filter("file is not null and full").join(files, F.col("file") == F.col("file_path"), "left")
    source = source.select("qid", F.when(F.col("text").isNull(), "not_found").otherwise("ok"), F.lit("file"), "file", F.lit(1), F.size(T.lines_of("text")), "text", F.lit(None).cast("string"))
    listed = whole.filter("file is not null and not full").join(outline(nodes).withColumnRenamed("file_path", "file"), "file", "left")
    listed = listed.select("qid", F.lit("ok"), F.lit("outline"), "file", none, none, F.coalesce("text", "file"), F.lit(None).cast("string"))
    refused = whole.filter("file is null").select("qid", F.lit("no_file"), F.lit(None).cast("string"), "path", none, none, F.lit(None).cast("string"), F.lit(None).cast("string"))
    return spans.union(source).union(listed).union(refused)


def grep(files: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """(qid, file_path, line, text, rank, total): lines that literally hold each query, by path and line; all of them, or
    the first `limit` of a query, of which only so many leave each task.

    files: file_path, text; queries: qid, query. A file without any query is dropped before its lines are made.
    """
    needles = queries.select("qid", F.col("query").alias("needle"))
    there = scan.containing(files.select(F.col("file_path").alias("id"), "text"), needles).select("qid", F.col("id").alias("file_path"))
    lines = there.join(files, "file_path").join(retrieval.small(queries), "qid").select("qid", "query", "file_path", F.posexplode(T.lines_of("text")).alias("n", "l"))
    hits = lines.filter(F.contains("l", F.col("query"))).select("qid", "file_path", (F.col("n") + 1).alias("line"), T.excerpt("l").alias("text"))
    if limit is not None:
        return topk.first_k(hits, ["qid"], [("file_path", "ascending"), ("line", "ascending")], limit)
    return topk.ranked(hits, "qid", ["file_path", "line"])


def grep_symbols(files: DataFrame, queries: DataFrame, spans: DataFrame, limit: int = 20) -> DataFrame:
    """grep's first `limit` lines of a query, each with the innermost symbol around it (null: none)."""
    kept = grep(files, queries, limit)
    kept = kept.withColumn("point_id", F.struct("qid", "rank"))
    found = graph.innermost(kept, spans, "left")
    return found.select("qid", "file_path", "line", "rank", "total", F.col("span_id").alias("symbol"))
