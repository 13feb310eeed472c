"""The given tables in the shapes of the operators: memories, links, recall logs, trees, graphs, paths, snapshots."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import lexical_index
from tessera.sources.shared import checkpoint_dir, tasks
from tessera.sources.store import Conflict, Store
from tessera.sources.tables import state, table

NOW = 1_706_659_200  # 2024-01-31 00:00 UTC
DAY = 86_400


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records in chains of three (ids that share id div 3), of ages from 0 to 89 days, never recalled."""
    d = table(spark, sf_dir, "documents")
    updated = F.lit(NOW) - F.pmod("doc_id", F.lit(90)) * DAY
    return d.select(
        F.col("doc_id").alias("id"),
        F.when(F.pmod("doc_id", F.lit(3)) > 0, F.col("doc_id") - 1).alias("supersedes_id"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80).alias("summary"),
        F.col("text").alias("body"),
        updated.alias("created_at"),
        updated.alias("updated_at"),
        F.lit(None).cast("long").alias("recalled_at"),
        F.lit(7.0).alias("stability"),
    )


def stored_index(spark: SparkSession, sf_dir: str) -> Store:
    """The lexical index of the documents, made by the first query that asks for it in the state the table is in."""
    key = hashlib.sha256("\n".join([f"{lexical_index.FORMAT} {sf_dir}/documents.parquet", *state(spark, sf_dir, "documents")]).encode()).hexdigest()
    store = Store(spark, f"{checkpoint_dir(spark).rstrip('/')}/lexical-{key}")
    if not store.latest().number:
        try:
            lexical_index.change(store, memories(spark, sf_dir).select("id", "summary", "body"))
        except Conflict:  # another session was first
            pass
    return store


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as revision chains: each turn supersedes the one before."""
    c = table(spark, sf_dir, "conversations")
    at = F.col("conv_id") * 100 + F.col("turn")
    return c.select(at.alias("id"), F.when(F.col("turn") > 0, at - 1).alias("supersedes_id"), "conv_id", "turn", "role", "text")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document linked to the one before it of the same source."""
    w = Window.partitionBy("source").orderBy("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.lag("doc_id").over(w).alias("before"))
    return d.filter("before is not null").select(F.col("doc_id").alias("source_id"), F.col("before").alias("target_id"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, parent_id, label): region, nation, customer, order."""
    def rows(name: str, key: str, parent: str | None, prefix: str, up: str, label: str) -> DataFrame:
        above = F.concat(F.lit(up), F.col(parent).cast("string")) if parent else F.lit(None).cast("string")
        return table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), above.alias("parent_id"), F.col(label).cast("string").alias("label"))

    parts = [rows("region", "r_regionkey", None, "r", "", "r_name"), rows("nation", "n_nationkey", "n_regionkey", "n", "r", "n_name"), rows("customer", "c_custkey", "c_nationkey", "c", "n", "c_name"), rows("orders", "o_orderkey", "o_custkey", "o", "c", "o_orderkey")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): customers (class) contain orders (method), orders call parts (function), parts reference
    suppliers (trait); nations are the files of customers, brands those of parts, suppliers lie in supply.rs."""
    customer, nation, part, supplier = (table(spark, sf_dir, t) for t in ("customer", "nation", "part", "supplier"))
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    one = F.lit(1)

    def key(prefix: str, column: str):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    named = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    file = F.concat(F.lit("src/"), F.lower(F.regexp_replace("n_name", " ", "_")), F.lit(".rs"))
    nodes = named.select(key("c", "c_custkey").alias("id"), F.lit("class").alias("kind"), F.col("c_name").alias("name"), file.alias("file_path"), one.alias("start_line"), one.alias("end_line"))
    owned = orders.join(named.select("c_custkey", file.alias("file_path")), F.col("o_custkey") == F.col("c_custkey"))
    nodes = nodes.union(owned.select(key("o", "o_orderkey").alias("id"), F.lit("method"), key("order", "o_orderkey"), "file_path", F.lit(2), F.lit(2)))
    brand = F.concat(F.lit("parts/"), F.lower(F.regexp_replace("p_brand", "[# ]", "_")), F.lit(".rs"))
    nodes = nodes.union(part.select(key("p", "p_partkey"), F.lit("function"), "p_name", brand, F.col("p_size"), F.col("p_size") + 5))
    nodes = nodes.union(supplier.select(key("s", "s_suppkey"), F.lit("trait"), "s_name", F.lit("supply.rs"), one, one))
    edges = orders.select(key("c", "o_custkey").alias("source"), key("o", "o_orderkey").alias("target"), F.lit("contains").alias("kind"), one.alias("line"))
    edges = edges.union(lines.select(key("o", "l_orderkey"), key("p", "l_partkey"), F.lit("calls"), F.col("l_linenumber")))
    # Pairs hardly repeat within what a task reads, so they are dealt out before repeated ones go.
    pairs = lines.select("l_partkey", "l_suppkey").repartition(tasks(spark), "l_partkey", "l_suppkey").distinct()
    edges = edges.union(pairs.select(key("p", "l_partkey"), key("s", "l_suppkey"), F.lit("references"), one))
    return nodes, edges


def parts_as_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: few names over many parts, so names are ambiguous."""
    p = table(spark, sf_dir, "part")
    kinds = F.array(*[F.lit(k) for k in ("function", "struct", "method", "trait", "enum")])
    file = F.concat(F.lower(F.regexp_replace("p_brand", "[# ]", "_")), F.lit("/"), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))), F.lit(".rs"))
    return p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.element_at(kinds, F.pmod("p_size", F.lit(5)) + 1).alias("kind"), F.col("p_name").alias("name"), file.alias("file_path"), F.col("p_size").alias("start_line"), (F.col("p_size") + 5).alias("end_line"))


def references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(refs, candidates) of name resolution: suppliers' files name parts, parts lie with their first supplier."""
    lines, part, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    place = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    sub = F.when(F.col("s_suppkey") % 7 == 0, "tests/").when(F.col("s_suppkey") % 11 == 0, "examples/").otherwise("")
    path = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/n"), F.col("n_nationkey").cast("string"), F.lit("/"), sub, F.lit("S"), F.col("s_suppkey").cast("string"), F.lit(".rs"))
    place = place.select("s_suppkey", path.alias("file_path"))
    pairs = lines.select("l_partkey", "l_suppkey").distinct()
    ref_id = F.concat(F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))
    refs = pairs.join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).join(place, F.col("l_suppkey") == F.col("s_suppkey"))
    prefer = F.when(F.col("l_suppkey") % 2 == 0, F.array(F.lit("function"), F.lit("method"))).otherwise(F.array(*[F.lit(k) for k in ("struct", "class", "trait", "enum", "type_alias")]))
    refs = refs.select(ref_id.alias("ref_id"), F.col("p_name").alias("name"), "file_path", prefer.alias("prefer"), F.when(F.col("l_suppkey") % 3 == 0, F.col("p_name")).alias("qualifier"))
    first = pairs.groupBy("l_partkey").agg(F.min("l_suppkey").alias("s_suppkey")).join(place, "s_suppkey")
    kinds = F.array(*[F.lit(k) for k in ("function", "struct", "method", "trait", "enum")])
    candidates = part.join(first, F.col("p_partkey") == F.col("l_partkey")).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.element_at(kinds, F.pmod("p_size", F.lit(5)) + 1).alias("kind"), "file_path")
    return refs, candidates


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path): host and path of each page's address, without query and fragment."""
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(F.regexp_replace(bare, "/+$", "").alias("path"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, text): documents as files of their sources."""
    path = F.concat(F.col("source"), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(path.alias("file_path"), "text")


def spans(files: DataFrame) -> DataFrame:
    """Nested fixed blocks of each file's lines: all of it, and every two lines."""
    n = files.select("file_path", F.size(F.split("text", "\n")).alias("n"))
    whole = n.select(F.concat("file_path", F.lit(":all")).alias("id"), "file_path", F.lit(1).alias("start_line"), F.col("n").alias("end_line"))
    blocks = n.select("file_path", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 2).cast("int"))).alias("b"))
    return whole.union(blocks.select(F.concat("file_path", F.lit(":"), F.col("b").cast("string")), "file_path", F.col("b") * 2 + 1, F.col("b") * 2 + 2))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(before, after): id % 10 = 0 edited, 1 removed, 2 touched, 3 added later, 4 unreadable; others as they were."""
    d = table(spark, sf_dir, "documents")
    digit = F.pmod("doc_id", F.lit(10))
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    before = d.filter(digit != 3).select(path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.col("doc_id").alias("mtime"), F.sha2("text", 256).alias("hash"))
    text = F.when(digit == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    moved = F.when(digit.isin(0, 2, 4), F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    after = d.filter(digit != 1).select(path.alias("path"), F.octet_length(text).cast("long").alias("size"), moved.alias("mtime"), F.when(digit != 4, F.sha2(text, 256)).alias("hash"))
    return before, after
