"""Reading tables, files and records; seeded samples; sinks."""

from __future__ import annotations

import json
import os
import tomllib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import paths as P


#: Bytes of a table from which on, and up to which, few files of it are dealt out over the cores first.
WORTH_DEALING, CHEAP_TO_DEAL = 8 << 20, 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table. One of few and small files, which may be a single row group and so a single task, is dealt out;
    larger ones are read as they are split."""
    path = f"{sf_dir}/{name}.parquet"
    rows = spark.read.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(conf).getContentSummary(at)
    cores = spark.sparkContext.defaultParallelism
    if WORTH_DEALING <= size.getLength() <= CHEAP_TO_DEAL and size.getFileCount() < cores:
        return rows.repartition(cores)
    return rows


def state(spark: SparkSession, sf_dir: str, name: str) -> list[str]:
    """Names, lengths and times of a table's files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in at.getFileSystem(conf).listStatus(at))


class Listing(NamedTuple):
    """What Spark's file source does not show of a tree: nested projects, files with hidden names or without content,
    ignore files."""

    nested: list[str]
    hidden: list[str]
    ignore: list[str]


def listed(spark: SparkSession, root: str, ignore_names: tuple[str, ...] = (".gitignore",)) -> Listing:
    """Listed by the driver, as Spark's file index lists a tree; skipped directories and nested projects are not entered."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(conf)
    base = fs.makeQualified(at).toString().rstrip("/") + "/"
    out = Listing([], [], [])
    open_ = [at]
    while open_:
        here = open_.pop()
        entries = list(fs.listStatus(here))
        rel = (here.toString().rstrip("/") + "/").removeprefix(base) if here is not at else ""
        if rel and any(e.getPath().getName() == ".git" for e in entries):
            out.nested.append(rel.rstrip("/"))
            continue
        for entry in entries:
            name = entry.getPath().getName()
            if entry.isDirectory():
                if name not in P.SKIPPED_DIRECTORIES:
                    open_.append(entry.getPath())
            elif name in ignore_names:
                out.ignore.append(rel + name)
            elif name.startswith((".", "_")) or any(x.startswith((".", "_")) for x in rel.split("/")) or not entry.getLen():
                out.hidden.append(rel + name)
    return out


def _hidden_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(path, length, modificationTime, content) of files that the file source leaves out: few, or empty."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{p}")
        fs = at.getFileSystem(conf)
        stream = fs.open(at)
        try:
            rows.append((p, fs.getFileStatus(at).getModificationTime(), bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
        finally:
            stream.close()
    table = spark.createDataFrame(rows, "path string, ms long, content binary")
    return table.select("path", F.octet_length("content").cast("long").alias("length"), F.timestamp_millis("ms").alias("modificationTime"), "content")


def source_tree(spark: SparkSession, root: str, ignored: DataFrame | None = None, ignore_names: tuple[str, ...] = (".gitignore",)) -> DataFrame:
    """(path, size, mtime, hash, language, text) of the source files under root: known extensions, hidden files too, no
    skipped directories, nothing of nested projects (see nested_projects), nothing that is ignored.

    ignored: rules as from ignore_rules; by default those of the ignore files in the tree, each for its directory.
    """
    base = root.rstrip("/") + "/"
    there = listed(spark, root, ignore_names)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.substring("path", F.instr("path", base) + F.lit(len(base)), F.length("path"))
    files = files.select(rel.alias("path"), "length", "modificationTime", "content")
    if there.hidden:
        files = files.unionByName(_hidden_files(spark, root, there.hidden))
    parts = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    skipped = F.arrays_overlap(parts, F.array(*[F.lit(d) for d in P.SKIPPED_DIRECTORIES]))
    out = files.filter(~skipped).withColumn("language", P.language(F.col("path"))).filter("language is not null")
    rules = ignored if ignored is not None else file_rules(spark, root, there.ignore)
    out = out.join(ignored_paths(out.select("path"), rules), "path", "left_anti")
    if there.nested:
        inside = F.lit(False)
        for prefix in there.nested:
            inside = inside | P.in_scope(F.col("path"), F.lit(prefix))
        out = out.filter(~inside)
    return out.select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"), "language", F.col("content").cast("string").alias("text"))


def nested_projects(spark: SparkSession, root: str) -> DataFrame:
    """(prefix): directories below root that hold a .git."""
    return spark.createDataFrame([(p,) for p in sorted(listed(spark, root).nested)], "prefix string")


def file_rules(spark: SparkSession, root: str, files: list[str]) -> DataFrame:
    """The rules of some ignore files, each for the directory that it lies in, in the order of their lines."""
    texts = _hidden_files(spark, root, files).select("path", F.posexplode(F.split(F.col("content").cast("string"), "\r?\n")).alias("ordinal", "line"))
    return ignore_rules(texts.select("line", P.directory(F.col("path")).alias("base"), "ordinal"))


def ignore_rules(rules: DataFrame) -> DataFrame:
    """(base, pattern, keep, only_directory, ordinal) from lines of ignore files: blank lines and comments go, * stays
    inside a directory, ** does not, ! keeps what an earlier rule ignores.

    rules: line, and where they are known base (the directory of the file, '' for the root) and ordinal. A rule with a
    slash before its end is anchored at its base.
    """
    if "ordinal" not in rules.columns:
        rules = rules.withColumn("ordinal", F.monotonically_increasing_id())
    if "base" not in rules.columns:
        rules = rules.withColumn("base", F.lit(""))
    rows = rules.select("base", "ordinal", F.trim("line").alias("l")).filter("l <> '' and l not like '#%'")
    rows = rows.withColumn("keep", F.startswith("l", F.lit("!"))).withColumn("l", F.regexp_replace("l", r"^!|^\\(?=[!#])", ""))
    anchored = F.regexp_replace("l", "/$", "").contains("/")
    body = F.regexp_replace(F.regexp_replace("l", "^/|/$", ""), r"([.+()\[\]{}^$|])", r"\\$1")
    body = F.regexp_replace(body, r"\*\*/", "\u0001")
    body = F.regexp_replace(F.regexp_replace(body, r"\*\*", "\u0002"), r"\*", "[^/]*")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"\?", "[^/]"), "\u0001", "(.*/)?"), "\u0002", ".*")
    pattern = F.concat(F.when(anchored, "^").otherwise("^(.*/)?"), body, F.lit("$"))
    return rows.select("base", pattern.alias("pattern"), "keep", F.endswith("l", F.lit("/")).alias("only_directory"), F.col("ordinal").cast("long").alias("ordinal"))


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path): paths that rules ignore: of the rules that match a path or a directory above it, the last one decides,
    those of a deeper directory after the others; below an ignored directory nothing is kept. rules: few."""
    parts = paths.select("path", F.split("path", "/").alias("p"))
    steps = parts.select("path", F.size("p").alias("n"), F.posexplode(F.expr("transform(sequence(1, size(p)), i -> array_join(slice(p, 1, i), '/'))")).alias("i", "at"))
    steps = steps.withColumn("is_directory", F.col("i") + 1 < F.col("n"))
    under = (F.col("base") == "") | F.startswith("at", F.concat(F.col("base"), F.lit("/")))
    rest = F.when(F.col("base") == "", F.col("at")).otherwise(F.substring("at", F.length("base") + 2, F.length("at")))
    fits = under & F.regexp_like(rest, F.col("pattern")) & (F.col("is_directory") | ~F.col("only_directory"))
    met = steps.join(F.broadcast(rules), fits)
    last = met.groupBy("path", "at").agg(F.max_by("keep", F.struct(F.length("base"), "ordinal")).alias("keep"))
    return last.filter("not keep").select("path").distinct()


def json_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON document, or one record a line (blank lines skipped)."""
    return spark.read.option("multiLine", not lines).json(path)


def manifest(rows: DataFrame) -> DataFrame:
    """Ready corpora: status ok, the last row of each (repo, base_commit) by ordinal."""
    return rows.filter("status = 'ok'").groupBy("repo", "base_commit").agg(F.max_by("chunks_path", "ordinal").alias("chunks_path"))


def file_texts(chunks: DataFrame) -> DataFrame:
    """(path, text) of chunks that are whole files; the last one of a path counts."""
    return chunks.filter("kind = 'file'").groupBy("path").agg(F.max_by("text", "ordinal").alias("text"))


def seeded_sample(rows: DataFrame, key: Column, n: int, seed: int, eligible: Column | None = None) -> DataFrame:
    """n eligible rows in the order of a seeded hash; the same on every engine and run."""
    rows = rows if eligible is None else rows.filter(eligible)
    return rows.withColumn("at", F.sha2(F.concat_ws(":", key.cast("string"), F.lit(str(seed))), 256)).orderBy("at").limit(n).drop("at")


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def ordered_body(turns: DataFrame, key: str, order: str, line: Column) -> DataFrame:
    """(key, body): lines of each key's rows in order, joined."""
    per = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("ls"))
    return per.select(key, F.expr("array_join(transform(ls, x -> x.l), '\n')").alias("body"))


def previous(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows with `previous`: the value of the row before in its key."""
    return rows.withColumn("previous", F.lag(value).over(Window.partitionBy(key).orderBy(order)))


def dataset(config: str, name: str, prefix: str = "DATASET_") -> str:
    """The path of a named dataset in a TOML file's [datasets]; an environment variable prefix + NAME goes before it.

    A relative path is taken from the folder of the file.
    """
    if override := os.environ.get(prefix + name.upper()):
        return os.path.expanduser(override)
    with open(config, "rb") as f:
        known = tomllib.load(f).get("datasets", {})
    if name not in known:
        raise KeyError(f"{config} has no dataset {name}")
    return os.path.normpath(os.path.join(os.path.dirname(os.path.abspath(config)), os.path.expanduser(known[name])))


def write_results(summary: DataFrame, rows: DataFrame, path: str) -> None:
    """A result as two JSON-lines folders beside each other: path/summary, of one row, and path/rows."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    rows.write.mode("overwrite").json(f"{path}/rows")


def lenient_json(column: Column, schema: str) -> Column:
    """A JSON text by a schema: null where it is no JSON, null fields where they do not fit, unknown fields left out."""
    return F.from_json(column, schema, {"mode": "PERMISSIVE", "allowUnquotedFieldNames": "false"})


def as_text(value: object) -> str:
    """One compact JSON document, as results are shown."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
