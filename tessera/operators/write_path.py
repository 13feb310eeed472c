"""Validation of batches of new records, all or nothing, as DataFrames of errors.

drafts: batch, i (place in the batch), id, summary, body, parent, supersedes, links (array). References are ids or
#N for place N of the same batch. Rules report (batch, i, field, error); a batch without rows there may be written.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.shared import cut
from tessera.sources.store import Lease, Store


def resolved(drafts: DataFrame) -> DataFrame:
    """drafts with parent, supersedes and links as ids: #N becomes the id of place N (null if there is none)."""
    refs = drafts.select("batch", "i", F.lit("parent").alias("field"), F.lit(0).alias("n"), F.col("parent").alias("ref"))
    refs = refs.union(drafts.select("batch", "i", F.lit("supersedes"), F.lit(0), "supersedes"))
    refs = refs.union(drafts.select("batch", "i", F.lit("links"), F.posexplode("links")))
    refs = refs.filter("ref is not null").withColumn("at", T.batch_index("ref"))
    places = drafts.select("batch", F.col("i").cast("long").alias("at"), F.col("id").alias("target"))
    return refs.join(places, ["batch", "at"], "left").select("batch", "i", "field", "n", "ref", "at", F.when(F.col("at").isNotNull(), F.col("target")).otherwise(F.trim("ref")).alias("target"))


def errors(drafts: DataFrame, stored: DataFrame) -> DataFrame:
    """All rule violations. stored: id, supersedes_id."""
    def of(rows: DataFrame, field: Column | str, error: str) -> DataFrame:
        return rows.select("batch", "i", (F.lit(field) if isinstance(field, str) else field).alias("field"), F.lit(error).alias("error"))

    own = drafts.select("batch", "i", F.col("id").alias("own"))
    refs = cut(resolved(drafts).join(own, ["batch", "i"]))  # read by all the rules below
    known = stored.select(F.col("id").alias("target")).union(drafts.select("id"))
    taken = stored.filter("supersedes_id is not null").select(F.col("supersedes_id").alias("target"))
    others = refs.filter("target is not null and target <> own")
    old = others.filter("field = 'supersedes'")
    twice = old.withColumn("n_same", F.count("*").over(Window.partitionBy("batch", "target"))).filter("n_same > 1")
    circles = _in_circle(old.select("batch", "i", F.col("own").alias("a"), F.col("target").alias("b")))
    parents = others.filter("field = 'parent'").select("batch", "i", F.col("own").alias("a"), F.col("target").alias("b"))
    parts = [
        of(drafts.filter(F.trim(F.coalesce("summary", F.lit(""))) == ""), "summary", "empty"),
        of(drafts.filter(F.trim(F.coalesce("body", F.lit(""))) == ""), "body", "empty"),
        of(drafts.filter(~T.only_latin(F.coalesce("summary", F.lit("")))), "summary", "script"),
        of(refs.filter("at is not null and target is null"), F.col("field"), "range"),
        of(refs.filter("target = own"), F.col("field"), "self"),
        of(refs.filter("at is null").join(known, "target", "left_anti"), F.col("field"), "missing"),
        of(old.filter("at is null").join(taken, "target", "left_semi"), "supersedes", "taken"),
        of(twice, "supersedes", "twice"),
        of(circles, "supersedes", "circle"),
        of(_in_circle(parents), "parent", "circle"),
    ]
    return reduce(DataFrame.union, parts).distinct()


def _in_circle(steps: DataFrame) -> DataFrame:
    """(batch, i) of rows that come back to themselves inside their batch. steps: batch, i, a, b (one b for an a).

    Jumps double until they are longer than any batch: whoever still lands somewhere then, lands on a circle.
    """
    here = steps.select("batch", F.col("a").alias("b")).distinct()
    jump = cut(steps.join(here, ["batch", "b"], "left_semi").select("batch", "a", "b"))
    longest = jump.groupBy("batch").count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length()):
        jump = cut(jump.join(jump.select("batch", F.col("a").alias("b"), F.col("b").alias("c")), ["batch", "b"]).select("batch", "a", F.col("c").alias("b")))
    landed = jump.select("batch", F.col("b").alias("a")).distinct()
    return steps.join(landed, ["batch", "a"], "left_semi").select("batch", "i")


def inherited_parents(drafts: DataFrame, stored: DataFrame) -> DataFrame:
    """(batch, i, parent_id): the explicit parent, else that of the record superseded (through the batch), else null.

    stored: id, parent_id. Steps through a batch double, so a chain of any length is followed to its end.
    """
    refs = cut(resolved(drafts))
    explicit = refs.filter("field = 'parent'").select("batch", "i", F.col("target").alias("explicit"))
    old = refs.filter("field = 'supersedes'").select("batch", "i", F.col("target").alias("old"))
    rows = drafts.select("batch", "i", "id").join(explicit, ["batch", "i"], "left").join(old, ["batch", "i"], "left")
    kept = stored.select(F.col("id").alias("old"), F.col("parent_id").alias("stored_parent"))
    in_batch = drafts.select("batch", F.col("id").alias("old"), F.lit(True).alias("here"))
    rows = rows.join(in_batch, ["batch", "old"], "left").join(kept, "old", "left")
    # A row knows its parent, or waits for the one before it in the batch (at), or has none.
    waits = F.col("explicit").isNull() & F.col("here")
    known = F.coalesce("explicit", F.when(F.col("here").isNull(), F.col("stored_parent")))
    rows = cut(rows.select("batch", "i", "id", known.alias("parent_id"), F.when(waits, F.col("old")).alias("at")))
    longest = rows.groupBy("batch").count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length()):
        if rows.filter("at is not null").isEmpty():
            break
        step = rows.select("batch", F.col("id").alias("at"), F.col("parent_id").alias("found"), F.col("at").alias("next"))
        rows = cut(rows.join(step, ["batch", "at"], "left").select("batch", "i", "id", F.coalesce("parent_id", "found").alias("parent_id"), F.col("next").alias("at")))
    return rows.select("batch", "i", "parent_id")


def accepted(drafts: DataFrame, found: DataFrame) -> DataFrame:
    """Drafts of batches without an error."""
    return drafts.join(found.select("batch").distinct(), "batch", "left_anti")


def distinct_links(drafts: DataFrame) -> DataFrame:
    """(batch, i, links): resolved links in order, each once."""
    refs = resolved(drafts).filter("field = 'links'").groupBy("batch", "i").agg(F.array_sort(F.collect_list(F.struct("n", "target"))).alias("l"))
    return refs.select("batch", "i", F.array_distinct(F.transform("l", lambda x: x["target"])).alias("links"))


#: What a new record may say.
FIELDS = ("summary", "body", "parent", "supersedes", "links")


def _shape_error(item: object) -> str | None:
    """The first fault of one record of a batch."""
    if not isinstance(item, dict):
        return "not an object"
    if any(key not in FIELDS for key in item):
        return "unknown field"
    for name in ("summary", "body"):
        if not isinstance(item.get(name), str) or not item[name].strip():
            return name
    for name in ("parent", "supersedes"):
        if not isinstance(item.get(name), str | None):
            return name
    links = item.get("links")
    if links is not None and not (isinstance(links, list) and all(isinstance(x, str) for x in links)):
        return "links"
    return None


def _batch_errors(text: str | None) -> list[tuple[int | None, str]]:
    try:
        items = json.loads(text or "")
    except ValueError:
        return [(None, "no JSON")]
    if not isinstance(items, list):
        return [(None, "not an array")]
    if not items:
        return [(None, "empty")]
    return [(i, error) for i, item in enumerate(items) if (error := _shape_error(item))]


def shape_errors(documents: DataFrame) -> DataFrame:
    """(batch, i, error): what is wrong with the shape of JSON batches, the first fault of each record.

    documents: batch, json (an array of objects). A batch that is no array, or an empty one, has one row with i null.
    """
    kind = documents.schema["batch"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [(k, i, error) for k, text in enumerate(rows.column("json").to_pylist()) for i, error in _batch_errors(text)]
            at, i, error = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([rows.column("batch").take(pa.array(at, pa.int64())), pa.array(i, pa.int32()), pa.array(error, pa.string())], names=["batch", "i", "error"])

    return documents.select("batch", "json").mapInArrow(run, f"batch {kind.simpleString()}, i int, error string")


def parsed_drafts(documents: DataFrame) -> DataFrame:
    """(batch, i, summary, body, parent, supersedes, links) of JSON batches; blank references are none."""
    each = documents.select("batch", F.posexplode(F.from_json("json", "array<struct<summary:string,body:string,parent:string,supersedes:string,links:array<string>>>")).alias("i", "d")).select("batch", "i", "d.*")
    none = F.array().cast("array<string>")
    links = F.filter(F.transform(F.coalesce("links", none), lambda x: F.trim(x)), lambda x: x != "")
    return each.select("batch", "i", F.trim("summary").alias("summary"), "body", *[F.nullif(F.trim(c), F.lit("")).alias(c) for c in ("parent", "supersedes")], links.alias("links"))


def records_of(drafts: DataFrame, found: DataFrame, stored: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(records, links) that the faultless batches make: rows with resolved relations, then links, none to itself.

    found: the errors of the drafts; stored: id, parent_id.
    """
    good = cut(accepted(drafts, found))
    refs = cut(resolved(good))
    old = refs.filter("field = 'supersedes'").select("batch", "i", F.col("target").alias("supersedes_id"))
    parents = inherited_parents(good, stored)
    at = F.lit(now).cast("long")
    records = good.join(parents, ["batch", "i"], "left").join(old, ["batch", "i"], "left").select("id", "parent_id", "supersedes_id", F.trim("summary").alias("summary"), "body", at.alias("created_at"), at.alias("updated_at"), F.lit(None).cast("long").alias("recalled_at"), F.lit(7.0).alias("stability"))
    own = good.select("batch", "i", F.col("id").alias("source_id"))
    links = refs.filter("field = 'links'").join(own, ["batch", "i"]).select("source_id", F.col("target").alias("target_id"))
    return cut(records), cut(links.filter("source_id <> target_id").distinct())


#: The last records and links of a store that has none.
RECORDS = "id string, parent_id string, supersedes_id string, summary string, body string, created_at long, updated_at long, recalled_at long, stability double"
LINKS = "source_id string, target_id string"


def write_batches(drafts: DataFrame, store: Store, now: int, marks: dict[str, int] | None = None, lease: Lease | None = None) -> DataFrame:
    """Appends the faultless batches to the store's records and links, and returns the errors of the others.

    Both tables change in one commit, so a batch is there as a whole or not at all, whenever a write breaks off; bytes
    are written for the new rows only. With marks, batches that were written before are not written again.
    """
    spark, base = drafts.sparkSession, store.latest()
    old_records, old_links = (store.table(name, base) if name in base.tables else spark.createDataFrame([], schema) for name, schema in (("records", RECORDS), ("links", LINKS)))
    drafts = cut(drafts)
    found = cut(errors(drafts, old_records.select("id", "supersedes_id")))
    records, links = records_of(drafts, found, cut(old_records.select("id", "parent_id")), now)
    new_links = links.join(old_links, ["source_id", "target_id"], "left_anti")
    store.commit(append={"records": records, "links": new_links}, marks=marks, base=base, lease=lease)
    return found
