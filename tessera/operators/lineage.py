"""Revision chains, parent trees and links of records, for all rows at once.

Chains and trees are walked by pointer doubling: every round a row looks at what its target looks at, so a chain of
length n is done in log2(n) joins and no driver loop sees rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import cut

#: Levels of a breadcrumb.
LEVELS = 32


def tails(records: DataFrame) -> DataFrame:
    """(id, tail): the last revision of each row's chain. records: id, supersedes_id (at most one successor each).

    Only a chain that turns in a circle is cut, when the jumps are longer than all rows together.
    """
    ids = records.select("id")
    step = records.filter("supersedes_id is not null").select(F.col("supersedes_id").alias("id"), F.col("id").alias("tail"))
    if step.isEmpty():
        return ids.select("id", F.col("id").alias("tail"))
    jump = ids.join(step, "id", "left").select("id", F.coalesce("tail", "id").alias("tail"))
    jump = cut(jump)
    for _ in range(records.count().bit_length()):
        further = jump.select(F.col("id").alias("tail"), F.col("tail").alias("further"))
        after = cut(jump.join(further, "tail", "left").select("id", "tail", F.coalesce("further", "tail").alias("further")))
        done = after.filter("further <> tail").isEmpty()
        jump = after.select("id", F.col("further").alias("tail"))
        if done:
            break
    return jump


def neighbours(links: DataFrame) -> DataFrame:
    """(id, other): links read both ways, each pair once, none to itself."""
    both = links.select(F.col("source_id").alias("id"), F.col("target_id").alias("other")).union(links.select("target_id", "source_id"))
    return both.filter("id <> other").distinct()


def ordered_neighbours(links: DataFrame) -> DataFrame:
    """(id, links): the other ends of each row's links, targets before sources, each at its first place.

    links: source_id, target_id, ordinal (the order in which they were made).
    """
    out = links.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), F.lit(0).alias("back"), "ordinal")
    both = out.union(links.select("target_id", "source_id", F.lit(1), "ordinal")).filter("id <> other")
    first = both.groupBy("id", "other").agg(F.min(F.struct("back", "ordinal")).alias("at"))
    per = first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "other"))).alias("l"))
    return per.select("id", F.transform("l", lambda x: x["other"]).alias("links"))


def breadcrumbs(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(id, depth, path): labels from the root down to each row. nodes: id, parent_id, label.

    A row whose parent is not there is no root and vanishes with all below it; so does a row more than `levels` deep.
    """
    frontier = nodes.filter("parent_id is null").select("id", F.lit(0).alias("depth"), F.array("label").alias("path"))
    out = frontier
    children = nodes.filter("parent_id is not null").select(F.col("id").alias("child"), "parent_id", "label")
    for depth in range(1, levels):
        step = children.join(frontier, children["parent_id"] == frontier["id"]).select(F.col("child").alias("id"), F.lit(depth).alias("depth"), F.concat("path", F.array("label")).alias("path"))
        frontier = cut(step)  # so that the next level does not start at the root again
        if frontier.isEmpty():
            break
        out = out.union(frontier)
    return out


def tree_lines(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(id, depth, line): breadcrumbs as an indented listing."""
    return breadcrumbs(nodes, levels).select("id", "depth", F.concat(F.expr("repeat('  ', depth)"), F.element_at("path", -1)).alias("line"))


def tree_order(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(id, depth, line, sort_key): the indented listing with a key that sorts it: every row under its parent, siblings
    by created_at, then id. nodes: id, parent_id, label, created_at."""
    keyed = nodes.withColumn("label", F.struct("created_at", "id", "label"))
    line = F.concat(F.expr("repeat('  ', depth)"), F.element_at("path", -1)["label"])
    return breadcrumbs(keyed, levels).select("id", "depth", line.alias("line"), F.transform("path", lambda x: F.struct(x["created_at"], x["id"])).alias("sort_key"))


def subtree_counts(nodes: DataFrame) -> DataFrame:
    """(id, below): how many rows lie under each row. nodes: id, parent_id.

    Jumps double: a row's count within 2n levels is its own within n and those of the rows n levels below, so a tree of
    any depth takes a few rounds and no pair of rows is formed. Rows on a circle count what the rounds reach.
    """
    state = cut(nodes.select("id", F.col("parent_id").alias("above"), F.lit(1).cast("long").alias("size")))
    for _ in range(max(1, state.count()).bit_length()):
        going = state.filter("above is not null")
        if going.isEmpty():
            break
        more = going.groupBy(F.col("above").alias("id")).agg(F.sum("size").alias("more"))
        jump = state.select(F.col("id").alias("above"), F.col("above").alias("next"))
        state = cut(state.join(jump, "above", "left").join(more, "id", "left").select("id", F.col("next").alias("above"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
    return state.select("id", (F.col("size") - 1).alias("below"))


def shown(records: DataFrame, links: DataFrame, now: int) -> DataFrame:
    """One row per record with what the single view adds: latest, links both ways, retention, needs_update."""
    from tessera.functions import memory as M

    superseded = records.filter("supersedes_id is not null").select(F.col("supersedes_id").alias("id"), F.lit(True).alias("old")).distinct()
    linked = neighbours(links).groupBy("id").agg(F.array_sort(F.collect_list("other")).alias("links"))
    kept = M.retention(F.lit(now), M.clock_origin(F.col("recalled_at"), F.col("created_at")), F.col("stability"))
    out = records.join(superseded, "id", "left").join(linked, "id", "left")
    out = out.withColumn("latest", F.col("old").isNull()).withColumn("retention", kept).withColumn("needs_update", M.needs_update(F.col("retention")))
    return out.withColumn("links", F.coalesce("links", F.array().cast(linked.schema["links"].dataType))).drop("old")
