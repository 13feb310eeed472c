"""Stable symbol ids of another system, and the nodes that stand for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths as P


def catalog(known: DataFrame) -> DataFrame:
    """(name, id, place): the ids of each name, in the order in which they first occur.

    known: id, asked (a name that a question asked for by that id, or null), ordinal. An id is known by its own last
    identifier, by the file name of a file id, and by the names that were asked for it.
    """
    own = known.select("id", P.trailing_name(F.col("id")).alias("name"), "ordinal", F.lit(0).alias("kind"))
    files = known.filter(F.startswith("id", F.lit("file:"))).select("id", P.file_name(F.expr("substring(id, 6)")), "ordinal", F.lit(1))
    asked = known.filter("asked is not null").select("id", F.coalesce(F.nullif(P.trailing_name(F.col("asked")), F.lit("")), "asked"), "ordinal", F.lit(2))
    first = own.union(files).union(asked).filter("name <> '' and id <> ''").groupBy("name", "id").agg(F.min(F.struct("kind", "ordinal")).alias("at"))
    return first.select("name", "id", F.row_number().over(Window.partitionBy("name").orderBy("at", "id")).alias("place"))


def mapped(found: DataFrame, known: DataFrame) -> DataFrame:
    """(qid, id, rank): stable ids of the nodes that answer a question, each at its first place.

    found: qid, rank, name, file_path; known: a catalog. Of a name's ids those whose path fits the node's file count, or
    all where none does.
    """
    met = found.join(known, "name")
    fits = P.path_fits(F.col("file_path"), P.path_hint(F.col("id")))
    met = met.withColumn("fits", fits).withColumn("any_fits", F.max("fits").over(Window.partitionBy("qid", "rank", "name", "file_path")))
    kept = met.filter("fits or not any_fits").groupBy("qid", "id").agg(F.min(F.struct("rank", "place")).alias("at"))
    return kept.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("at", "id")).alias("rank"))
