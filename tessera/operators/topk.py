"""The first rows of each key and how many there are, combined before they are shuffled.

A window with a count keeps Spark from limiting early: every row of a key would go to one task. Here each task keeps the k
first rows of a key and a count of all; only those meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.sources.shared import cut

#: Rows a task gathers before it drops those behind the k first.
GATHERED = 50_000


def _firsts(table: pa.Table, keys: list[str], order: list[tuple[str, str]], k: int) -> pa.Table:
    """The k first rows of each key, with the key's rows so far (n) on the first of them."""
    table = table.sort_by([(key, "ascending") for key in keys] + order)
    coded = [pc.fill_null(table.column(key).combine_chunks().dictionary_encode().indices, -1).to_numpy() for key in keys]
    new = np.r_[True, np.any([c[1:] != c[:-1] for c in coded], axis=0)] if len(table) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    if not len(starts):
        return table
    sums = np.add.reduceat(table.column("n").to_numpy(), starts)
    n = np.zeros(len(table), np.int64)
    n[starts] = sums
    place = np.arange(len(table)) - np.repeat(starts, np.diff(np.r_[starts, len(table)]))
    return table.set_column(table.schema.get_field_index("n"), "n", pa.array(n)).filter(pa.array(place < k))


def partial_firsts(rows: DataFrame, keys: list[str], order: list[tuple[str, str]], k: int) -> DataFrame:
    """rows with n: at most k rows of a key from each task; n adds up to the key's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        more: list[pa.Table] = []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            more.append(t.append_column("n", pa.array(np.ones(len(t), np.int64))))
            if sum(map(len, more)) >= GATHERED:
                kept, more = _firsts(pa.concat_tables([*([kept] if kept is not None else []), *more]), keys, order, k), []
        tables = [*([kept] if kept is not None else []), *more]
        if tables:
            yield from _firsts(pa.concat_tables(tables), keys, order, k).to_batches(max_chunksize=10_000)

    schema = StructType([*rows.schema.fields, StructField("n", LongType())])
    return rows.mapInArrow(run, schema)


def first_k(rows: DataFrame, keys: list[str], order: list[tuple[str, str]], k: int, total: str = "total") -> DataFrame:
    """The k first rows of each key with rank and total. order: columns with ascending or descending; ties go by any.

    What meets for a key is k rows a task at most.
    """
    w = Window.partitionBy(*keys)
    by = [F.asc(c) if way == "ascending" else F.desc(c) for c, way in order]
    few = partial_firsts(rows, keys, order, k)
    return few.withColumn("rank", F.row_number().over(w.orderBy(*by))).withColumn(total, F.sum("n").over(w)).filter(F.col("rank") <= k).drop("n")


def ranked(rows: DataFrame, key: str, order: list[str], total: str = "total") -> DataFrame:
    """All rows with their rank in their key and the key's total. order: columns, ascending.

    Rows are dealt by ranges of key and order, ranked within each range, and go on from where the ranges before end: a
    key of any size is spread over the tasks.
    """
    n = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(rows.repartitionByRange(n, key, *order).withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(key, "range").agg(F.count("*").alias("n"))
    starts = sizes.select(F.col(key).alias("of"), F.col("range").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy(key)).alias(total))
    within = F.row_number().over(Window.partitionBy("range", key).orderBy(*order))
    return dealt.withColumn("rank", within).join(starts, F.col(key).eqNullSafe(F.col("of")) & (F.col("range") == F.col("at"))).withColumn("rank", F.col("rank") + F.col("start")).select(*rows.columns, "rank", total)
