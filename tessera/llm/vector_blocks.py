"""A stated set of query vectors against all vectors: shared by exact and approximate search.

Vectors are dealt to shelves of bounded bytes by a hash of their id, each to one shelf only; queries are sent to every
shelf. A task reads a shelf once, prepares it, and streams the queries past it in blocks, so what it holds does not grow
with the table nor with the queries; it returns each query's best of the shelf.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import runtime

#: Bytes of vectors of a shelf; of a smaller table, the vectors from which on there is another shelf, and how many at most.
SHELF_BYTES, LEAST, SPREAD = 16 << 20, 4096, 12
#: Products of queries and vectors at a time.
AT_ONCE = 1 << 20

#: (vectors, ids) to a search: (queries, ids of queries) to (query index, id, score) of the best.
Search = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
Prepare = Callable[[np.ndarray, np.ndarray], Search]


def usable(df: DataFrame, vectors_too: str = "true") -> DataFrame:
    """(vec_id, embedding array<double>, dim): one row per vec_id (the least vector of rows that share it).

    Left out: null ids, and vectors that are null, empty or hold a null or non-finite component. Only ids are shuffled
    to find those that repeat.
    """
    finite = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    rows = df.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) embedding")
    rows = rows.filter(f"vec_id is not null and embedding is not null and size(embedding) > 0 and {finite}").filter(vectors_too)
    again = runtime.checkpoint(rows.groupBy("vec_id").count().filter("count > 1").select("vec_id"))
    if not again.isEmpty():
        again = runtime.broadcast_if_small(again)
        once = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        rows = rows.join(again, "vec_id", "left_anti").select("vec_id", "embedding").union(once)
    return rows.withColumn("dim", F.size("embedding"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _stream(prepare: Callable[[int], Prepare], of_score: pa.DataType):
    """Rows by shelf, its vectors before the queries, to the best of each query in each shelf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, search = None, [], None
        for batch in batches:
            dims, shelves, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "shelf", "is_query"))
            cut = np.flatnonzero(np.r_[True, (dims[1:] != dims[:-1]) | (shelves[1:] != shelves[:-1]) | (asks[1:] != asks[:-1])]) if len(batch) else []
            for i, j in zip(cut, np.r_[cut[1:], len(batch)], strict=True):
                dim, part = int(dims[i]), batch.slice(i, j - i)
                if here != (dim, shelves[i]):
                    here, held, search = (dim, shelves[i]), [], None
                ids, vectors = part.column("vec_id").to_numpy(), _matrix(part.column("embedding"), dim)
                if not asks[i]:
                    held.append((ids, vectors))
                    continue
                if search is None:
                    if not held:
                        continue
                    found, all_vectors = (np.concatenate(x) for x in zip(*held, strict=True))
                    order = np.argsort(found, kind="stable")
                    search, n, held = prepare(dim)(np.ascontiguousarray(all_vectors[order]), found[order]), len(found), []
                step = max(1, AT_ONCE // n)
                for k in range(0, len(ids), step):
                    at, of, score = search(vectors[k : k + step], ids[k : k + step])
                    score = score.astype(np.int64) if of_score == pa.int64() else score
                    yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + step][at], pa.int64()), pa.array(of, pa.int64()), pa.array(score, of_score)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, k: int, prepare: Callable[[int], Prepare], score_type: str) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best by search, ties to the smaller vec_id; never the query itself."""
    per = runtime.checkpoint(vectors.groupBy("dim").count()).collect()  # a row for each dimension there is
    n, n_bytes = sum(r["count"] for r in per), sum(8 * r["dim"] * r["count"] for r in per)
    n_shelves = max(1, -(-n_bytes // SHELF_BYTES), min(SPREAD, -(-n // LEAST)))
    shelf = F.pmod(F.xxhash64("vec_id"), F.lit(n_shelves)).cast("int")
    columns = ("dim", "shelf", "is_query", "vec_id", "embedding")
    found = vectors.withColumn("shelf", shelf).withColumn("is_query", F.lit(False)).select(*columns)
    asked = vectors.filter(is_query).withColumn("shelf", F.explode(F.sequence(F.lit(0), F.lit(n_shelves - 1)))).withColumn("is_query", F.lit(True)).select(*columns)
    dealt = found.union(asked).repartitionById(n_shelves, "shelf").sortWithinPartitions("dim", "shelf", "is_query")
    best = dealt.mapInArrow(_stream(prepare, pa.int64() if score_type == "long" else pa.float64()), f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def keep_best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best by score, ties to the smaller id, best first."""
    if len(score) > k:
        bound = np.partition(score, len(score) - k)[len(score) - k]
        pick = np.flatnonzero(score >= bound)
    else:
        pick = np.arange(len(score))
    return pick[np.lexsort((ids[pick], -score[pick]))][:k]


def together(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, id) of each query as (query index, id, score) of all."""
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *[np.full(len(of), i) for i, (_, of) in enumerate(held)]]), np.concatenate([none, *[of for _, of in held]]), np.concatenate([np.zeros(0), *[s for s, _ in held]])
