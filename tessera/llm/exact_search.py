"""Operator 4, exact top-k search by pivot-table elimination.

Each vector's distances to many pivots are computed once. By the triangle inequality the largest difference of two
vectors' distances to one pivot is a lower bound of their distance, hence an upper bound of their inner product
((|q|^2 + |x|^2 - bound^2) / 2). A query evaluates the candidates of a shelf in the order of that bound and stops,
exactly, when the next bound cannot reach its k-th best score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.vector_blocks import keep_best, together, top_k, usable

PIVOTS = 32
#: Candidates evaluated first, in the order of their bounds; then twice as many each time.
STEP = 128
#: Queries bounded at a time, so that their bounds stay in the cache.
AT_ONCE = 32
#: Rounding in single precision: of a distance and of differences of two, as a share of the longest distance to a pivot;
#: of squares and their sums, as a share of the squared norms. Scores themselves are exact integers.
OF_DISTANCE, OF_SQUARES = 2.0**-21, 1e-6


class PivotTable:
    """Distances of some vectors to the pivots, their squared norms, and how far rounding may move a difference."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray):
        # Integer components: the squares are exact in double precision.
        square = (vectors * vectors).sum(1)
        away = np.sqrt(np.maximum(square[:, None] + (pivots * pivots).sum(1) - 2 * vectors @ pivots.T, 0))
        self.away = np.ascontiguousarray(away.T.astype(np.float32))
        self.square = square.astype(np.float32)
        self.spare = (away.max(1, initial=0) * OF_DISTANCE).astype(np.float32)


def upper_bounds(mine: PivotTable, some: slice, theirs: PivotTable) -> np.ndarray:
    """Upper bounds of the inner products of a few queries with a shelf, in single precision, rounded up."""
    a, b = mine.away[:, some], theirs.away
    most = np.zeros((a.shape[1], b.shape[1]), np.float32)
    gap = np.empty_like(most)
    for p in range(len(a)):
        np.subtract(a[p, :, None], b[p], out=gap)
        np.abs(gap, out=gap)
        np.maximum(most, gap, out=most)
    most -= mine.spare[some, None]
    most -= theirs.spare
    np.maximum(most, 0, out=most)
    np.multiply(most, most, out=most)
    squares = (mine.square[some, None] + theirs.square) * np.float32(1 + 4 * OF_SQUARES)
    squares -= most
    return squares * np.float32(0.5) + np.float32(1e-3)


def pivot_search(pivots: np.ndarray, k: int):
    """prepare(vectors, ids) of a shelf to search(queries, ids); search.evaluated counts the products computed."""

    def prepare(vectors: np.ndarray, found: np.ndarray):
        theirs = PivotTable(vectors, pivots)

        def evaluate(query, own, upper):
            score, of = np.zeros(0), np.zeros(0, np.int64)
            first = np.argpartition(-upper, STEP)[:STEP] if len(upper) > STEP else np.arange(len(upper))
            rest = None
            part = first
            while len(part):
                at = part[found[part] != own]
                search.evaluated += len(at)
                score, of = np.r_[score, vectors[at] @ query], np.r_[of, found[at]]
                best = keep_best(score, of, k)
                score, of = score[best], of[best]
                least = score[k - 1] if len(score) >= k else -np.inf
                if rest is None:  # in the order of bounds, what can still reach the k-th best
                    reach = upper >= least
                    reach[first] = False
                    rest = np.flatnonzero(reach)
                    rest, step = rest[np.argsort(-upper[rest])], STEP
                rest = rest[: np.searchsorted(-upper[rest], -least, "right")]
                part, rest, step = rest[:step], rest[step:], step * 2
            return score, of

        def search(queries: np.ndarray, ids: np.ndarray):
            mine = PivotTable(queries, pivots)
            held = []
            for at in range(0, len(ids), AT_ONCE):
                upper = upper_bounds(mine, slice(at, at + AT_ONCE), theirs)
                held += [evaluate(queries[at + i], ids[at + i], upper[i]) for i in range(len(upper))]
            return together(held)

        search.evaluated = 0
        return search

    return prepare


def exact_top_k(embeddings: DataFrame, is_query, k: int = 20, scale: int = 64, n_pivots: int = PIVOTS) -> DataFrame:
    """The k largest integer inner products of each query with every other row, exactly.

    Components are floor(scale * x); integer sums are exact while squared norms stay below 2**53. Returns query_id,
    rank (from 1), vec_id, score, ties to the smaller vec_id; all candidates where there are fewer than k.

    Vectors that are null, empty or hold a null or non-finite component take no part, nor do null ids. Rows that share
    a vec_id count once (the least vector). Vectors of another dimension than the query's are no candidates. An empty
    table gives an empty result. Pivots are the vectors whose ids hash lowest: a bounded number for any table.
    """
    rows = usable(embeddings)
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: F.floor(x * scale).cast("double")))
    low = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).select("embedding").collect()
    by_dim: dict[int, list[list[float]]] = {}
    for r in low:
        by_dim.setdefault(len(r[0]), []).append(r[0])
    return top_k(rows, is_query, k, lambda dim: pivot_search(np.array(by_dim.get(dim, [])).reshape(-1, dim), k), "long")
