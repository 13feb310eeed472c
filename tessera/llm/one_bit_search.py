"""Operator 6, approximate nearest neighbours (largest inner product) on randomly rotated one-bit codes.

A vector is turned by a fixed random rotation and kept as the packed signs of its unit form, with two correction
scalars: its norm, and the inner product of the unit vector with its code. Sign bits against a query's rotated vector
estimate the inner product without bias; the error bound, from the same scalar, chooses which vectors get reranked on
the original components.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm.vector_blocks import keep_best, together, top_k, usable

#: Width of the error bound in standard deviations.
EPSILON = 2.5
SEED = 20


@functools.lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    turned, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return turned * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> bytes:
    """Packed sign bits of each row, then the rows' norms and corrections."""
    norm = np.sqrt((vectors * vectors).sum(1))
    turned = (vectors / norm[:, None]) @ rotation(vectors.shape[1])
    correction = np.abs(turned).sum(1) / np.sqrt(vectors.shape[1])
    return np.packbits(turned > 0, axis=1).tobytes() + norm.tobytes() + correction.tobytes()


def decode(raw: bytes, n: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = -(-dim // 8)
    bits = np.frombuffer(raw, np.uint8, n * width).reshape(n, width)
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    scalars = np.frombuffer(raw, np.float64, offset=n * width)
    return signs, scalars[:n], scalars[n:]


def one_bit_search(k: int, epsilon: float):
    """prepare(vectors, ids) of a shelf to search(queries, ids)."""

    def prepare(vectors: np.ndarray, found: np.ndarray):
        dim = vectors.shape[1]
        signs, length, correction = decode(encode(vectors), len(found), dim)
        scale = (length / (correction * np.sqrt(dim))).astype(np.float32)
        spare = (np.sqrt(np.maximum(1 - correction**2, 0)) / correction * epsilon / np.sqrt(max(dim - 1, 1)) * length).astype(np.float32)

        def search(queries: np.ndarray, ids: np.ndarray):
            norm = np.sqrt((queries * queries).sum(1))
            turned = (queries @ rotation(dim)).astype(np.float32)
            about = (turned @ signs.T) * scale
            held = []
            for i in range(len(ids)):
                error = spare * np.float32(norm[i])
                low = about[i] - error
                least = np.partition(low, len(low) - k - 1)[len(low) - k - 1] if len(low) > k + 1 else -np.inf
                pick = np.flatnonzero((about[i] + error >= least) & (found != ids[i]))
                # Summed row by row, so that equal vectors get equal scores.
                score, of = (vectors[pick] * queries[i]).sum(1), found[pick]
                best = keep_best(score, of, k)
                held.append((score[best], of[best]))
            return together(held)

        return search

    return prepare


def approximate_top_k(embeddings: DataFrame, is_query, k: int = 20, epsilon: float = EPSILON) -> DataFrame:
    """About the k largest inner products of each query with every other row: query_id, rank (from 1), vec_id, score.

    Every row is in the index; score is the inner product of the original vectors in double precision; ties go to the
    smaller vec_id; all candidates where there are fewer than k.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do null ids. Rows that
    share a vec_id count once (the least vector). Vectors of another dimension than the query's are no candidates. An
    empty table gives an empty result.
    """
    rows = usable(embeddings, "exists(embedding, x -> x <> 0)")
    return top_k(rows, is_query, k, lambda dim: one_bit_search(k, epsilon), "double")
