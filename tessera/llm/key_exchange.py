"""Corpus-wide lookups of many small keys (window and n-gram hashes) without a row for each key.

Documents are dealt into chunks of a few MB by a hash of the whole row's id and text. A chunk combines its own keys
first (a key that fills a third of the corpus is one entry in each chunk, never a hot row), deals them to key buckets
as packed sorted arrays, and gets one answer per key back in the same order, so answers need not repeat the keys.
Chunk and bucket numbers grow with the corpus; what one task holds does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import id_or_last, power_of_two, small_batches, text_of

CHUNK_BYTES = 3 << 19
BUCKET_BYTES = 12 << 20


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; one pass with a partial sum per task."""
    return docs.select(F.coalesce(F.sum(F.octet_length(F.col(text)).cast("long")), F.lit(0)).alias("n")).first()["n"]


def sizes(n_bytes: int, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[int, int]:
    """Numbers of chunks and of key buckets for a corpus."""
    return max(1, -(-n_bytes // chunk_bytes)), max(8, power_of_two(n_bytes / bucket_bytes))


def in_chunks(docs: DataFrame, n_chunks: int, id_col: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(chunk, key_id, doc_id, text, *extra). Identical rows share a chunk, rows of one id with other texts need not."""
    small_batches(docs.sparkSession)
    # The order of columns in the hash is fixed; retries and reruns deal alike.
    at = F.pmod(F.xxhash64(F.col(id_col), F.col(text)), F.lit(n_chunks)).cast("long")
    return docs.select(at.alias("chunk"), id_or_last(id_col).alias("key_id"), F.col(id_col).cast("long").alias("doc_id"), text_of(text).alias("text"), *[F.col(f"`{c}`") for c in extra])
