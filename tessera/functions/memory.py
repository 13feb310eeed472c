"""Forgetting curve, ages and vectors as Column expressions. `now` is always a parameter (unix seconds)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the forgetting curve and of fusion.
DAY = 86400
BASE_STABILITY, LEAST_STABILITY, GROWTH, NEEDS_UPDATE = 7.0, 0.1, 1.7, 0.3
STALE_DAYS = 30
RETENTION_WEIGHT, REVISION_DECAY, LINK_DECAY = 0.1, 0.5, 0.5
RRF_K, POOL, VECTOR_GATE, LEXICAL_GATE = 60, 20, 0.8, 0.3
DIMENSIONS = 64


def clock_origin(recalled_at: Column, created_at: Column) -> Column:
    return F.coalesce(recalled_at, created_at)


def elapsed_days(now: Column, origin: Column) -> Column:
    return F.greatest((now - origin) / F.lit(float(DAY)), F.lit(0.0))


def retention(now: Column, origin: Column, stability: Column) -> Column:
    return F.exp(-elapsed_days(now, origin) / F.greatest(stability, F.lit(LEAST_STABILITY)))


def needs_update(kept: Column) -> Column:
    return kept < NEEDS_UPDATE


def strengthened(stability: Column) -> Column:
    return F.greatest(stability, F.lit(BASE_STABILITY)) * GROWTH


def stale(now: Column, updated_at: Column, days: int = STALE_DAYS) -> Column:
    return now - updated_at > days * DAY


def age_days(now: Column, updated_at: Column) -> Column:
    return F.floor(F.greatest(now - updated_at, F.lit(0)) / DAY).cast("long")


def final_score(relevance: Column, kept: Column) -> Column:
    return relevance * (1.0 - RETENTION_WEIGHT + RETENTION_WEIGHT * kept)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths and zero norms."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def bucket(word: Column) -> Column:
    """A word's dimension in the hash embedder: first byte of its SHA-256, modulo the dimensions."""
    return (F.conv(F.substring(F.sha2(word, 256), 1, 2), 16, 10).cast("int") % DIMENSIONS).cast("int")


def usable(vector: Column, model: Column, wanted: str, dimensions: int = DIMENSIONS, builtin: tuple[str, ...] = ("hash", "builtin")) -> Column:
    """A stored vector that a query of the wanted model can meet; one without a model counts as built in."""
    unnamed = F.coalesce(F.trim(model), F.lit("")) == ""
    same = F.coalesce(model == wanted, F.lit(False))
    return (F.coalesce(F.size(vector), F.lit(0)) == dimensions) & (same | (unnamed & F.lit(wanted in builtin)))
