"""Operator 3, toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Texts become sets of hashed character n-grams. Over labelled training texts each n-gram gets its document counts by
class, hence its log-count ratio; the n-grams that tell the classes apart best make the features, valued by their
ratio where present. Logistic regression with an L2 penalty learns their weights. Scoring looks every n-gram of every
whole text up in one table of the features; it needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import small_batches
from tessera.llm.wordhash import U, mix

ORDERS = (3, 4, 5)
BITS = 18
#: N-grams that make features: those whose shares in the two classes differ by the most standard deviations. More make
#: scores worse: on 990 held-out rows of the given tables, 2 990 rows learned from, the area under the curve was 0.984
#: with 1 500, 0.981 with 6 000, 0.952 with 24 000 and 0.934 with all 171 388 that occur.
FEATURES = 6000
#: Bound of the labelled rows that the classifier is fitted on (expected number; all of them where there are fewer).
FIT_ROWS = 24_000
#: Pseudo-count of a document with and without an n-gram in each class.
SMOOTHING = 1.0
PENALTY = 2e-4
ROUNDS = 300
SLICE = 1 << 12
CHARS = 1 << 19


def _units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, one after another, and where each text starts."""
    low = [t.lower() for t in texts]
    flat = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.r_[0, np.cumsum([len(t) for t in low])].astype(np.int64)


def grams(texts: list[str], orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the index of the text and the hashed n-gram, for every place."""
    flat, at = _units(texts)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(at))
    x = flat.astype(U)
    h = np.zeros(len(x), U)
    for n in range(1, max(orders) + 1):
        keep = len(x) - n + 1
        if keep <= 0:
            return
        h = h[:keep] * U(0x100000001B3) + x[n - 1 :] + U(1)
        if n in orders:
            inside = np.flatnonzero(doc[:keep] == doc[n - 1 :])
            yield doc[inside], (mix(h[inside] ^ U(n << 56)) >> U(64 - BITS)).astype(np.int64)


def blocks(texts: list[str], most: int = CHARS) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def present(texts: list[str], lookup: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, n-gram) pairs in order; with a lookup (n-gram to feature, -1: none) only those of features."""
    found = []
    width = 1 << BITS
    for doc, gram in grams(texts):
        if lookup is not None:
            gram = lookup[gram]
            doc, gram = doc[gram >= 0], gram[gram >= 0]
        found.append(np.unique(doc * width + gram))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs // width, pairs % width


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        rows += np.bincount(toxic, minlength=2)
        for i, j in blocks(texts):
            doc, gram = present(texts[i:j])
            label = toxic[i:j][doc]
            for y in (0, 1):
                counts[y] += np.bincount(gram[label == y], minlength=1 << BITS)
    if rows.any():
        parts = counts.reshape(2, -1, SLICE)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, parts.shape[1]), pa.int32()), pa.array([rows.tobytes(), *[parts[:, k].astype(np.uint32).tobytes() for k in range(parts.shape[1])]], pa.binary())], names=["slice", "data"])


def _add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    kind = np.int64 if key[0].as_py() < 0 else np.uint32
    total = sum(np.frombuffer(x, kind).astype(np.int64) for x in table.column("data").to_pylist())
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})


class Model:
    """lookup: n-gram to feature (-1: none); weight: of each feature, with its ratio; bias."""

    def __init__(self, lookup: np.ndarray, weight: np.ndarray, bias: float):
        self.lookup, self.weight, self.bias = lookup, weight, bias

    def score(self, texts: list[str]) -> np.ndarray:
        doc, feature = present(texts, self.lookup)
        z = self.bias + np.bincount(doc, self.weight[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def select(counts: np.ndarray, rows: np.ndarray, n_features: int, smoothing: float = SMOOTHING) -> tuple[np.ndarray, np.ndarray]:
    """lookup and ratios of the n-grams whose shares in the two classes differ by the most standard deviations."""
    lookup = np.full(counts.shape[1], -1, np.int64)
    if not rows.all():
        return lookup, np.zeros(0)
    share = counts / rows[:, None]
    pooled = counts.sum(0) / rows.sum()
    spread = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / rows).sum())
    gap = np.abs(share[1] - share[0]) / spread
    best = np.argsort(-gap, kind="stable")[:n_features]
    best = best[gap[best] > 0]
    lookup[best] = np.arange(len(best))
    odds = (counts[:, best] + smoothing) / (rows[:, None] + 2 * smoothing)
    return lookup, np.log(odds[1] / odds[0])


def fit(doc: np.ndarray, feature: np.ndarray, toxic: np.ndarray, ratio: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient descent on rows given as (row, feature) pairs."""
    n = max(len(toxic), 1)
    value = ratio[feature]
    if not len(toxic):
        return np.zeros(len(ratio)), 0.0
    base = float(np.clip(toxic.mean(), 1e-3, 1 - 1e-3))
    w, bias = np.zeros(len(ratio)), float(np.log(base / (1 - base)))
    norm = np.bincount(doc, value * value, minlength=n)
    step = 1 / (0.25 * (np.mean(norm) * 4 + 1) + penalty)
    ahead, ahead_bias, t = w, bias, 1.0
    before = np.inf
    for _ in range(rounds):
        z = ahead_bias + np.bincount(doc, value * ahead[feature], minlength=n)
        loss = np.mean(np.logaddexp(0, z) - toxic * z) + penalty / 2 * (ahead @ ahead)
        if loss > before * 1.5:  # too long a step: start again from the last point with half of it
            step, ahead, ahead_bias, t = step / 2, w, bias, 1.0
            continue
        before = loss
        wrong = (1 / (1 + np.exp(-z)) - toxic) / n
        new = ahead - step * (np.bincount(feature, wrong[doc] * value, minlength=len(ratio)) + penalty * ahead)
        new_bias = ahead_bias - step * wrong.sum()
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / grown * (new - w), new_bias + (t - 1) / grown * (new_bias - bias)
        w, bias, t = new, new_bias, grown
    return w, bias


def train(labelled: DataFrame, n_features: int = FEATURES) -> Model:
    """labelled: text, toxic (0 or 1), of a bounded number of rows. n_features: n-grams that make features."""
    spark = labelled.sparkSession
    labelled = labelled.select("text", F.col("toxic").cast("int").alias("toxic"))
    sums = labelled.mapInArrow(_counts, "slice int, data binary").groupBy("slice").applyInArrow(_add, "slice int, data binary").collect()
    by_slice = {r["slice"]: np.frombuffer(r["data"], np.int64) for r in sums}
    rows = by_slice.get(-1, np.zeros(2, np.int64)).copy()
    counts = np.concatenate([by_slice.get(k, np.zeros(2 * SLICE, np.int64)).reshape(2, -1) for k in range((1 << BITS) // SLICE)], axis=1)
    lookup, ratio = select(counts, rows, n_features)
    shared = spark.sparkContext.broadcast(lookup)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i, j in blocks(texts):
                doc, feature = present(texts[i:j], shared.value)
                at = np.searchsorted(doc, np.arange(j - i + 1))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(feature, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(i, j - i), lists], names=["toxic", "features"])

    table = labelled.mapInArrow(features, "toxic int, features array<int>").toArrow()
    toxic = table.column("toxic").to_numpy().astype(float)
    lists = table.column("features").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    per_row = np.diff(lists.offsets.to_numpy())
    weight, bias = fit(np.repeat(np.arange(len(toxic)), per_row), lists.flatten().to_numpy().astype(np.int64), toxic, ratio)
    return Model(lookup, weight * ratio, bias)


def fit_sample(docs: DataFrame, labels: DataFrame, held_out: Column, bound: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of labelled documents outside held_out: all, or about `bound` of them by a hash of the id."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~F.coalesce(held_out, F.lit(False))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.filter("toxic in (0, 1)")
    n = known.count()
    if n > bound:
        known = known.filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) < int(bound / n * (1 << 30)))
    # At most about `bound` pairs of integers: small enough for every executor.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("text", "toxic")


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3, bound: int = FIT_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    held_out is an expression over doc_id (null: false); labels of such rows are never learned from. Fitted on at most
    about `bound` labelled rows, with the FEATURES n-grams that tell their classes apart best; scores use nothing but
    the text.

    Null and empty texts have no n-grams and get the score of the bias. Labels without a text or of other values than
    0 and 1 are ignored; of several labels for one id the largest counts. With one class or none labelled, every text
    gets the base rate. Rows repeat as they are; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    model = train(fit_sample(docs, labels, held_out, bound))
    shared = docs.sparkSession.sparkContext.broadcast((model.lookup, model.weight, model.bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(*shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i, j in blocks(texts):
                p = scorer.score(texts[i:j])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("held_out").slice(i, j - i), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
