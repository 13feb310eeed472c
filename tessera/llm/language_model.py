"""Operator 7, LM scoring: n-gram maximum-likelihood estimates mixed by deleted interpolation.

Counts of all n-grams of the training documents travel packed (key_exchange): each chunk of documents sends its own
n-grams with their counts and gets the corpus counts back. Training documents in every FOLDS-th chunk are the deleted
part: their tokens, seen against the counts of the rest, give the held-out statistics from which
expectation-maximisation learns one weight vector per bucket of context frequency. All training documents then make
the final counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import runtime
from tessera.llm.key_exchange import in_chunks, sizes, total_bytes
from tessera.llm.packing import pack_sorted, unpack_sorted
from tessera.llm.wordhash import LOWER, U, Words, mix, new_base, trim, utf8

#: Every FOLDS-th chunk is held out to learn the weights.
FOLDS = 8
END = U(0x5851F42D4C957F2D)
#: Estimates are binned by eighths of a power of two for the weights (not for the scores).
STEPS = 8

KEYS = "bucket int, chunk long, keys binary, counts binary"
REDUCED = "kind string, bucket int, chunk long, total long, total_rest long, n_distinct long, data binary, rest binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Grams:
    """Tokens of a chunk's texts (words and an end each) and the keys of the n-grams that end at each token."""

    def __init__(self, table: pa.Table, order: int, n_buckets: int, base: int):
        data, offsets = utf8(table.column("text"))
        words = Words(LOWER[data], offsets)
        n_docs = len(offsets) - 1
        self.first = words.first_of[:-1] + np.arange(n_docs)
        self.n_tokens = np.diff(words.first_of) + 1
        n = len(words) + n_docs
        tokens = np.empty(n, U)
        tokens[np.arange(len(words)) + words.doc] = words.hashes(base)
        tokens[self.first + self.n_tokens - 1] = END
        self.doc = np.repeat(np.arange(n_docs), self.n_tokens)
        self.is_first = np.zeros(n, bool)
        self.is_first[self.first] = True
        place = np.arange(n) - self.first[self.doc]
        self.unique, self.slot, self.bucket = [], [], []
        gram = tokens
        for k in range(1, order + 1):
            if k > 1:
                before = np.r_[np.full(k - 1, END), tokens[: n - k + 1]][:n]
                gram = mix(gram + mix(np.where(place >= k - 1, before, END) * U(2 * k + 1)))
            unique, slot = np.unique(gram, return_inverse=True)
            self.unique.append(unique)
            self.bucket.append((unique >> U(65 - n_buckets.bit_length())).astype(np.int64) + (k - 1) * n_buckets)
            self.slot.append(slot)

    def cut(self, k: int) -> list[tuple[int, int, int]]:
        """(bucket, from, to) of the unique keys of order k + 1."""
        b = self.bucket[k]
        at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
        return list(zip(b[at].tolist(), at.tolist(), np.r_[at[1:], len(b)].tolist(), strict=True))


def _narrow(x: np.ndarray) -> bytes:
    kind = next(k for k in ("u1", "u2", "u4", "u8") if int(x.max(initial=0)) < 1 << 8 * int(k[1]))
    return kind[1].encode() + pa.compress(x.astype(kind).tobytes(), codec="lz4_raw", asbytes=True)


def _wide(raw: bytes, n: int) -> np.ndarray:
    width = int(raw[:1])
    return np.frombuffer(pa.decompress(raw[1:], n * width, codec="lz4_raw", asbytes=True), f"u{width}").astype(np.int64)


def _emit(order: int, n_buckets: int, base: int):
    def emit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        g = Grams(table, order, n_buckets, base)
        train = (~table.column("held_out").to_numpy())[g.doc]
        rows = []
        for k in range(order):
            counts = np.bincount(g.slot[k], weights=train, minlength=len(g.unique[k])).astype(np.int64)
            rows += [(b, pack_sorted(g.unique[k][i:j]), _narrow(counts[i:j])) for b, i, j in g.cut(k)]
        trim()
        b, keys, counts = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"bucket": pa.array(b, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(b), pa.int64()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return emit


def _reduce(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One bucket of keys: corpus counts for every chunk, and for deleted chunks also those of the rest."""
    rows = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    chunks = table.column("chunk").to_pylist()
    counts = np.concatenate([_wide(x, len(k)) for x, k in zip(table.column("counts").to_pylist(), rows, strict=True)])
    keys = np.concatenate(rows)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    group = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(s)]))
    deleted = np.repeat([c % FOLDS == 0 for c in chunks], [len(x) for x in rows])
    total = np.add.reduceat(counts[order], new)
    rest = total - np.add.reduceat((counts * deleted)[order], new)
    back = np.empty(len(keys), np.int64)
    back[order] = group
    bucket = key[0].as_py()
    out = [("stat", bucket, None, int(total.sum()), int(rest.sum()), int((total > 0).sum()), None, None)]
    at = 0
    for chunk, x in zip(chunks, rows, strict=True):
        slot = back[at : at + len(x)]
        out.append(("reply", bucket, chunk, 0, 0, 0, _narrow(total[slot]), _narrow(rest[slot]) if chunk % FOLDS == 0 else None))
        at += len(x)
    cols = list(zip(*out, strict=True))
    types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({f.split()[0]: pa.array(c, t) for f, c, t in zip(REDUCED.split(", "), cols, types, strict=True)})


def _counts(g: Grams, replies: pa.Table, order: int, column: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per order: the count of the n-gram that ends at each token, and of its context (order 1: none)."""
    blobs = dict(zip(replies.column("bucket").to_pylist(), replies.column(column).to_pylist(), strict=True))
    found, context = [], []
    ends = 0
    for k in range(order):
        parts = [_wide(blobs[b], j - i) for b, i, j in g.cut(k)]
        per_key = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        found.append(per_key[g.slot[k]])
        if k == 0:
            ends = int(found[0][g.first[0] + g.n_tokens[0] - 1])
            context.append(np.zeros(len(g.doc), np.int64))
        else:
            context.append(np.where(g.is_first, ends, np.r_[0, found[k - 1][:-1]]))
    return found, context


def _estimates(found: list[np.ndarray], context: list[np.ndarray], n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Relative frequencies (a column for the uniform one, then one per order) and the bucket of the context."""
    columns = [np.full(len(found[0]), 1.0 / (v + 1)), found[0] / max(n, 1)]
    columns += [np.where(c > 0, f / np.maximum(c, 1), 0.0) for f, c in zip(found[1:], context[1:], strict=True)]
    top = context[-1] if len(found) > 1 else np.zeros(len(found[0]), np.int64)
    return np.stack(columns, axis=1), np.frexp(top.astype(np.float64))[1] * (top > 0)


def _held_out(order: int, n_buckets: int, base: int, n_rest: int, v: int):
    def tally(_key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        names = [f"bin_{k}" for k in range(1, order + 1)]
        empty = pa.table({x: pa.array([], pa.int32()) for x in ("bucket", *names)} | {"n": pa.array([], pa.int64())})
        if not len(table):
            return empty
        g = Grams(table, order, n_buckets, base)
        train = (~table.column("held_out").to_numpy())[g.doc]
        found, context = _counts(g, replies, order, "rest")
        f, bucket = _estimates(found, context, n_rest, v)
        bins = np.where(f[:, 1:] > 0, 1 + np.floor(-STEPS * np.log2(np.maximum(f[:, 1:], 1e-300))), 0).astype(np.int32)
        rows, n = np.unique(np.column_stack([bucket.astype(np.int32), bins])[train], axis=0, return_counts=True)
        return pa.table({x: pa.array(rows[:, i], pa.int32()) for i, x in enumerate(("bucket", *names))} | {"n": pa.array(n, pa.int64())})

    return tally


def learn_weights(tallies: np.ndarray, order: int, v: int, rounds: int = 50) -> np.ndarray:
    """EM: tallies' columns are bucket, a bin per order, n. One weight per bucket (row), uniform and orders (columns).

    The rows are at most 65 buckets times about STEPS * 40 bins to the power of the order (in fact some thousands), however
    large the corpus.

    A bucket without held-out tokens has the weights of all buckets together; each bucket leans on those by a token.
    """
    if not len(tallies):
        return np.tile(np.full(order + 1, 1 / (order + 1)), (65, 1))
    bucket, bins, n = tallies[:, 0].astype(int), tallies[:, 1:-1], tallies[:, -1].astype(float)
    f = np.column_stack([np.full(len(n), 1.0 / (v + 1)), np.where(bins > 0, 2.0 ** (-(bins - 0.5) / STEPS), 0.0)])
    together = np.full(order + 1, 1 / (order + 1))
    for _ in range(rounds):
        part = together * f
        together = (part / part.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
    together = np.maximum(together, 1e-9) / np.maximum(together, 1e-9).sum()
    weights = np.tile(together, (65, 1))
    for _ in range(rounds):
        part = weights[bucket] * f
        part *= (n / part.sum(1))[:, None]
        sums = np.column_stack([np.bincount(bucket, part[:, i], 65) for i in range(order + 1)]) + together
        weights = sums / sums.sum(1, keepdims=True)
    weights[0, 2:] = 0  # an unseen context has no estimate
    return weights / weights.sum(1, keepdims=True)


def _score(order: int, n_buckets: int, base: int, n: int, v: int, weights: np.ndarray):
    def score(_key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        g = Grams(table, order, n_buckets, base)
        found, context = _counts(g, replies, order, "data")
        f, bucket = _estimates(found, context, n, v)
        p = np.log10((weights[bucket] * f).sum(1))
        add_one = np.log10((found[0] + 1.0) / (n + 1.0 * (v + 1)))
        sums = [np.add.reduceat(x, g.first) for x in ((found[0] > 0).astype(np.int64), add_one, p)]
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "held_out": table.column("held_out"),
                "n_tokens": pa.array(g.n_tokens, pa.int64()),
                "n_known": pa.array(sums[0], pa.int64()),
                "train_tokens": pa.array(np.full(len(g.first), n), pa.int64()),
                "base_score": pa.array(sums[1], pa.float64()),
                "score": pa.array(sums[2], pa.float64()),
            }
        )

    return score


def deleted_interpolation(docs: DataFrame, held_out, order: int = 2) -> DataFrame:
    """log10 probability of each text under an interpolated n-gram model of the rows where held_out is false.

    Texts are lower-cased (A-Z), cut into words, and closed by an end, which is a token; the words before a text's
    first count as ends. One row per input row: doc_id, held_out, n_tokens, n_known (tokens that training has),
    train_tokens, base_score (add-one unigrams), score. A null held_out is false.

    A null or empty text is its end alone. Rows repeat as they are. With no training rows every estimate but the
    uniform one is zero and scores stay finite. An empty table gives an empty result. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    n_chunks, n_buckets = sizes(total_bytes(docs))
    n_chunks, base = max(n_chunks, 8 * FOLDS), new_base()
    chunks = in_chunks(docs, n_chunks, extra=("held_out",))
    keys = chunks.groupBy("chunk").applyInArrow(_emit(order, n_buckets, base), KEYS)
    reduced = runtime.written(keys.groupBy("bucket").applyInArrow(_reduce, REDUCED), "ngram-counts")
    stats = reduced.filter((F.col("kind") == "stat") & (F.col("bucket") < n_buckets))
    n, n_rest, v = (x or 0 for x in stats.agg(F.sum("total"), F.sum("total_rest"), F.sum("n_distinct")).first())
    replies = reduced.filter("kind = 'reply'").select("bucket", "chunk", "data", "rest")
    deleted = F.col("chunk") % FOLDS == 0
    tally_schema = "bucket int, " + ", ".join(f"bin_{k} int" for k in range(1, order + 1)) + ", n long"
    tallies = chunks.filter(deleted).groupBy("chunk").cogroup(replies.filter(deleted).groupBy("chunk")).applyInArrow(_held_out(order, n_buckets, base, n_rest, v), tally_schema)
    names = tallies.columns
    with runtime.own_shuffles(docs.sparkSession):
        rows = tallies.groupBy(*names[:-1]).agg(F.sum("n").alias("n")).toPandas().to_numpy(dtype=np.int64)
    weights = learn_weights(rows, order, v)
    return chunks.groupBy("chunk").cogroup(replies.select("bucket", "chunk", "data").groupBy("chunk")).applyInArrow(_score(order, n_buckets, base, n, v, weights), RESULT)
