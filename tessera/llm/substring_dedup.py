"""Operator 1, substring dedup: a log-structured fingerprint index of word windows.

Each batch of documents (ascending doc_id) becomes packed sorted arrays of its window fingerprints, dealt to buckets by
their leading bits. A bucket merge-joins them with the historical runs (sorted, immutable, each key with the first
document that has it), answers each chunk of the batch with one bit per fingerprint and the first document of each hit,
and what is new becomes a run of the lowest tier; FANOUT runs of a tier are compacted into one of the next. Hits are
then verified: the words of each run of windows must stand in the document that is said to have them, and what does not
is taken back. A word goes when some verified window over it starts in a document with a smaller doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import runtime
from tessera.llm.key_exchange import in_chunks, sizes, total_bytes
from tessera.llm.packing import pack, pack_ids, pack_sorted, unpack, unpack_ids, unpack_sorted
from tessera.llm.wordhash import U, Words, new_base, trim, utf8

WINDOW = 13
#: Runs of one tier that are compacted into one of the next.
FANOUT = 4
#: Keys of a bucket of the index from which on it has twice as many buckets.
BUCKET_KEYS = 1 << 23
#: Bytes of spans (and of the documents that they are verified in) that a task takes at a time.
VERIFY_BYTES = 4 << 20
#: The leading bits of a key are of another hash of the window than the rest.
LEADING = U(0xFFFF << 48)

KEYS = "bucket int, chunk long, keys binary, first binary"
REDUCED = "kind string, bits int, bucket int, chunk long, n long, keys binary, first binary"
SPAN = "struct<origin:bigint,at:int,words:string>"
ANSWER = f"doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, row_chunk long, row long, spans array<{SPAN}>"


def _keyed(words: Words, width: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows' first words and keys, the order of keys, and where a new key begins in that order."""
    h = words.hashes(base)
    at, a = words.windows(width, h, 0)
    _, b = words.windows(width, h, 1)
    keys = (b & LEADING) | (a >> U(16))
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return at, keys, order, new


def _cut(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending keys."""
    bucket = (keys >> U(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return list(zip(bucket[at].tolist(), at.tolist(), np.r_[at[1:], len(keys)].tolist(), strict=True))


def _emit(width: int, bits: int, base: int):
    def emit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        words = Words(*utf8(table.column("text")))
        at, keys, order, new = _keyed(words, width, base)
        docs = table.column("key_id").to_numpy()[words.doc[at]][order]
        first = np.minimum.reduceat(docs, new) if len(new) else docs
        k = keys[order][new]
        del words, at, keys, order, docs
        trim()
        cut = _cut(k, bits)
        return pa.table(
            {
                "bucket": pa.array([b for b, _, _ in cut], pa.int32()),
                "chunk": pa.array([key[0].as_py()] * len(cut), pa.int64()),
                "keys": pa.array([pack_sorted(k[i:j]) for _, i, j in cut], pa.binary()),
                "first": pa.array([pack_ids(first[i:j]) for _, i, j in cut], pa.binary()),
            }
        )

    return emit


def _history(runs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys of a bucket's runs, each once, and the first document of each."""
    keys = [unpack_sorted(x) for x in runs.column("keys").to_pylist()]
    first = [unpack_ids(x) for x in runs.column("first").to_pylist()]
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    if len(keys) == 1:
        return keys[0], first[0]
    k, f = np.concatenate(keys), np.concatenate(first)
    order = np.lexsort((f, k))  # a key is in two runs only where a compaction broke off before it dropped them
    k, f = k[order], f[order]
    new = np.r_[True, k[1:] != k[:-1]]
    return k[new], f[new]


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({f.split()[0]: pa.array(c, t) for f, c, t in zip(REDUCED.split(", "), columns, types, strict=True)})


def _merge_join(bits: int, write_run: bool):
    """One bucket: the batch's keys against history; per chunk a bit a key and the first documents of hits; the new run."""

    def merge(key: tuple[pa.Scalar, ...], batch: pa.Table, runs: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        rows = [unpack_sorted(x) for x in batch.column("keys").to_pylist()]
        if not rows:
            return _rows([])
        past, past_first = _history(runs)
        keys = np.concatenate(rows)
        first = np.concatenate([unpack_ids(x) for x in batch.column("first").to_pylist()])
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        unique = s[new]
        least = np.minimum.reduceat(first[order], new)
        known = np.zeros(len(unique), dtype=bool)
        if len(past):
            spot = np.minimum(np.searchsorted(past, unique), len(past) - 1)
            known = past[spot] == unique
            least = np.where(known, np.minimum(least, past_first[spot]), least)
        origin = np.empty(len(keys), np.int64)
        origin[order] = np.repeat(least, np.diff(np.r_[new, len(s)]))
        hit = origin < first
        out: list[tuple] = []
        end = 0
        for chunk, x in zip(batch.column("chunk").to_pylist(), rows, strict=True):
            at, end = end, end + len(x)
            out.append(("reply", bits, bucket, chunk, len(x), np.packbits(hit[at:end]).tobytes(), pack_ids(origin[at:end][hit[at:end]])))
        fresh = ~known
        if write_run and fresh.any():
            out.append(("run", bits, bucket, None, int(fresh.sum()), pack_sorted(unique[fresh]), pack_ids(least[fresh])))
        trim()
        return _rows(out)

    return merge


def _compact(key: tuple[pa.Scalar, ...], runs: pa.Table) -> pa.Table:
    keys, first = _history(runs)
    return _rows([("run", runs.column("bits")[0].as_py(), key[0].as_py(), None, len(keys), pack_sorted(keys), pack_ids(first))])


def _refine(bits: int):
    """Rows of runs, those of fewer buckets split."""

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["bits"] == bits:
                    yield pa.RecordBatch.from_pylist([row], schema=batch.schema)
                    continue
                keys, first = unpack_sorted(row["keys"]), unpack_ids(row["first"])
                for b, i, j in _cut(keys, bits):
                    yield pa.RecordBatch.from_pylist([{"bits": bits, "bucket": b, "keys": pack_sorted(keys[i:j]), "first": pack_ids(first[i:j])}], schema=batch.schema)

    return refine


def _locate(width: int, bits: int, base: int, with_text: bool, own: tuple[str, ...] = ()):
    """A chunk's documents with its answers: what is left of them, and the spans of words that others had first."""

    def locate(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        words = Words(*utf8(table.column("text")))
        at, keys, order, new = _keyed(words, width, base)
        removed = np.zeros(len(words), dtype=bool)
        spans: list[list[dict]] = [[] for _ in range(len(table))]
        if len(order):
            docs = table.column("key_id").to_numpy()[words.doc[at]][order]
            counts = np.diff(np.r_[new, len(order)])
            origin = np.minimum.reduceat(docs, new)
            answers = {b: (x, f) for b, x, f in zip(replies.column("bucket").to_pylist(), replies.column("keys").to_pylist(), replies.column("first").to_pylist(), strict=True) if b >= 0}
            for b, i, j in _cut(keys[order][new], bits):
                hit = np.unpackbits(np.frombuffer(answers[b][0], np.uint8), count=j - i).astype(bool)
                origin[i:j][hit] = unpack_ids(answers[b][1])
            origin = np.repeat(origin, counts)
            hit = docs > origin
            starts, origin = at[order][hit], origin[hit]
            by_place = np.argsort(starts, kind="stable")
            starts, origin = starts[by_place], origin[by_place]
            row_of = table.column("row").to_numpy()
            taken_back = [i for i, b in enumerate(replies.column("bucket").to_pylist()) if b < 0]
            if taken_back:  # window starts (row, word) that verification has refused
                no = {x for i in taken_back for x in zip(unpack_ids(replies.column("keys")[i].as_py()).tolist(), unpack(replies.column("first")[i].as_py()).tolist(), strict=True)}
                doc = words.doc[starts]
                stay = np.array([x not in no for x in zip(row_of[doc].tolist(), (starts - words.first_of[doc]).tolist(), strict=True)], bool)
                starts, origin = starts[stay], origin[stay]
            steps = np.zeros(len(words) + 1, np.int32)
            np.add.at(steps, starts, 1)
            np.add.at(steps, starts + width, -1)
            removed = np.cumsum(steps[:-1]) > 0
            cut = np.flatnonzero(np.r_[True, (starts[1:] != starts[:-1] + 1) | (origin[1:] != origin[:-1])]) if len(starts) else []
            ends = np.r_[cut[1:], len(starts)] if len(starts) else []
            raw = memoryview(words.data)
            for i, j in zip(cut, ends, strict=True):
                w, last = int(starts[i]), int(starts[j - 1]) + width - 1
                d = int(words.doc[w])
                text = b" ".join(bytes(raw[int(words.start[w]) : int(words.end[last])]).split())
                spans[d].append({"origin": int(origin[i]), "at": w - int(words.first_of[d]), "words": text.decode()})
        n_words = np.diff(words.first_of)
        gone = np.add.reduceat(np.r_[removed, False].astype(np.int64), np.minimum(words.first_of[:-1], len(removed)))
        gone[n_words == 0] = 0
        shas, texts = _kept(words, removed, gone, with_text)
        trim()
        others = {c: table.column(c) for c in own}
        kind = pa.list_(pa.struct([("origin", pa.int64()), ("at", pa.int32()), ("words", pa.string())]))
        return pa.table(
            others
            | {"doc_id": table.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(shas, pa.string()), "kept_text": pa.array(texts, pa.string())}
            | {"row_chunk": pa.array([key[0].as_py()] * len(table), pa.int64()), "row": table.column("row"), "spans": pa.array(spans, kind)}
        )

    return locate


def _verify(width: int):
    """(chunk, row, at) of the windows whose words their origin does not have. One group: spans, and whole origins."""

    def verify(_key: tuple[pa.Scalar, ...], spans: pa.Table, origins: pa.Table) -> pa.Table:
        texts: dict[int, list[bytes]] = {}
        for i, t in zip(origins.column("origin").to_pylist(), origins.column("text").to_pylist(), strict=True):
            texts.setdefault(i, []).append(b" %b " % b" ".join(t.encode().split()))
        bad = []
        columns = (spans.column(c).to_pylist() for c in ("row_chunk", "row", "at", "origin", "words"))
        for chunk, row, at, origin, words in zip(*columns, strict=True):
            there = texts.get(origin, [])
            if any(b" %b " % words.encode() in t for t in there):
                continue
            each = words.encode().split()
            for k in range(len(each) - width + 1):  # not one passage there, but perhaps several
                window = b" %b " % b" ".join(each[k : k + width])
                if not any(window in t for t in there):
                    bad.append((chunk, row, at + k))
        chunk, row, at = zip(*bad, strict=True) if bad else ((), (), ())
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "row": pa.array(row, pa.int64()), "at": pa.array(at, pa.int32())})

    return verify


def _refusals(_key: tuple[pa.Scalar, ...], bad: pa.Table) -> pa.Table:
    """Refused windows of a chunk as one more answer to it, of bucket -1."""
    rows, at = bad.column("row").to_numpy(), bad.column("at").to_numpy()
    return pa.table({"bucket": pa.array([-1], pa.int32()), "chunk": bad.column("chunk").slice(0, 1).combine_chunks(), "keys": pa.array([pack_ids(rows)], pa.binary()), "first": pa.array([pack(at.astype(U))], pa.binary())})


def _kept(words: Words, removed: np.ndarray, gone: np.ndarray, with_text: bool) -> tuple[list[str], list[str | None]]:
    data, n = words.data, len(words.offsets) - 1
    drop = np.zeros(len(data) + 1, np.int8)  # a removed word goes with the white space after it
    after = np.r_[words.start[1:], len(data)]
    last = np.r_[words.doc[1:] != words.doc[:-1], True] if len(words) else np.zeros(0, bool)
    after[last] = words.offsets[words.doc[last] + 1]
    drop[words.start[removed]] += 1
    np.add.at(drop, after[removed], -1)
    stay = np.cumsum(drop[:-1], dtype=np.int8) == 0
    joined = data.copy()
    joined[words.space] = 32
    one = stay & ~words.space
    one[words.end[(words.end < after)]] = True  # one space after each word that has white space after it
    one &= stay
    at = np.r_[0, np.cumsum(one)][words.offsets]
    flat = joined[one].tobytes()
    shas, texts = [], []
    raw, whole = (np.r_[0, np.cumsum(stay)][words.offsets], data[stay].tobytes()) if with_text else (at, b"")
    for i in range(n):
        x = flat[at[i] : at[i + 1]]
        shas.append(hashlib.sha256(x[:-1] if x.endswith(b" ") else x).hexdigest())
        texts.append(whole[raw[i] : raw[i + 1]].decode() if with_text and gone[i] else None)
    return shas, texts


def _plain(with_text: bool, own: tuple[str, ...] = ()):
    """The answer for documents too short for a window: nothing goes."""

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(*utf8(batch.column("text")))
            n = np.diff(words.first_of)
            shas, texts = _kept(words, np.zeros(len(words), bool), np.zeros(len(n), np.int64), with_text)
            none = pa.nulls(len(batch), pa.int64())
            spans = pa.nulls(len(batch), pa.list_(pa.struct([("origin", pa.int64()), ("at", pa.int32()), ("words", pa.string())])))
            columns = [*[batch.column(c) for c in own], batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.zeros(len(n)), pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string()), none, none, spans]
            yield pa.RecordBatch.from_arrays(columns, names=[*own, "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "row_chunk", "row", "spans"])

    return plain


class FingerprintIndex:
    """A log-structured index in a folder: runs only ever get written, read and dropped as a whole.

    add(docs) answers for a batch whose doc_ids are above those of earlier batches. An index is made for expected_bytes
    of text; where it outgrows them, its buckets are split. FingerprintIndex.open(spark, path) goes on with an index
    that was made before, and drop() deletes it. A run counts once it is whole, so an add() that broke off is repeated.
    """

    def __init__(self, spark: SparkSession, expected_bytes: int, width: int = WINDOW, path: str | None = None):
        self.spark, self.width, self.base = spark, width, new_base()
        self.n_chunks, n_buckets = sizes(expected_bytes)
        self.bits = n_buckets.bit_length() - 1
        self.path = path or runtime.scratch(spark, "fingerprints")
        self.runs: list[tuple[int, str]] = []
        self.n_keys = self.n_written = 0
        spark.createDataFrame([(width, self.base, self.bits, self.n_chunks)], "width int, base long, bits int, n_chunks long").coalesce(1).write.parquet(f"{self.path}/made")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        self = cls.__new__(cls)
        self.spark, self.path = spark, path
        self.width, self.base, self.bits, self.n_chunks = spark.read.parquet(f"{path}/made").first()
        folders = [x.split("-") for x in runtime.names(spark, path) if x.startswith("tier-")]
        self.n_written = 1 + max((int(n) for _, _, n in folders), default=-1)
        self.runs = sorted((int(tier), f"{path}/tier-{tier}-{n}/kind=run") for _, tier, n in folders if {"_SUCCESS", "kind=run"} <= set(runtime.names(spark, f"{path}/tier-{tier}-{n}")))
        held = self._rows_of([r for _, r in self.runs]).agg(F.coalesce(F.max("bits"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first() if self.runs else (0, 0)
        self.bits, self.n_keys = max(self.bits, held[0]), held[1]
        return self

    def drop(self) -> None:
        runtime.delete(self.spark, self.path)
        self.runs = []

    def _rows_of(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("bits int, bucket int, n long, keys binary, first binary").parquet(*paths)

    def _runs(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], "bits int, bucket int, keys binary, first binary")
        rows = self._rows_of(paths).drop("n")
        return rows.mapInArrow(_refine(self.bits), rows.schema) if rows.filter(F.col("bits") < self.bits).limit(1).count() else rows

    def _write(self, tier: int, rows: DataFrame) -> str:
        out = f"{self.path}/tier-{tier}-{self.n_written:06d}"
        self.n_written += 1
        with runtime.own_shuffles(self.spark):
            rows.write.partitionBy("kind").option("compression", "zstd").parquet(out)
        return out

    def add(self, docs: DataFrame, write_run: bool = True, with_text: bool = False, n_chunks: int | None = None, extra: tuple[str, ...] = (), all_docs: DataFrame | None = None) -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256, kept_text (null unless asked for and changed) of each row.

        Before them come the columns named in extra, as in_0, in_1 and so on. all_docs (doc_id, text) has the documents of earlier
        batches too, in which hits are verified; without it, only those of this batch are, the others by their keys.
        """
        spark, schema = self.spark, docs.schema
        own = tuple(f"in_{k}" for k in range(len(extra)))
        docs = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(k) for c, k in zip(extra, own, strict=True)])
        long_enough = F.coalesce(F.octet_length("text") >= 2 * self.width - 1, F.lit(False))
        chunks = in_chunks(docs.filter(long_enough), n_chunks or self.n_chunks, extra=own)
        chunks = chunks.withColumn("row", F.xxhash64("doc_id", "text"))
        keys = chunks.groupBy("chunk").applyInArrow(_emit(self.width, self.bits, self.base), KEYS)
        runs = self._runs([r for _, r in self.runs])
        out = self._write(0, keys.groupBy("bucket").cogroup(runs.groupBy("bucket")).applyInArrow(_merge_join(self.bits, write_run), REDUCED))
        written = spark.read.schema(REDUCED).parquet(out)
        replies = written.filter("kind = 'reply'").select("bucket", "chunk", "keys", "first")
        columns = "".join(f"{k} {schema[c].dataType.simpleString()}, " for c, k in zip(extra, own, strict=True)) + ANSWER
        locate = _locate(self.width, self.bits, self.base, with_text, own)
        refused: list[DataFrame] = []
        plain = docs.filter(~long_enough).select("doc_id", "text", *own).withColumn("doc_id", F.col("doc_id").cast("long"))
        while True:
            answers = reduce(DataFrame.union, [replies, *refused])
            found = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(locate, columns).union(plain.mapInArrow(_plain(with_text, own), columns))
            found = runtime.written(found, "deduplicated", folder := [])
            bad = runtime.checkpoint(self._refused(found, docs if all_docs is None else all_docs, all_docs is None))
            if bad.isEmpty():
                break
            refused.append(bad.groupBy("chunk").applyInArrow(_refusals, "bucket int, chunk long, keys binary, first binary"))
            runtime.drop(folder)
        if write_run:
            n = self._rows_of([f"{out}/kind=run"]).agg(F.sum("n")).first()[0] if "kind=run" in runtime.names(spark, out) else None
            if n:
                self.runs.append((0, f"{out}/kind=run"))
                self.n_keys += n
                self._compact()
        runtime.delete(spark, f"{out}/kind=reply")
        return found.drop("row_chunk", "row", "spans")

    def _compact(self) -> None:
        while self.n_keys > BUCKET_KEYS << self.bits:
            self.bits += 1
        tier = 0
        while len(full := [r for t, r in self.runs if t == tier]) >= FANOUT:
            out = self._write(tier + 1, self._runs(full).groupBy("bucket").applyInArrow(_compact, REDUCED))
            self.runs = [(t, r) for t, r in self.runs if t != tier] + [(tier + 1, f"{out}/kind=run")]
            for old in full:
                runtime.delete(self.spark, old.removesuffix("/kind=run"))
            tier += 1

    def _refused(self, found: DataFrame, docs: DataFrame, only_here: bool) -> DataFrame:
        """(chunk, row, at) of windows that the document said to have them does not have."""
        spans = found.select("row_chunk", "row", F.explode("spans").alias("s")).select("row_chunk", "row", "s.*")
        spans = spans.withColumn("bytes", F.octet_length("words").cast("long"))
        per = runtime.checkpoint(spans.groupBy("origin").agg(F.sum("bytes").alias("bytes")))
        # At least a fourth of the chunks: origins may be all of the documents.
        n_groups = max(1, -(-self.n_chunks // 4), -(-(per.agg(F.sum("bytes")).first()[0] or 0) // VERIFY_BYTES))
        # An origin of very many spans is dealt to several groups, its text with each.
        heavy = runtime.checkpoint(per.filter(F.col("bytes") > VERIFY_BYTES).select("origin", F.ceil(F.col("bytes") / VERIFY_BYTES).alias("parts")))
        heavy = runtime.broadcast_if_small(heavy)
        group = F.pmod(F.xxhash64("origin"), F.lit(n_groups))
        part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("row_chunk", "row", "at"), F.col("parts")))
        texts = docs.select(F.col("doc_id").cast("long").alias("origin"), "text").filter("origin is not null and text is not null")
        texts = texts.join(runtime.broadcast_if_small(per.select("origin")), "origin", "left_semi")
        if only_here:
            spans = spans.join(runtime.broadcast_if_small(docs.select(F.col("doc_id").cast("long").alias("origin")).distinct()), "origin", "left_semi")
        spans = spans.join(heavy, "origin", "left").select("row_chunk", "row", "at", "origin", "words", group.alias("g"), part.cast("long").alias("part"))
        texts = texts.join(heavy, "origin", "left").select("origin", "text", group.alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)).alias("part"))
        return spans.groupBy("g", "part").cogroup(texts.groupBy("g", "part")).applyInArrow(_verify(self.width), "chunk long, row long, at int")


def without_repeats(docs: DataFrame, width: int = WINDOW, n_batches: int = 3) -> DataFrame:
    """The rows of docs, all columns kept, with repeated words cut out of text; rows of which nothing is left go.

    White space after a kept word stays as it was. n_chars, where there is one, follows the text.
    """
    found = substring_dedup(docs, width, n_batches, with_text=True, extra=tuple(docs.columns))
    found = found.filter("n_words = 0 or n_removed < n_words")
    of = {c: F.col(f"in_{k}") for k, c in enumerate(docs.columns)}
    text = F.coalesce(F.col("kept_text"), of["text"])
    new = {"text": text, "n_chars": F.when(F.col("kept_text").isNull(), of["n_chars"]).otherwise(F.length(text).cast("long"))} if "n_chars" in of else {"text": text}
    return found.select(*[new.get(c, of[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def substring_dedup(docs: DataFrame, width: int = WINDOW, n_batches: int = 3, with_text: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Removes each word under a window of `width` words that also starts in a document of a smaller doc_id.

    One row per input row: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space), kept_text (null
    where nothing goes). The table is taken in n_batches of ascending doc_id, as an incremental load would bring it.

    Null or empty texts have no words. A null doc_id counts as above all others. Rows that share a doc_id never remove
    each other's words. Texts of fewer than `width` words stay whole. Other columns are ignored. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    runtime.small_batches(spark)
    index = FingerprintIndex(spark, total_bytes(docs), width)
    at = runtime.id_or_last()
    cuts = docs.select(F.percentile_approx(at, [i / n_batches for i in range(1, n_batches)], 1000).alias("c")).first()["c"] if n_batches > 1 else []
    edges = sorted(set(cuts or []))
    bounds = list(zip([None, *edges], [*edges, None], strict=True))
    per_batch = max(1, -(-index.n_chunks // len(bounds)))
    parts = []
    for i, (low, high) in enumerate(bounds):
        batch = docs if low is None else docs.filter(at > low)
        batch = batch if high is None else batch.filter(at <= high)
        parts.append(index.add(batch, write_run=i + 1 < len(bounds), with_text=with_text, n_chunks=per_batch, extra=extra, all_docs=docs))
    index.drop()
    return reduce(DataFrame.union, parts)
