"""Operator 12, cross-tokenizer alignment: which tokens of one tokenizer share bytes with which of another.

Tokens are intervals of bytes. The ends of the B tokens are a static interval index; two bisections of it stab the B
tokens that an A token overlaps, and those are its links. A gap between B tokens that no A token spans is where groups
part. Then each link is held against how often its pair of ids is linked in the whole corpus.

Neither tokenizer joins anything across a single blank or line break between two visible characters (the B pieces are
looked through for that when they are read), so a text is the concatenation of the stretches between those. A chunk's
distinct stretches are aligned all at once, as one long text; workers remember the tokens of those they have seen. Pairs
travel packed (key_exchange): a chunk of documents sends each of its pairs once with a count and gets corpus counts back
in order. A pair's best partner is a maximum by B id, of which there are no more than the vocabulary has.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import runtime
from tessera.llm.key_exchange import sizes, total_bytes
from tessera.llm.packing import pack, pack_sorted, unpack, unpack_sorted
from tessera.llm.wordhash import U, mix, trim, utf8

#: Stretches up to this many characters are remembered; so many stretches, or tokens, before a worker starts anew.
REMEMBERED_CHARS, REMEMBERED, REMEMBERED_TOKENS = 64, 1_000_000, 10_000_000

# Fixed value: the pattern by which byte-level vocabularies split text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Stretches on whose letters all versions of Unicode agree.
LATIN = re.compile("[ \n][!-~\u00a1-\u024f]+")

KEYS = "bucket int, chunk long, keys binary, counts binary"
REDUCED = "kind string, bucket int, chunk long, data binary, b array<int>, most array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_level() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, then from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


def _visible() -> np.ndarray:
    """By a character's first byte: it is ASCII other than white space and controls, or one of two or three bytes among
    which there is no white space."""
    out = np.zeros(256, bool)
    out[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xEE)]] = True
    return out


VISIBLE = _visible()


def stretch_starts(data: np.ndarray) -> np.ndarray:
    """Places of single blanks and line breaks between visible characters (UTF-8)."""
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[(at > 0) & (at < len(data) - 1)]
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    tail = (one & 0xC0) == 0x80
    before = np.where(tail, np.where((two & 0xC0) == 0x80, VISIBLE[three] & (three >= 0xE0), VISIBLE[two] & (two >= 0xC3) & (two < 0xE0)), VISIBLE[one] & (one < 0x80))
    return at[before & VISIBLE[data[at + 1]]]


def links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A token the first and the last B token that it overlaps; ends are bytes, in order."""
    starts = np.r_[0, a_ends][:-1]
    return np.searchsorted(b_ends, starts, "right"), np.searchsorted(b_ends, a_ends, "left")


def unspanned(first: np.ndarray, last: np.ndarray, n_b: int) -> np.ndarray:
    """For each B token whether no A token goes on beyond it: a group ends there."""
    open_ = np.bincount(first, minlength=n_b + 1) - np.bincount(last, minlength=n_b + 1)
    return np.cumsum(open_)[:n_b] == 0


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] of them, and so on."""
    return np.repeat(first - np.r_[0, np.cumsum(n)][:-1], n) + np.arange(n.sum())


class Coder:
    """One tokenizer's tokens of stretches, remembered as ranges of one array."""

    def __init__(self, token_bytes: list[bytes]):
        self.bytes = token_bytes
        self.length = np.array([len(b) for b in token_bytes], np.int64)
        self.clear()

    def clear(self) -> None:
        self.tokens, self.ends = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        self.n_tokens = 0

    def add(self, ids: list[int], n: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """n[0] tokens of the first stretch, and so on; whether those of each stretch are its bytes."""
        tokens, ends = np.array(ids, np.int32), np.cumsum(n)
        self.tokens.append(tokens)
        self.ends.append(self.n_tokens + ends)
        self.n_tokens += len(tokens)
        length = np.diff(np.r_[0, np.cumsum(self.length[tokens])][np.r_[0, ends]])
        sound = length == np.array([len(x) for x in raw], np.int64)
        if sound.all() and b"".join([self.bytes[i] for i in ids]) == b"".join(raw):
            return sound
        return np.array([b"".join([self.bytes[i] for i in ids[e - k : e]]) == x for e, k, x in zip(ends.tolist(), n.tolist(), raw, strict=True)], bool)

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of some stretches, one after another, and how many each has."""
        self.tokens, self.ends = [np.concatenate(self.tokens)], [np.concatenate(self.ends)]
        ends = np.r_[0, self.ends[0]]
        n = ends[numbers + 1] - ends[numbers]
        return self.tokens[0][_ranges(ends[numbers], n)], n


class Aligner:
    """Both tokenizers, and the stretches whose tokens are known."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(a_path)
        a.encode_special_tokens = True
        b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = byte_level()
        a_bytes = [b""] * a.get_vocab_size()
        for t, i in a.get_vocab(with_added_tokens=False).items():
            a_bytes[i] = bytes(of[c] for c in t) if all(c in of for c in t) else b""
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.in_stretches = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        prefix = b.piece_to_id("▁")
        special = {t["id"] for t in json.loads(a.to_str())["added_tokens"]}
        ranks = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={x: i for i, x in enumerate(a_bytes) if x and i not in special}, special_tokens={})
        splits = json.loads(a.to_str())
        same = splits["normalizer"] is None and splits["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

        def encode_a(plain: list[str], others: list[str]) -> tuple[list[int], np.ndarray]:
            """Stretches of Latin letters as one text by the same ranks, the others one by one."""
            ids = ranks.encode_ordinary("".join(plain))
            ends = np.searchsorted(np.cumsum(self.a.length[np.array(ids, np.int64)]), np.cumsum([len(s.encode()) for s in plain])) + 1
            more = [x.ids for x in a.encode_batch_fast(others, add_special_tokens=False)] if others else []
            return ids + [i for x in more for i in x], np.r_[np.diff(np.r_[0, ends]), [len(x) for x in more]].astype(np.int64)

        def encode_b(new: list[str]) -> tuple[list[int], np.ndarray]:
            """A blank at the begin is B's own; before a line break B's is one token too many."""
            ids = b.encode([s[s[0] == " " :] for s in new], num_threads=1)
            ids = [x[1:] if s[0] != " " and x[:1] == [prefix] else x for s, x in zip(new, ids, strict=True)]
            return [i for x in ids for i in x], np.array([len(x) for x in ids], np.int64)

        self._latin = LATIN if same else re.compile("(?!)")
        self._encode = encode_a, encode_b
        self.a, self.b = Coder(a_bytes), Coder(b_bytes)
        self.known: dict[str, int] = {}
        self.sound = np.zeros(0, bool)
        n_a, n_b = len(a_bytes), len(b_bytes)
        #: Token ids as text with what may follow: an A token another of its group or its B tokens, a B token another or a group.
        self.shown = pa.array([f"{i}{c}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for c in marks for i in range(n)], pa.string())
        self.shown_at = {"a": (0, n_a), "b": (2 * n_a, 2 * n_a + n_b)}

    def numbers(self, parts: list[str]) -> np.ndarray:
        """The number of each stretch, all of whose tokens are known afterwards."""
        if len(self.known) > REMEMBERED or self.a.n_tokens > REMEMBERED_TOKENS:
            self.known, self.sound = {}, np.zeros(0, bool)
            self.a.clear()
            self.b.clear()
        known, begin = self.known.get, len(self.sound)
        at = [known(p, -1) for p in parts]
        new = [p for p, i in zip(parts, at, strict=True) if i < 0]
        if new:
            plain, others = [], []
            for p in new:
                (plain if self._latin.fullmatch(p) else others).append(p)
            new = plain + others
            raw = [p.encode() for p in new]
            self.sound = np.r_[self.sound, self.a.add(*self._encode[0](plain, others), raw) & self.b.add(*self._encode[1](new), raw)]
            fresh = {p: begin + k for k, p in enumerate(new)}
            at = [fresh[p] if i < 0 else i for p, i in zip(parts, at, strict=True)]
            self.known.update((p, i) for p, i in fresh.items() if len(p) <= REMEMBERED_CHARS)
        return np.array(at, np.int64)


def aligner_of(a_path: str, b_path: str) -> Callable[[], Aligner]:
    """One aligner a worker."""

    def aligner() -> Aligner:
        if (a_path, b_path) not in _made:
            _made[a_path, b_path] = Aligner(a_path, b_path)
        return _made[a_path, b_path]

    return aligner


_made: dict[tuple[str, str], Aligner] = {}


def _slices(data: pa.Buffer, offsets: np.ndarray) -> pa.Array:
    """Texts between offsets of one buffer."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), data)


class Chunk:
    """The alignments of a chunk's documents: its distinct stretches, and for each place the number of its stretch."""

    def __init__(self, aligner: Aligner, texts: pa.ChunkedArray, n_buckets: int):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        led = pc.if_else(some, pc.binary_join_element_wise(pa.scalar(" "), pc.fill_null(texts, ""), pa.scalar("")), "")
        data, offsets = utf8(led)
        self.n_docs, filled = len(texts), np.diff(offsets) > 0
        starts = np.sort(np.r_[offsets[:-1][filled], stretch_starts(data) if aligner.in_stretches else np.zeros(0, np.int64)])
        starts = starts[np.r_[True, starts[1:] != starts[:-1]][: len(starts)]]
        coded = _slices(pa.py_buffer(np.ascontiguousarray(data)), np.r_[starts, len(data)].astype(np.int64)).dictionary_encode()
        self.code = coded.indices.to_numpy().astype(np.int64)
        self.doc = np.searchsorted(offsets, starts, "right") - 1
        parts = coded.dictionary.to_pylist()
        numbers = aligner.numbers(parts)
        sound = aligner.sound[numbers]
        bad = np.zeros(self.n_docs, bool)
        bad[self.doc[~sound[self.code]]] = True
        self.sound = ~bad & filled
        live = self.sound[self.doc]
        self.code, self.doc = self.code[live], self.doc[live]
        self.times = np.bincount(self.code, minlength=len(parts))
        # Stretches that stand in sound texts, as one long text.
        used = np.flatnonzero(self.times)
        self.n_stretches = len(parts)
        (a, n_a), (b, n_b) = aligner.a.of(numbers[used]), aligner.b.of(numbers[used])
        first, last = links(np.cumsum(aligner.a.length[a]), np.cumsum(aligner.b.length[b]))
        self._ends = unspanned(first, last, len(b))
        self._tokens, self._last = (a, b), last
        n_links = last - first + 1
        pairs = np.repeat(a.astype(U), n_links) << U(32) | b[_ranges(first, n_links)].astype(U)
        self.of_stretch = np.repeat(np.repeat(used, n_a), n_links)
        self.per = {name: np.bincount(of, minlength=self.n_stretches) for name, of in (("n_a", np.repeat(used, n_a)), ("n_b", np.repeat(used, n_b)), ("n_groups", np.repeat(used, n_b)[self._ends]), ("n_links", self.of_stretch))}
        # Buckets by a hash, so that pairs of a frequent token are spread.
        by_pair = np.argsort(pairs, kind="stable")
        new = np.r_[True, np.diff(pairs[by_pair]) > 0][: len(pairs)]
        unique, self.slot = pairs[by_pair][new], np.empty(len(pairs), np.int64)
        self.slot[by_pair] = np.cumsum(new) - 1
        bucket = (mix(unique) >> U(65 - n_buckets.bit_length())).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.keys, self.bucket, self.slot = unique[order], bucket[order], back[self.slot]

    def counts(self) -> np.ndarray:
        return np.bincount(self.slot, weights=self.times[self.of_stretch], minlength=len(self.keys)).astype(np.int64)

    def cut(self) -> list[tuple[int, int, int]]:
        """(bucket, from, to) of the keys."""
        at = np.flatnonzero(np.r_[True, self.bucket[1:] != self.bucket[:-1]]) if len(self.bucket) else np.zeros(0, np.int64)
        return list(zip(self.bucket[at].tolist(), at.tolist(), np.r_[at[1:], len(self.bucket)].tolist(), strict=True))

    def by_doc(self, per_stretch: np.ndarray) -> np.ndarray:
        """Sums of whole numbers (exact: below 2**53)."""
        return np.bincount(self.doc, weights=per_stretch[self.code], minlength=self.n_docs).astype(np.int64)

    def by_stretch(self, per_key: np.ndarray) -> np.ndarray:
        return np.bincount(self.of_stretch, weights=per_key[self.slot], minlength=self.n_stretches).astype(np.int64)

    def groups(self, aligner: Aligner) -> list[str]:
        """Of each document: `a1,a2|b1;a3|b2,b3`."""
        a, b = self._tokens
        group_b = np.cumsum(self._ends) - self._ends
        group_a = group_b[self._last] if len(a) else np.zeros(0, np.int64)
        ends_a = np.r_[group_a[1:] != group_a[:-1], True] if len(a) else np.zeros(0, bool)
        index = np.r_[np.choose(ends_a, aligner.shown_at["a"]) + a, np.choose(self._ends, aligner.shown_at["b"]) + b]
        order = np.lexsort((np.r_[np.zeros(len(a)), np.ones(len(b))], np.r_[group_a, group_b]))
        items = aligner.shown.take(pa.array(index[order]))
        ends = np.cumsum(pc.binary_length(items).to_numpy()) if len(items) else np.zeros(0, np.int64)
        n_items = self.per["n_a"] + self.per["n_b"]
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(n_items)]]
        data, offsets = utf8(items)
        each = _slices(pa.py_buffer(np.ascontiguousarray(data)), bounds).take(pa.array(self.code))
        length = pc.binary_length(each).to_numpy() if len(each) else np.zeros(0, np.int64)
        whole = np.r_[0, np.cumsum(np.bincount(self.doc, weights=length, minlength=self.n_docs))].astype(np.int64)
        joined = _slices(each.buffers()[2] or pa.py_buffer(b""), whole)
        return [t[:-1] for t in joined.to_pylist()]


def _emit(aligner: Callable[[], Aligner], n_buckets: int):
    def emit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        c = Chunk(aligner(), table.column("text"), n_buckets)
        counts = c.counts()
        rows = [(b, pack_sorted(c.keys[i:j]), pack(counts[i:j].astype(U))) for b, i, j in c.cut()]
        trim()
        b, keys, n = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"bucket": pa.array(b, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(b), pa.int64()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(n, pa.binary())})

    return emit


def _reduce(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One bucket of pairs: corpus counts for every chunk, and the greatest of each B id."""
    rows = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    chunks = table.column("chunk").to_pylist()
    keys, counts = np.concatenate(rows), np.concatenate([unpack(x) for x in table.column("counts").to_pylist()]).astype(np.int64)
    unique, slot = np.unique(keys, return_inverse=True)
    total = np.zeros(len(unique), np.int64)
    np.add.at(total, slot, counts)
    b, at = np.unique(unique & U(0xFFFFFFFF), return_inverse=True)
    most = np.zeros(len(b), np.int64)
    np.maximum.at(most, at, total)
    ends = np.cumsum([len(x) for x in rows])
    replies = [pack(total[slot[e - len(x) : e]].astype(U)) for e, x in zip(ends, rows, strict=True)]
    n, bucket = len(rows), key[0].as_py()
    return pa.table(
        {
            "kind": pa.array(["best", *["reply"] * n]),
            "bucket": pa.array([bucket] * (n + 1), pa.int32()),
            "chunk": pa.array([None, *chunks], pa.int64()),
            "data": pa.array([None, *replies], pa.binary()),
            "b": pa.array([b.astype(np.int32), *[None] * n], pa.list_(pa.int32())),
            "most": pa.array([most, *[None] * n], pa.list_(pa.int64())),
        }
    )


def _score(aligner: Callable[[], Aligner], n_buckets: int, best: np.ndarray, with_groups: bool):
    def score(_key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        c = Chunk(aligner(), table.column("text"), n_buckets)
        blobs = dict(zip(replies.column("bucket").to_pylist(), replies.column("data").to_pylist(), strict=True))
        parts = [unpack(blobs[b]).astype(np.int64) for b, _, _ in c.cut()]
        total = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        is_best = (total == best[(c.keys & U(0xFFFFFFFF)).astype(np.int64)]).astype(np.int64)
        per = [*c.per.values(), c.by_stretch(is_best), c.by_stretch(total)]
        groups_of = c.groups(aligner())
        digests = [hashlib.sha256(g.encode()).hexdigest() if ok else "" for g, ok in zip(groups_of, c.sound, strict=True)]
        names = [f.split()[0] for f in RESULT.split(", ")]
        columns = [table.column("doc_id"), *[pa.array(c.by_doc(x)) for x in per], pa.array(digests, pa.string())]
        out = dict(zip(names, columns, strict=True))
        trim()
        return pa.table(out | ({"groups": pa.array(groups_of, pa.string())} if with_groups else {}))

    return score


def align(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_a and n_b tokens, n_groups, n_links, n_best (links whose count is the highest of
    their B id), count_sum, groups_sha256 (of `a1,a2|b1;a3|b2,b3`); with_groups adds groups, that text itself.

    A encodes a blank and the text, B the text (to which it adds the blank), both without special tokens. A text that is
    null, empty or doesn't come back from either tokenizer byte for byte has no tokens: zeros, and an empty
    groups_sha256. Rows repeat as they are, each counting in the corpus; null ids stay. An empty table gives an empty
    result. Other columns are ignored, whatever their names.

    Documents are dealt into chunks at random and written once so, since equal rows would meet in one chunk by a hash.
    """
    spark = docs.sparkSession
    runtime.small_batches(spark)
    n_chunks, n_buckets = sizes(total_bytes(docs))
    dealt = docs.select((F.rand() * n_chunks).cast("long").alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = runtime.written(dealt, "alignment")
    aligner = aligner_of(a_path, b_path)
    keys = dealt.select("chunk", "text").groupBy("chunk").applyInArrow(_emit(aligner, n_buckets), KEYS)
    reduced = runtime.written(keys.groupBy("bucket").applyInArrow(_reduce, REDUCED), "pair-counts")
    most = reduced.filter("kind = 'best'").select(F.explode(F.arrays_zip("b", "most")).alias("x")).groupBy("x.b").agg(F.max("x.most").alias("most"))
    # As many rows as the B vocabulary has, at most.
    rows = most.collect()
    best = np.zeros(max((r["b"] for r in rows), default=0) + 1, np.int64)
    best[[r["b"] for r in rows]] = [r["most"] for r in rows]
    replies = reduced.filter("kind = 'reply'").select("bucket", "chunk", "data")
    schema = RESULT + (", groups string" if with_groups else "")
    return dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_score(aligner, n_buckets, best, with_groups), schema)
