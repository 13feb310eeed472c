"""Operator 9, byte-level BPE encoding and decoding on length-bucketed padded numpy matrices.

A text is cut by the tokenizer's pattern; the distinct new pieces of a batch go into matrices by length (one row a
piece, one column a byte). In each round every row merges its leftmost pair of minimum rank, found through a hashed
pair table, and closes the gap; rows without a pair that merges leave the matrix. Very long rows stand alone and merge
all pairs of the minimum rank in a round, which comes to the same. Ranks are the token ids, so a pair
merges to its own rank. Decoding gathers the ids' bytes from one flat table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.runtime import small_batches
from tessera.llm.wordhash import spread

#: No merge.
NONE = np.int32(2**31 - 1)
#: A piece of more bytes than this is a row by itself.
LONG = 1024
#: Distinct pieces a worker remembers before it starts anew, and bytes of text it takes at a time.
REMEMBERED = 500_000
TEXT_BYTES = 1 << 20

_EMPTY = np.uint64(2**64 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

# Code points that are letters and numbers since Unicode 17, and neither for the tokenizers' libraries.
LATER_LETTERS = (
    "558-558 58B-58C 88F-88F C5C-C5C CDC-CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD "
    "A7E2-A7E2 A7F1-A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A 11DB0-11DDB "
    "11DF1-11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 "
    "18E00-19191 191A0-191D2 1B123-1B128 1B168-1B168 1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F "
    "2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
)
LATER_NUMBERS = "11DE0-11DE9 1246F-1246F 12475-1247F 12550-12686 16FF4-16FF6"

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PairTable:
    """Open addressing over arrays: (left id, right id) to the id both merge to."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.values = np.full(1 << self.bits, NONE)
        keys = np.array([a << 32 | b for a, b in pairs], dtype=np.uint64)
        values = np.array(list(pairs.values()), dtype=np.int32)
        slot = self._slot(keys)
        self.probes = 1
        while len(keys):
            free = self.keys[slot] == _EMPTY
            self.keys[slot[free]] = keys[free]  # of several for one slot the last one stays
            done = self.keys[slot] == keys
            self.values[slot[done]] = values[done]
            keys, values, slot = keys[~done], values[~done], (slot[~done] + 1) & (len(self.keys) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape = left.shape
        keys = (left.astype(np.uint64).ravel() << np.uint64(32)) | right.astype(np.uint64).ravel()
        slot = self._slot(keys)
        found = np.full(len(keys), NONE)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == keys
            found[open_[hit]] = self.values[slot[hit]]
            go = ~hit & (there != _EMPTY)
            if not go.any():
                break
            open_, keys, slot = open_[go], keys[go], (slot[go] + 1) & (len(self.keys) - 1)
        return found.reshape(shape)


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = PairTable(pairs)
        self.rising = all(r > a and r > b for (a, b), r in pairs.items())
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        self.token_len = np.array([len(t) for t in tokens], dtype=np.int64)
        self.token_at = np.r_[0, np.cumsum(self.token_len)[:-1]]
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = np.array([whole], dtype=np.int32)
            elif len(p) > LONG:
                out[i] = self._long(p)
            else:
                n = len(p)
                by_length.setdefault(n if n <= 16 else 1 << (n - 1).bit_length(), []).append(i)
        for width, rows in by_length.items():
            step = max(1, (1 << 21) // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out  # type: ignore[return-value]

    def _matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, width)
        lens = np.array([len(p) for p in pieces])
        columns = np.arange(width)
        ids = np.where(columns < lens[:, None], self.of_byte[raw], -1).astype(np.int32)
        rank = np.full(ids.shape, NONE)
        rank[:, :-1] = np.where(columns[1:] < lens[:, None], self.pairs.find(np.maximum(ids[:, :-1], 0), np.maximum(ids[:, 1:], 0)), NONE)
        rows = np.arange(len(pieces))
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        while True:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(at)), at]
            stuck = best == NONE
            if stuck.any():
                for r, i in zip(rows[stuck].tolist(), np.flatnonzero(stuck).tolist(), strict=True):
                    out[r] = ids[i, : lens[i]].copy()
                go = ~stuck
                ids, rank, rows, lens, at, best = ids[go], rank[go], rows[go], lens[go], at[go], best[go]
                if not len(rows):
                    return out
                most = int(lens.max())
                ids, rank = ids[:, :most], rank[:, :most]
            here = np.arange(len(rows))
            ids[here, at] = best
            shift = np.minimum(np.arange(ids.shape[1]) + (np.arange(ids.shape[1]) > at[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, shift, axis=1)
            rank = np.take_along_axis(rank, shift, axis=1)
            lens = lens - 1
            ids[here, lens] = -1
            rank[here, lens] = NONE
            for left in (at - 1, at):  # the pairs on both sides of the merged one are new
                ok = (left >= 0) & (left + 1 < lens)
                i, j = here[ok], left[ok]
                rank[i, j] = self.pairs.find(ids[i, j], ids[i, j + 1])
            gone = here[at + 1 >= lens]
            rank[gone, np.minimum(at[gone], ids.shape[1] - 1)] = NONE

    def _long(self, piece: bytes) -> np.ndarray:
        """A row by itself, without padding: where every merge has a higher rank than its parts, no merge of a round can
        make a pair of that rank or a lower one, so the round merges all pairs of the minimum rank, from the left."""
        ids = self.of_byte[np.frombuffer(piece, dtype=np.uint8)].copy()
        rank = self.pairs.find(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            if self.rising:
                nth = np.arange(len(at))
                first = np.r_[True, at[1:] != at[:-1] + 1]  # pairs that follow one another share an element
                at = at[(nth - np.maximum.accumulate(np.where(first, nth, 0))) % 2 == 0]
            else:
                at = at[:1]
            ids[at] = best
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            ids, rank, at = ids[stay], rank[stay[:-1]], place[at]
            rank = rank[: len(ids) - 1]
            new = np.unique(np.r_[at - 1, at])
            new = new[(new >= 0) & (new < len(rank))]
            rank[new] = self.pairs.find(ids[new], ids[new + 1])
        return ids

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after another."""
        return self.token_bytes[spread(self.token_at[ids], self.token_len[ids])]


class TextCoder:
    """Encodes texts piece by piece, remembering pieces that it has met."""

    def __init__(self, bpe: ByteBpe, pattern: str):
        import regex

        def ranges(text: str) -> str:
            return "".join(f"\\U{a:0>8}-\\U{b:0>8}" for a, b in (x.split("-") for x in text.split()))

        letters, numbers = ranges(LATER_LETTERS), ranges(LATER_NUMBERS)
        older = pattern.replace(r"\p{L}", rf"[\p{{L}}--[{letters}]]").replace(r"\p{N}", rf"[\p{{N}}--[{numbers}]]")
        self.bpe, self.find = bpe, regex.compile(pattern).findall
        self.later = regex.compile(f"[{letters}{numbers}]").search
        self.find_older = regex.compile(older, regex.V1).findall
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.written: list[str] = []
        self.ids = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def _pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.later(text):
                return self.find_older(text)
        return self.find(text)

    def _learn(self, new: list[str]) -> None:
        coded = self.bpe.encode_pieces([p.encode() for p in new])
        counts = np.array([len(x) for x in coded], dtype=np.int64)
        base = len(self.ids)
        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
        self.written += [",".join(map(str, x.tolist())) for x in coded]
        self.ids = np.concatenate([self.ids, *coded])
        self.start = np.r_[self.start, base + np.cumsum(counts) - counts]
        self.count = np.r_[self.count, counts]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts one after another, where each text's end, and each text's ids in decimal with commas."""
        if len(self.code) > REMEMBERED:
            self._forget()
        pieces = [self._pieces(t) for t in texts]
        new = set().union(*pieces).difference(self.code)
        if new:
            self._learn(sorted(new))
        codes = [np.fromiter(map(self.code.__getitem__, p), np.int64, len(p)) for p in pieces]
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        count = self.count[flat]
        ids = self.ids[spread(self.start[flat], count)]
        ends = np.r_[0, np.cumsum(count)][np.cumsum([len(p) for p in pieces], dtype=np.int64)] if texts else np.zeros(0, np.int64)
        written = [",".join([self.written[c] for c in x.tolist()]) for x in codes]
        return ids, ends, written


def coder_of(path: str, pattern: str) -> Callable[[], TextCoder]:
    """One coder a worker, made at its first batch."""
    made: list[TextCoder] = []

    def coder() -> TextCoder:
        if not made:
            made.append(TextCoder(ByteBpe.load(path), pattern))
        return made[0]

    return coder


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= TEXT_BYTES:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Token ids of every whole text by the ranks in `path` (.tiktoken), and the bytes they decode to.

    One row per input row: doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256; with_ids
    adds ids (array of int) and decoded (the text again). No special tokens. Nothing is shuffled.

    A null or empty text has no tokens and decodes to nothing. Ids are those of merging each piece by itself, whole
    pieces that are tokens first. Other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    coder = coder_of(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids_of = batch.column("text").to_pylist(), batch.column("doc_id")
            for i, j in _blocks(texts):
                c = coder()
                ids, ends, written = c.encode([t or "" for t in texts[i:j]])
                data = c.bpe.decode(ids)
                byte_ends = np.r_[0, np.cumsum(c.bpe.token_len[ids])][ends]
                starts, byte_starts = np.r_[0, ends[:-1]], np.r_[0, byte_ends[:-1]]
                decoded = [data[a:b].tobytes() for a, b in zip(byte_starts, byte_ends, strict=True)]
                columns = [
                    ids_of.slice(i, j - i),
                    pa.array(ends - starts, pa.int64()),
                    pa.array([hashlib.sha256(w.encode()).hexdigest() for w in written], pa.string()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
                ]
                if with_ids:
                    columns += [pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids, pa.int32())), pa.array([d.decode() for d in decoded], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = RESULT + (", ids array<int>, decoded string" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
