"""Vectorised words and rolling hashes over Arrow text columns (numpy, no loop over words).

Words are runs of bytes other than 0x20 and 0x09-0x0D, which is the same as on characters, since UTF-8 uses those
bytes for nothing else. A word's hash is a polynomial of its bytes in the field modulo 2**61 - 1: two different words
of at most L bytes agree for at most L of the field's bases, so with a base drawn at random (new_base) no text can aim
at a collision. A window's hash is a polynomial of its words' hashes, from prefix sums, and costs the same at any width.
"""

from __future__ import annotations

import ctypes
import secrets

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
PRIME = 2**61 - 1
P = U(PRIME)
#: The base where none is drawn.
BASE = 0x1A2B3C4D5E6F7081 % PRIME
#: Odd multipliers of two families of window hashes.
FAMILIES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Bytes hashed at a time.
BLOCK = 1 << 18
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_field: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def new_base() -> int:
    """A base for one job or index, to be handed to all of its tasks."""
    return (1 << 32) + secrets.randbelow(PRIME - (1 << 33))


def trim() -> None:
    """Gives memory back that a worker's allocators keep after a large group; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        size = 1 << (size - 1).bit_length()
        grown = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U)
            p[0] = 1
            grown.append(np.multiply.accumulate(p))
        have = _powers[base] = (grown[0], grown[1])
    return have[0][:n], have[1][:n]


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1, for x < 2**64."""
    x = (x & P) + (x >> U(61))
    return np.where(x >= P, x - P, x)


def times(a: np.ndarray, b: np.ndarray | U) -> np.ndarray:
    """a * b modulo 2**61 - 1, for reduced a and b."""
    low = U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> U(31), a & low, b >> U(31), b & low
    middle = a1 * b0 + a0 * b1
    return reduced((a1 * b1 << U(1)) + (middle >> U(30)) + ((middle & U((1 << 30) - 1)) << U(31)) + a0 * b0)


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    m = 1
    while m < n:
        out[m : 2 * m] = times(out[:m], U(pow(base, m, PRIME)))[: n - m]
        m *= 2
    return out


def field_powers(base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """High and low 32 bits of base**i, and base**-i, modulo 2**61 - 1 for i < 2 * BLOCK."""
    if base not in _field:
        if len(_field) > 2:
            _field.clear()
        up = _powers_of(base, 2 * BLOCK)
        _field[base] = (up >> U(32), up & U(2**32 - 1), _powers_of(pow(base, -1, PRIME), 2 * BLOCK))
    return _field[base]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each starts (n + 1 offsets). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """The words of some texts: doc (index of the text), start and end (byte positions), in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.space = IS_SPACE[data]
        inside = ~self.space
        first = inside.copy()
        first[1:] &= self.space[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[heads] = inside[heads]
        self.start = np.flatnonzero(first)
        lens = np.add.reduceat(inside.view(np.int8), self.start, dtype=np.int64) if len(self.start) else np.zeros(0, np.int64)
        self.end = self.start + lens
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.first_of = np.searchsorted(self.start, offsets)  # per text the index of its first word, and the end

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, base: int = BASE) -> np.ndarray:
        """By blocks of bytes, so that what is held besides the words does not grow with the texts nor with a word."""
        lens = self.end - self.start
        pieces = np.maximum(1, -(-lens // BLOCK))
        of = np.repeat(np.arange(len(self)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = self.start[of] + nth * BLOCK
        end = np.minimum(start + BLOCK, self.end[of])
        high_up, low_up, down = field_powers(base)
        out = np.empty(len(of), U)
        at = 0
        while at < len(of):
            to = int(np.searchsorted(start, start[at] + BLOCK))
            low, high = int(start[at]), int(end[to - 1])
            x = self.data[low:high].astype(U) + U(1)
            x[self.space[low:high]] = 0
            begins = start[at:to] - low
            parts = [reduced(np.add.reduceat(x * up[: high - low], begins)) for up in (high_up, low_up)]
            out[at:to] = times(reduced(times(parts[0], U(1 << 32)) + parts[1]), down[begins])
            at = to
        if len(of) > len(self):
            first = np.flatnonzero(nth == 0)
            for w in np.flatnonzero(pieces > 1).tolist():
                i = int(first[w])
                out[i] = U(sum(v * pow(base, k * BLOCK, PRIME) for k, v in enumerate(out[i : i + int(pieces[w])].tolist())) % PRIME)
            out = out[first]
        return mix(out)

    def windows(self, width: int, hashes: np.ndarray, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of width words inside one text."""
        n = len(self) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        up, down = powers(FAMILIES[family], len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, U)
        np.cumsum(hashes * up[:-1], out=sums[1:])
        at = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])
        return at, mix((sums[at + width] - sums[at]) * down[at])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0]+lengths[0]-1, starts[1] .. and so on."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    ends = np.cumsum(n)
    out[0] = s[0]
    out[ends[:-1]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)
