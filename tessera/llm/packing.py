"""Packed integers for what travels between tasks: bytes by place, as many as the largest needs, the top ones compressed.

The low bytes of hashes and gaps are as good as random; the top two places are not, and cost what they tell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessera.llm.wordhash import U

_LENGTHS = 4


def pack(x: np.ndarray) -> bytes:
    """Unsigned 64-bit integers, in order."""
    n, width = len(x), max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    places = np.ascontiguousarray(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    out = [bytes([width]), n.to_bytes(_LENGTHS, "little")]
    for place in places[-2:]:
        raw = place.tobytes()
        small = pa.compress(raw, codec="zstd", asbytes=True) if n else raw
        small = small if len(small) < n else raw
        out += [len(small).to_bytes(_LENGTHS, "little"), small]
    return b"".join([*out, places[:-2].tobytes()])


def unpack(raw: bytes) -> np.ndarray:
    width, n, at = raw[0], int.from_bytes(raw[1 : 1 + _LENGTHS], "little"), 1 + _LENGTHS
    out = np.zeros((n, 8), np.uint8)
    for place in range(max(0, width - 2), width):
        size = int.from_bytes(raw[at : at + _LENGTHS], "little")
        part = raw[at + _LENGTHS : at + _LENGTHS + size]
        at += _LENGTHS + size
        out[:, place] = np.frombuffer(part if size == n else pa.decompress(part, n, codec="zstd", asbytes=True), np.uint8)
    if width > 2:
        out[:, : width - 2] = np.frombuffer(raw, np.uint8, offset=at).reshape(width - 2, n).T
    return out.view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit integers as the first one and the gaps."""
    return keys[:1].tobytes() + pack(np.diff(keys)) if len(keys) else b""


def unpack_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, U)
    return np.cumsum(np.r_[np.frombuffer(raw, U, 1), unpack(raw[8:])], dtype=U)


def pack_ids(ids: np.ndarray) -> bytes:
    """int64 ids, in any order, as the least one and what is above it."""
    if not len(ids):
        return b""
    low = ids.min()
    return low.tobytes() + pack(ids.astype(U) - U(int(low) & (2**64 - 1)))


def unpack_ids(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    return (unpack(raw[8:]) + np.frombuffer(raw, U, 1)[0]).astype(np.int64)
