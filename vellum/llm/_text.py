"""Byte-level text primitives shared by the operators of this subpackage.

Everything here works on whole Arrow string columns cut into slices of a bounded
number of bytes: one uint8 buffer with document offsets, on which words, rolling
hashes and shingles are computed with numpy instead of a Python loop per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 18
_M1, _M2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x *= _M1
    x ^= x >> U(33)
    x *= _M2
    x ^= x >> U(33)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers that depend on the seed only."""
    return mix((np.arange(n, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15) + U(seed * 0xD1B54A32D192ED03 % (1 << 64))) | U(1)


BASE = 0x9E6C63D0676A9A99
_INVERSE = pow(BASE, -1, 1 << 64)
_BYTE = constants(256, 11)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), U(BASE if kind == "up" else _INVERSE))
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


class Prefixes:
    """Polynomial prefix hashes modulo 2**64 of a byte buffer; hash of any span in O(1)."""

    def __init__(self, buf: np.ndarray):
        self.h = np.zeros(len(buf) + 1, U)
        np.cumsum(_BYTE[buf] * _power("up", len(buf)), out=self.h[1:])
        self.inverse = _power("down", len(buf) + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.h[end] - self.h[start]) * self.inverse[start]


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of rows in them) of a string or binary column; null counts as empty.

    A slice holds at most ``limit`` bytes unless a single row is longer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    column = pc.fill_null(column, b"")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice: byte span, document and 64-bit hash of each."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.buf = _LOWER[buf] if lower else buf
        self.offs = offs
        inside = ~_SPACE[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[offs] = True
        before = np.zeros(len(buf), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(buf), bool)
        after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & ~(before & ~edge[:-1]))
        self.end = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
        self.doc = np.searchsorted(offs, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, offs)

    def hashes(self) -> np.ndarray:
        p = Prefixes(self.buf)
        return mix(p.spans(self.start, self.end) + (self.end - self.start).astype(U) * U(0xA0761D6478BD642F))


_STEP = constants(8, 23)


def shingles(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words of one document; of all its words if there are fewer, of none if it has none."""
    if not len(w):
        return np.zeros(0, U)
    if len(w) < k:
        return shingles(w, len(w)) * U(3) + U(len(w))
    m = len(w) - k + 1
    out = np.zeros(m, U)
    for i in range(k):
        out += w[i : i + m] * _STEP[i % 8] * U(2 * (i // 8) + 1)
    return mix(out)


def crc32_le(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
