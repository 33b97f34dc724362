"""Vectorised kernels over the UTF-8 bytes of whole texts.

All of them take a run of texts as one byte buffer and its offsets, as Arrow
stores them, and keep memory in proportion to :data:`CHUNK` (or to one text,
if that is longer).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
CHUNK = 1 << 19

U = np.uint64
_RNG = np.random.default_rng(20240229)
#: A random 64-bit name for each byte.
BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
#: ASCII white space: space, \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The name of a pair of names."""
    z = x * U(0xD6E8FEB86659FD93)
    z += y
    z ^= z >> U(32)
    z *= U(0x9FB21C651E98DF25)
    z ^= z >> U(29)
    return z


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK):
    """Slices of a batch, each with at most ``limit`` bytes in ``column`` or with one row."""
    _, offs = texts(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = j


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if _POWERS.get("up", np.zeros(0)).size < n:
        size = max(n, CHUNK + 1)
        for k, b in (("up", BASE), ("down", BASE_INVERSE)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_names(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of ``codes[start:end]`` for all spans, from one prefix sum."""
    up, down = powers(codes.size + 1)
    total = np.zeros(codes.size + 1, np.uint64)
    np.cumsum(codes * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(raw: np.ndarray, offs: np.ndarray, inside: np.ndarray | None = None):
    """Start, end and text number of each maximal run of word bytes (by default, of all but white space)."""
    inside = ~SPACE[raw] if inside is None else inside
    edge = np.zeros(raw.size + 1, bool)
    edge[offs] = True
    before = np.empty(raw.size, bool)
    if raw.size:
        before[0] = True
        before[1:] = ~inside[:-1]
        before |= edge[:-1]
        after = np.empty(raw.size, bool)
        after[-1] = True
        after[:-1] = ~inside[1:]
        after |= edge[1:]
        starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(offs, starts, "right") - 1
