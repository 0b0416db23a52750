"""Array helpers over the bytes of an Arrow text column: words and 64-bit hashes.

A text chunk is one flat byte array plus document offsets, so one numpy call
serves many documents. Hashes are polynomial over a random byte table, mixed to
64 bits; two different strings share one with a chance near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240229))
TABLE = _rng.integers(1, 2**64, 256, dtype=U, endpoint=False)
LOWER_TABLE = TABLE.copy()
LOWER_TABLE[65:91] = TABLE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class _Cache(dict):
    """What a process has computed; it isn't sent to others."""

    def __reduce__(self):
        return dict, ()


_pow = _Cache()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2**64, for n positions at least."""
    if _pow.get("n", 0) < n:
        size = max(n, 1 << 16)
        for key, b in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            x = np.full(size, b, U)
            x[0] = 1
            _pow[key] = np.cumprod(x, dtype=U)
        _pow["n"] = size
    return _pow["up"], _pow["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix_hash(data: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """h with (h[e] - h[s]) * down[s] the hash of bytes s to e."""
    h = np.zeros(len(data) + 1, U)
    np.cumsum(table[data] * powers(len(data) + 1)[0][: len(data)], out=h[1:])
    return h


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, buf = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents of about `most` bytes: first row, last row, bytes, offsets. No text is split."""
    data, off = flat(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space), and per document the first word's index."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = LOWER_TABLE) -> np.ndarray:
    h = prefix_hash(data, table)
    return mix((h[ends] - h[starts]) * powers(len(data) + 1)[1][starts])


_SHINGLE = mix(np.arange(1, 65, dtype=U))


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its n-word shingles; a shorter text is one shingle as a whole."""
    starts, ends, first = words(data, off)
    w = word_hashes(data, starts, ends)
    at = max(0, len(w) - n + 1)
    rolled = np.zeros(at, U)
    for k in range(n):
        rolled += mix(w[k : k + at] ^ _SHINGLE[k])
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            short = np.zeros(1, U)
            for k in range(b - a):
                short += mix(w[a + k : a + k + 1] ^ _SHINGLE[k])
            out.append(mix(short + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out
