"""Vectorised text kernels on Arrow buffers.

A batch of texts is one UTF-8 byte buffer plus offsets. Tokens, their 64-bit
hashes and k-word shingles are found with whole-array numpy operations, so no
Python loop runs over characters or words. Work goes on in slices of about
``SLICE`` bytes, which bounds the temporary arrays whatever the batch size; a
text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
U64 = np.uint64
_rng = np.random.default_rng(20240607)
#: A random 64-bit value for each byte, and the base of the polynomial word hash.
BYTE_VALUE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = int(_rng.integers(2**62, 2**63)) | 1
BASE_INVERSE = pow(BASE, -1, 2**64)
MIX = _rng.integers(0, 2**63, 8, dtype=np.uint64) * U64(2) + U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The separators of the word pattern [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE + 1)
        for key, base in (("up", BASE), ("down", BASE_INVERSE)):
            p = np.full(size, U64(base))
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
        have = _powers["up"]
    return have[:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, min(int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1, n, lo + 50_000))
        yield lo, hi
        lo = hi


def runs(data: np.ndarray, off: np.ndarray, inside: np.ndarray, cls: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that are inside (and of one class); runs end with their text."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off[:-1][off[:-1] < n]] = True
    edge[n] = True
    if cls is not None:
        edge[1:n] |= cls[1:] != cls[:-1]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte range: a polynomial prefix hash, finalised."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    value = BYTE_VALUE[LOWER] if lower else BYTE_VALUE
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(value[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * MIX[0])


def words(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of a slice, and where each text's words begin."""
    starts, ends = runs(data, off, ~SPACE[data])
    return run_hashes(data, starts, ends, lower), np.searchsorted(starts, off)


def shingle_sets(hashes: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each text; fewer words: the whole sequence as one; none: empty."""
    n = len(hashes)
    if n >= k:
        rolled = np.zeros(n - k + 1, U64)
        for i in range(k):
            rolled += hashes[i : n - k + 1 + i] * MIX[1 + i % 7] ** U64(1 + i // 7)
        rolled = mix(rolled)
    out = []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= k:
            own = np.sort(rolled[lo : hi - k + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]] if len(own) > 1 else own)
        elif hi > lo:
            h = np.array([hi - lo], U64)
            for i in range(lo, hi):
                h = mix(h * MIX[0] + hashes[i : i + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, U64))
    return out
