"""Vectorised text kernels over Arrow buffers: words, word hashes, n-grams and content-defined anchors.

Words are maximal runs of bytes that are not ASCII white space, so they never depend on a locale. All
hashes are 64-bit polynomials in fixed random tables, finished by a mixer: equal on every machine and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
BYTE = np.random.Generator(np.random.PCG64(20240611)).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
BASE, GRAM = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64: every bit of the result depends on every bit of x."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each text starts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if where else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), offsets


def portions(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together; a longer text is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of words before each text; data[offsets[0]:offsets[-1]] is read."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    solid = np.zeros(hi - lo + 2, dtype=bool)
    solid[1:-1] = ~WHITE[data[lo:hi]]
    cut = np.zeros(hi - lo + 2, dtype=bool)
    cut[offsets - lo + 1] = True  # a text starts here, whatever stands before it
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[1:-1])) + lo
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[2:])) + lo + 1
    return starts, ends, np.searchsorted(starts, offsets)


_power = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_power[0]) < n:
        size = max(1024, 1 << int(n - 1).bit_length())
        x = np.full(size, BASE, np.uint64)
        x[0] = 1
        _power[0] = np.cumprod(x, dtype=np.uint64)
    return _power[0]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    at = place + np.repeat(starts, size)
    return mix(np.add.reduceat(BYTE[data[at]] * _powers(int(size.max()))[place], first))


def gram_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n tokens, also of those that span two texts: mask these by inside()."""
    if len(tokens) < n:
        return np.zeros(0, np.uint64)
    total, power, done, block, size = None, 1, 0, tokens, 1
    step = int(GRAM)
    left = n
    while left:
        if left & 1:
            part = block[done : done + len(tokens) - n + 1]
            total = part.copy() if total is None else total + part * U(power)
            power, done = power * step % 2**64, done + size
        left >>= 1
        if left:
            block = block[: len(block) - size] + block[size:] * U(step)
            step, size = step * step % 2**64, size * 2
    return mix(total)


def inside(bounds: np.ndarray, n: int) -> np.ndarray:
    """Of each run of n tokens, whether it lies in one text; bounds: number of tokens before each text."""
    total = int(bounds[-1] - bounds[0])
    if total < n:
        return np.zeros(0, bool)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return text[: total - n + 1] == text[n - 1 :]


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    if len(x) < n:
        return x[:0]
    size, block = 1, x
    while size * 2 <= n:
        block = np.minimum(block[:-size], block[size:])
        size *= 2
    return block if size == n else np.minimum(block[: len(x) - n + 1], block[n - size : n - size + len(x) - n + 1])


def anchors(tokens: np.ndarray, bounds: np.ndarray, length: int, short: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers: runs of `length` tokens whose least `short`-gram stands first or last.

    The choice depends on the run's own tokens only, so every copy of a chosen run is chosen too. Of any
    length - short neighbouring runs of one text at least one is chosen, so any passage of 2 * length - short - 1
    tokens holds one.
    """
    ok = inside(bounds, length)
    if not len(ok):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    small = gram_hashes(tokens, short)
    span = length - short
    least = sliding_min(small, span + 1)
    n = len(ok)
    at = np.flatnonzero(ok & ((small[:n] == least) | (small[span : span + n] == least)))
    return at, gram_hashes(tokens, length)[at]


def plain(docs, *names: str):
    """docs under names that can't clash: its columns of these exact names keep them, all others are numbered. toDF(*docs.columns) undoes it."""
    first = {n: docs.columns.index(n) for n in names if n in docs.columns}
    return docs.toDF(*[c if first.get(c) == i else f"_c{i}" for i, c in enumerate(docs.columns)])
