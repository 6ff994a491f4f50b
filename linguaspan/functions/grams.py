"""N-grams of whole batches, by Arrow's own string functions: for tables whose rows of n-grams would be many times the text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import MASK

WORDS = 1 << 19  # words that are joined at a time, so that no string array comes near its bound


def portions(lists: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a list array, of about WORDS words together, and where each begins; a longer row is a slice of its own."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64))
    a = 0
    while a < len(lists):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + WORDS, "right")))
        yield a, lists.slice(a, b - a)
        a = b


def word_ngrams(lists: pa.Array, n: int, most_masks: int = -1) -> tuple[np.ndarray, pa.Array]:
    """Row and text of each n-gram, joined by blanks, of lists of words; those with more than most_masks masks are left out (-1: none is)."""
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64))
    count = len(flat) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), pa.array([], pa.string())
    ok = row[:count] == row[n - 1 :]
    if most_masks >= 0:
        masks = np.concatenate([[0], np.cumsum(np.asarray(pc.equal(flat, MASK)).astype(np.int64))])
        ok &= masks[n:] - masks[:-n] <= most_masks
    keep = pa.array(ok)
    parts = [flat.slice(j, count).filter(keep) for j in range(n)]
    return row[:count][ok], pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]


def masked(lists: pa.Array) -> pa.Array:
    """Lists of words in which numbers and punctuation are a mask; each different word is looked at once."""
    flat = lists.flatten().dictionary_encode()
    known = flat.dictionary
    number = pc.and_(pc.match_substring_regex(known, r"^[0-9]*\.?[0-9]*$"), pc.match_substring_regex(known, "[0-9]"))
    known = pc.if_else(pc.or_(number, pc.match_substring_regex(known, r"^[!-/:-@\[-`{-~]*$")), MASK, known)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), known.take(flat.indices))


def counted(rows: np.ndarray, grams: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each different (row, n-gram) and how often it stands there."""
    codes = grams.dictionary_encode()
    size = max(1, len(codes.dictionary))
    key, n = np.unique(rows * size + np.asarray(codes.indices, np.int64), return_counts=True)
    return key // size, codes.dictionary.take(pa.array(key % size)), n


def clipped(hyp: Sequence, refs: Sequence[Sequence], n: int) -> tuple[int, int, int]:
    """N-grams of the hypothesis that a reference has, each at most as often as the reference that has it most; all of the hypothesis; all of the references."""
    grams = (lambda x: Counter(x[i : i + n] for i in range(len(x) - n + 1))) if isinstance(hyp, str) else (lambda x: Counter(zip(*[x[k:] for k in range(n)])))
    own, most, total = grams(hyp), Counter(), 0
    for r in refs:
        most |= grams(r)
        total += max(0, len(r) - n + 1)
    return sum((own & most).values()), max(0, len(hyp) - n + 1), total
