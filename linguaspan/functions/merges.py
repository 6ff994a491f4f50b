"""Byte-pair merges over whole arrays: words are numbers of symbols in one array, 0 before and after each word.

A character's number is its code point and 1; symbols that merges make are numbered from FIRST.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np

FIRST = 0x110001
BITS = 31  # a pair's code is its left number shifted by these, and its right one


def numbered(text: str, sizes: np.ndarray) -> np.ndarray:
    """The array of words of these sizes, given as one text."""
    out = np.zeros(len(text) + len(sizes) + 1, np.int32)
    place = np.ones(len(out), bool)
    place[np.concatenate([[0], np.cumsum(sizes + 1)])] = False
    out[place] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32) + 1
    return out


def sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, rising, and the sum of each one's weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys)
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begin], np.add.reduceat(weights[order], begin)


def codes(syms: np.ndarray) -> np.ndarray:
    """The code of each place's symbol and the next; 0 where one of them is the 0 between words."""
    left, right = syms[:-1].astype(np.int64), syms[1:].astype(np.int64)
    return np.where((left > 0) & (right > 0), left << BITS | right, 0)


def pair_counts(syms: np.ndarray, freqs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of neighbours in words with frequencies, and how often they are there."""
    pair = codes(syms)
    there = np.flatnonzero(pair)
    return sums(pair[there], freqs[np.cumsum(syms == 0)[there] - 1])


def chains(syms: np.ndarray, freqs: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest parts of words in which every two neighbours are one of the common pairs (codes, rising): their symbols one after another, each part's size and frequency."""
    pair = codes(syms)
    joined = np.concatenate([[False], common[np.minimum(np.searchsorted(common, pair), len(common) - 1)] == pair, [False]])
    first = np.flatnonzero(joined[1:] & ~joined[:-1])
    sizes = np.flatnonzero(~joined[1:] & joined[:-1]) - first + 1
    return syms[joined[1:] | joined[:-1]], sizes, freqs[np.cumsum(syms == 0)[first] - 1]


class Chained:
    """Words whose neighbours can be merged; the places of each symbol are kept."""

    def __init__(self, syms: np.ndarray):
        self.syms = syms
        self.next, self.prev = np.arange(1, len(syms) + 1, dtype=np.int32), np.arange(-1, len(syms) - 1, dtype=np.int32)
        order = np.argsort(syms, kind="stable").astype(np.int32)
        begin = np.flatnonzero(np.concatenate([[True], np.diff(syms[order]) != 0])) if len(syms) else []
        self.at = {int(syms[order[b]]): order[b:e] for b, e in zip(begin, [*begin[1:], len(syms)])}

    def found(self, left: int, right: int) -> np.ndarray:
        """Places of a pair, those that overlap left out from the left; the fewer of both symbols' places are looked through."""
        a, b = self.at.get(left), self.at.get(right)
        if a is None or b is None:
            return np.zeros(0, np.int32)
        if len(a) <= len(b):
            a = self.at[left] = a[self.syms[a] == left]
            p = a[self.syms[self.next[a]] == right]
        else:
            b = self.at[right] = b[self.syms[b] == right]
            p = self.prev[b]
            p = p[self.syms[p] == left]
        if left == right and len(p):
            p = np.sort(p)
            run = np.concatenate([[True], self.next[p[:-1]] != p[1:]])
            each = np.arange(len(p))
            p = p[(each - np.maximum.accumulate(np.where(run, each, 0))) % 2 == 0]
        return p

    def merge(self, p: np.ndarray, new: int) -> None:
        """Make the symbols at these places and their next ones one."""
        q = self.next[p]
        r = self.next[q]
        self.syms[p], self.syms[q] = new, -1
        self.next[p], self.prev[r] = r, p
        self.at[new] = p

    def left(self) -> np.ndarray:
        """The array of the words as they are now."""
        return self.syms[self.syms >= 0]


def applied(syms: np.ndarray, merges: Iterable[tuple[int, int, int]]) -> np.ndarray:
    """The words after merges (left, right, new), one after another."""
    words = Chained(syms.copy())
    for left, right, new in merges:
        if len(p := words.found(left, right)):
            words.merge(p, new)
    return words.left()


def learnt(syms: np.ndarray, freqs: np.ndarray, most: int, least: int, made: list[str]) -> Iterator[tuple[int, int, int]]:
    """Up to `most` further merges (left, right, n), each of a pair that is there n >= least times; made: names of the symbols from FIRST on, which grows.

    A symbol is always made of the same two: what stands between two borders that no merge has crossed is merged without regard to what is around it. So a pair's
    count only falls once both its symbols are there, and pairs under `least` need not be kept.
    """
    word = np.cumsum(syms == 0, dtype=np.int32) - 1
    pair, n = pair_counts(syms, freqs)
    counts = dict(zip(pair[n >= least].tolist(), n[n >= least].tolist()))
    words, mask = Chained(syms), (1 << BITS) - 1
    name = lambda k: made[k - FIRST] if k >= FIRST else chr(k - 1)
    entry = lambda p: (-counts[p], name(p >> BITS), name(p & mask), p)
    heap = [entry(p) for p in counts]
    heapify(heap)
    while heap and most > 0:
        n, a, b, pair = heappop(heap)
        now = counts.get(pair, 0)
        if now != -n:  # counts that fell are corrected when they come up
            if now:
                heappush(heap, entry(pair))
            continue
        left, right = pair >> BITS, pair & mask
        yield left, right, now
        most -= 1
        new = FIRST + len(made)
        made.append(a + b)
        del counts[pair]
        p = words.found(left, right)
        q = words.next[p]
        r = words.next[q]
        before, after, f = words.syms[words.prev[p]], words.syms[r], freqs[word[p]]
        words.merge(p, new)
        last = words.syms[r] != new  # else that border is one before a merged pair
        for code, lost in ((lambda k: k << BITS | left, sums(before, f)), (lambda k: right << BITS | k, sums(after[last], f[last]))):
            for k, d in zip(*(x.tolist() for x in lost)):
                if (c := counts.get(code(k))) is not None:
                    if c - d >= least:
                        counts[code(k)] = c - d
                    else:
                        del counts[code(k)]
        for code, (keys, got) in ((lambda k: k << BITS | new, sums(words.syms[words.prev[p]], f)), (lambda k: new << BITS | k, sums(after[last], f[last]))):
            common = (got >= least) & (keys > 0)
            for k, d in zip(keys[common].tolist(), got[common].tolist()):
                counts[code(k)] = d
                heappush(heap, entry(code(k)))


def byte_pairs(words: Iterable[tuple[str, int]], symbols: int, least: int = 1) -> Iterator[tuple[str, str, int]]:
    """Up to `symbols` merges (left, right, n) of words with frequencies: each time the most frequent pair of neighbours, of equal ones the first by its strings."""
    words = [(w, n) for w, n in words if len(w) > 1]
    made: list[str] = []
    name = lambda k: made[k - FIRST] if k >= FIRST else chr(k - 1)
    syms = numbered("".join(w for w, _ in words), np.array([len(w) for w, _ in words], np.int64))
    for left, right, n in learnt(syms, np.array([n for _, n in words], np.int64), symbols, max(least, 1), made):
        yield name(left), name(right), n
