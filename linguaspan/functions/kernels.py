"""Row kernels in Python, for what column expressions can't say: alignments with backtrace, graph closure, packing, RIBES.

Most are plain functions of lists; `arrow` makes an Arrow UDF of one, so rows travel in Arrow batches.
"""

from __future__ import annotations

import difflib
import math
import random
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from .merges import byte_pairs  # noqa: F401


AT_A_TIME = 64  # rows that are Python objects at a time


def arrow(f: Callable, returns: str) -> Callable:
    """A column function: f once a row; a null argument gives null. A struct (from f as a dict) travels in an array of one. Of a batch only a few rows at a time are Python objects."""
    packed = returns.startswith("struct")
    returns = f"array<{returns}>" if packed else returns
    kind = to_arrow_type(_parse_datatype_string(returns))

    def run(*columns: pa.Array) -> pa.Array:
        parts = [pa.array([], kind)]
        for at in range(0, len(columns[0]), AT_A_TIME):
            rows = zip(*[c.slice(at, AT_A_TIME).to_pylist() for c in columns])
            found = (None if any(x is None for x in r) else f(*r) for r in rows)
            parts.append(pa.array([[v] if packed and v is not None else v for v in found], kind))
        return pa.concat_arrays(parts)

    udf = F.arrow_udf(run, returns)
    return (lambda *columns: F.get(udf(*columns), F.lit(0))) if packed else udf


def equal_links(a: pa.Array, b: pa.Array) -> pa.Array:
    """For each row of two arrays of token lists: links (s, t) between tokens that are equal in lower case, in order."""
    size = lambda x: np.asarray(pc.fill_null(pc.list_value_length(x), 0), np.int64)
    (n_a, n_b), (x, y) = (size(a), size(b)), (pc.utf8_lower(c.flatten()) for c in (a, b))
    codes = pa.concat_arrays([x, y]).dictionary_encode()
    row_a, row_b = (np.repeat(np.arange(len(n)), n) for n in (n_a, n_b))
    place = lambda n: np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    key = np.asarray(codes.indices, np.int64) + np.concatenate([row_a, row_b]) * max(1, len(codes.dictionary))
    key_a, key_b = key[: len(x)], key[len(x) :]
    by = np.argsort(key_b, kind="stable")
    low, high = (np.searchsorted(key_b[by], key_a, side) for side in ("left", "right"))
    n = high - low
    t = place(n_b)[by[place(n) + np.repeat(low, n)]]
    links = pa.StructArray.from_arrays([pa.array(np.repeat(place(n_a), n), pa.int32()), pa.array(t, pa.int32())], names=["s", "t"])
    ends = np.concatenate([[0], np.cumsum(np.bincount(row_a, n, len(a)).astype(np.int64))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), links, mask=pc.or_(a.is_null(), b.is_null()))


def lcs(x: Sequence, y: Sequence) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence; on equal lengths the step back is along x only if that is strictly longer."""
    n, m = len(x), len(y)
    size = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        row, up = size[i + 1], size[i]
        for j in range(m):
            row[j + 1] = up[j] + 1 if x[i] == y[j] else max(up[j + 1], row[j])
    out, i, j = [], n, m
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif size[i - 1][j] > size[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def ratio(a: Sequence, b: Sequence) -> float:
    """2 * matches / total length; 1 for two empty sequences."""
    return 2 * len(lcs(a, b)) / (len(a) + len(b)) if len(a) or len(b) else 1.0


def related(a: Sequence[str], b: Sequence[str]) -> list[bool]:
    """Which tokens of a are in the common subsequence with b, case folded."""
    hit = {i for i, _ in lcs([w.casefold() for w in a], [w.casefold() for w in b])}
    return [i in hit for i in range(len(a))]


def lowered(words: Sequence[str]) -> list[str]:
    """Lower case letter by letter, as SQL's lower has it: ß stays, and a sigma is σ anywhere."""
    return pc.utf8_lower(pa.array(words, pa.string())).to_pylist()


def mask_unrelated(a: Sequence[str], b: Sequence[str], mark: str = "✖", fold: bool | Callable = True) -> dict:
    """fold: case folded, as in the reference; or by a function of a list of words; or not at all."""
    folded = fold if callable(fold) else (lambda x: [w.casefold() for w in x]) if fold else list
    pairs = lcs(folded(a), folded(b))
    one, two = {i for i, _ in pairs}, {j for _, j in pairs}
    total = len(a) + len(b)
    return {"ratio": 2 * len(pairs) / total if total else 1.0, "a": [w if i in one else mark for i, w in enumerate(a)], "b": [w if j in two else mark for j, w in enumerate(b)]}


def longest_run(a: Sequence[str], b: Sequence[str]) -> tuple[int, int, int]:
    """(begin in a, begin in b, length) of the longest common contiguous run; the earliest in a, then in b."""
    m = difflib.SequenceMatcher(None, list(a), list(b), autojunk=False).find_longest_match(0, len(a), 0, len(b))
    return m.a, m.b, m.size


def groups(n_s: int, n_t: int, links: Sequence[tuple[int, int]], by_source: bool = True, consecutive: bool = False) -> list[tuple[list[int], list[int]]]:
    """Connected components of an alignment, by the first word of the driving side; then the other side's words without a link.

    consecutive: holes on the driving side are filled, and the closure goes on from there.
    """
    n, m = (n_s, n_t) if by_source else (n_t, n_s)
    to: list[set[int]] = [set() for _ in range(n)]
    back: list[set[int]] = [set() for _ in range(m)]
    for s, t in links:
        a, b = (s, t) if by_source else (t, s)
        if 0 <= a < n and 0 <= b < m:
            to[a].add(b)
            back[b].add(a)
    seen, out = set(), []
    for first in range(n):
        if first in seen:
            continue
        mine, other, wait = set(), set(), [first]
        while wait:
            a = wait.pop()
            if a in mine:
                continue
            mine.add(a)
            for b in to[a] - other:
                other.add(b)
                wait += back[b] - mine
            if consecutive:
                wait += set(range(min(mine), max(mine) + 1)) - mine
        # filling a hole may reach a group that came before
        for old in [g for g in out if not (g[0].isdisjoint(mine) and g[1].isdisjoint(other))] if consecutive else ():
            out.remove(old)
            mine |= old[0]
            other |= old[1]
        seen |= mine
        out.append((mine, other))
    out = sorted((sorted(mine), sorted(other)) for mine, other in out)
    linked = {b for _, other in out for b in other}
    out += [([], [b]) for b in range(m) if b not in linked]
    return out if by_source else [(t, s) for s, t in out]


def unfold(src: Sequence[str], tgt: Sequence[str], links: Sequence, by_source: bool = True, consecutive: bool = False) -> list[str]:
    """Groups as `i．w＿i．w‖j．w`."""
    show = lambda at, words: "＿".join(f"{i}．{words[i]}" for i in at)
    return [f"{show(s, src)}‖{show(t, tgt)}" for s, t in groups(len(src), len(tgt), [(p["s"], p["t"]) for p in links], by_source, consecutive)]


def span_groups(n_s: int, n_t: int, links: Sequence[tuple[int, int]], begin: int, end: int) -> list[tuple[list[int], list[int]]]:
    """The groups of the source span [begin, end); none if one of them leaves it."""
    own = [g for g in groups(n_s, n_t, links) if any(begin <= s < end for s in g[0])]
    return own if all(begin <= s < end for g in own for s in g[0]) else []


def span_targets(links: Sequence[tuple[int, int]], begin: int, end: int) -> list[int]:
    """Targets of a source span, if none of these has a link outside the span."""
    own = {t for s, t in links if begin <= s < end}
    return sorted(own) if all(begin <= s < end for s, t in links if t in own) else []


def phrases(n_s: int, n_t: int, links: Sequence[tuple[int, int]], longest: int = 7) -> list[tuple[int, int, int, int]]:
    """Consistent phrase pairs (s begin, s end, t begin, t end), ends inclusive, of at most `longest` words a side before the extension over unaligned border words."""
    return sorted(p for box in phrase_boxes(n_s, n_t, links, longest) for p in product(*(range(a, b + 1) for a, b in zip(box[::2], box[1::2]))))


def phrase_boxes(n_s: int, n_t: int, links: Sequence[tuple[int, int]], longest: int = 7) -> list[tuple[int, ...]]:
    """The phrase pairs as boxes: first and last s begin, s end, t begin and t end. Each box has linked words at the borders of its core, so no two share a phrase pair."""
    to: list[list[int]] = [[] for _ in range(n_s)]
    low, high = [n_s] * n_t, [-1] * n_t  # of each target word, the first and the last source word
    for i, j in links:
        if 0 <= i < n_s and 0 <= j < n_t:
            to[i].append(j)
            low[j], high[j] = min(low[j], i), max(high[j], i)
    free_s, free_t = [not x for x in to], [h < 0 for h in high]
    before_s, after_s, before_t, after_t = ([0] * (n + 1) for n in (n_s, n_s, n_t, n_t))  # how many free words stand before and after each place
    for free, before, after in ((free_s, before_s, after_s), (free_t, before_t, after_t)):
        for k, f in enumerate(free):
            before[k + 1] = before[k] + 1 if f else 0
        for k in range(len(free) - 1, -1, -1):
            after[k] = after[k + 1] + 1 if free[k] else 0
    out = []
    for a in range(n_s):
        if not to[a]:
            continue
        c, d = n_t, -1
        for b in range(a, min(n_s, a + longest)):
            if not to[b]:
                continue
            c, d = min(c, *to[b]), max(d, *to[b])
            if d - c >= longest:
                break
            if min(low[c : d + 1]) < a:
                break  # a longer span doesn't mend that
            if max(high[c : d + 1]) > b:
                continue
            out.append((a - before_s[a], a, b, b + after_s[b + 1], c - before_t[c], c, d, d + after_t[d + 1]))
    return out


def unboxed(boxes: Sequence[tuple[int, ...]], most: int) -> Iterator[np.ndarray]:
    """The phrase pairs of boxes as four rows of numbers, at most so many at a time."""
    box = np.array(boxes, np.int64).reshape(-1, 4, 2)
    size = box[:, :, 1] - box[:, :, 0] + 1
    ends = np.cumsum(size.prod(1))
    for lo in range(0, int(ends[-1]) if len(ends) else 0, most):
        at = np.arange(lo, min(lo + most, int(ends[-1])))
        k = np.searchsorted(ends, at, "right")
        at -= ends[k] - size[k].prod(1)
        out = np.empty((4, len(at)), np.int64)
        for d in (3, 2, 1, 0):
            out[d] = box[k, d, 0] + at % size[k, d]
            at //= size[k, d]
        yield out


def complete_tuples(n_s: int, n_t: int, links: Sequence[tuple[int, int]], matched: set[int]) -> list[tuple[list[int], list[int]]]:
    """Groups closed over their whole spans of which all source words are matched."""
    return [g for g in groups(n_s, n_t, links, True, True) if g[0] and g[1] and set(g[0]) <= matched]


def pack(examples: Sequence[tuple[float, list[str], list[str]]], src: list[str], tgt: list[str], n: int = 999, total: int = 999, each: int = 999, single: bool = False, inference: bool = False, prime: bool = True, cur: str = "⸨cur⸩", sep: str = "⸨sep⸩", tags: Callable[[float], str] | None = None) -> list[tuple[str, str, str]]:
    """(source, prefix, target) examples: similar pairs packed in front of the current one, the best next to it.

    examples: best first. Each packing takes up to n pairs whose side is `each` tokens at most while the whole stays within `total`; what is
    left over makes further examples (unless single or inference). Nothing that fits: the bare pair. prime: both sides get the similar
    pair; else the source gets its target side only, and the target just its mark.
    """
    left, out = list(examples), []
    while True:
        taken, rest, size_s, size_t = [], [], len(src) + 1, len(tgt) + 1
        for e in left:
            a = e[1] if prime else e[2]
            b = e[2] if prime else []
            if len(taken) < n and max(len(a), len(b)) <= each and size_s + len(a) + 1 <= total and size_t + len(b) + (1 if prime else 0) <= total:
                taken.append(e)
                size_s, size_t = size_s + len(a) + 1, size_t + len(b) + (1 if prime else 0)
            else:
                rest.append(e)
        if not taken:
            return out or [(" ".join(src), "", " ".join(tgt))]
        mark = lambda e: tags(e[0]) if tags else sep
        one = [w for e in reversed(taken) for w in [mark(e), *(e[1] if prime else e[2])]]
        two = [w for e in reversed(taken) for w in [mark(e), *e[2]]] if prime else []
        out.append((" ".join([*one, cur, *src]), " ".join([*two, cur]), " ".join([*two, cur, *tgt])))
        if single or inference or len(rest) == len(left) or not rest:
            return out
        left = rest


def contexts(matches: Sequence[tuple[float, str, str]], most: int = 1, characters: int = 100, inference: bool = False) -> list[list[int]]:
    """Packs of match positions, by falling score: a source or target seen before is dropped; a pack closes at `most` matches or once over so many characters."""
    order = sorted(range(len(matches)), key=lambda i: -matches[i][0])
    seen_s, seen_t, packs, now, size = set(), set(), [], [], 0
    for i in order:
        _, s, t = matches[i]
        if s in seen_s or t in seen_t:
            continue
        seen_s.add(s)
        seen_t.add(t)
        now.append(i)
        size += len(s)
        if len(now) >= most or size > characters:
            packs.append(now)
            now, size = [], 0
    if now:
        packs.append(now)
    return packs[:1] if inference else packs


def gaps(words: Sequence[str], seed: int, least: int = 1, most: int = 5, longest: int = 5, share: float = 0.5, gap: str = "｟gap｠", tries: int = 5) -> dict | None:
    """A sentence with spans replaced by a mark, and the spans; none if `least` gaps can't be placed."""
    rng = random.Random(seed)
    n = len(words)
    for _ in range(tries):
        spans: list[tuple[int, int]] = []
        want = rng.randint(least, most) if most >= least else least
        choice = [(a, a + k) for a in range(n) for k in range(1, longest + 1) if a + k <= n]
        rng.shuffle(choice)
        for a, b in choice:
            if len(spans) == want:
                break
            if all(b < c or a > d for c, d in spans) and sum(y - x for x, y in spans) + b - a <= share * n:
                spans.append((a, b))
        if len(spans) >= least:
            spans.sort()
            out, at = [], 0
            for a, b in spans:
                out += [*words[at:a], gap]
                at = b
            filled = [w for a, b in spans for w in [gap, *words[a:b]]] + [gap]
            return {"with_gaps": " ".join([*out, *words[at:]]), "filled": " ".join(filled), "n_gaps": len(spans), "n_words": sum(b - a for a, b in spans)}
    return None


class _Runs:
    """How often each run of k words occurs, and where first; counted once for each k."""

    def __init__(self, words: Sequence[str]):
        self.words, self.by_size = list(words), {}

    def unique(self, part: tuple) -> int:
        """Where the run stands if it occurs once, else -1."""
        k = len(part)
        if k not in self.by_size:
            seen: dict[tuple, int] = {}
            for i in range(len(self.words) - k + 1):
                key = tuple(self.words[i : i + k])
                seen[key] = -1 if key in seen else i
            self.by_size[k] = seen
        return self.by_size[k].get(part, -1)


def ribes(hyp: Sequence[str], ref: Sequence[str], alpha: float = 0.25, beta: float = 0.10) -> float:
    """Rank correlation of words mapped by unique context, times precision and brevity."""
    if not hyp or not ref:
        return 0.0
    order, known, one, two = [], set(ref), _Runs(hyp), _Runs(ref)
    for i, w in enumerate(hyp):
        if w not in known:
            continue
        for k in range(max(i, len(hyp) - i) + 1):
            at = -1
            for a, b, inner in ((i - k, i + 1, k), (i, i + k + 1, 0))[: 2 if k else 1]:  # wider to the left, then to the right
                if a >= 0 and b <= len(hyp):
                    part = tuple(hyp[a:b])
                    if one.unique(part) >= 0 and (at := two.unique(part)) >= 0:
                        at += inner
                        break
            if at >= 0:
                order.append(at)
                break
            if k >= len(ref):
                break
    n = len(order)
    if n == 1 and len(ref) == 1:
        tau = 1.0
    elif n < 2:
        return 0.0
    else:
        tau = sum(order[i] < order[j] for i in range(n) for j in range(i + 1, n)) / (n * (n - 1) / 2)
    brevity = min(1.0, math.exp(1 - len(ref) / len(hyp)))
    return tau * (n / len(hyp)) ** alpha * brevity**beta


def link_table(src: Sequence[str], tgt: Sequence[str], links: Sequence) -> str:
    """An HTML table with a row for each source word and a mark for each link."""
    from html import escape

    have: dict[int, set[int]] = {}
    for p in links:
        have.setdefault(p["s"], set()).add(p["t"])
    head = "<tr><th></th>" + "".join(f"<th>{escape(w, False)}</th>" for w in tgt) + "</tr>"
    cells = lambda own: "".join("<td>■</td>" if j in own else "<td></td>" for j in range(len(tgt))) if own else "<td></td>" * len(tgt)
    return "<table>" + head + "".join(f"<tr><th>{escape(w, False)}</th>" + cells(have.get(i)) + "</tr>" for i, w in enumerate(src)) + "</table>"


def joined_features(words: Sequence[str], tags: Sequence[str], pieces: Sequence[str], joiner: str = "￭") -> list[str]:
    """Each piece's word's tag: a piece begins a new word unless it or the one before it carries a joiner there."""
    out, at = [], -1
    for i, p in enumerate(pieces):
        if not (i and (p.startswith(joiner) or pieces[i - 1].endswith(joiner))):
            at += 1
        out.append(tags[min(at, len(tags) - 1)] if tags else "-")
    return out


def subsequences(word: str, least: int = 1, most: int = 2) -> list[str]:
    """Ordered choices of `least` to `most` characters, for acronyms; as in the reference, single characters always, and the empty choice if least is 0."""
    from itertools import combinations

    return sorted({"".join(c) for k in {1, *range(max(least, 0), most + 1)} for c in combinations(word, k)})


def word_diff(hyp: Sequence[str], ref: Sequence[str], colour: str = "red") -> str:
    """The hypothesis in HTML, with what isn't in the common subsequence highlighted."""
    from html import escape

    hit = {i for i, _ in lcs(hyp, ref)}
    return " ".join(escape(w) if i in hit else f'<span style="color:{colour}">{escape(w)}</span>' for i, w in enumerate(hyp))
