import itertools
import random

import numpy as np
import pytest
from test_llm import ODD, corpus, frame, prose  # noqa: F401

from linguaspan.llm import signature_trees


def expected(rows, threshold):
    """doc_id -> (class_id, n_links, n_copies), by comparing all pairs."""
    docs = {}
    for i, t in rows:
        ws = (t or "").split()
        if i is not None and ws:
            docs.setdefault(i, set()).add(frozenset(zip(*[ws[k:] for k in range(3)])) if len(ws) >= 3 else frozenset([tuple(ws)]))
    owners = {}
    for i, own in docs.items():
        for x in own:
            owners.setdefault(x, set()).add(i)
    links = {x: 0 for x in owners}
    near = {i: set() for i in docs}
    for ids in owners.values():
        for a, b in itertools.permutations(ids, 2):
            near[a].add(b)
    for x, y in itertools.combinations(owners, 2):
        if len(x & y) / len(x | y) >= threshold:
            links[x] += 1
            links[y] += 1
            for a, b in itertools.product(owners[x], owners[y]):
                near[a].add(b)
                near[b].add(a)
    out = {}
    for i in docs:
        seen, wait = {i}, [i]
        while wait:
            for b in near[wait.pop()] - seen:
                seen.add(b)
                wait.append(b)
        numbers = sum(links[x] for x in docs[i]), sum(len(owners[x]) - 1 for x in docs[i])
        if any(numbers):
            out[i] = (min(seen), *numbers)
    return out


@pytest.fixture(scope="module")
def rows(corpus):  # noqa: F811
    rng = random.Random(8)
    base = prose(rng, 120).split()
    near = [" ".join(w if rng.random() > 0.04 else "zz" + str(rng.random()) for w in base) for _ in range(60)]
    near += [" ".join(base[: 20 + 5 * k]) for k in range(20)]
    half = [[f"w{k}" for k in range(12)], [f"w{k}" for k in range(8)]]  # 10 and 6 grams: 0.6
    tie = [[f"t{k}" for k in range(12)], [f"t{k}" for k in range(7)]]  # 10 and 5 grams: exactly 0.5
    return corpus + [(100 + k, t) for k, t in enumerate([*near, *map(" ".join, half + tie)])] + [(100, near[0]), (7, near[3])]


@pytest.mark.parametrize("limits", [{}, {"group_sets": 5, "group_grams": 700}])
def test_classes_equal_brute_force(spark, rows, limits):
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in signature_trees.classes(frame(spark, rows), 0.5, 3, 32, 2, **limits).collect()}
    assert got == expected(rows, 0.5)


def test_one_of_each_class_stays(spark, rows):
    want = expected(rows, 0.5)
    kept = signature_trees.one_of_each(frame(spark, rows), 0.5)
    assert kept.columns == ODD.replace(",", "").split()[::2]
    assert sorted(str(r[0]) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in want or want[i][0] == i)


def test_inner_nodes_prune(capsys):
    rng = np.random.default_rng(7)
    base = [rng.integers(0, 2**63, 200, dtype=np.uint64) for _ in range(64)]
    sets = [np.unique(np.where(rng.random(200) < 0.1, rng.integers(0, 2**63, 200, dtype=np.uint64), base[k % 64])) for k in range(2048)]
    sizes = np.array([len(s) for s in sets])
    marks = [signature_trees.signature(s, w) for s, w in zip(sets, signature_trees.width_of(sizes).tolist())]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    rank = np.array([[k % 64] for k in range(2048)])
    tested: dict[int, int] = {}
    found = [set(zip(a.tolist(), b.tolist())) for a, b in signature_trees.unit_pairs(sizes, marks, rank, np.zeros(2048, int), 0.5, tested)]
    got = {tuple(sorted(p)) for f in found for p in f}
    a, b = np.triu_indices(2048, 1)
    same = a % 64 == b % 64
    value = signature_trees.exact(np.concatenate(sets), bounds, a[same], b[same])
    want = {(int(x), int(y)) for x, y in zip(a[same][value >= 0.5], b[same][value >= 0.5])}
    assert want <= got and len(got) < 1.1 * len(want)
    assert tested[0] < 0.2 * len(a)  # four fifths of the leaf pairs went with inner nodes
    sides = 1 + np.arange(2048) % 2
    dual = {tuple(sorted(p)) for x, y in signature_trees.unit_pairs(sizes, marks, rank, sides, 0.5) for p in zip(x.tolist(), y.tolist())}
    assert {p for p in want if sides[p[0]] != sides[p[1]]} <= dual


def test_jaccard_by_bitmaps_equals_that_by_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 90)).astype(np.uint64)) for _ in range(60)]
    flat, bounds = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    a, b = np.triu_indices(60, 1)
    want = [len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) for i, j in zip(a, b)]
    signature_trees.HOT_BITS = 64  # the others are compared as sets
    assert np.allclose(signature_trees.exact(flat, bounds, a, b), want) and np.allclose(signature_trees.exact(flat, bounds, a[:9], b[:9]), want[:9])
    signature_trees.HOT_BITS = 2048
