import math
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from linguaspan.functions import kernels as K

word = st.sampled_from("abcd")
sentence = st.lists(word, max_size=8)


def test_lcs_length_of_three():
    assert len(K.lcs("a b c d".split(), "a c d".split())) == 3


@settings(max_examples=100, deadline=None)
@given(sentence, sentence)
def test_lcs_is_a_common_subsequence(a, b):
    pairs = K.lcs(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=10), st.booleans(), st.booleans())
def test_groups_partition_both_sides(links, by_source, consecutive):
    got = K.groups(6, 6, links, by_source, consecutive)
    assert sorted(i for s, _ in got for i in s) == list(range(6))
    assert sorted(j for _, t in got for j in t) == list(range(6))


@settings(max_examples=100, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 4), st.integers(0, 4)), max_size=8))
def test_phrases_have_no_outgoing_link(links):
    for a, b, c, d in K.phrases(5, 5, sorted(links), 7):
        inside = [(a <= s <= b, c <= t <= d) for s, t in links]
        assert all(x == y for x, y in inside) and any(x for x, _ in inside)


def test_ribes_of_equal_sentences():
    assert math.isclose(K.ribes("a b c d".split(), "a b c d".split()), 1.0)
    assert K.ribes([], ["a"]) == 0.0
    assert K.ribes("d c b a".split(), "a b c d".split()) == 0.0


def test_packing_keeps_the_best_next_to_the_sentence():
    got = K.pack([(0.9, ["x"], ["X"]), (0.5, ["y"], ["Y"])], ["s"], ["t"], n=2)
    assert got == [("⸨sep⸩ y ⸨sep⸩ x ⸨cur⸩ s", "⸨sep⸩ Y ⸨sep⸩ X ⸨cur⸩", "⸨sep⸩ Y ⸨sep⸩ X ⸨cur⸩ t")]
    assert K.pack([], ["s"], ["t"]) == [("s", "", "t")]


def test_gaps_restore_the_sentence():
    words = [f"w{i}" for i in range(12)]
    got = K.gaps(words, 7)
    parts = [p.split() for p in got["filled"].split("｟gap｠")[1:-1]]
    out = []
    for w in got["with_gaps"].split():
        out += parts.pop(0) if w == "｟gap｠" else [w]
    assert out == words and 1 <= got["n_gaps"] <= 5


def test_features_over_joiners():
    assert K.joined_features("this is un example .".split(), "S S S R S".split(), "this is un exa ￭mple .".split()) == "S S S R R S".split()


def test_byte_pairs_equal_counting_anew():
    rng = random.Random(4)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))): rng.randint(1, 9) for _ in range(150)} | {"aaaaa": 7, "ababab": 3}
    parts, want = {w: list(w) for w in words}, []
    for _ in range(400):
        n = Counter()
        for w, p in parts.items():
            for x in zip(p, p[1:]):
                n[x] += words[w]
        if not n:
            break
        best = min(n, key=lambda x: (-n[x], x))
        want.append((*best, n[best]))
        for w, p in parts.items():
            out = []
            for c in p:
                if out and out[-1] == (best[0], 0) and c == best[1]:
                    out[-1] = ("".join(best), 1)
                else:
                    out.append((c, 0))
            parts[w] = [c for c, _ in out]
    assert list(K.byte_pairs(words.items(), 400)) == want and len(want) > 100
